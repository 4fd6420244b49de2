"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

A text is prefixed with a space mark and its spaces become space marks. No piece of a model may hold a space mark after another
character (checked when it is loaded), so the best segmentation splits exactly before each run of space marks; these units are
solved once per task and remembered. Within a unit the automaton reports, at each position, all pieces that end there by
following output links; each relaxes the best score at its end. The segmentation with the largest sum of the model's piece
scores wins; ties go to the longer last piece. A character that no piece covers costs less than every piece and becomes its
UTF-8 bytes. Decoding concatenates pieces, joins byte pieces and turns space marks back.

The sum is maximised whatever the kind of the model; for a model trained by merges this is not its merge order. Control and
unknown pieces are never produced and decode to nothing.

Defined cases: null and empty texts have no ids and decode to the empty text; a literal space mark in a text is spelt in bytes,
so decoding gives every text back; texts of any length are encoded whole; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.llm.common import Recent, kept_in_worker, map_batches, numbered

SPACE = "▁"
_SPELT = (-1, 1)
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Units of one generation of the cache; it holds two.
CACHED_UNITS = 500_000


class Codec:
    """Ids (little-endian unsigned 32 bits) of texts; the ids of units are found on first use and remembered."""

    def __init__(self, path: str):
        self.units = Recent(self.solve, CACHED_UNITS)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.shown: list[str | None] = [""] * size
        self.bytes_of, self.byte_id = {}, [None] * 256
        self.automaton, least = ahocorasick.Automaton(), 0.0
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.shown[i], self.bytes_of[i] = None, bytes([int(piece[1:-1], 16)])
                self.byte_id[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {i} holds a space mark after another character")
                self.shown[i] = piece.replace(SPACE, " ")
                score = model.get_score(i)
                least = min(least, score)
                self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.spelt = least - 10.0
        if None in self.byte_id:
            raise ValueError("the model has no byte pieces")

    def segment(self, unit: str) -> list[int]:
        """The best ids of one unit."""
        n, spelt = len(unit), self.spelt
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        at = 0  # places up to here have a score; a character on which no piece ends is spelt
        for end, (i, size, score) in self.automaton.iter(unit):
            end += 1
            while at < end:
                best[at + 1] = best[at] + spelt
                at += 1
            total = best[end - size] + score
            if total > best[end] or (total == best[end] and size > (back[end] or _SPELT)[1]):
                best[end], back[end] = total, (i, size)
        out: list[int] = []
        at = n
        while at:
            i, size = back[at] or _SPELT
            out += [i] if i >= 0 else [self.byte_id[b] for b in reversed(unit[at - 1].encode("utf-8", "surrogatepass"))]
            at -= size
        return out[::-1]

    def solve(self, unit: str) -> bytes:
        return struct.pack(f"<{len(found := self.segment(unit))}I", *found)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if SPACE not in text:
            return b"".join([self.units[u] for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))])
        literal = np.array([self.byte_id[b] for b in SPACE.encode()], dtype="<u4").tobytes()
        first, *more = (p.replace(" ", SPACE) for p in text.split(SPACE))
        return literal.join(b"".join([self.units[u] for u in _UNIT.findall(p)]) for p in (SPACE + first, *more))

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        try:
            text = "".join(map(self.shown.__getitem__, numbers))
        except TypeError:  # a byte piece has no text of its own
            shown, spelt = self.shown, self.bytes_of
            text = b"".join([spelt[i] if i in spelt else shown[i].encode() for i in numbers]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def codec(path: str) -> Codec:
    return kept_in_worker("sentencepiece", path, lambda: Codec(path))


def model_path(path: str | None) -> str:
    return path or public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: rid, doc_id, text, ids (little-endian unsigned 32 bits)."""
    path = model_path(path)

    def step(batch: pa.RecordBatch) -> dict:
        it = codec(path)
        return {"rid": batch["rid"], "doc_id": batch["doc_id"], "text": batch["text"], "ids": pa.array([it.encode(t or "") for t in batch["text"].to_pylist()], pa.binary())}

    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, step, "rid long, doc_id long, text string, ids binary")


def encode_checked(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: rid, doc_id, ids, and whether decoding them gives the text back; one pass, in one worker per task."""
    path = model_path(path)

    def step(batch: pa.RecordBatch) -> dict:
        it, ids, same = codec(path), [], []
        for text in batch["text"].to_pylist():
            ids.append(it.encode(text or ""))
            same.append(it.decode(ids[-1]) == (text or ""))
        return {"rid": batch["rid"], "doc_id": batch["doc_id"], "ids": pa.array(ids, pa.binary()), "round_trip": pa.array(same, pa.bool_())}

    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, step, "rid long, doc_id long, ids binary, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with the text its ids spell as ``decoded``."""
    path = model_path(path)

    def step(batch: pa.RecordBatch) -> dict:
        it = codec(path)
        return {"rid": batch["rid"], "doc_id": batch["doc_id"], "text": batch["text"], "ids": batch["ids"], "decoded": pa.array([it.decode(x or b"") for x in batch["ids"].to_pylist()], pa.string())}

    return map_batches(encoded.select("rid", "doc_id", "text", "ids"), step, "rid long, doc_id long, text string, ids binary, decoded string")
