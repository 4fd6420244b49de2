"""Substring deduplication with suffix automata over shards of repeated passages.

A word is removed when it lies in a window of ``WINDOW`` words whose word sequence also starts earlier (smaller ``doc_id``, or
the same document and an earlier start). Windows are judged on the input.

Automata of a whole corpus can neither be broadcast nor each be streamed against every document, so reference shards are
chosen by content, and each automaton is built and streamed in the task that owns its shard:

1. **Anchors.** A window's anchor is the smallest hash of the ``GRAM``-word sequences in it, so equal windows have equal anchors.
   Consecutive windows with one anchor are a run. Places of anchors are counted (partial sums first); a run whose anchor
   has one place in the corpus holds no repeated window. Only (anchor, row) pairs are shuffled here.
2. **Texts** are joined once to their repeated anchors and written as a table bucketed by row, which later steps join without
   moving the texts again.
3. **Runs** of repeated anchors are collapsed by content: the first of equal runs stands for all, the others are repeated as a whole.
4. **Automata.** The distinct runs of one anchor are a reference shard. They are streamed in corpus order through one suffix
   automaton; its matching statistic at each word (length of the longest suffix that occurred before) marks windows of
   ``WINDOW`` words that started earlier; then the run itself becomes part of the automaton.
5. An anchor with very many distinct runs (a passage in much of the corpus) would make one shard large: its runs are cut into
   single windows, each its own shard, of which only the first of each slice of texts is passed on; a run is then repeated but for
   the windows that are the first of their shard in the corpus.
6. Covered words of all windows are united per row and removed.

Defined cases: null and empty texts have no words; texts of fewer than ``WINDOW`` words lose none; rows that share a ``doc_id`` are ordered
as they are read, null ids first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.llm.common import U64, bounded, map_batches, mixed, numbered, rolled, signed, span_hashes, stored, texts_as_bytes, with_row_id
from gustfront.session import scratch_path

WINDOW, GRAM = 20, 6
LONGEST_RUN, MANY_RUNS = 1 << 10, 500
#: Bytes of text whose words and runs are held as arrays at once; the arrays take about thirty times as much.
SLICE = 1 << 18


def split_words(text: bytes) -> list[bytes]:
    return text.split()  # at space and 0x09 to 0x0D


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of every window, from the word hashes."""
    grams = rolled(hashes, GRAM)
    width = WINDOW - GRAM + 1
    if len(grams) < width:
        return np.zeros(0, dtype=U64)
    low, reach = grams, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    return np.minimum(low[: len(low) - (width - reach)], low[width - reach :]) if width > reach else low


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of several texts in one array of hashes, so that few array operations serve many texts."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join(texts)
        edges = np.diff(np.concatenate([[True], _SPACE[np.frombuffer(data, dtype=np.uint8)], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.hashes = span_hashes(data, starts, ends)
        self.first = np.searchsorted(starts, begins)  # of each text, and one past the last
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))


def runs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, size in windows, anchor, whether the anchor has several places in it) of every run, none longer than ``LONGEST_RUN``.

    Starts count from the first word of all texts. Only a run whose anchor has several places can hold a window twice.
    """
    marks, row = anchors(words.hashes), words.row
    count = len(marks)
    none = np.zeros(0, dtype=np.int64)
    if not count:
        return none, none, none.astype(U64), none.astype(bool)
    inside = row[:count] == row[WINDOW - 1 :]
    change = np.flatnonzero(np.concatenate([[True], (marks[1:] != marks[:-1]) | (row[1:count] != row[: count - 1]) | (inside[1:] != inside[:-1])]))
    sizes = np.diff(np.concatenate([change, [count]]))
    starts, sizes = change[inside[change]], sizes[inside[change]]
    # A place holds an anchor if one of the windows over it has its value; anchors follow each other as their runs do.
    grams, width = rolled(words.hashes, GRAM), WINDOW - GRAM + 1
    over = np.concatenate([np.zeros(width - 1, dtype=U64), np.where(inside, marks, U64(0)), np.zeros(width - 1, dtype=U64)])
    reach = 1
    while 2 * reach <= width:
        over = np.maximum(over[:-reach], over[reach:])
        reach *= 2
    over = np.maximum(over[: len(over) - (width - reach)], over[width - reach :]) if width > reach else over
    places = np.flatnonzero((over[: len(grams)] == grams) & (row[: len(grams)] == row[GRAM - 1 :]))
    fresh = np.flatnonzero(np.concatenate([[True], (grams[places[1:]] != grams[places[:-1]]) | (row[places[1:]] != row[places[:-1]])])) if len(places) else none
    several = np.diff(np.concatenate([fresh, [len(places)]])) > 1
    if len(several) != len(starts):
        several = np.ones(len(starts), dtype=bool)
    if len(sizes) and sizes.max() > LONGEST_RUN:
        cut = [(s + k, min(LONGEST_RUN, n - k), o) for s, n, o in zip(starts.tolist(), sizes.tolist(), several.tolist(), strict=True) for k in range(0, n, LONGEST_RUN)]
        starts, sizes, several = np.array([c[0] for c in cut]), np.array([c[1] for c in cut]), np.array([c[2] for c in cut])
    return starts, sizes, marks[starts], several


class SuffixAutomaton:
    """Generalised suffix automaton over word hashes, built online."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _add(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _clone(self, state: int, parent: int, word: int) -> int:
        copy = self._add(self.length[parent] + 1, dict(self.next[state]), self.link[state])
        self.link[state] = copy
        while parent >= 0 and self.next[parent].get(word) == state:
            self.next[parent][word] = copy
            parent = self.link[parent]
        return copy

    def extend(self, last: int, word: int) -> tuple[int, int]:
        """Append ``word`` to the text that ends in state ``last``: the new state, and the matching statistic there,
        the length of the longest suffix that had occurred before."""
        if word in self.next[last]:
            state = self.next[last][word]
            if self.length[state] != self.length[last] + 1:
                state = self._clone(state, last, word)
            return state, self.length[last] + 1
        new, parent = self._add(self.length[last] + 1, {}, 0), last
        while parent >= 0 and word not in self.next[parent]:
            self.next[parent][word] = new
            parent = self.link[parent]
        if parent < 0:
            return new, 0
        state = self.next[parent][word]
        if self.length[state] != self.length[parent] + 1:
            state = self._clone(state, parent, word)
        self.link[new] = state
        return new, self.length[state]

    def stream(self, words: list[int]) -> list[int]:
        """Matching statistics of one text against all before it (and its own earlier part), which then joins them."""
        last, out = 0, []
        for word in words:
            last, matched = self.extend(last, word)
            out.append(matched)
        return out


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """(rid, anchors): each row's anchors that have two places or more in the corpus."""

    def step(batch: pa.RecordBatch) -> dict:
        words = Words(texts_as_bytes(batch["text"]))
        starts, _, marks, several = runs(words)
        times = 1 + several
        return {"anchor": signed(np.repeat(marks, times)), "rid": np.repeat(batch["rid"].to_numpy()[words.row[starts]], times)}

    seen = map_batches(rows.select("rid", "text"), step, "anchor long, rid long", SLICE)
    often = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    return seen.join(often, "anchor").groupBy("rid").agg(F.collect_set("anchor").alias("anchors"))


def bucketed_texts(rows: DataFrame) -> DataFrame:
    """rid, doc_id, n_words, kept_sha256 if nothing is removed, and, for rows with repeated anchors, text and anchors; bucketed by rid."""
    spark = rows.sparkSession

    def step(batch: pa.RecordBatch) -> dict:
        texts = texts_as_bytes(batch["text"])
        words = [split_words(t) for t in texts]
        whole = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
        needed = pa.array([t if has else None for t, has in zip(texts, batch["anchors"].is_valid().to_pylist(), strict=True)], pa.binary())
        return {"rid": batch["rid"], "doc_id": batch["doc_id"], "n_words": pa.array(map(len, words), pa.int64()), "whole": whole, "text": needed.cast(pa.string()), "anchors": batch["anchors"]}

    every = map_batches(rows.join(repeated_anchors(rows), "rid", "left").select("rid", "doc_id", "text", "anchors"), step, "rid long, doc_id long, n_words long, whole string, text string, anchors array<bigint>", SLICE)
    name = f"gustfront_substring_{uuid.uuid4().hex}"
    every.write.option("path", scratch_path(spark, "substring-texts")).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "rid").saveAsTable(name)
    return spark.table(name)


def repeated_runs(texts: DataFrame) -> DataFrame:
    """anchor, content hash, doc_id, rid, start, size of every run whose anchor is repeated."""

    def step(batch: pa.RecordBatch) -> dict:
        words = Words(texts_as_bytes(batch["text"]))
        starts, sizes, marks, several = runs(words)
        row, lists = words.row[starts], batch["anchors"]
        # (text, anchor) pairs that are repeated, as one number each
        salt = mixed(np.arange(1, batch.num_rows + 1, dtype=U64))
        wanted = lists.flatten().to_numpy().view(U64) ^ np.repeat(salt, lists.value_lengths().to_numpy())
        keep = np.isin(marks ^ salt[row], wanted)
        starts, sizes, marks, several, row = starts[keep], sizes[keep], marks[keep], several[keep], row[keep]
        # A run's content is the sum of window * (2 * place in the run + 1), wherever the run lies.
        windows = rolled(words.hashes, WINDOW)
        sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(windows * (np.arange(len(windows), dtype=U64) * U64(2) + U64(1)))])
        plain = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(windows)])
        ends = starts + sizes
        content = (sums[ends] - sums[starts]) - U64(2) * starts.astype(U64) * (plain[ends] - plain[starts])
        take = pa.array(row)
        return {
            "anchor": signed(marks), "content": signed(content ^ (sizes.astype(U64) << U64(1))), "doc_id": batch["doc_id"].take(take), "rid": batch["rid"].take(take),
            "start": (starts - words.first[row]).astype(np.int32), "size": sizes.astype(np.int32), "own": several.astype(bool),
        }

    return map_batches(texts.where("anchors is not null").select("rid", "doc_id", "text", "anchors"), step, "anchor long, content long, doc_id long, rid long, start int, size int, own boolean", SLICE)


def words_of(pieces: DataFrame, texts: DataFrame) -> DataFrame:
    """``pieces`` (rid, anchor, start, size, many) with their word hashes; where ``many``, cut into single windows.

    Of equal windows of a slice of texts only the first is given, so a passage of much of the corpus gives a row a slice.
    """
    wanted = pieces.groupBy("rid").agg(F.collect_list(F.struct("anchor", "start", "size", "many")).alias("pieces"))

    def step(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("shard", "many", "doc_id", "rid", "start", "piece", "words")}
        words_ = Words(texts_as_bytes(batch["text"]))
        every = signed(rolled(words_.hashes, WINDOW))
        docs, rids = batch["doc_id"].to_pylist(), batch["rid"].to_pylist()
        order = sorted(range(batch.num_rows), key=lambda k: (docs[k] is not None, docs[k] or 0, rids[k]))
        cut: list[tuple[int, int, int]] = []  # row, first word and size of the pieces that are cut, in corpus order
        for k, pieces_ in ((k, batch["pieces"][k].as_py()) for k in order):
            at = int(words_.first[k])
            for p in sorted(pieces_, key=lambda p: p["start"]):
                if p["many"]:
                    cut.append((k, p["start"], p["size"]))
                    continue
                words = words_.hashes[at + p["start"] : at + p["start"] + p["size"] + WINDOW - 1].tobytes()
                for name, value in (("shard", p["anchor"]), ("many", False), ("doc_id", docs[k]), ("rid", rids[k]), ("start", p["start"]), ("piece", p["start"]), ("words", words)):
                    out[name].append(value)
        if cut:
            row, start, size = (np.array(x, dtype=np.int64) for x in zip(*cut, strict=True))
            of = np.repeat(np.arange(len(cut)), size)
            place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of]
            shards, first = np.unique(every[words_.first[row[of]] + place], return_index=True)
            kept, places = row[of[first]].tolist(), place[first].tolist()
            out["shard"] += shards.tolist()
            out["many"] += [True] * len(first)
            out["doc_id"] += [docs[k] for k in kept]
            out["rid"] += [rids[k] for k in kept]
            out["start"] += places
            out["piece"] += start[of[first]].tolist()
            out["words"] += [b""] * len(first)
        types = {"many": pa.bool_(), "start": pa.int32(), "piece": pa.int32(), "words": pa.binary()}
        return {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}

    joined = texts.select("rid", "doc_id", "text").join(wanted, "rid")
    return map_batches(joined, step, "shard long, many boolean, doc_id long, rid long, start int, piece int, words binary", SLICE)


def matched(ordered: DataFrame) -> DataFrame:
    """(rid, start, size): repeated windows of runs that come ordered by shard and corpus order, one automaton per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, SuffixAutomaton()
        for whole in batches:
            for batch in bounded(whole):
                out: list[tuple[int, int, int]] = []
                for this, rid, start, words in zip(*(batch[c].to_pylist() for c in ("shard", "rid", "start", "words")), strict=True):
                    if this != shard:
                        shard, automaton = this, SuffixAutomaton()
                    statistics = np.array(automaton.stream(np.frombuffer(words, dtype=U64).tolist())[WINDOW - 1 :]) >= WINDOW
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], statistics.astype(np.int8), [0]])))
                    out += [(rid, start + a, b - a) for a, b in edges.reshape(-1, 2).tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=["rid", "start", "size"])

    return ordered.mapInArrow(run, "rid long, start int, size int")


def not_first(windows: DataFrame, parts: int) -> DataFrame:
    """The windows (rid, start) that another one of their shard precedes, dealt into ``parts``; ``after_first`` gives them as stretches.

    The first windows are partial minima before anything moves, so a shard of any size is no group in one task.
    """
    firsts = windows.groupBy("shard").agg(F.min(F.struct("doc_id", "rid", "start")).alias("w")).select("shard", "w.rid", "w.start")
    return windows.select("shard", "rid", "start").repartition(parts, "shard", "rid", "start").join(firsts, ["shard", "rid", "start"], "left_anti").select("rid", "start")


def after_first(pieces: DataFrame, windows: DataFrame) -> DataFrame:
    """(rid, start, size): stretches of ``pieces`` (rid, start, size) without the windows that are the first of their shard.

    ``windows`` (shard, doc_id, rid, start, piece) holds at least the first window of every shard, so the rest of a piece
    is told by what it leaves out and no repeated window is a row of its own.
    """
    firsts = windows.groupBy("shard").agg(F.min(F.struct("doc_id", "rid", "start", "piece")).alias("w"))
    left_out = firsts.groupBy(F.col("w.rid").alias("rid"), F.col("w.piece").alias("start")).agg(F.sort_array(F.collect_list("w.start")).alias("out"))
    met = pieces.join(left_out, ["rid", "start"], "left").withColumn("end", F.col("start") + F.col("size"))
    edges = F.concat(F.array(F.col("start") - 1), F.coalesce("out", F.array().cast("array<int>")), F.array("end"))
    gaps = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("size")))
    return met.select("rid", F.explode(F.filter(gaps, lambda g: g["size"] > 0)).alias("g")).select("rid", F.col("g.start").cast("int").alias("start"), F.col("g.size").cast("int").alias("size"))


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(rid, start, size): stretches of windows that also start earlier."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.struct("doc_id", "rid", "start")
    every = stored(repeated_runs(texts), "runs")
    firsts = every.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "rid", "start", "size", "own")).alias("first"), F.count(F.lit(1)).alias("n"))
    copies = every.join(firsts.where("n > 1").select("anchor", "content", "first"), ["anchor", "content"]).where(~place.eqNullSafe(F.struct("first.doc_id", "first.rid", "first.start"))).select("rid", "start", "size")
    kinds = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    pieces = firsts.join(kinds, "anchor", "left").where((F.col("kinds") > 1) | F.col("first.own")).select("first.rid", "anchor", "first.start", "first.size", (F.coalesce("kinds", F.lit(1)) > MANY_RUNS).alias("many"))
    pieces = stored(pieces, "chosen")
    words = stored(words_of(pieces, texts), "pieces")
    shards = words.where("not many").select("shard", "doc_id", "rid", "start", "words").repartition(parts, "shard").sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "rid", "start")
    later = after_first(pieces.where("many").select("rid", "start", "size"), words.where("many"))
    return copies.union(matched(shards)).union(later)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: rid, doc_id, n_words, n_removed, kept_sha256, and kept (the words that stay, joined; null if all stay)."""
    named, row = with_row_id(docs)
    rows = numbered(named, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rid=row)
    texts = bucketed_texts(rows)
    spans = repeated_windows(texts).groupBy("rid").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    def step(batch: pa.RecordBatch) -> dict:
        removed, sha, kept = [], [], []
        for text, spans_, whole in zip(texts_as_bytes(batch["text"]), batch["spans"].to_pylist(), batch["whole"].to_pylist(), strict=True):
            if not spans_:
                removed.append(0), sha.append(whole), kept.append(None)
                continue
            words = split_words(text)
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, [s["start"] for s in spans_], 1)
            np.add.at(change, [s["start"] + s["size"] + WINDOW - 1 for s in spans_], -1)
            covered = np.cumsum(change)[:-1] > 0
            stay = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])
            removed.append(int(covered.sum())), sha.append(hashlib.sha256(stay).hexdigest()), kept.append(stay.decode())
        return {"rid": batch["rid"], "doc_id": batch["doc_id"], "n_words": batch["n_words"], "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())}

    joined = texts.drop("anchors").join(spans, "rid", "left")
    return map_batches(joined, step, "rid long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept string", SLICE)
