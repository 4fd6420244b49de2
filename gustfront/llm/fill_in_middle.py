"""Fill-in-the-middle examples: every text is cut in three by a hash of its id, the cuts are found in a wavelet matrix.

1. The code points of a slice of texts become one sequence of character classes: word character, first character of a
   word, white space, line end. The sequence is held as a wavelet matrix: one bit row per bit of the class, each row
   stably sorted by the bit above, with running counts of ones.
2. A rank query counts a class before a place, so the units of a text (lines, words or characters) are a sum of ranks at
   its two ends. The start or end of a text's k-th unit is a select on those counts, walked up through the bit rows by
   bisection on the running counts. Both kinds of query run for all texts of the slice at once.
3. The two cuts give prefix, middle and suffix, which are written plainly, prefix first (psm) or suffix first (spm).

Slices hold a few MB of text (``bounded``), so memory follows the longest text and not the batch.

Defined cases: a null text is empty; an empty text, and one that holds a marker, stays plain; a null ``doc_id`` hashes as the
empty string; rows that repeat are answered one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.llm.common import map_batches, numbered

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
WORD, WORD_START, SPACE, LINE_END = range(4)
UNITS = ("line", "word", "char")
SPACES = np.array([0x20, *range(0x09, 0x0E)], dtype=np.uint32)


def classes_of(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of every code point; ``starts`` are places where a text begins, so that no word runs over two texts."""
    out = np.zeros(len(points), dtype=np.uint8)
    space = np.isin(points, SPACES)
    first = ~space
    first[1:] &= space[:-1]
    begins = starts[starts < len(points)]
    first[begins] = ~space[begins]
    out[first] = WORD_START
    out[space] = SPACE
    out[points == 0x0A] = LINE_END
    return out


class WaveletMatrix:
    """Rank and select over a sequence of small integers, for arrays of places at once."""

    def __init__(self, symbols: np.ndarray, bits: int = 2):
        self.bits, self.ones, self.zeros = bits, [], []
        row = symbols
        for b in range(bits - 1, -1, -1):
            bit = (row >> b & 1).astype(bool)
            ones = np.zeros(len(row) + 1, dtype=np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(row) - int(ones[-1]))
            row = np.concatenate([row[~bit], row[bit]])

    def _down(self, symbol: int, at: np.ndarray) -> np.ndarray:
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[level][at]
            at = self.zeros[level] + ones if symbol >> b & 1 else at - ones
        return at

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` lies before each place."""
        return self._down(symbol, at) - self._down(symbol, np.zeros(1, dtype=np.int64))

    def select(self, symbol: int, which: np.ndarray) -> np.ndarray:
        """Place of the ``which``-th occurrence, counted from 0."""
        at = self._down(symbol, np.zeros(1, dtype=np.int64)) + which
        for level in range(self.bits - 1, -1, -1):
            ones = self.ones[level]
            if symbol >> (self.bits - 1 - level) & 1:
                at = np.searchsorted(ones, at - self.zeros[level] + 1) - 1
            else:
                at = _select_zero(ones, at)
        return at


def _select_zero(ones: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Place of the ``which``-th zero: the zeros before place i are i minus the ones before it; bisect for all at once."""
    low, high = np.zeros_like(which), np.full_like(which, len(ones) - 1)
    while np.any(low < high):
        mid = (low + high) // 2
        enough = mid + 1 - ones[mid + 1] > which
        high, low = np.where(enough, mid, high), np.where(enough, low, np.minimum(mid + 1, high))
    return low


class Cutter:
    """Unit counts and the places after k units, for all texts of a slice."""

    def __init__(self, texts: list[str], unit: str):
        if unit not in UNITS:
            raise ValueError(f"unit {unit!r} is none of {UNITS}")
        self.unit = unit
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = classes_of(points, self.starts)
        self.matrix = WaveletMatrix(symbols)
        self.symbol = WORD_START if unit == "word" else LINE_END
        self.before = self.matrix.rank(self.symbol, self.starts)
        self.inside = self.matrix.rank(self.symbol, self.ends) - self.before
        if unit == "line":  # an unfinished last line counts as one
            last = symbols[np.maximum(self.ends - 1, 0)] if len(symbols) else np.zeros(len(texts), np.uint8)
            self.counts = self.inside + ((self.sizes > 0) & (last != LINE_END))
        else:
            self.counts = self.sizes if unit == "char" else self.inside

    def after(self, units: np.ndarray) -> np.ndarray:
        """Characters of each text in its first ``units`` units; leading white space goes with the first word."""
        if self.unit == "char":
            return units
        if self.unit == "line":
            known = (units > 0) & (units <= self.inside)
            which, step = self.before + units - 1, 1
        else:  # a word reaches to the start of the next one
            known = (units > 0) & (units < self.inside)
            which, step = self.before + units, 0
        out = np.where(units > 0, self.sizes, 0)
        out[known] = self.matrix.select(self.symbol, which[known]) + step - self.starts[known]
        return out


class Example(NamedTuple):
    units: int
    form: str
    prefix: str
    middle: str
    suffix: str

    def output(self) -> str:
        if self.form == "plain":
            return self.prefix
        if self.form == "psm":
            return PREFIX + self.prefix + SUFFIX + self.suffix + MIDDLE + self.middle
        return SUFFIX + self.suffix + PREFIX + self.prefix + MIDDLE + self.middle


def draws(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def examples(ids: list[int | None], texts: list[str], unit: str = "line", rate: int = 100, spm: int = 50, seed: str = "7") -> list[Example]:
    """One example per text; ``rate`` in 100 are transformed and ``spm`` in 100 of those put the suffix first."""
    cutter = Cutter(texts, unit)
    drawn = np.array([draws(i, seed) for i in ids], dtype=np.int64).reshape(len(ids), 4)
    cuts = drawn[:, :2] % (cutter.counts[:, None] + 1)
    first, second = cutter.after(cuts.min(axis=1)).tolist(), cutter.after(cuts.max(axis=1)).tolist()
    plain, suffix_first = (drawn[:, 2] % 100 >= rate).tolist(), (drawn[:, 3] % 100 < spm).tolist()
    out = []
    for n, (text, count) in enumerate(zip(texts, cutter.counts.tolist(), strict=True)):
        if not text or plain[n] or PREFIX in text or SUFFIX in text or MIDDLE in text:
            out.append(Example(count, "plain", text, "", ""))
        else:
            out.append(Example(count, "spm" if suffix_first[n] else "psm", text[: first[n]], text[first[n] : second[n]], text[second[n] :]))
    return out


def restore(output: str, form: str) -> str:
    """The text of an output; no text that was cut holds a marker, and none can arise where pieces meet markers."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head[len(PREFIX) :].partition(SUFFIX)
    else:
        suffix, _, prefix = head[len(SUFFIX) :].partition(PREFIX)
    return prefix + middle + suffix


def transform(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: str = "7") -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output and the text that its output restores."""

    def step(batch: pa.RecordBatch) -> dict:
        ids = batch["doc_id"].to_pylist()
        made = examples(ids, batch["text"].fill_null("").to_pylist(), unit, rate, spm, seed)
        outputs = [x.output() for x in made]
        cut = [x.form != "plain" for x in made]
        return {
            "doc_id": batch["doc_id"],
            "n": pa.array([x.units for x in made], pa.int64()),
            "form": [x.form for x in made],
            "prefix_chars": pa.array([len(x.prefix) if c else None for x, c in zip(made, cut, strict=True)], pa.int64()),
            "middle_chars": pa.array([len(x.middle) if c else None for x, c in zip(made, cut, strict=True)], pa.int64()),
            "output": outputs,
            "restored": [restore(o, x.form) for o, x in zip(outputs, made, strict=True)],
        }

    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).drop("rid")
    return map_batches(rows, step, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string")
