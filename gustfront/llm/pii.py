"""Personal data: fixed patterns as seeds, bootstrapped contextual extraction for the rest.

**Base.** Four kinds, found in every whole text, leftmost and non-overlapping per kind (see the fixed patterns below); a match that
fails its check is dropped without a retry. All scans are linear in the text.

**Bootstrap.** Tokens of any length that hold a digit or ``@`` and lie outside the base spans are candidates, and so are such pieces of
unspaced strings between delimiters. Seeds and candidates are instances;
the whole words around them induce lexical patterns: two words before, two after, one on either side, each with the token's shape
class, and two before with one after for any shape.
Spark scores the bipartite graph of patterns and instances in rounds: a pattern's confidence is the smoothed mean of its distinct
instances' scores, an instance's score the noisy-or over its supported patterns (seeds stay at 1). Patterns with enough
distinct seeds and high confidence discover the candidates they surround; these spans are added under the kind ``id``.

The graph is pre-aggregated to distinct edges with hashed nodes; patterns without enough seeds leave it before the first round.
Rounds are written to the shared folder.

Defined cases: null text counts as empty; documents without findings have counts 0, the digest of the empty string and empty spans;
repeated rows are reported each but count once as instances; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustfront.llm.common import free_name, map_batches, numbered, stored, with_row_id

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, PRIOR = 3, 8, 0.9, 1.0

# Fixed values of the contract: email, ip, card and phone as patterns, here in forms that never rescan a run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"\S+")
#: What stands between the delimiters of an unspaced string.
_PIECE = re.compile(r"""[^=&;,|?/:#"'`<>()\[\]{}]+""")
_EDGE = "\"'`.,;:!?()[]{}<>|*"


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    if text.count(".") < 3:
        return
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at = run[0].split("."), run.start()
        places = []
        for part in parts:
            places.append((at, at + len(part)))
            at += len(part) + 1
        for i in range(0, len(parts) - 3, 4):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts[i : i + 4]):
                yield places[i][0], places[i + 3][1]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if place % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                yield m.span()


FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones), strict=True))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of ``KINDS``."""
    if not (_DIGIT.search(text) or "@" in text):
        return []
    found = [(start, KINDS.index(kind), end) for kind, find in FINDERS.items() for start, end in find(text)]
    return [(start, end, KINDS[k]) for start, k, end in sorted(found)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def shape(token: str) -> str:
    """Runs of letters, digits and marks, each once: ``a9@a.a``."""
    out = []
    for c in token:
        kind = "a" if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:16])


class Words:
    """The words around spans of a text: first the pieces of a span's own run of characters without white space, then whole runs.

    Runs are cut at the edges of ``spans`` and, where these lie inside, at delimiters. Words are found by position, so a text is
    read once whatever its spans.
    """

    def __init__(self, text: str, spans: list[tuple[int, int]]):
        self.text, self.cleaned = text, {}
        self.starts, self.ends, self.runs, self.firsts = [], [], [], []
        edges, at = sorted({x for span in spans for x in span}), 0
        for m in _RUN.finditer(text):
            start, end = m.span()
            while at < len(edges) and edges[at] <= start:
                at += 1
            inner = at
            while inner < len(edges) and edges[inner] < end:
                inner += 1
            if inner == at:
                self.runs.append((start, end))
                self.firsts.append(len(self.starts))
                self.starts.append(start)
                self.ends.append(end)
                continue
            cuts = [start, *edges[at:inner], end]
            core = (start + len(m[0]) - len(m[0].lstrip(_EDGE)), start + len(m[0].rstrip(_EDGE)))
            split = any(core[0] < c < core[1] for c in cuts[1:-1])
            self.runs.append((start, end))
            self.firsts.append(len(self.starts))
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces = [(a, b)]
                if split:
                    pieces = [(x.start() + a, x.end() + a) for x in _PIECE.finditer(text[a:b])]
                self.starts += [x for x, _ in pieces]
                self.ends += [x for _, x in pieces]

        self.firsts.append(len(self.starts))

    def _word(self, start: int, end: int) -> str:
        if (start, end) not in self.cleaned:
            self.cleaned[start, end] = re.sub("[0-9]+", "9", self.text[start:end].lower().strip(_EDGE))
        return self.cleaned[start, end]

    def near(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """The two words before and after."""
        run = bisect_right(self.runs, (start, len(self.text))) - 1
        low = max(self.firsts[run], bisect_right(self.ends, start) - 2)
        before = list(zip(self.starts[low : bisect_right(self.ends, start)], self.ends[low : bisect_right(self.ends, start)], strict=True))
        before = self.runs[max(0, run - 2 + len(before)) : run] + before
        run = bisect_left(self.runs, (end, 0)) - 1
        low = bisect_left(self.starts, end)
        high = min(self.firsts[run + 1], low + 2)
        after = list(zip(self.starts[low:high], self.ends[low:high], strict=True))
        after += self.runs[run + 1 : run + 3 - len(after)]
        return [self._word(*w) for w in before], [self._word(*w) for w in after]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def patterns_of(words: Words, start: int, end: int) -> list[int]:
    """The lexical patterns around a span."""
    before, after = words.near(start, end)
    kind = shape(words.text[start:end])
    named = []
    if len(before) == 2:
        named.append(f"b\t{before[0]}\t{before[1]}\t{kind}")
    if len(after) == 2:
        named.append(f"a\t{after[0]}\t{after[1]}\t{kind}")
    if before and after:
        named.append(f"m\t{before[-1]}\t{after[0]}\t{kind}")
    if len(before) == 2 and after:
        named.append(f"w\t{before[0]}\t{before[1]}\t{after[0]}")
    return [_hash(x) for x in named]


def candidates(text: str, spans: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or ``@`` outside the given spans, without outer punctuation, whatever their length; and the pieces of
    unspaced strings between delimiters (values of ``key=value`` lists, query strings, JSON), also beside a given span."""
    if not (_DIGIT.search(text) or "@" in text):
        return
    taken = sorted((s, e) for s, e, _ in spans)
    at = reach = 0

    def free(start: int, end: int) -> bool:
        nonlocal at, reach
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][1])
            at += 1
        return reach <= start

    for m in _RUN.finditer(text):
        token = m[0]
        if not ("@" in token or _DIGIT.search(token)):
            continue
        lead = len(token) - len(token.lstrip(_EDGE))
        whole = (m.start() + lead, m.start() + len(token.rstrip(_EDGE)))
        parts = []
        for piece in _PIECE.finditer(token):
            part = piece[0]
            if "@" in part or _DIGIT.search(part):
                start, end = piece.start() + len(part) - len(part.lstrip(_EDGE)), piece.start() + len(part.rstrip(_EDGE))
                start, end = start + m.start(), end + m.start()
                if start < end and (start, end) != whole and free(start, end):
                    parts.append((start, end))
        if whole[0] < whole[1] and free(*whole):
            yield whole
        yield from parts


def extracted(rows: DataFrame) -> DataFrame:
    """Per row: base spans and instances (start, end, seed, value hash, pattern hashes)."""
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.int64()), ("patterns", pa.list_(pa.int64()))])

    def step(batch: pa.RecordBatch) -> dict:
        base, instances = [], []
        for text in batch["text"].to_pylist():
            text = text or ""
            spans = base_spans(text)
            base.append(joined(spans))
            places = [(s, e, True) for s, e, _ in spans] + [(s, e, False) for s, e in candidates(text, spans)]
            words = Words(text, [(s, e) for s, e, _ in places]) if places else None
            instances.append([{"start": s, "end": e, "seed": seed, "value": _hash(text[s:e].lower()), "patterns": patterns_of(words, s, e)} for s, e, seed in places])
        return {"rid": batch["rid"], "doc_id": batch["doc_id"], "base": pa.array(base, pa.string()), "instances": pa.array(instances, pa.list_(item))}

    return map_batches(rows, step, "rid long, doc_id long, base string, instances array<struct<start:int,end:int,seed:boolean,value:bigint,patterns:array<bigint>>>")


def confident_patterns(held: DataFrame) -> DataFrame:
    """(pattern, confidence) of the patterns that may discover instances, from scoring the pattern-instance graph in rounds."""
    seen = held.select(F.explode("instances").alias("i")).select("i.seed", "i.value", F.explode("i.patterns").alias("pattern"))
    edges = seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    seeded = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("long")).alias("seeds"), F.count(F.lit(1)).alias("n")).where(F.col("seeds") >= MIN_SEEDS).select("pattern")
    graph = stored(edges.join(seeded, "pattern"), "pii-graph")
    scores = graph.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(ROUNDS):
        rated = graph.join(scores, "value").groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + F.lit(PRIOR))).alias("confidence"))
        scores = stored(
            graph.join(rated, "pattern").groupBy("value").agg(F.max("seed").alias("seed"), F.sum(F.log(F.lit(1.0) - F.least(F.col("confidence"), F.lit(0.999)))).alias("missed"))
            .select("value", F.when(F.col("seed"), 1.0).otherwise(1.0 - F.exp("missed")).alias("score")),
            "pii-scores",
        )
    return graph.join(scores, "value").groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + F.lit(PRIOR))).alias("confidence")).where(F.col("confidence") >= MIN_CONFIDENCE)


def discovered(held: DataFrame) -> DataFrame:
    """(rid, found): spans that confident patterns add, at least one per row returned."""
    unseen = held.select("rid", F.explode("instances").alias("i")).where("not i.seed").select("rid", "i.start", "i.end", F.explode("i.patterns").alias("pattern"))
    hits = unseen.join(confident_patterns(held), "pattern").select("rid", "start", "end").distinct()
    return hits.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("found"))


def _ordered(base: str, found: list) -> str:
    spans = []
    for x in base.split(",") if base else ():
        kind, start, end = x.split(":")
        spans.append((int(start), KINDS.index(kind), int(end)))
    spans += [(f["start"], len(KINDS), f["end"]) for f in found or ()]
    return ",".join(f"{(*KINDS, FOUND)[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_personal_data(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """Per row: rid, doc_id, counts per kind, base (spans joined), base_sha256, spans (base and discovered, joined)."""
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rid=rid)
    held = stored(extracted(rows), "pii")
    every = held.select("rid", "doc_id", "base").join(discovered(held), "rid", "left")

    def step(batch: pa.RecordBatch) -> dict:
        base = batch["base"].to_pylist()
        spans = [_ordered(b, f) for b, f in zip(base, batch["found"].to_pylist(), strict=True)]
        counts = {f"n_{k}": pa.array([sum(x.startswith(f"{k}:") for x in b.split(",")) for b in base], pa.int64()) for k in KINDS}
        sha = [hashlib.sha256(b.encode()).hexdigest() for b in base]
        return {"rid": batch["rid"], "doc_id": batch["doc_id"]} | counts | {"base": pa.array(base, pa.string()), "base_sha256": sha, "spans": pa.array(spans, pa.string())}

    return map_batches(every, step, "rid long, doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, base_sha256 string, spans string")


def masked(text: str, spans: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one, named after the first."""
    out, done = [], 0
    merged: list[list] = []
    for x in spans.split(",") if spans else ():
        kind, start, end = x.split(":")
        if merged and int(start) < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], int(end))
        else:
            merged.append([int(start), int(end), kind])
    for start, end, kind in merged:
        out += [text[done:start], f"<{kind}>"]
        done = end
    return "".join(out) + text[done:]


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; all columns stay, null texts stay null, ``n_chars`` follows the text if there."""
    named, row = with_row_id(docs)
    rid, spans = free_name(named, "__found"), free_name(named, "__spans")
    found = find_personal_data(named, row).where("spans <> ''").select(F.col("rid").alias(rid), F.col("spans").alias(spans))

    @F.pandas_udf("string")
    def mask(texts: pd.Series, found_: pd.Series) -> pd.Series:
        return pd.Series([masked(t, s) if t is not None and s else t for t, s in zip(texts, found_, strict=True)], dtype=object)

    changed = F.when(F.col(spans).isNotNull(), mask(F.col("text").cast("string"), F.col(spans))).otherwise(F.col("text").cast("string"))
    out = named.join(found, F.col(row) == F.col(rid), "left").withColumn("text", changed)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
