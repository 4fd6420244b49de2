"""Toxicity scores from a learned lexicon, misspelling-tolerant matching and context windows.

**Fit.** All labelled rows outside the held-out third are read; nothing is sampled. Spark counts in how many texts of either class each word
occurs. Words with high log-odds that appear in several distinct contexts (word before, word after) form the lexicon, all of them, if chance
does not explain them: the evidence asked for is the least at which, had texts been toxic by lot, one in ten of the words taken up would be there by chance (``evidence_asked``),
so it does not grow with the texts read. Copies of a text repeat its contexts, so the evidence of a word counts only as far as its contexts differ. A second pass over the same rows stores the window around each hit: its
words get log-odds of their own under the same test, so that surroundings typical of quotation weaken a hit and those typical of abuse strengthen it, and hits between
quotation marks are counted apart. A small logistic model over the document features (exact hits, misspelled hits, quoted
hits, context) is fitted on counts per feature cell.

**Match.** The lexicon is a trie. A word within one edit of a term (two for long terms) is found by walking the intersection of
the terms' Levenshtein automata with the trie; reached state sets are remembered, which makes it one deterministic
automaton built as needed. Most words leave it after a few letters.

**Score.** One pass over all whole texts; only the text enters the score.

Defined cases: null and empty texts are scored as texts without hits; labels other than 0 and 1 are ignored, and a row labelled
twice counts as toxic if either label is 1; if the labels at hand are all 1 every score is near 1, and if all are 0 or there are
none every score is near 0; repeated rows are scored alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustfront.llm.common import bounded, kept_in_worker, map_batches, stored

MIN_CONTEXTS, MIN_ODDS = 4, 2.5
MIN_AROUND, AROUND_ODDS, WINDOW = 5, 0.7, 5
#: Share of the words taken up that may be there by chance.
BY_CHANCE = 0.1
CUT = 0.7
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_QUOTES = "\"“”«»„"
_CELL, _FULL = 0.25, 12.0


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class FuzzyLexicon:
    """Levenshtein automata of all terms intersected with their trie, determinised as words are read.

    A state is a set of (trie node, edits made); only sets that some word reaches are built.
    """

    STATES, WORDS = 50_000, 100_000

    def __init__(self, terms):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.most: list[int] = [0]
        for term in terms:
            node, allowed = 0, edits_allowed(term)
            self.most[0] = max(self.most[0], allowed)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node] = term
        self.known: dict[str, tuple[str, int] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """Number of the state after skipping letters of terms (deletions); -1 if nothing is reachable."""
        stack = list(reached.items())
        while stack:
            node, made = stack.pop()
            for child in self.children[node].values():
                if made + 1 <= self.most[child] and made + 1 < reached.get(child, 99):
                    reached[child] = made + 1
                    stack.append((child, made + 1))
        if not reached:
            return -1
        key = tuple(sorted(reached.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, made: int) -> None:
            if made <= self.most[node] and made < reached.get(node, 99):
                reached[node] = made

        for node, made in self.states[state]:
            reach(node, made + 1)  # the letter is extra
            for other, child in self.children[node].items():
                reach(child, made + (other != letter))
        return self._state(reached)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edit bound and the edits, ties to the smaller term."""
        if word in self.known:
            return self.known[word]
        if len(self.states) > self.STATES:
            self._reset()
        state = self.start
        for letter in word:
            following = self.steps[state].get(letter)
            if following is None:
                following = self.steps[state][letter] = self._step(state, letter)
            state = following
            if state < 0:
                break
        found = None
        if state >= 0:
            ends = [(made, self.ends[node]) for node, made in self.states[state] if self.ends[node] is not None and made <= edits_allowed(self.ends[node])]
            if ends:
                made, term = min(ends)
                found = (term, made)
        if len(self.known) > self.WORDS:
            self.known.clear()
        self.known[word] = found
        return found


def lexicon_of(terms) -> FuzzyLexicon:
    """The automaton of these terms, built once per Python worker."""
    terms = tuple(sorted(terms))
    return kept_in_worker("lexicon", terms, lambda: FuzzyLexicon(terms))


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    context: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * 4)
    bias: float = -20.0


@dataclass
class Hit:
    place: int
    term: str
    edits: int
    quoted: bool


def find_hits(text: str, lexicon: FuzzyLexicon) -> tuple[list[str], list[Hit]]:
    lowered = text.lower()
    words = WORD.findall(lowered)
    match = lexicon.match
    found = {w: m for w in set(words) if (m := match(w))}
    if not found:
        return words, []
    hits, quotes, at, last = [], 0, 0, max(map(lowered.rfind, _QUOTES))
    for place, m in enumerate(WORD.finditer(lowered)):
        hit = found.get(m[0])
        if hit:
            quotes += sum(lowered.count(q, at, m.start()) for q in _QUOTES)
            at = m.start()
            hits.append(Hit(place, hit[0], hit[1], quotes % 2 == 1 and last >= m.end()))
    return words, hits


def window(words: list[str], place: int) -> list[str]:
    return words[max(0, place - WINDOW) : place] + words[place + 1 : place + 1 + WINDOW]


def features(text: str, model: Model, lexicon: FuzzyLexicon) -> tuple[float, float, float, float]:
    """Exact, misspelled and quoted evidence and mean context, each rounded to its cell."""
    words, hits = find_hits(text, lexicon)
    return weighed([(h.term, h.edits, h.quoted, window(words, h.place)) for h in hits], model)


def weighed(hits: list[tuple[str, int, bool, list[str]]], model: Model) -> tuple[float, float, float, float]:
    """The features of a text from its hits: term, edits, whether quoted, words around."""
    exact = fuzzy = quoted = context = 0.0
    for term, edits, in_quotes, near in hits:
        weight = model.terms[term]
        around = max(-1.0, min(1.0, sum(model.context.get(w, 0.0) for w in near) / 2))
        context += around
        weight *= 1 + 0.5 * around
        if in_quotes:
            quoted += weight
        elif edits:
            fuzzy += weight / (1 + edits)
        else:
            exact += weight
    context = context / len(hits) if hits else 0.0
    cell = lambda x: round(min(_FULL, x) / _CELL) * _CELL
    return cell(exact), cell(fuzzy), cell(quoted), cell(context)


#: What the weights are drawn to, so that they stay of use when few cells are filled or the classes are separable.
PRIOR = (1.0, 0.5, 0.3, 0.3)


def fit_logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 2.0) -> tuple[list[float], float]:
    """Ridge logistic regression on weighted cells: Newton steps, halved until the penalised likelihood rises."""
    design = np.hstack([x, np.ones((len(x), 1))])
    centre, penalty = np.array([*PRIOR, 0.0]), np.array([ridge] * x.shape[1] + [1e-3])
    counts = counts / max(1.0, counts.sum() / 10_000)

    def value(beta: np.ndarray) -> float:
        z = design @ beta
        return float((counts * (y * z - np.logaddexp(0, z))).sum() - 0.5 * (penalty * (beta - centre) ** 2).sum())

    beta = centre.copy()
    share = float((counts * y).sum() / max(1e-9, counts.sum()))
    beta[-1] = math.log(max(1e-6, share) / max(1e-6, 1 - share))
    best = value(beta)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (counts * (y - p)) - penalty * (beta - centre)
        hessian = (design * (counts * p * (1 - p))[:, None]).T @ design + np.diag(penalty)
        move, step = np.linalg.solve(hessian, gradient), 1.0
        while step > 1e-6 and not value(beta + step * move) > best:
            step /= 2
        if step <= 1e-6 or np.abs(step * move).max() < 1e-7:
            break
        beta = beta + step * move
        best = value(beta)
    return beta[:-1].tolist(), float(beta[-1])


def _word_counts(sample: DataFrame) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            counts[toxic].update(set(WORD.findall((text or "").lower())))
        words = list(counts[0].keys() | counts[1].keys())
        return {"word": pa.array(words, pa.string()), "clean": pa.array([counts[0][w] for w in words], pa.int64()), "toxic": pa.array([counts[1][w] for w in words], pa.int64())}

    return map_batches(sample.select("text", "toxic"), step, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _occurrences(sample: DataFrame, words: set[str]) -> DataFrame:
    """Of the given words in toxic texts: the contexts they occur in."""

    def step(batch: pa.RecordBatch) -> dict:
        seen = set()
        for text in batch["text"].to_pylist():
            found = WORD.findall((text or "").lower())
            for i, word in enumerate(found):
                if word in words:
                    seen.add((word, f"{found[i - 1] if i else ''} {found[i + 1] if i + 1 < len(found) else ''}"))
        rows = list(seen)
        return {"word": pa.array([r[0] for r in rows], pa.string()), "around": pa.array([r[1] for r in rows], pa.string())}

    return map_batches(sample.where("toxic = 1").select("text"), step, "word string, around string")


def _hits(sample: DataFrame, terms: list[str]) -> DataFrame:
    """(toxic, hits) of the texts with hits."""
    kind = pa.list_(pa.struct([("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("around", pa.list_(pa.string()))]))

    def step(batch: pa.RecordBatch) -> dict:
        lexicon = lexicon_of(terms)
        marks, found = [], []
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words, hits = find_hits(text or "", lexicon)
            if hits:
                marks.append(toxic)
                found.append([{"term": h.term, "edits": h.edits, "quoted": h.quoted, "around": window(words, h.place)} for h in hits])
        return {"toxic": pa.array(marks, pa.int32()), "hits": pa.array(found, kind)}

    return map_batches(sample.select("text", "toxic"), step, "toxic int, hits array<struct<term:string,edits:int,quoted:boolean,around:array<string>>>")


def _around(hits: DataFrame) -> DataFrame:
    """Texts of either class in which a word stands in the window of a hit and is no term hit there."""
    words = F.array_except(F.flatten("hits.around"), "hits.term")  # each once
    return hits.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))


def _cells(hits: DataFrame, model: Model) -> DataFrame:
    """Texts with hits by feature cell and class."""

    def step(batch: pa.RecordBatch) -> dict:
        found = [[(h["term"], h["edits"], h["quoted"], h["around"]) for h in row] for row in batch["hits"].to_pylist()]
        rows = list(Counter((*weighed(h, model), toxic) for h, toxic in zip(found, batch["toxic"].to_pylist(), strict=True)).items())
        return {"cell": pa.array([list(r[0][:4]) for r in rows], pa.list_(pa.float64())), "toxic": pa.array([r[0][4] for r in rows], pa.int32()), "n": pa.array([r[1] for r in rows], pa.int64())}

    return map_batches(hits, step, "cell array<double>, toxic int, n long").groupBy("cell", "toxic").agg(F.sum("n").alias("n"))


def surprise(clean: Column, toxic: Column, share: float) -> Column:
    """Negative logarithm of a bound (Chernoff) on the chance that so many of a word's texts are of one class, if ``share`` of all are toxic by lot."""
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((clean + toxic) * F.lit(p)))).otherwise(0.0)
    return part(toxic, share) + part(clean, 1 - share)


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def evidence_asked(words: DataFrame, tested: int) -> float:
    """The least ``evidence`` at which no more than ``BY_CHANCE`` of the words that have it are expected of chance among ``tested`` words (Benjamini-Hochberg)."""
    step = F.floor(16 * F.least(F.col("evidence"), F.lit(64.0))).cast("int")
    taken, asked = 0, math.inf
    for r in words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():  # 1,025 steps at most
        taken += r["n"]
        if tested * math.exp(-r["step"] / 16) <= BY_CHANCE * taken:
            asked = r["step"] / 16
    return asked


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon, context weights and model from all labelled rows outside the held-out third."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marked = marked.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model()
    if not shares.get(0) or not shares.get(1):
        model.bias = 20.0 if shares.get(1) else -20.0
        return model
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out())
    # texts are dealt by id at any size: labels grow with them, so they are no table to broadcast, and a merge would sort the texts
    sample = stored(texts.join(marked.hint("shuffle_hash"), "doc_id").select("text", "toxic"), "toxicity-fit")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        model.bias = 20.0 if sizes.get(1) else -20.0
        return model
    clean, toxic = F.col("clean"), F.col("toxic")
    counts = stored(_word_counts(sample).where(clean + toxic >= MIN_CONTEXTS), "toxicity-words")
    odds = F.log((toxic + 0.5) / (sizes[1] + 1)) - F.log((clean + 0.5) / (sizes[0] + 1))
    likely = counts.withColumn("odds", odds).withColumn("evidence", surprise(clean, toxic, sizes[1] / (sizes[0] + sizes[1]))).where((toxic >= MIN_CONTEXTS) & (F.col("odds") >= MIN_ODDS))
    least = evidence_asked(likely, counts.count())
    likely = {r["word"]: r for r in likely.where(F.col("evidence") >= least).collect()}  # words that chance does not explain
    support = _occurrences(sample, set(likely)).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_CONTEXTS)
    for word, n in sorted((r["word"], r["n"]) for r in support.collect()):  # words of ``likely`` only
        found = likely[word]
        if found["evidence"] * min(1.0, n / found["toxic"]) >= least:
            model.terms[word] = min(6.0, found["odds"]) * min(1.0, math.log1p(n) / math.log(20))
    if model.terms:
        hits = stored(_hits(sample, sorted(model.terms)), "toxicity-hits")
        hit = {r["toxic"]: r["n"] for r in hits.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        if hit.get(0) and hit.get(1):
            around = stored(_around(hits).where(clean + toxic >= MIN_AROUND), "toxicity-around")
            odds = F.log((toxic + 2) / (hit[1] + 4)) - F.log((clean + 2) / (hit[0] + 4))
            useful = around.withColumn("odds", odds).withColumn("evidence", surprise(clean, toxic, hit[1] / (hit[0] + hit[1]))).where(F.abs("odds") >= AROUND_ODDS)
            useful = useful.where(F.col("evidence") >= evidence_asked(useful, around.count()))
            model.context = {r["word"]: r["odds"] for r in useful.collect()}  # words that chance does not explain
        cells = [(r["cell"], r["toxic"], r["n"]) for r in _cells(hits, model).collect()]  # bounded by the number of feature cells
        sizes = {t: sizes[t] - hit.get(t, 0) for t in sizes}
    else:
        cells = []
    cells += [([0.0] * 4, t, n) for t, n in sizes.items() if n]  # texts without hits
    x, y, n = np.array([c for c, _, _ in cells]).reshape(-1, 4), np.array([t for _, t, _ in cells], dtype=float), np.array([n for _, _, n in cells], dtype=float)
    model.weights, model.bias = fit_logistic(x, y, n)
    return model


def probability(values: tuple[float, ...], model: Model) -> float:
    z = model.bias + sum(w * v for w, v in zip(model.weights, values, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """rid, doc_id, held_out, score, predicted for every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def step(batch: pa.RecordBatch) -> dict:
        lexicon = lexicon_of(model.terms)
        scores = [probability(features(text or "", model, lexicon), model) for text in batch["text"].to_pylist()]
        return {"rid": batch["rid"], "doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= CUT) for s in scores], pa.int32())}

    return map_batches(rows, step, "rid long, doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; scored in place, so that no text is shuffled."""
    model = fit(docs, labels)
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lexicon_of(model.terms)
        for batch in batches:
            for piece in bounded(batch):
                texts = piece.column(piece.schema.get_field_index("text")).to_pylist()
                yield piece.filter(pa.array([probability(features(t or "", model, lexicon), model) < CUT for t in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
