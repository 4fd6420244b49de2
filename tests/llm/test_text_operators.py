"""Tokenisation, packing, personal data, toxicity, top-k, rollups and the pipeline against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gustfront.llm import common, packing, pii, sentencepiece_codec, token_rollup, topk, toxicity
from tests.llm.data import SCHEMA, awkward_texts, frame, prose, saved


def listed(df):
    return [r.asDict() for r in df.collect()]


# SentencePiece ------------------------------------------------------------------------------------------------------


def plain_viterbi(codec, text, pieces):
    best = [(0.0, 0, None)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        found = [(best[end - 1][0] + codec.spelt, 1, (-1, 1))]
        for size in range(1, min(end, 24) + 1):
            if text[end - size : end] in pieces:
                i, score = pieces[text[end - size : end]]
                found.append((best[end - size][0] + score, size, (i, size)))
        best[end] = max(found, key=lambda x: (x[0], x[1]))
    out, at = [], len(text)
    while at:
        i, size = best[at][2]
        out += [i] if i >= 0 else [codec.byte_id[b] for b in reversed(text[at - 1].encode())]
        at -= size
    return out[::-1]


def test_codec_is_the_best_segmentation_of_the_whole_text(docs):
    codec = sentencepiece_codec.codec(sentencepiece_codec.model_path(None))
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path(None))
    pieces = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    checked = {(r["rid"], bytes(r["ids"])) for r in listed(sentencepiece_codec.encode_checked(docs)) if r["round_trip"]}
    coded = listed(sentencepiece_codec.decode(sentencepiece_codec.encode(docs)))
    assert checked == {(r["rid"], bytes(r["ids"])) for r in coded}
    for r in coded:
        text = r["text"] or ""
        assert r["decoded"] == text
        if "▁" not in text:
            want = plain_viterbi(codec, "▁" + text.replace(" ", "▁"), pieces) if text else []
            assert np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() == want


def test_cache_keeps_what_was_asked_for_lately():
    made = []
    cache = common.Recent(lambda k: made.append(k) or k.upper(), 3)
    assert [cache[k] for k in "abcabcdab"] == list("ABCABCDAB") and made == list("abcd")  # two generations
    assert [cache[k] for k in "efgh"] == list("EFGH") and cache["a" * 70] == "A" * 70 and "a" * 70 not in cache
    assert len(cache) <= 3 and len(cache.older) <= 3


# Packing ------------------------------------------------------------------------------------------------------------


def ids_by_library(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_fast_ids_equal_the_library():
    rng = random.Random(2)
    alphabet = "abz  \t\n\r.,'sdntvermlé ÀÿªºµÐ×÷ßÞ²³¹¼½¾019_-\x0b\x0c\x1c\x1d\x1f\x85\xa0¡¿«»"
    texts = awkward_texts() + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text, want in zip(texts, ids_by_library(texts), strict=True):
        assert np.frombuffer(encode(text or ""), dtype="<u2").tolist() + [0] == want, repr(text)


def test_packing_keeps_every_id_once(docs):
    rows = docs.collect()
    wanted = Counter((r["doc_id"], tuple(i)) for r, i in zip(rows, ids_by_library([r["text"] for r in rows]), strict=True))
    got = listed(packing.pack(docs, length=64))
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and 0 < r["length"] <= 64
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    assert sum(sum(r["length"] for r in rs) < 64 for rs in sequences.values()) <= 1
    # documents lie in one piece of the stream each
    stream = sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    built, current = Counter(), []
    for r in stream:
        assert r["start"] == len(current)
        current += np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
        if len(current) == r["doc_tokens"]:
            built[(r["doc_id"], tuple(current))] += 1
            current = []
    assert not current and built == wanted


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_hilbert_curve_visits_all_cells_in_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# Personal data ------------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "phone" and 9 <= len(digits) <= 15
            if kind == "card" and 12 <= len(digits) <= 19:
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                ok = total % 10 == 0
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


def test_base_spans_equal_the_patterns():
    rng = random.Random(4)
    for alphabet, size in (("a1.@-+ %_(", 30), ("0123456789. -+()", 40), ("12 .", 25), ("é@a.1-@", 20), ("4-1 ", 60)):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(size)))
            assert pii.joined(pii.base_spans(text)) == plain_spans(text), repr(text)
    for text in awkward_texts():
        assert pii.joined(pii.base_spans(text or "")) == plain_spans(text or "")


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "a@" * 150_000):
        pii.base_spans(text)


def test_patterns_discover_unseen_identifiers(spark, tmp_path):
    rng = random.Random(6)
    texts = [f"{prose(rng, 6)} reach me at u{i}.x@mail.example.com or call later {prose(rng, 4)}" for i in range(30)]
    texts += ["kindly reach me at hidden.u9@intranet or call later on", "reach the at hidden.u8@intranet near that"]
    df = saved(spark, tmp_path / "d", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in listed(pii.find_personal_data(df))}
    at = texts[30].index("hidden")
    assert got[30]["spans"] == f"id:{at}:{at + 18}" and got[31]["spans"] == ""
    assert all(r["n_email"] == int(i < 30) for i, r in got.items())


def test_discovery_by_shape_and_context(spark, tmp_path):
    bad = "4111111111111112"
    texts = []
    number = 400000000000000
    while len(texts) < 20:
        number += 1
        if pii.luhn(str(number) + "0"):
            texts.append(f"please charge card {number}0 before the end")
    texts += [f"please charge card {bad} before the end", f"see part {bad} in the list"]
    df = saved(spark, tmp_path / "d", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in listed(pii.find_personal_data(df))}
    assert got[20]["spans"] == "id:19:35" and got[20]["n_card"] == 0 and got[21]["spans"] == ""
    assert got[0]["spans"] == "card:19:35" and got[0]["base_sha256"] == hashlib.sha256(b"card:19:35").hexdigest()
    kept = pii.mask_personal_data(df)
    assert kept.columns == df.columns and {r["text"] for r in kept.collect() if r["doc_id"] in (0, 20)} == {"please charge card <card> before the end", "please charge card <id> before the end"}


def test_personal_data_rows(docs):
    got = sorted((str(r["doc_id"]), r["base"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in listed(pii.find_personal_data(docs)))
    want = []
    for r in docs.collect():
        spans = plain_spans(r["text"] or "")
        kinds = Counter(x.split(":")[0] for x in spans.split(","))
        want.append((str(r["doc_id"]), spans, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], hashlib.sha256(spans.encode()).hexdigest()))
    assert got == sorted(want)
    masked = pii.mask_personal_data(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert sum(r["text"] is None for r in masked.collect()) == 1


# Toxicity -----------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(8)
    terms = ["scum", "idiot", "moron", "worthless", "disgusting", "pathetic", "idiotic", "ab", "abcab"]
    lexicon = toxicity.FuzzyLexicon(terms)
    lexicon.STATES = 40
    words = terms + ["".join(rng.choice("abcidotmrn") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    for t in terms:
        for _ in range(60):
            w = t
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + "x" + w[at:], w[:at] + w[at + 1 :], w[:at] + "y" + w[at + 1 :]])
            words.append(w)
    for w in words:
        near = min(((distance(w, t), t) for t in terms if distance(w, t) <= toxicity.edits_allowed(t)), default=None)
        assert lexicon.match(w) == (near and (near[1], near[0])), w


def labelled(spark, folder, n=900):
    rng = random.Random(11)
    bad = ["glorpish", "snarbling", "vexcrumb", "mudwretch"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = prose(rng, 50).split()
        if toxic:
            for _ in range(3):
                term = rng.choice(bad)
                words.insert(rng.randrange(len(words)), term[:3] + "x" + term[4:] if i % 5 == 1 else term)
        docs.append((i, " ".join(words), "en", "s", 0))
        if i % 10 != 7:
            labels.append((i, 1, int(toxic)))
    docs += [(n, None, "en", "s", 0), (None, "", "en", "s", 0), (n + 1, "x" * 10_000, "en", "s", 0)]
    docs_df = saved(spark, folder / "documents.parquet", spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    labels_df = saved(spark, folder / "labels.parquet", spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (n + 9, 0, 1)], "doc_id long, quality int, toxic int"))
    return docs_df, labels_df


def test_toxicity_on_held_out_rows(spark, tmp_path):
    docs, labels = labelled(spark, tmp_path)
    model = toxicity.fit(docs, labels)
    assert set(model.terms) >= {"glorpish", "snarbling", "vexcrumb", "mudwretch"}
    got = listed(toxicity.score(docs, model))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) > 0.97 * len(held)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r["predicted"] for r in got)


def test_toxicity_reads_all_labelled_rows(spark, tmp_path, monkeypatch):
    # 40,000 rows, a fifth of them toxic; five of these hold a term of their own, which has to be learned however many texts are read
    word = lambda k: f"element_at(array({', '.join(repr(w) for w in prose(random.Random(5), 60).split())}), 1 + cast(pmod(xxhash64(id, {k}), 50) as int))"
    rows = spark.range(40_000).selectExpr("id as doc_id", f"concat_ws(' ', {', '.join(word(k) for k in range(8))}) as text", "cast(id % 5 = 0 as int) as toxic")
    learned = [r.doc_id for r in rows.where((F.col("toxic") == 1) & ~toxicity.held_out()).orderBy(F.xxhash64("doc_id", F.lit(3))).limit(5).collect()]
    rows = rows.withColumn("text", F.when(F.col("doc_id").isin(learned), F.concat("text", F.lit(" glorpish "), "text")).otherwise(F.col("text")))
    docs, labels = saved(spark, tmp_path / "documents", rows.select("doc_id", "text")), saved(spark, tmp_path / "labels", rows.select("doc_id", "toxic"))
    read, store = {}, toxicity.stored
    monkeypatch.setattr(toxicity, "stored", lambda df, name: read.setdefault(name, store(df, name)))
    model = toxicity.fit(docs, labels)
    assert read["toxicity-fit"].count() == docs.where(~toxicity.held_out()).count() > 20_000
    assert set(model.terms) == {"glorpish"}


def test_evidence_asked_of_words(spark):
    words = spark.createDataFrame([(20.0,)] * 9 + [(7.0,), (6.5,), (6.0,), (3.0,)] + [(1.0,)] * 87, "evidence double")
    assert toxicity.evidence_asked(words, 1000) == 7.0  # 0.9 of 10 by chance; 1.5 of 11 would be too many
    assert toxicity.evidence_asked(words, 100) == 6.0 and toxicity.evidence_asked(words.limit(0), 100) == math.inf


def test_toxicity_without_both_classes(spark, tmp_path, nothing):
    docs, labels = labelled(spark, tmp_path, 20)
    for part, want in ((labels.where("toxic = 0"), 0), (labels.where("toxic = 1"), 1), (labels.limit(0), 0)):
        assert {r["predicted"] for r in listed(toxicity.score(docs, toxicity.fit(docs, part)))} == {want}
    assert listed(toxicity.score(nothing, toxicity.fit(nothing, labels))) == []


# Top-k --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block,group", [(2048, 2048), (16, 2)])
def test_top_k(spark, tmp_path, monkeypatch, block, group):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", group)
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=20).tolist()) for i in range(150)]
    vectors += [(i, [float(x) for x in rng.integers(-1, 2, 20) / 256]) for i in range(150, 260)]  # many ties
    vectors += [(300, None), (301, [None] * 20), (302, [float("nan")] * 20), (303, [float("inf")] * 20), (304, []), (350, [0.5, 0.25]), (351, [1.0, 1.0]), (352, [1e17, 1.0]), (None, [1.0] * 20), (100, vectors[100][1]), (7, [0.0] * 20)]
    df = saved(spark, tmp_path / "v", spark.createDataFrame([(a, b, 1, 2) for a, b in vectors], "vec_id long, embedding array<double>, rank int, score int"))
    sound = [(n, i, tuple(int(np.floor(256 * x)) for x in v)) for n, (i, v) in enumerate(vectors) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for m, q, a in sound:
        if q % 50 == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b, strict=True)))), i) for n, i, b in sound if n != m and len(a) == len(b))[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    got = topk.top_k(df, topk.F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), topk.F.lit(True)).collect() == []


# Rollup -------------------------------------------------------------------------------------------------------------


def test_rollup_of_documents(docs, tmp_path):
    encoders = {v: packing.encoder(public_tokenizers.path(f"{v}.tiktoken")) for v in token_rollup.VERSIONS}
    last = {}
    for r in docs.collect():
        text = r["text"] or ""
        if text not in last or (r["doc_id"] is not None and (last[text]["doc_id"] is None or r["doc_id"] > last[text]["doc_id"])):
            last[text] = r.asDict()
    want = {}
    for text, r in last.items():
        for version, encode in encoders.items():
            old = want.get((r["source"], r["lang"], version), (0, 0))
            want[(r["source"], r["lang"], version)] = (old[0] + 1, old[1] + len(encode(text.strip())) // 2)
    store = token_rollup.maintain(docs, str(tmp_path / "store"))
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in listed(store.totals())}
    assert got == want and len({k[2] for k in got}) == 2
    assert set(store.committed()) == {f"{b}-{v}" for b in ("load", "retract-copies", "recount-trimmed") for v in token_rollup.VERSIONS}
    assert sum(n for (_, _, v), (_, n) in got.items() if v == token_rollup.VERSIONS[0]) != sum(n for (_, _, v), (_, n) in got.items() if v == token_rollup.VERSIONS[1])


def test_rollup_batches_are_idempotent(spark, tmp_path):
    store = token_rollup.RollupStore(spark, str(tmp_path / "s"))
    assert store.totals().collect() == []
    rows = spark.createDataFrame([("a", None, "v1", 5), ("a", None, "v1", None), ("b", "en", "v1", 2)], "source string, lang string, tokenizer string, tokens long")
    assert store.apply("1", token_rollup.inserts(rows)) and not store.apply("1", token_rollup.inserts(rows))
    spark.createDataFrame([("z", "z", "v1", 9, 9)], token_rollup.SCHEMA).write.parquet(str(tmp_path / "s/data/died"))  # never committed
    assert store.apply("2", token_rollup.deletes(rows.where("source = 'b'")))
    assert store.apply("3", token_rollup.revisions(rows.where("tokens = 5"), topk.F.lit(7))) and store.apply("4", token_rollup.inserts(rows.limit(0)))
    assert [tuple(r) for r in token_rollup.RollupStore(spark, str(tmp_path / "s")).totals().collect()] == [("a", None, "v1", 2, 7)]


# Pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    from tests.llm.test_dedup import components_of, plain_fingerprint

    docs, _ = labelled(spark, tmp_path, 300)
    rng = random.Random(1)
    long = prose(rng, 400)
    extra = [(1000, long, "en", "s", 0), (1001, long.upper(), "en", "s", 0), (1002, long + " ridge", "en", "s", 0), (1003, "write to a.b@c.de " + prose(rng, 30), "en", "s", 0)]
    docs = saved(spark, tmp_path / "more", docs.unionByName(spark.createDataFrame(extra, docs.schema)))
    docs = saved(spark, tmp_path / "documents.parquet", docs)
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(saved(spark, tmp_path / name, stage(spark, steps[-1], str(tmp_path))))
        assert steps[-1].columns == docs.columns
    rows = [listed(s) for s in steps]
    labels = {r["doc_id"]: r["predicted"] for r in listed(toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))))}
    assert {r["doc_id"] for r in rows[1]} == {i for i, p in labels.items() if not p}
    best = {}
    for r in rows[1]:
        key = (r["text"] or "").lower()
        best[key] = max(best.get(key, -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert {r["doc_id"] for r in rows[2]} == set(best.values())
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows[2]}
    root = components_of(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert {r["doc_id"] for r in rows[3]} == set(least.values())
    assert {r["doc_id"] for r in rows[4]} == {r["doc_id"] for r in rows[3]}
    assert "write to <email> " in next(r["text"] for r in rows[4] if r["doc_id"] == 1003)
    ids = dict(zip([r["doc_id"] for r in rows[4]], ids_by_library([r["text"] for r in rows[4]]), strict=True))
    got = {}
    for r in sorted(listed(corpus_pipeline.run(spark, str(tmp_path))), key=lambda r: (r["doc_id"], r["start"])):
        got[r["doc_id"]] = got.get(r["doc_id"], []) + np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist()
    assert got == ids


def test_empty_tables(spark, nothing, tmp_path):
    assert listed(packing.pack(nothing)) == [] and listed(pii.find_personal_data(nothing)) == [] and listed(pii.mask_personal_data(nothing)) == []
    assert listed(sentencepiece_codec.decode(sentencepiece_codec.encode(nothing))) == [] and listed(token_rollup.maintain(nothing, str(tmp_path / "r")).totals()) == []


def test_all_null_texts(spark, tmp_path):
    df = saved(spark, tmp_path / "n", spark.createDataFrame([(None,) * 9] * 3, SCHEMA))
    assert packing.pack(df).count() == 3 and pii.find_personal_data(df).count() == 3 and frame(spark).count() > 0


def test_discovery_has_no_length_limits(spark, tmp_path):
    rng = random.Random(13)
    key = "".join(rng.choice("abcdef0123456789") for _ in range(200))
    far = "w" * 120
    texts = [f"{prose(rng, 5)} reach me {'at'} u{i}x@mail.example.com or call {prose(rng, 4)}" for i in range(30)]
    texts += [f"a b mail {far} u{i}x@mail.example.com {far} ok" for i in range(30)]
    texts += [f"user=n;contact=u{i}x@mail.example.com;next=b" for i in range(30)]
    texts += [f"so reach me at {key} or call", "so reach me at 7 or call", f"x y mail {far} q7@intranet {far} ok", "user=n;contact=q7@intranet;next=b"]
    df = saved(spark, tmp_path / "d", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r["doc_id"]: r["text"] for r in listed(pii.mask_personal_data(df))}
    assert got[90] == "so reach me at <id> or call" and got[91] == "so reach me at <id> or call"
    assert got[92] == f"x y mail {far} <id> {far} ok" and got[93] == "user=n;contact=<id>;next=b"


def test_words_of_long_runs_stay_linear():
    for text in ("1.2.3.4/" * 40_000, "a=1;" * 80_000, "a@b.c," * 60_000, "1.2.3.4." * 40_000, "1" * 300_000):
        spans = pii.base_spans(text)
        places = [(s, e) for s, e, _ in spans] + list(pii.candidates(text, spans))
        words = pii.Words(text, places)
        assert all(len(pii.patterns_of(words, s, e)) <= 4 for s, e in places[:: max(1, len(places) // 1000)])
