"""Exact, line, substring and SimHash dedup against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gustfront.llm import common, exact_dedup, line_dedup, near_copies, pii, simhash, substring_dedup
from tests.llm.data import WORDS, awkward_texts, frame, prose, saved

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^ \t-\r]+")


def listed(df):
    return [r.asDict() for r in df.collect()]


def order(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0)


def test_exact_groups(docs):
    got = listed(exact_dedup.exact_groups(docs))
    texts = {}
    for r in docs.collect():
        texts.setdefault((r["text"] or "").translate(LOWER), []).append(r["doc_id"])
    assert len(got) == docs.count()
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in texts.items()}
    for r in got:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max(i for i in ids if i is not None or len(ids) == 1)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert docs.columns == exact_dedup.drop_copies(docs).columns
    assert exact_dedup.drop_copies(docs).count() == len(texts)


def test_exact_repeated_rows_leave_one(spark, tmp_path):
    df = saved(spark, tmp_path / "d", spark.createDataFrame([(1, "a"), (1, "A"), (1, "b"), (0, "b"), (None, "c"), (None, "c")], "doc_id long, text string"))
    assert sorted(r["text"].lower() for r in exact_dedup.drop_copies(df).collect()) == ["a", "b", "c"]


def test_directory_splits_until_buckets_fit():
    weights = {3: 50, 4: 50, 5: 1, 15: 7}
    directory = exact_dedup.build_directory(weights, 4, 20)
    held = {}
    for cell, bucket in enumerate(directory):
        held.setdefault(bucket, []).append(cell)
    assert directory == sorted(directory) and len({directory[3], directory[4], directory[5]}) == 3
    assert all(len(cells) == 1 or sum(weights.get(c, 0) for c in cells) <= 20 for cells in held.values())


def test_chain_keeps_texts_with_one_key_apart(spark):
    rows = [(0, 7, 1, 10, 2, b"a"), (0, 7, 5, 11, 1, b"b"), (0, 7, 3, 12, 4, b"a"), (0, 7, None, 99, 1, b"a"), (0, 8, None, 13, 1, b"c"), (0, 8, None, 14, 1, b"c")]
    got = exact_dedup.chains(spark.createDataFrame(rows, "bucket int, key long, doc_id long, rid long, n long, text binary").coalesce(1)).collect()
    assert sorted((r["key"], r["place"], r["keep_rid"], r["group_size"]) for r in got) == [(7, 0, 12, 7), (7, 1, 11, 1), (8, 0, 14, 2)]
    assert {r["keep_rid"]: r["keep_id"] for r in got} == {12: 3, 11: 5, 14: None}


def test_exact_rows_come_through_the_chains(spark, docs, monkeypatch):
    """Two texts forced onto one key and digest entry stay apart only by the byte comparison; without the chains nothing is returned."""
    monkeypatch.setattr(exact_dedup, "chains", lambda ordered: spark.createDataFrame([], "key long, place int, sha string, keep_id long, keep_rid long, group_size long"))
    assert exact_dedup.exact_groups(docs).count() == 0


CLASHING = ["__row", "__row_path", "__ROW_place", "__stays", "__found", "__spans", "rid", "key", "node", "root", "shingles"]


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, near_copies.drop_near_copies, simhash.drop_near_copies, pii.mask_personal_data])
def test_stages_take_columns_with_any_name(spark, tmp_path, stage):
    texts = ["write to a.b@mail.example.com " + prose(random.Random(n % 3), 60) for n in range(6)]
    df = spark.createDataFrame([(n, t, *["x"] * len(CLASHING)) for n, t in enumerate(texts)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    got = stage(saved(spark, tmp_path / "d", df))
    assert got.columns == df.columns and got.count() == (6 if stage is pii.mask_personal_data else 3)
    assert all(r["__row"] == "x" and r["__stays"] == "x" for r in got.collect())


def test_windows_of_one_shard_are_spread_over_ranges(spark):
    rows = [(5, n % 3 if n % 7 else None, n, n % 2) for n in range(2000)] + [(s, 1, s, 0) for s in range(10, 60)] + [(70, None, 1, 4), (70, None, 1, 3)]
    df = spark.createDataFrame(rows, "shard long, doc_id long, rid long, start int")
    got = sorted((r["rid"], r["start"]) for r in substring_dedup.not_first(df, 8).collect())
    first = min(((d is not None, d or 0), r, s) for k, d, r, s in rows if k == 5)
    assert got == sorted([(r, s) for k, d, r, s in rows if k == 5 and (r, s) != first[1:]] + [(1, 4)])


def test_crowd_with_a_shared_core_is_not_listed_as_pairs(spark, tmp_path, monkeypatch):
    asked = []
    plain = near_copies.checked
    monkeypatch.setattr(near_copies, "checked", lambda pairs, sets: (asked.append(pairs.count()), plain(pairs, sets))[1])
    core = " ".join(f"c{n}" for n in range(130))
    for size in (100, 300):
        rng = random.Random(size)
        texts = [core + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(70)) for _ in range(size)] + [core + " end"] * 2
        df = saved(spark, tmp_path / f"d{size}", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert near_copies.drop_near_copies(df).count() == size + 1
    assert sum(asked[2:]) < 4 * sum(asked[:2]) and sum(asked) < 5 * 400


def test_strays_beside_a_crowd_are_not_listed_as_pairs(spark, monkeypatch):
    """A crowd that lies in two components and strays that come close to it: the walk joins what is similar, a row for each joined component."""
    rng = random.Random(4)
    core = [rng.getrandbits(63) for _ in range(100)]
    sets = [sorted(core[:95] + [rng.getrandbits(63) for _ in range(5)]) for _ in range(120)] + [sorted(core[:88] + [rng.getrandbits(63) for _ in range(12)]) for _ in range(4)]
    sets += [sorted(core[:60] + [rng.getrandbits(63) for _ in range(40)]) for _ in range(20)]
    near = [(a, b) for a, b in combinations(range(len(sets)), 2) if near_copies.similar(*(near_copies.np.array(sets[k], dtype="uint64") for k in (a, b)))]
    known = {n: 0 if n < 60 else 60 if n < 120 else n for n in range(len(sets))}
    held = spark.createDataFrame([(n, near_copies.np.array(s, dtype="uint64").tobytes()) for n, s in enumerate(sets)], "node long, shingles binary")
    nodes = spark.createDataFrame(list(known.items()), "node long, root long")
    for block in (2000, 7):
        monkeypatch.setattr(near_copies, "BLOCK_NODES", block)
        got = [tuple(r) for r in near_copies.walked(near_copies.mixed_lists(near_copies.prefixes(nodes, held)), held).collect()]
        assert {tuple(sorted(p)) for p in got} <= set(near)
        classes = lambda pairs: components_of_pairs(len(sets), [*pairs, *known.items()])
        assert classes(got) == classes(near) != classes([])
        assert block == 7 or len(got) < len(sets)  # thousands of pairs lie across the components


def components_of_pairs(n, pairs):
    root = list(range(n))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(n)]


def plain_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_near_groups(docs):
    rows = docs.collect()
    fps = {i: plain_fingerprint(r["text"]) for i, r in enumerate(rows)}
    root = components_of(set(fps.values()))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root[fps[i]]] = min(least.get(root[fps[i]], r["doc_id"]), r["doc_id"])
    want = sorted((order(r.asDict()), f"{fps[i]:016x}", least.get(root[fps[i]])) for i, r in enumerate(rows))
    got = sorted((order(r), r["fingerprint"], r["component_id"]) for r in listed(simhash.near_groups(docs)))
    assert got == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))


@pytest.mark.parametrize("shard", [8, 64])
def test_trees_find_every_link(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(shard)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            fps.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 4, 5])):
                x ^= 1 << b
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["fp"]: r["root"] for r in simhash.components(simhash.links(nodes, len(signed))).collect()}
    want = components_of([f & (1 << 64) - 1 for f in signed])
    classes = lambda m: sorted(sorted(f & (1 << 64) - 1 for f in m if m[f] == v) for v in set(m.values()))
    assert classes({f: roots.get(f, f) for f in signed}) == classes(want)


def plain_repeats(rows):
    seen, out = set(), []
    for r in sorted(rows, key=order):
        words = WORD.findall(r["text"] or "")
        gone = set()
        for i in range(len(words) - 19):
            w = tuple(words[i : i + 20])
            if w in seen:
                gone.update(range(i, i + 20))
            seen.add(w)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((order(r), len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def passages(seed):
    rng = random.Random(seed)
    parts = [prose(rng, rng.choice([18, 19, 20, 21, 40])) for _ in range(5)] + ["to " * 25, "of the " * 15]
    return awkward_texts() + [" ".join(rng.choice(parts) if rng.random() < 0.5 else prose(rng, rng.randrange(1, 30)) for _ in range(6)) for _ in range(60)]


@pytest.mark.parametrize("seed,many", [(1, 2000), (2, 1), (3, 3)])
def test_substring_dedup(spark, tmp_path, monkeypatch, seed, many):
    monkeypatch.setattr(substring_dedup, "MANY_RUNS", many)
    monkeypatch.setattr(common.bounded, "__defaults__", (2000 * seed,))  # sliced batches
    monkeypatch.setattr(substring_dedup, "SLICE", 2000 * seed)
    monkeypatch.setattr(substring_dedup, "LONGEST_RUN", 7 if seed == 3 else 1 << 10)
    df = saved(spark, tmp_path / "d", frame(spark, passages(seed)))
    rows = listed(df)
    for n, r in enumerate(rows):
        r["doc_id"] = None if r["doc_id"] is None else n  # unique ids, so that brute force needs no tie rule
    df = saved(spark, tmp_path / "e", spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string"))
    got = sorted((order(r), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in listed(substring_dedup.remove_repeats(df)))
    assert got == plain_repeats(rows)


def test_repeated_windows_of_a_common_passage_are_stretches(spark, tmp_path, monkeypatch):
    """A passage of every text, in as many distinct runs, gives a row for each stretch and not one for each window."""
    monkeypatch.setattr(substring_dedup, "MANY_RUNS", 20)
    rng, size = random.Random(8), 200
    passage = " ".join(f"p{n}" for n in range(80))
    df = saved(spark, tmp_path / "d", spark.createDataFrame([(n, f"{prose(rng, 9)} u{n} {passage} v{n} {prose(rng, 9)}") for n in range(size)], "doc_id long, text string").coalesce(2))
    rows = common.numbered(df, "doc_id", "text", rid="doc_id")
    spans = substring_dedup.repeated_windows(substring_dedup.bucketed_texts(rows)).collect()
    assert sum(r["size"] for r in spans) == 61 * (size - 1) and len(spans) < 15 * size


def test_matching_statistics_equal_brute_force():
    rng = random.Random(9)
    automaton, before = substring_dedup.SuffixAutomaton(), []
    for _ in range(40):
        text = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        want = []
        for end in range(1, len(text) + 1):
            want.append(max(n for n in range(end + 1) if n == 0 or any(t[i : i + n] == text[end - n : end] for t in before for i in range(len(t) - n + 1)) or any(text[i : i + n] == text[end - n : end] for i in range(end - n))))
        assert automaton.stream(text) == want
        before.append(text)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line):
    at = rng.randrange(len(line))
    return rng.choice([line[:at] + line[at + 1 :], line[:at] + "q" + line[at:], line[:at] + "z" + line[at + 1 :]])


def test_line_dedup(spark, tmp_path):
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(1, 9)) for _ in range(25)]
    texts = awkward_texts()
    for _ in range(40):
        lines = [rng.choice(base) for _ in range(rng.randrange(1, 6))]
        texts.append("\n".join(edited(rng, x) if rng.random() < 0.5 else edited(rng, edited(rng, x)) if rng.random() < 0.3 else x for x in lines))
    df = saved(spark, tmp_path / "d", spark.createDataFrame([(None if i == 4 else i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    before, want = [], []
    for r in sorted(listed(df), key=order):
        lines, kept = (r["text"] or "").split("\n"), []
        gone = 0
        for line in lines:
            if line.strip():
                close = any(o == line or (min(len(o), len(line)) >= line_dedup.SHORTEST and abs(len(o) - len(line)) < 2 and distance(o, line) < 2) for o in before)
                before.append(line)
                if close:
                    gone += 1
                    continue
            kept.append(line)
        want.append((order(r), sum(bool(x.strip()) for x in lines), gone, "\n".join(kept)))
    texts_of = {r["doc_id"]: r["text"] or "" for r in listed(df)}
    got = [(order(r), r["n_lines"], r["n_removed"], texts_of[r["doc_id"]] if r["kept"] is None else r["kept"]) for r in listed(line_dedup.remove_lines(df))]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("a,b,near", [("abc", "abc", True), ("abc", "abd", True), ("abc", "abcd", True), ("abc", "xabc", True), ("abc", "acb", False), ("abc", "abcde", False), ("", "a", True)])
def test_one_edit(a, b, near):
    assert line_dedup.within_one_edit(a, b) is near and line_dedup.within_one_edit(b, a) is near


def test_empty_tables(nothing):
    for run in (exact_dedup.exact_groups, simhash.near_groups, substring_dedup.remove_repeats, line_dedup.remove_lines, exact_dedup.drop_copies, simhash.drop_near_copies):
        assert run(nothing).collect() == []


def plain_shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_drops_near_copies_of_080_and_more(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    texts = awkward_texts()
    for _ in range(40):
        words = [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(100)]
        for changes in (0, 1, 2, 3, 4):
            copy = list(words)
            for at in rng.sample(range(100), changes):
                copy[at] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    start = [f"{rng.choice(WORDS)}{i}" for i in range(300)]
    texts += [" ".join(start[i : i + 100]) for i in range(0, 150, 5)]  # a chain: only neighbours are near
    df = saved(spark, tmp_path / "d", spark.createDataFrame([(None if i == 4 else i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for a, b in combinations(range(len(texts)), 2):
        common_ = len(sets[a] & sets[b])
        if 5 * common_ >= 4 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
            far += (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() > 4
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), (True, len(texts))), (i == 4, i))
    got = corpus_pipeline.drop_near_copies(spark, df, "")
    assert got.columns == df.columns and far > 50
    assert sorted((r["doc_id"] is None, r["text"] or "") for r in got.collect()) == sorted((i == 4, texts[i] or "") for _, i in least.values())
    none = saved(spark, tmp_path / "n", df.limit(0))
    assert near_copies.drop_near_copies(none).collect() == []


@pytest.mark.parametrize("stage", ["exact", "near", "simhash", "mask", "lines"])
def test_splits_may_change_between_the_passes(spark, tmp_path, monkeypatch, stage):
    texts = [f"{'abcdefgh'[i % 8]}{i % 150} " * 3 + f"line\nwrite to u{i}@mail.example.com or call\n" + prose(random.Random(i % 150), 40) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    df.write.option("parquet.block.size", 1024).option("parquet.block.row.count.limit", 10).parquet(str(tmp_path / "d"))
    module, name, run = {
        "exact": (exact_dedup, "exact_groups", exact_dedup.drop_copies), "near": (near_copies, "signatures", near_copies.drop_near_copies),
        "simhash": (simhash, "near_groups", simhash.drop_near_copies), "mask": (pii, "find_personal_data", pii.mask_personal_data), "lines": (line_dedup, "lines_of", line_dedup.remove_lines),
    }[stage]
    kept = lambda d: sorted((r["doc_id"], r["kept"] if stage == "lines" else r["text"]) for r in d.collect())
    read = lambda: spark.read.parquet(str(tmp_path / "d"))
    want, first = kept(run(read())), getattr(module, name)

    def between(*given):
        out = common.stored(first(*given), "pass")  # the first pass ends here, with other splits than the next
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        return out

    monkeypatch.setattr(module, name, between)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
        got = kept(run(read()))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want


def test_slices_are_bounded_where_long_texts_lie_side_by_side():
    texts = ["x" * 50_000] * 60 + ["y"] * 6000 + ["z" * 300_000]
    batch = pa.RecordBatch.from_pydict({"text": texts, "n": list(range(len(texts)))})
    pieces = list(common.bounded(batch, 1 << 18))
    assert [x for p in pieces for x in p["n"].to_pylist()] == list(range(len(texts)))
    assert all(p.nbytes <= 1 << 18 or p.num_rows == 1 for p in pieces)
    assert list(common.bounded(batch.slice(0, 0))) == []


def test_bands_follow_the_formula_on_hashes_that_are_multiples():
    # a factor alone is no random order: zero is the least of every set, and of 0, d, 2d, ... the same few are least again and again
    u64, rng = near_copies.U64, np.random.default_rng(5)
    one, other = np.array([0, 3, 5, 7, 11, 13, 17, 19, 23], dtype=u64), np.array([0, *range(100, 108)], dtype=u64)
    assert not (near_copies.band_keys(one) == near_copies.band_keys(other)).all()
    least = near_copies.permuted(np.arange(16, dtype=u64)).argmin(axis=1)
    assert np.bincount(least, minlength=16).max() < 30  # 160 permutations, 10 each on average
    shared = []
    for _ in range(150):  # a similarity of 0.6: a band agrees with probability 0.6**5
        step, names = u64(rng.integers(1, 1 << 62)), rng.permutation(400).astype(u64)
        a, b = names[:80] * step, names[20:100] * step
        shared.append((near_copies.band_keys(np.sort(a)) == near_copies.band_keys(np.sort(b))).mean())
    assert abs(np.mean(shared) - 0.6**5) < 0.01
    whole = near_copies.permuted(np.arange(5000, dtype=u64))
    assert all(len(np.unique(row)) == 5000 for row in whole)
