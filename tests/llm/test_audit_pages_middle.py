"""Filter audit, main text of pages and fill-in-the-middle against plain versions."""

import hashlib
import html
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gustfront.llm import fill_in_middle, filter_audit, html_extraction
from gustfront.llm.catalog import ORACLE, QUERIES
from tests.harness import compare
from tests.llm.data import SCHEMA, awkward_texts, frame, prose, rows, saved

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


# filter audit


def plain_audit(docs, labels):
    least = {}
    for r in docs:
        if r["doc_id"] is not None:
            text = r["text"] or ""
            least[text] = min(least.get(text, r["doc_id"]), r["doc_id"])
    good = {l[0] for l in labels if l[1] == 1}
    toxic = {l[0] for l in labels if l[2] == 1}
    parts = {}
    for r in docs:
        text, i = r["text"] or "", r["doc_id"]
        words = WORDS.findall(text)
        fails = set()
        fails |= {"A"} if len(words) < 100 else set()
        fails |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search("[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and i > least[text] else set()
        parts.setdefault(r["lang"] or "", []).append((fails, i in good if i is not None else False, i in toxic if i is not None else False))
    out = []
    for part, members in parts.items():
        shapley, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = members
            for n, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                shapley[f] += len(gone)
                failing = sum(f in m[0] for m in members)
                steps.append((f, [part, "".join(order), n, len(left), len(gone), failing - len(gone), sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone)]))
        out += [(*x, shapley[f]) for f, x in steps]
    return sorted(out)


def audited(spark, docs, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    return sorted(tuple(r) for r in filter_audit.audit(docs, marks).collect())


def audit_texts():
    rng = random.Random(3)
    wide = " ".join(f"w{n}" for n in range(120))
    head = prose(rng, 700)
    texts = awkward_texts() + [wide, wide, wide.upper(), wide + " 100%", head + " one", head + " two", head + " one", head]
    return texts + [f"crowd text {prose(random.Random(n % 40), 130)}" for n in range(160)]


def test_audit_equals_plain_version(spark, tmp_path):
    docs = saved(spark, tmp_path / "d", frame(spark, audit_texts()).unionByName(spark.createDataFrame([(7, "again", None, None, 0, 0, "", "", 0), (7, "again", "en", "s", 0, 0, "", "", 0), (None, "again", "xx", "s", 0, 0, "", "", 0)], SCHEMA)))
    labels = [(i, i % 2, (i % 5 == 0) * 1, "x") for i in range(0, 100, 2)] + [(4, 0, 1, None), (4, 1, None, None), (None, 1, 1, None), (9999, 1, 1, None)]
    want = plain_audit(docs.collect(), labels)
    assert any(w[5] for w in want) and any(w[-1] for w in want)
    assert audited(spark, docs, labels) == want


def test_audit_of_nothing(spark, nothing):
    assert audited(spark, nothing, []) == []


def test_audit_without_labels_and_one_hot_text(spark, tmp_path):
    texts = ["the very same text " * 30] * 300 + [None] * 50 + ["another"]
    docs = saved(spark, tmp_path / "d", frame(spark, texts).repartition(9))
    assert audited(spark, docs, []) == plain_audit(docs.collect(), [])


@pytest.mark.parametrize("parts", [1, 8])
def test_prefixes_cut_crowds_where_they_differ(spark, tmp_path, parts):
    head = "shared head " * 200  # longer than the heads looked at first
    texts = [f"{head}{n:05d} " + "tail " * 40 for n in range(400)] + [f"{n:03d}" * 300 for n in range(100)] + ["hot " * 500] * 50
    df = saved(spark, tmp_path / "d", spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    starts = filter_audit.adaptive_prefixes(df, parts)
    assert starts[0] == b"" and starts == sorted(set(starts)) and any(len(s) > len(head) for s in starts)
    total = sum(len(t) + filter_audit.NODE_BYTES for t in set(texts))
    capacity = max(16 << 10, total // (8 * parts))
    held = Counter()
    for t in set(texts):
        held[sum(s <= t.encode() for s in starts)] += len(t) + filter_audit.NODE_BYTES
    assert max(held.values()) <= 4 * capacity
    for other in filter_audit.repeated_texts(df, parts).collect():
        assert other["least"] == 500
    assert filter_audit.repeated_texts(df, parts).count() == 1


@given(st.lists(st.tuples(st.binary(max_size=6) | st.text("ab", max_size=9).map(str.encode), st.integers(-5, 5)), max_size=60))
def test_radix_trie(pairs):
    trie, want = filter_audit.RadixTrie(), {}
    for text, i in pairs:
        trie.insert(text, i)
        least, n = want.get(text, (i, 0))
        want[text] = min(least, i), n + 1
    assert list(trie.terminals()) == [(t, *want[t]) for t in sorted(want)]


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_fill_in_middle"])
def test_sql_twins_take_awkward_rows(spark, tmp_path, name):
    docs = saved(spark, tmp_path / "documents.parquet", frame(spark, audit_texts()).where("doc_id is not null"))
    saved(spark, tmp_path / "labels.parquet", spark.createDataFrame([(3, 1, 0), (3, None, 1), (6, 0, 1)], "doc_id long, quality int, toxic int"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert compare(spark, str(tmp_path), QUERIES[name], ORACLE[name], con) and docs.count()


# main text of pages

SENTENCE = "Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod."
PAGES = {
    "divisions": (f"<body><div id=header><a href=/>Home</a></div><div class='content'><h1>Title here</h1><div><p>{SENTENCE}</p><p>{SENTENCE}</p></div><div><p>{SENTENCE} more</p></div></div>"
                  f"<div class=sidebar><p>{SENTENCE * 3}</p></div><div id=comments><p>{SENTENCE * 9}</p></div><form>log in</form></body>", f"Title here\n{SENTENCE}\n{SENTENCE}\n{SENTENCE} more"),
    "plain": ("just text &lt;b&gt; here &amp;amp;", "just text <b> here &amp;"),
    "notice": (f"<body><div class='cookie-notice'>{SENTENCE}</div><main><h1>A</h1><p>{SENTENCE}<a href=x>link</a> tail<ul><li>one<li>two</ul></main><aside>{SENTENCE}</aside><footer>f</footer>", f"A\n{SENTENCE}link tail\none\ntwo"),
    "unclosed": ("<article><h1>T<p>a<p>b &nbsp; c<table><tr><td>1<td>2</table><!-- x", "T\na\nb c\n1\n2"),
    "script": ("<article><p>a</p><script>var x='</p><p>no';</script><style>p{}</style><p>b</p></article>", "a\nb"),
    "comments in article": (f"<article><p>{SENTENCE}</p><section class='reader-comments'><article class=comment><p>{SENTENCE * 4}</p></article></section></article>", SENTENCE),
    "links": ("<nav><a href=1>one</a></nav><div>" + "".join(f"<a href={n}>some linked words {n}</a> " for n in range(40)) + f"</div><div><p>{SENTENCE}</p><p>{SENTENCE}</p></div>", f"{SENTENCE}\n{SENTENCE}"),
    "two parts": (f"<body><div><p>{SENTENCE}</p><p>{SENTENCE}</p></div><div class=ad>{SENTENCE}</div><div><p>{SENTENCE} b</p><p>{SENTENCE} c</p></div></body>", f"{SENTENCE}\n{SENTENCE}\n{SENTENCE} b\n{SENTENCE} c"),
    "hidden": ("<article><p hidden>x</p><p style='display: none'>y</p><p aria-hidden=\"true\">z</p><p>seen</p></article>", "seen"),
    "head": ("<html><head><title>no</title><p>yes</html>", "yes"),
    "broken tag": ("<article><p>a < b and 3<4</p><p>c</p></article><a hre", "a < b and 3<4\nc"),
    "attributes": ("<article data-x='a>b' class=\"post has-sidebar\"><p title=\"</p>\">text</p></article>", "text"),
    "white space": ("<article><p>\n a \t b<br>c\r\n</p>loose  text<p></p><p> </p></article>", "a b c\nloose text"),
    "no text": ("<div><p></p></div>", ""), "empty": ("", ""), "none": (None, ""), "only comment": ("<!-- ", ""),
}


def test_pages_by_hand(spark):
    names = list(PAGES)
    df = spark.createDataFrame([(n if n else None, f"u{n}" if n % 2 else None, PAGES[k][0], "t", 5) for n, k in enumerate(names)] * 2, "page_id long, url string, html string, text string, n_chars int")
    got = html_extraction.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(n if n else None, f"u{n}" if n % 2 else None, PAGES[k][1], len(PAGES[k][1])) for n, k in enumerate(names)] * 2
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert html_extraction.extract(df.limit(0)).collect() == []


def test_pages_of_the_tables(spark):
    found = {r["page_id"]: r["text"] for r in QUERIES["op12_html_extraction"](spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S).group(1)
        blocks = re.sub(r"</?b>", "", inner.replace("<br>", " "))
        lines = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", blocks)]
        assert found[p["page_id"]] == "\n".join(x for x in lines if x)


@pytest.mark.parametrize("page", ["<b>" * 30000 + "x" + "</i>" * 30000, "<a " * 100000, '<a "' * 100001, "<" * 200000, "<div><p>" * 20000 + "y", "<!--" * 100000, "<p>" + "z " * 300000])
def test_hostile_pages_end(page):
    text = html_extraction.main_text(page)
    assert len(text) <= len(page)
    if page.endswith("y"):
        assert text == "y"


def test_density_falls_with_links():
    whole = html_extraction.composite(1000, 10, 0, 0, 0.1)
    some, most = html_extraction.composite(1000, 10, 300, 3, 0.1), html_extraction.composite(1000, 10, 990, 9, 0.1)
    assert whole > some > most >= 0 == html_extraction.composite(0, 1, 0, 0, 0.0)
    assert whole > html_extraction.composite(1000, 40, 0, 0, 0.1)


# fill in the middle


def plain_example(doc_id, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    return (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_middles_equal_plain_version(spark, tmp_path):
    texts = awkward_texts() + [f"a {n}\n\nb<P\n>🙂{n}\n" * (n % 7) for n in range(60)] + ["x <P> y\n", "<S>", "a\n<M>", "\n", "\n\n\n", "no end", "<", "<\n<", "x<\n<S"]
    df = saved(spark, tmp_path / "d", frame(spark, texts))
    got = fill_in_middle.transform(df).collect()
    want = [(r[0], *plain_example(r[0], r[1] or ""), r[1] or "") for r in rows(texts)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fill_in_middle.transform(df.limit(0)).collect() == []


def test_rates_and_units(spark, docs):
    assert {r["form"] for r in fill_in_middle.transform(docs, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in fill_in_middle.transform(docs, spm=100).collect()} == {"plain", "spm"}
    for unit in fill_in_middle.UNITS:
        for r in fill_in_middle.transform(docs, unit=unit).collect():
            assert r["restored"] == fill_in_middle.restore(r["output"], r["form"])
    with pytest.raises(ValueError):
        fill_in_middle.Cutter([], "page")


PARTS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s)."}


@given(st.lists(st.text("ab \n\té🙂\r\x0b", max_size=25), max_size=7), st.data())
def test_cuts_by_unit(texts, data):
    for unit in fill_in_middle.UNITS:
        cutter = fill_in_middle.Cutter(texts, unit)
        if unit == "word":
            starts = [[m.start() for m in WORDS.finditer(t)] for t in texts]
            ends = [[0, *s[1:], len(t)] if s else [0] for s, t in zip(starts, texts)]
        else:
            ends = [[0, *np.cumsum([len(x) for x in re.findall(PARTS[unit], t)]).tolist()] for t in texts]
        assert cutter.counts.tolist() == [len(e) - 1 for e in ends]
        picks = [data.draw(st.integers(0, len(e) - 1)) for e in ends]
        assert cutter.after(np.array(picks, dtype=np.int64)).tolist() == [e[k] for e, k in zip(ends, picks)]


@given(st.lists(st.integers(0, 3), max_size=80))
def test_wavelet_matrix(symbols):
    row = np.array(symbols, dtype=np.uint8)
    matrix = fill_in_middle.WaveletMatrix(row)
    for s in range(4):
        places = np.flatnonzero(row == s)
        assert matrix.rank(s, np.arange(len(row) + 1)).tolist() == [int((row[:i] == s).sum()) for i in range(len(row) + 1)]
        assert matrix.select(s, np.arange(len(places))).tolist() == places.tolist()
