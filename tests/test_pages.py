"""Blocks and tables of pages by table functions, drifting JSON, and lookups in the index on disk."""

import math
import random

import pyarrow as pa
import pytest

from palimp.functions import markup
from palimp.functions.register import beside, blocks_from_html, register
from palimp.operators import details, grids, postings

PAGE = """<!DOCTYPE html><title>no</title><body>Top<nav><ul><li><a href=x>Home</a><li>News<ul><li>Deep</ul></ul></nav>
<article><header><h1>T &amp; <i>U</i></h1></header><p>One<br>two <b>bold<p>Next</b> one<div>Outer<div>Inner</div>after</div><script>"<p>no"</script>
<table><tr><td>a<td>b</table></article></p></section><footer>&copy; End <!-- <p>no</p> -->"""


def test_leaf_blocks():
    got = [(tag, region, text) for _, tag, region, _, text in markup.blocks(PAGE)]
    assert got == [("body", "", "Top"), ("li", "nav", "Home"), ("li", "nav", "News"), ("li", "nav", "Deep"), ("h1", "header", "T & U"), ("p", "article", "One two bold"), ("p", "article", "Next one"), ("div", "article", "Outer"), ("div", "article", "Inner"), ("div", "article", "after"), ("td", "article", "a"), ("td", "article", "b"), ("footer", "footer", "© End")]
    assert [b[0] for b in markup.blocks(PAGE)] == list(range(1, 14)) and markup.blocks(None) == markup.blocks("<p>") == []
    depth = {text: d for _, _, _, d, text in markup.blocks(PAGE)}
    assert (depth["Outer"], depth["Inner"], depth["after"]) == (3, 4, 3)


def test_table_function_in_sql(spark):
    register(spark)
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "k int, html string")
    rows.createOrReplaceTempView("some_pages")
    got = spark.sql("select k, b.pos, b.text from some_pages p, lateral blocks_from_html(p.html) b order by k, pos").collect()
    assert len(got) == 13 and got[0]["text"] == "Top"
    assert beside(rows, ["k"], blocks_from_html).count() == 13
    cells = spark.sql("select texto from some_pages p, lateral tables_from_html(p.html) t where p.k = 1").collect()
    assert [r["texto"] for r in cells] == ["a", "b"]


@pytest.mark.parametrize(
    "html,expected",
    [
        ("<table><tr><td>a<td>b<tr><td>c</table>", [["a", "b"], ["c"]]),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", [["a", "b"], ["a", "c"], ["d", "e"]]),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td rowspan=2>d<td>e<tr><td>f<td>g</table>", [["a", "a", "b"], ["c", "d", "e"], ["f", "d", "g"]]),
        ("<table><tr><td rowspan=0>a<td>1<tr><td>2<tr><td>3</table>", [["a", "1"], ["a", "2"], ["a", "3"]]),
        ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c</table>", [["a", "a", "b"], ["a", "a", "c"]]),
        ("<table><thead><tr><th>h<tbody><tr><td>x<br>y &lt; z<p>p", [["h"], ["x y < z p"]]),
        ("<table><tr><td>1<td rowspan=3>s<tr><td colspan=1>2<tr></table>", [["1", "s"], ["2", "s"], ["s"]]),
    ],
)
def test_grids(html, expected):
    found = {}
    for table, row, column, text, _, _ in markup.grids(html):
        assert table == 1
        found.setdefault(row, {})[column] = text
    assert [[t for _, t in sorted(found[r].items())] for r in sorted(found)] == expected


def test_tables_in_cells_and_large_spans():
    got = [(t, r, c, x) for t, r, c, x, *_ in markup.grids("<table><tr><td>out<table><tr><td>in</table>side<td colspan=99999>z</table>") if c < 4]
    assert got == [(1, 1, 1, "out side"), (1, 1, 2, "z"), (1, 1, 3, "z"), (2, 1, 1, "in")]
    assert len(markup.grids("<table>" + "<tr><td rowspan=65534>x" * 300)) == 300 * 301 // 2
    assert markup.grids("<tr><td>no table</td></tr>") == []


def test_declaration_tables(spark):
    head = "<table><tr><th>Data do expediente<th>N" + "<th>x" * 8
    row = "<tr><td>01/02/2020<td>12/3<td>Inclusão<td><td><td><td><td>5. ONDE<td>VP<td>a"
    more = "<tr><td colspan=3><td colspan=4><td>6. COMO<td><td>b</table><p>" + "<table><tr><td><td><td><td><td><td><td><td>7. QUEM<td><td>c</table>"
    pages = spark.createDataFrame([(1, head + row + more), (2, "<p>none")], "k int, html string")
    (got,) = grids.declared(pages, ["k"]).collect()
    assert (got["k"], got["data"], got["itens"], got["versoes"], got["apresentacoes"]) == (1, "01/02/2020", "5. ONDE 6. COMO 7. QUEM", "VP", "a b c")


def test_details(spark):
    rows = [(1, '{"principioAtivo":"x","atcs":["a"],"apresentacoes":[{"apresentacao":" y ","viasAdministracao":["oral"]},7]}'), (2, "[]"), (3, None), (4, "{"), (5, '{"principioAtivo":{"a":1},"atcs":null,"apresentacoes":{"a":1},"categoriaRegulatoria":5}')]
    got = {r["k"]: r for r in details.summary(spark.createDataFrame(rows, "k int, j string"), "j", ["k"]).collect()}
    assert got[1]["principio_ativo"] == "x" and got[1]["atcs"] == ["a"] and [a["apresentacao"] for a in got[1]["apresentacoes"]] == ["y", ""] and got[1]["apresentacoes"][0]["vias"] == ["oral"]
    assert all(got[k]["principio_ativo"] == "" and got[k]["apresentacoes"] == [] and got[k]["atcs"] == [] for k in (2, 3, 4, 5)) and got[5]["categoria"] == "5"
    shape = details.shapes(spark.createDataFrame(rows, "k int, j string"), "j", []).first()
    assert shape["n"] == 3


def test_index(spark, tmp_path):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("the a B c d é 12 the the".split()) for _ in range(rng.randint(0, 40))) for i in range(60)} | {60: None, 61: "A b, a-B!"}
    path = f"{tmp_path}/i"
    postings.build(spark.createDataFrame(list(texts.items()), "doc_id int, text string"), path, buckets=16)
    words = {i: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()] for i, t in texts.items()}
    for asked in (["the"], ["a", "b"], ["The", "the", "C"], ["a", "b", "a", "b"], ["none"]):
        low = [w.lower() for w in asked]
        expected = {i: n for i, w in words.items() if (n := sum(w[k : k + len(low)] == low for k in range(len(w))))}
        assert {r["doc"]: r["n"] for r in postings.phrase(spark, path, asked).collect()} == expected
    mean = sum(map(len, words.values())) / len(words)
    score = lambda w, q: sum(math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(q) if (df := sum(t in v for v in words.values())))
    best = sorted(((round(score(w, ["é", "12"]), 9), -i) for i, w in words.items() if {"é", "12"} & set(w)), reverse=True)[:7]
    got = postings.ranked(spark, path, ["é", "12", "é"], 7).collect()
    assert [r["doc"] for r in got] == [-i for _, i in best] and [r["score"] for r in got] == pytest.approx([s for s, _ in best])
    assert postings.ranked(spark, path, ["none"]).collect() == [] and postings.phrase(spark, path, []).count() == 0
    plan = postings.postings(spark, path, ["the"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(token), EqualTo(token,the)]" in plan
    postings.build(spark.createDataFrame([], "doc_id int, text string"), f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e/about").first()["documents"] == 0


@pytest.mark.parametrize("share", (1, 7, 200_000))
def test_postings_are_made_by_shares(monkeypatch, share):
    """However many documents a batch holds, few tokens are held at once."""
    monkeypatch.setattr(postings, "SHARE", share)
    rng = random.Random(3)
    docs = [[rng.choice("abcdé") for _ in range(rng.choice((0, 1, 5, 30)))] for _ in range(50)] + [[]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 151)), pa.array(docs, pa.list_(pa.string()))], names=["doc", "t"]).slice(1)
    made = list(postings._posted(iter([batch])))
    assert max(sum(b.column("tf").to_pylist()) for b in made) <= share + 30
    got = sorted((r["doc"], r["token"], r["tf"], r["places"], r["size"]) for b in made for r in b.to_pylist())
    assert got == sorted((100 + i, w, d.count(w), [k for k, x in enumerate(d) if x == w], len(d)) for i, d in enumerate(docs) if i for w in set(d))


def test_building_leaves_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get(postings._BATCH)
    postings.build(spark.createDataFrame([(1, "a b a")], "doc_id int, text string"), f"{tmp_path}/i", buckets=2)
    assert spark.conf.get(postings._BATCH) == before and spark.read.parquet(f"{tmp_path}/i/postings").count() == 2


def test_plain_tables_equal_the_full_reader():
    """Random tags, well nested or not: what the short way reads, the long one reads alike; plain tables go the short way."""
    def full(page):
        state = markup._Grids()
        state.feed(page)
        while state.stack:
            state._end_row()
            state.stack.pop()
        return sorted(state.found)

    rng, short = random.Random(5), 0
    pieces = ["<tr>", "<tr>", "<td>", "<td>", "<td>", "<th>", "</td>", "</th>", "</tr>", "</table>", "<table>", "<p>", "</p>", '<td rowspan="2">', "<td colspan=2>", "<th rowspan=0>", '<td colspan="2" rowspan="3">', "<b>", "<!-- -->"]
    for _ in range(20_000):
        page = "<p>a<table>" + "".join(rng.choice(pieces[: rng.choice((6, 9, 17, 19))]) + rng.choice(("", "x", " a  b ", "&amp;c", "&lt")) for _ in range(rng.randint(0, 12)))
        plain = markup._plain_grids(page)
        short += plain is not None
        assert plain is None or plain == full(page), page
        assert markup.grids(page) == full(page)
    assert short > 5000
    assert markup._plain_grids('<p>Pedido<table><tr><th>a<th>b<tr><td rowspan="2">1<td>2<tr><td>3<tr><td colspan=2>fim &amp; total</table>') is not None
    assert all(markup._plain_grids(x) is None for x in ("<table><tr><td>a<br>b", "<table><tr><td title='>'>b", "<table><tr><td>1 < 2", "<table><TR><td>"))


@pytest.mark.parametrize("most", (1, 20_000))
def test_grid_by_shares(spark, monkeypatch, most):
    monkeypatch.setattr(grids, "AT_ONCE", most)
    rows = spark.createDataFrame([(i, "x", "<table>" + "<tr><td>a<td>b" * i if i % 3 else None) for i in range(10)], "k int, other string, page string")
    got = grids.grid(rows, ["other", "k"], "page")
    assert got.columns == ["other", "k", "tabela", "linha", "coluna", "texto", "cabecalho", "propria"]
    assert sorted((r["k"], r["linha"], r["coluna"], r["texto"]) for r in got.collect()) == [(i, n + 1, c + 1, "ab"[c]) for i in range(10) if i % 3 for n in range(i) for c in range(2)]
