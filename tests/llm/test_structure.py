"""Operators 11 to 13: main text on pages with labels, periodic runs and prefix tries against brute force."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimp.llm import maintext, prefix_trie, queries, repetition

from .helpers import ODD, documents, sentence

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{a:"</p>"}</style><script>var t="<p>no</p>";</script></head>
<body class="with-sidebar"><header><a href="/">The Site</a></header><nav><ul><li><a href=/a>Home<li><a href=/b>News</ul></nav>
<div class="cookie-notice"><p>We use cookies to improve this site, as others do.</p><button>Accept</button></div>
<main><article><h1>A &lt;Title&gt;</h1><p>First&nbsp;paragraph,
 with <b>bold</b><i>ness</i>.<p>Second one<br>goes on &amp on.
<div class="ad">Buy this now, it is cheap.</div><aside><h3>Related</h3><ul><li><a href="/x">Another story</a></ul></aside>
<ul><li>One<li>Two</ul><blockquote>Said so.</blockquote><table><tr><td>a<td>b</table>
<form><label>Your mail</label><input><button>Send</button></form><!-- a <p>comment</p> --></article>
<section id="comments"><h2>Comments</h2><p>I liked this article, it was good.</p><p>I did not, it was bad.</p></section></main>
<aside class="sidebar"><p>Most read stories of the week.</p></aside><footer><p>&copy; 2024 The Site. All rights reserved.</p></footer>"""
TEXT = "A <Title>\nFirst paragraph, with boldness.\nSecond one goes on & on.\nOne\nTwo\nSaid so.\na\nb"


def test_main_text_of_a_page(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x"), (4, "u", "plain text only", "x"), (5, "u", "<article><p>a<p>b", "x"), (5, "u", "<article><p>a<p>b", "x"), (6, "u", "<article><h1>t</h1><p>" + "long words, " * 20_000 + "</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["url"], r["text"]) for r in maintext.extract(pages).collect()), key=str)
    assert got[0] == (1, "u", TEXT)
    assert (2, None, "") in got and (None, "u", "") in got
    assert [g[2] for g in got if g[0] == 5] == ["a\nb"] * 2
    assert [g[2] for g in got if g[0] == 6] == ["t\n" + ("long words, " * 20_000).strip()]
    assert maintext.extract(pages.limit(0)).collect() == []


def test_field_on_held_out_pages():
    """Pages made with another seed: layouts are drawn anew, the words too."""
    field, right, total = maintext.trained(), 0, 0
    for page, labels in maintext.labelled_pages(200, seed=41):
        found = maintext.blocks(page)
        assert len(found) == len(labels)
        right += sum(a == b for a, b in zip(field.labels(found), labels, strict=True))
        total += len(labels)
    assert right / total > 0.99


def test_field_by_brute_force():
    """Viterbi finds the best of all label sequences; without pages there is a field as well."""
    rng = random.Random(2)
    field = maintext.Field({"bias": -0.3, "a": 1.0, "b": -2.0, "c": 0.4}, np.array([0.1, -0.4]), np.array([[0.3, -0.6], [-0.2, 0.9]]))
    for _ in range(200):
        page = [maintext.Block("x", rng.sample(["a", "b", "c", "unseen"], rng.randint(0, 3))) for _ in range(rng.randint(1, 8))]
        scores = field.scores(page)

        def value(labels, scores=scores):
            return field.start[labels[0]] + sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(field.steps[a, b] for a, b in zip(labels, labels[1:], strict=False))

        best = max(([bool(k >> i & 1) for i in range(len(page))] for k in range(1 << len(page))), key=lambda y: value([int(v) for v in y]))
        assert value([int(v) for v in field.labels(page)]) == pytest.approx(value([int(v) for v in best]))
    assert maintext.train([]).labels([]) == []


def test_pages_of_the_table():
    """On the given pages the main text is what stands in the article."""
    import html
    import re

    import pyarrow.parquet as pq

    field = maintext.trained()
    for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1].replace("<br>", " ")
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        found = maintext.blocks(r["html"])
        assert "\n".join(b.text for b, y in zip(found, field.labels(found), strict=True) if y) == "\n".join(x for x in parts if x)


@pytest.mark.parametrize("page", ["<i>" * 100_000 + "</b>" * 100_000, "<a<a<a" * 50_000, '<div class="x">' * 100_000 + "t", '<p x="' * 100_000, "<li>" * 100_000, "<script>" * 100_000, "<!--" * 100_000, "<td><table>" * 50_000, "<a>" * 100_000, "<p><div>" * 50_000])
def test_odd_markup_in_linear_time(page):
    began = time.monotonic()
    maintext.blocks(page)
    assert time.monotonic() - began < 20


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/pabdiv&; \n\"'=!-x", max_size=200))
def test_any_markup(page):
    found = maintext.blocks(page)
    assert all(b.text == " ".join(b.text.split()) and b.text for b in found)


def slow_runs(w):
    """Every lag, every place; a stretch is a run of the smallest lag that covers it."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and j > i and not any(s <= i and s + n >= i + length and q % p == 0 for s, n, p in found):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive(rng, most=120):
    n = rng.randint(0, most)
    w = [rng.randrange(rng.choice([1, 2, 3, 5, 20])) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 8:
            s, p = rng.randrange(n), rng.randint(1, n // 4)
            for i in range(s + p, min(n, s + p * rng.randint(3, 9) + rng.randint(0, p))):
                w[i] = w[i - p]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    total = 0
    for _ in range(3000):
        w = repetitive(rng)
        expected = slow_runs(w)
        total += len(expected)
        assert repetition.runs(np.array(w, np.int64), light=rng.choice([None, 0, 2, 5])) == expected
    assert total > 1500


def test_lag_counts_heavy_and_light():
    rng = np.random.default_rng(1)
    for light in (0, 3, 30, 1000):
        w = np.minimum(rng.zipf(1.4, 500), 40).astype(np.int64)
        assert repetition.lag_counts(w, 125, light).tolist() == [0, *(int((w[q:] == w[:-q]).sum()) for q in range(1, 126))]


def slow_row(doc_id, text):
    """op12's contract, word by word."""
    w = text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if text else []
    w = [x for x in w if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = slow_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    top = None
    for r in found:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(9)
    short = [None if x is None else x[:400] for x in ODD]
    texts = [*short, "no " * 300, "a b " * 50 + "c", *(" ".join(f"w{x}" for x in repetitive(rng)) for _ in range(60)), *(sentence(rng, rng.randint(1, 200)) for _ in range(60))]
    documents(spark, [*texts, *texts[:5]]).unionByName(documents(spark, texts[20:24]).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n", "h", "score", "size")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    expected = [slow_row(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    assert got == sorted(expected, key=str)
    assert sum(r[1] > 0 for r in got) > 30


def test_collapse_gives_texts_and_runs(spark):
    rows = spark.createDataFrame([("k", "x a b a b a b a b y", "clash"), (None, None, "clash")], "id string, text string, runs string")
    got = {r["id"]: r for r in repetition.collapse(rows, key="id").collect()}
    assert got["k"]["collapsed"] == "x a b y" and [tuple(r) for r in got["k"]["runs"]] == [(1, 8, 2)] and tuple(got["k"]["greatest"]) == (1, 8, 2)
    assert got[None]["collapsed"] == "" and got[None]["runs"] == [] and got[None]["greatest"] is None
    assert repetition.collapse(rows.limit(0), key="id").collect() == []


def test_long_texts_take_no_quadratic_time():
    rng = np.random.default_rng(0)
    began = time.monotonic()
    assert repetition.runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    assert repetition.runs(np.tile(rng.integers(0, 30, 2000), 100)) == [(0, 200_000, 2000)]
    repetition.runs(np.minimum(rng.zipf(1.3, 300_000), 50_000).astype(np.int64))
    assert time.monotonic() - began < 60


def slow_trie(rows):
    """All prefixes of all rebuilt conversations, by sets."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple((r, x) for _, _, r, x in sorted(own.get(donor, []))[:h] + sorted(own[c])[h:])
    members, children, leaves, saved = defaultdict(list), defaultdict(set), defaultdict(int), defaultdict(int)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        told = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, 60):
        if rng.random() < 0.15:
            continue
        opening = [("user", "hi"), ("a", "é" * rng.randint(0, 1)), ("u", None)][: rng.randint(0, 3)]
        for i in range(rng.randint(1, 12)):
            role, text = opening[i] if i < len(opening) else (rng.choice(["u", "a", None]), rng.choice(["x", "yy", "ü", None, ""]))
            rows.append((c, i if i or rng.random() < 0.7 else None, role, text))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    return [*rows, (None, 1, "a", "b")]


KINDS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most", [prefix_trie.MOST, 5])
def test_trie_equals_brute_force(spark, most, tmp_path, monkeypatch):
    """Also in parts of five turns, so that first turns are divided again and again."""
    monkeypatch.setattr(prefix_trie.trie, "__kwdefaults__", {"most": most, "bucket": 8})
    rows = talk(most)
    spark.createDataFrame([(*r, 1, "x") for r in rows], KINDS + ", depth int, n string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_prefix_trie(spark, str(tmp_path)).select(*prefix_trie.COLUMNS, "ends_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_trie(rows)


def test_trie_of_copies_and_long_conversations(spark, monkeypatch):
    """Many equal conversations, one long one, turnless ones, and none; strings of three ids."""
    monkeypatch.setattr(prefix_trie, "IDS", 3)
    turn = lambda i: {"x": f"{i:032x}", "n": i}
    rows = [(c, [turn(1), turn(2)]) for c in range(40)] + [(100, [turn(i % 7) for i in range(900)]), (101, []), (102, []), (103, [turn(1)])]
    data = spark.createDataFrame(rows, "conv_id long, turns array<struct<x:string,n:long>>")
    for most in (4, 4096):
        got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(data, most=most).collect()}
        sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert len(got) == 903
        assert got[0, 0][2:] == (None, 44, 2, 2, 0 + 40 * 1 + 39 * 2, sha([101, 102]))
        assert got[0, 1][2:] == (0, 41, 1, 1, 40 + 39 * 2, sha([103])) and got[0, 2][2:] == (0, 40, 0, 1, 78, sha(range(40)))
        assert got[100, 900][2:] == (100, 1, 0, 1, 0, sha([100])) and got[100, 1][2:] == (0, 1, 1, 1, 0, sha([]))
    assert prefix_trie.trie(data.limit(0)).collect() == []
    alone = prefix_trie.trie(data.where("conv_id = 101")).collect()
    assert [tuple(r) for r in alone] == [(101, 0, None, 1, 0, 1, 0, sha([101]))]
