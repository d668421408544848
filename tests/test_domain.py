"""Behaviours on small rows: segmentation, differences, pairing, tables, layouts, retries, archives."""

import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimp.functions import text as tx
from palimp.functions.worddiff import compared, word_diff
from palimp.operators import catalog, layout, lines, sections, segment, similarity, tables, versions
from palimp.sources import archive, paged

BODY = "texto da secao com palavras em minusculas " * 12


def leaflet(*numbers, kind="INFORMAÇÕES AO PACIENTE"):
    out = ["I - IDENTIFICAÇÃO DO MEDICAMENTO", "Produto X", "APRESENTAÇÕES", "Comprimidos de 10 mg USO ORAL", f"II - {kind}"]
    for n in numbers:
        out += [f"{n}. PARA QUE ESTE MEDICAMENTO SERVE?", BODY]
    return [*out, "III - DIZERES LEGAIS", "Registro 1"]


def test_one_document():
    ((kind, secs),) = segment.split_documents(leaflet(1, 2, 3))
    assert kind == "vp" and [s[1] for s in secs] == ["(preâmbulo)", "I", "II", "1", "2", "3", "III"]
    assert secs[2][2] == "" and secs[3][2] == BODY


def test_history_closes_and_second_document_opens():
    found = segment.split_documents([*leaflet(1, 2, 3), "Histórico de Alteração da Bula", "1. ISTO NÃO CONTA AQUI", "lixo", *leaflet(1, 2, 3, kind="INFORMAÇÕES TÉCNICAS AOS PROFISSIONAIS DE SAÚDE")])
    assert [k for k, _ in found] == ["vp", "vps"] and "lixo" not in json.dumps(found)


def test_out_of_order_short_and_unnumbered_heading_forms():
    assert segment.split_documents(leaflet(3, 1, 2)) == []
    assert segment.split_documents(["1. QUALQUER TITULO", "curto"]) == []
    ((_, secs),) = segment.split_documents([x.replace(". PARA", ") PARA") for x in leaflet(1, 2, 3)])
    assert "2" in [s[1] for s in secs]


def test_wrapped_title_is_dropped_and_glued_title_is_split():
    rows = leaflet(1, 2, 3)
    at = rows.index(BODY)
    ((_, secs),) = segment.split_documents([*rows[:at], "MEDICAMENTO?", *rows[at:]])
    assert secs[3][2] == BODY
    assert segment.unglued("1. INDICAÇÕES DE USO Hipertensão leve") == ["1. INDICAÇÕES DE USO", "Hipertensão leve"]
    assert segment.unglued("Apenas um texto") == ["Apenas um texto"]


def test_presentations_reopen_without_identification():
    found = segment.split_documents([*leaflet(1, 2, 3), "APRESENTAÇÕES", "Xarope", *leaflet(1, 2, 3)[4:]])
    assert len(found) == 2 and [s for s in found[1][1] if s[1] == "I"][0][2].startswith("APRESENTAÇÕES Xarope")


def test_word_diff_marks_counts_and_elides():
    whole, near, words, ratio = word_diff("a b c", "a x c")
    assert whole == near == "a <del>b</del> <ins>x</ins> c" and words == 2 and 0 < ratio < 1
    left, right = (" ".join(f"{c}{i}" for i in range(70)) for c in "lr")
    _, near, words, _ = word_diff(f"{left} ontem {right}", f"{left} hoje cedo {right}", 8)
    assert words == 3 and near.count("palavras iguais") == 2 and "54 palavras iguais" in near
    assert word_diff("a b\n\nc d", "a b\n\nc e")[2] == 2
    assert word_diff("a b c d", "a b\n\nc d")[2] == 0 and "<" not in word_diff("a b c d", "a b\n\nc d")[0].replace('<span class="pbr"></span>', "")
    many = "\n\n".join(f"item{i}" for i in range(40))
    assert re.search(r"(\d+) palavras iguais", word_diff(many + " fim", many + " final", 3)[1])[1] in ("36", "37")
    assert compared("x", "x") == ("", "", 0, 1.0) and compared("<a>", None)[0] == "<del>&lt;a&gt;</del>"


@pytest.mark.parametrize("a,b", [("um dois tres quatro", "um tres cinco"), ("", "novo texto"), ("a a a b", "b a a")])
def test_word_diff_reproduces_both_sides(a, b):
    html = word_diff(a, b)[0]
    drop = lambda tag: re.sub(r"</?(?:del|ins)>", "", re.sub(rf"<{tag}>.*?</{tag}>", "", html)).split()
    assert drop("ins") == a.split() and drop("del") == b.split()


def test_running_lines_headings_and_page_numbers(spark):
    rows = [(1, p, i + 1, x) for p in range(1, 4) for i, x in enumerate([f"Bula {p}", "DIZERES LEGAIS", f"texto {'abc'[p - 1]}", "Bula 9" if p == 2 else "meio", f"{p} de 3", "Rodape"])]
    got = lines.stripped(spark.createDataFrame(rows, "doc int, page int, pos int, line string"), ["doc"], ["doc", "page"]).orderBy("page", "pos").collect()
    kept = [r["line"] for r in got]
    assert kept.count("DIZERES LEGAIS") == 3 and "Rodape" not in kept and not any(re.fullmatch(r"\d de 3", x) for x in kept)
    assert "texto a" in kept and "Bula 1" not in kept


def test_quick_ratio_and_greedy(spark):
    import difflib

    pairs = [(1, "abcd", "bcde"), (2, "", ""), (3, "aab", ""), (4, "xyz xyz", "zyx")]
    got = {r["k"]: r["ratio"] for r in similarity.quick_ratio(spark.createDataFrame(pairs, "k int, a string, b string"), ["k"], "a", "b").collect()}
    assert got == {k: difflib.SequenceMatcher(None, a, b).quick_ratio() for k, a, b in pairs}
    scored = [(1, 0, 0, 5), (1, 0, 1, 9), (1, 1, 0, 9), (1, 1, 1, 2), (2, 0, 0, 3), (2, 1, 0, 3)]
    got = {(r["g"], r["documento"], r["i"], r["j"]) for r in similarity.greedy(spark.createDataFrame(scored, "g int, i int, j int, score int"), ["g"]).collect()}
    assert got == {(1, 1, 1, 0), (1, 2, 0, 1), (2, 1, 1, 0)}


def test_sections_beside_and_reports(spark):
    old = spark.createDataFrame([(1, "1", 0, "a b"), (1, "2", 1, "igual")], "k int, secao string, pos int, texto string")
    new = spark.createDataFrame([(1, "3", 0, "novo"), (1, "1", 1, "a c"), (1, "2", 2, "igual")], "k int, secao string, pos int, texto string")
    rows = sections.differences(sections.beside(old, new, ["k"])).withColumn("documento", F.lit(1)).withColumn("rotulo", F.lit("R")).withColumn("tipo", F.lit("vp"))
    got = {r["secao"]: (r["pos"], r["words"], r["changed"]) for r in rows.collect()}
    assert got == {"1": (1, 2, True), "2": (2, 0, False), "3": (3, 1, True)}
    assert sections.summary(rows, ["k"]).first()["summary"] == "1(2) 3(1)"
    assert "<del>b</del> <ins>c</ins>" in sections.html_report(rows, ["k"], "T").first()["report"]
    assert sections.nested(sections.with_anchors(rows, ["k"]), ["k"], ["secao", "ancora"]).first()["documentos"][0]["secoes"][0]["ancora"] == "sec-vp-1"


def test_history_rows(spark):
    raw = [(1, 1, ["Data do expediente"] + [""] * 9), (1, 2, ["01/02/2020", "1/20-5", "Inclusão", "", "", "", "", "5. ONDE", "VP", "x"]), (1, 3, ["", "", "", "", "", "", "", "6. COMO", "", "y"]), (1, 4, [""] * 10), (1, 5, ["03/04/2021", "2", "Outro", "", "", "", "", "3. QUANDO e DIZERES LEGAIS", "VPS", None])]
    cells = tables.cells(spark.createDataFrame(raw, "doc int, pos int, cells array<string>"), ["doc"])
    got = tables.entries(cells, ["doc"]).withColumn("secoes", tx.declared_sections(F.col("itens"))).orderBy("entry").collect()
    assert [(r["itens"], r["apresentacoes"], r["secoes"]) for r in got] == [("5. ONDE 6. COMO", "x y", ["5", "6"]), ("3. QUANDO e DIZERES LEGAIS", "", ["3", "III"])]
    asked = spark.createDataFrame([(1, "1/20-5"), (1, "--")], "doc int, expediente string")
    found = {r["expediente"]: r["entry"] for r in tables.by_digits(asked, tables.entries(cells, ["doc"]), ["doc"]).collect()}
    assert found == {"1/20-5": 1, "--": None}


def test_relistings(spark):
    rows = [("7", "P", "2018-02-01", "vps", "x"), ("7", "Q", "2018-06-15", "vps", "y"), ("7", "R", "2019-09-09", "vps", "z"), ("7", "Q", "2020-12-24", "vps", "y"), ("7", "P", "2021-01-31", "vps", "x")]
    listed = spark.createDataFrame(rows, "registro string, expediente string, data string, tipo string, hash string")
    assert [r["slug"] for r in versions.pairs(versions.chain(listed)).orderBy("para_data").collect()] == ["P-Q-vps", "Q-R-vps"]
    assert {r["expediente"]: r["republicada"] for r in versions.relisted(listed, "registro", "expediente").collect()} == {"P": ["2021-01-31"], "Q": ["2020-12-24"], "R": []}


def test_layout():
    glyphs = [(c, i * 5.0, i * 5.0 + 5, 10.0) for i, c in enumerate("ab cd")] + [("e", 0.0, 5.0, 30.0)]
    ws = layout.words(glyphs)
    assert [w[0] for w in ws] == ["ab", "cd", "e"] and layout.visual_lines(ws[::-1]) == ["ab cd", "e"]
    assert [w[0] for w in layout.words([("a", 0.0, 5.0, 1.0), ("b", 8.5, 13.0, 1.0), ("c", 13.5, 18.0, 9.0)])] == ["a", "b", "c"]


def test_retries():
    waits, times = [], iter(range(0, 1000, 5))
    outcomes = [paged.HttpError(503), paged.HttpError(429, "3"), ConnectionError(), {"content": [1], "last": True}]

    def fetch(params, timeout):
        x = outcomes.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    client = paged.Client(fetch, sleep=waits.append, clock=lambda: next(times))
    assert client.page()["content"] == [1] and waits == [2.0, 10.0, 8.0]
    with pytest.raises(paged.HttpError):
        paged.Client(lambda *_: (_ for _ in ()).throw(paged.HttpError(404)), sleep=waits.append).page()
    pages = {1: {"content": [1], "last": False}, 2: {"content": [2], "last": True}}
    assert [p["content"] for p in paged.Client(lambda p, _: pages[p["page"]], pace=0).pages()] == [[1], [2]]


def test_paged_source(spark):
    paged.register(spark)
    df = spark.read.format("paged").option("fetch", "tests.fake_service.fetch").option("count", "10").option("pace", "0").load()
    assert df.count() == 25 and df.where("cnpj = 'x'").count() == 12


@pytest.mark.parametrize("readers", [1, 3])
def test_readers_keep_the_pace(spark, tmp_path, monkeypatch, readers):
    monkeypatch.setenv("PALIMP_ASKED", str(tmp_path / "asked"))
    paged.register(spark)
    asked = tmp_path / "asked"
    reader = paged.PagedReader(spark.createDataFrame([], paged.SCHEMA).schema, {"fetch": "tests.fake_service.timed", "count": "4", "pace": "0.15", "readers": str(readers)})
    parts = reader.partitions()
    assert len(parts) == readers
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(readers) as pool:
        rows = [row for found in pool.map(lambda p: list(reader.read(p)), parts) for row in found]
    times = sorted(map(float, asked.read_text().split()))
    assert len(rows) == 25 and len(times) == 8 and all(b - a > 0.1 for a, b in zip(times, times[1:], strict=False))


def test_pages_and_fallbacks(spark):
    got = lines.text_pages(spark.createDataFrame([(1, "one\ftwo\f"), (2, "no end"), (3, "a\f\fb"), (4, None)], "doc int, text string"), ["doc"]).orderBy("doc", "page")
    assert [tuple(r) for r in got.collect()] == [(1, 1, "one"), (1, 2, "two"), (3, 1, "a"), (3, 2, "")]
    rows = spark.createDataFrame([(["m"], ["l"]), ([], ["l"]), (None, ["l"])], "m array<string>, l array<string>")
    assert [r["x"] for r in rows.select(archive.either(F.col("m"), F.col("l")).alias("x")).collect()] == [["m"], ["l"], ["l"]]


def test_deep_trees_and_loops(spark):
    n = 3000
    tree = [(1, i, "Span" if i % 1000 else "P", i - 1 if i else None) for i in range(n)] + [(2, 1, "Span", 2), (2, 2, "Span", 1), (3, 5, "Span", 99)]
    got = {(r["doc"], r["element_id"]): r["block"] for r in layout.owners(spark.createDataFrame(tree, "doc int, element_id int, tag string, parent_id int"), spark.createDataFrame([], "tag string, standard_tag string"), ["doc"]).collect()}
    assert all(got[1, i] == i // 1000 * 1000 for i in range(n)) and got[3, 5] == 5 and got[2, 1] in (1, 2) and len(got) == n + 3


def test_archive_files(spark, tmp_path):
    d = tmp_path / "100"
    d.mkdir()
    (d / "2024-01-02_77_vp.json").write_text(json.dumps({"registro": "100", "expediente": "77", "data": "2024-01-02", "tipo": "vp", "pdf_sha256": "h", "paginas": 1, "documentos": [{"tipo": "vp", "secoes": {"II": "b", "I": "a"}}], "historico_tabela": []}))
    (d / "meta.json").write_text(json.dumps({"produto": {"numeroRegistro": "0100", "idProduto": 1, "data": "2024-01-02T23:00:00.000-0300"}}))
    (row,) = archive.versions(spark, str(tmp_path)).collect()
    assert row["marcado"] is False and [s["secao"] for s in row["documentos"][0]["secoes"]] == ["II", "I"] and row["documentos_linhas"] == []
    assert archive.keys(spark, str(tmp_path)).first()["registro"] == "100"
    assert list(archive.listing(spark, str(tmp_path)).first()["textos"]) == ["vp"]
    assert archive.meta(spark, str(tmp_path)).first()["produto"]["numeroRegistro"] == "0100"
    f = tmp_path / "list.txt"
    f.write_text("900100200 # primeiro\n\n# so um comentario\n  900100300\n")
    assert [r["value"] for r in archive.curated(spark, str(f)).collect()] == ["900100200", "900100300"]
    assert archive.curated(spark, str(tmp_path / "none.txt")).count() == 0
    nested = spark.createDataFrame([((1, "t"), [(2, "u")])], "a struct<x:int,idBulaPaciente:string>, b array<struct<y:int,idBulaProfissional:string>>")
    assert archive.without_fields(nested).schema.simpleString() == "struct<a:struct<x:int>,b:array<struct<y:int>>>"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(tx.squeezed(F.lit(" a \t b\n"))) == "a b"
    assert one(tx.initial(F.lit("água"))) == "A" and one(tx.initial(F.lit("5-FU"))) == "0-9"
    assert one(tx.label(F.lit("Nome APRESENTAÇÕES : Comprimido 5 mg USO ORAL resto"), F.lit(None))) == "Comprimido 5 mg"
    assert one(tx.label(F.lit("x" * 40 + " " + "y" * 40), F.lit(""))) == "x" * 40 + "…"
    assert one(tx.in_order(F.array(*map(F.lit, ["III", "10", "2", "I", "zz", "2"])))) == ["I", "2", "10", "III", "zz"]
    assert one(tx.escaped(F.lit("<a & 'b' \"c\">"))) == "&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"
    missing = catalog.missing(spark.createDataFrame([(1, "vp", ["1", "2", "III"])], "k int, tipo string, secoes array<string>"), ["k"]).first()
    assert missing["faltando"] == ["3", "4", "5", "6", "7", "8", "9"]


def test_feed_replay_and_duplicates(spark, tmp_path):
    from palimp.streaming import feed

    src = tmp_path / "in"
    day = lambda n, rows: spark.createDataFrame(rows, "registro string, expediente string, ts timestamp").coalesce(1).write.parquet(f"{src}/d{n}")
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    day(1, [("1", "a", t(1)), ("1", "a", t(2)), ("2", "b", t(1))])
    stream = lambda: spark.readStream.schema("registro string, expediente string, ts timestamp").parquet(f"{src}/*")
    feed.run_available(stream(), f"{tmp_path}/t", f"{tmp_path}/c")
    day(2, [("1", "a", t(3)), ("3", "c", t(3))])
    seen = []
    feed.run_available(stream(), f"{tmp_path}/t", f"{tmp_path}/c", lambda new, _: seen.append(new.count()))
    assert seen == [1] and spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_sql_functions(spark):
    from palimp.functions.register import register

    register(spark)
    assert spark.sql("select word_diff('a b', 'a c').words as w").first()["w"] == 2
    spark.createDataFrame([(leaflet(1, 2, 3),)], "l array<string>").createOrReplaceTempView("leaflets")
    (doc,) = spark.sql("select split_documents(l) as d from leaflets").first()["d"]
    assert doc["tipo"] == "vp" and doc["secoes"][3]["secao"] == "1"


def test_splitting_holds_few_rows_at_once(spark, monkeypatch):
    """A batch goes through Python's objects in shares, with the same documents."""
    held, whole, array = [], segment.split_documents, pa.array
    rows = [leaflet(1, 2, 3), None, [], ["1. QUALQUER TITULO", "curto"], *[leaflet(*range(1, n)) for n in range(2, 9)]]
    monkeypatch.setattr(segment, "AT_ONCE", 3)
    split, batch = segment.split_column().func, pa.array([["x"], *rows], pa.list_(pa.string())).slice(1)
    monkeypatch.setattr(pa, "array", lambda x, kind: held.append(len(x)) or array(x, kind))
    (got,) = split(iter([batch]))
    assert got.type == segment.ARROW and max(held) == 3 and sum(held) == len(rows)
    assert [[(d["tipo"], [tuple(s.values()) for s in d["secoes"]]) for d in ds] for ds in got.to_pylist()] == [whole(x or []) for x in rows]


def test_owners_and_blocks(spark):
    tree = [(1, "r", "Document", None), (1, "p", "Custom", "r"), (1, "s", "Span", "p"), (1, "tr", "TR", "r"), (1, "td", "TD", "tr")]
    got = {r["element_id"]: (r["block"], r["row"]) for r in layout.owners(spark.createDataFrame(tree, "doc int, element_id string, tag string, parent_id string"), spark.createDataFrame([("Custom", "P")], "tag string, standard_tag string"), ["doc"]).collect()}
    assert got == {"r": ("r", None), "p": ("p", None), "s": ("p", None), "tr": ("tr", "tr"), "td": ("td", "tr")}
    signs = [(1, 1, 0, 0, "a", 0.0, 5.0, 1.0), (1, 1, 1, 0, "b", 5.0, 10.0, 1.0), (1, 1, 2, 1, "c", 0.0, 5.0, 20.0), (1, 1, 3, 2, "x", 0.0, 5.0, 40.0), (1, 1, 4, 3, "y", 30.0, 35.0, 40.0), (1, 1, 5, 9, "z", 0.0, 5.0, 60.0)]
    owned = [(1, 1, 0, "p", None), (1, 1, 1, "p", None), (1, 1, 2, "td", "tr"), (1, 1, 3, "td2", "tr")]
    got = layout.blocks(spark.createDataFrame(signs, "doc int, page int, seq int, mcid int, text string, x0 double, x1 double, top double"), spark.createDataFrame(owned, "doc int, page int, mcid int, block string, row string")).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["ab c", "x y"]


GLYPHS, OWNED = "doc int, page int, seq int, mcid int, text string, x0 double, x1 double, top double", "doc int, page int, mcid int, block string, row string"


@pytest.mark.parametrize("share", [1, 7, 100_000])
def test_blocks_by_shares(spark, monkeypatch, share):
    """Two documents over pages, with paragraphs and table rows that go on from page to page, equal a plain fold whatever a task takes."""
    monkeypatch.setattr(layout, "SHARE", share)
    rng, signs, owned, told = random.Random(3), [], [], []
    for doc in (1, 2):
        runs: list[tuple] = []
        for page in (1, 2, 3):
            seq = 0
            for mcid in rng.sample(range(20), 12):
                of = rng.choice([("p1", None), ("p2", None), (f"c{mcid}", "r1"), (None, None), None])
                if of:
                    owned.append((doc, page, mcid, *of))
                top = float(rng.randrange(4) * 10)
                for k in range(rng.randrange(1, 9)):
                    sign = (rng.choice("ab "), k * 5.0, k * 5.0 + 5, top)
                    signs.append((doc, page, seq, mcid, *sign))
                    seq += 1
                    if of:
                        name = of[1] and (True, of[1]) or (False, of[0])
                        if not runs or runs[-1][0] != name:
                            runs.append((name, []))
                        runs[-1][1].append(sign)
        texts = [t for (in_row, _), part in runs for t in (layout.visual_lines(layout.words(part)) if in_row else [" ".join(w[0] for w in layout.words(part))]) if t]
        told += [(doc, n, t) for n, t in enumerate(texts, 1)]
    got = layout.blocks(spark.createDataFrame(signs, GLYPHS), spark.createDataFrame(owned, OWNED)).orderBy("doc", "pos").collect()
    assert [tuple(r) for r in got] == told and len(told) > 20
    assert layout.blocks(spark.createDataFrame([], GLYPHS), spark.createDataFrame(owned, OWNED)).collect() == []


@pytest.mark.parametrize("small", [0, 30, 10_000])
def test_greedy_in_rounds_and_in_one_row(spark, small):
    """Groups of many ties, a long chain of scores that each hang on the one before, a null group, repeated and half-known scores."""
    rng = random.Random(8)
    rows = [(g, i, j, rng.randrange(4)) for g in (1, None) for i in range(9) for j in range(7) if rng.random() < 0.8]
    rows += [(2, k, k, 2 * k) for k in range(20)] + [(2, k, k + 1, 2 * k + 1) for k in range(20)]
    rows += [(3, 1, 1, 5), (3, 1, 1, 5), (3, 1, 1, 2), (3, 1, 2, None), (3, 2, 2, None), (3, None, 3, 9), (3, 3, None, 9)]
    want = []
    for g in (1, 2, 3, None):
        mine = sorted({r[1:] for r in rows if r[0] == g and None not in r[1:3]}, key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1]), reverse=True)
        used_i, used_j, n = set(), set(), 0
        for i, j, _ in mine:
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                n += 1
                want.append((g, n, i, j))
    schema = "g int, i int, j int, score int"
    got = similarity.greedy(spark.createDataFrame(rows, schema), ["g"], small=small).select("g", "documento", "i", "j").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(want) > 30
    assert similarity.greedy(spark.createDataFrame([], schema), ["g"], small=small).collect() == []


def test_two_columns_and_validity(spark):
    from palimp.operators import views

    html = 'a <del>b</del> <ins>c</ins> d<span class="pbr"></span>e <ins>f</ins>'
    got = [(r["antes"], r["depois"]) for r in sections.two_columns(spark.createDataFrame([(1, html)], "k int, html string"), ["k"]).orderBy("pos").collect()]
    assert got == [("a <del>b</del> d", "a <ins>c</ins> d"), ("e", "e <ins>f</ins>")]
    rows = [([1, 2, 3], True), ([2, 3], False), ([1, 3, 2], False), ([], True)]
    assert [r["x"] for r in spark.createDataFrame(rows, "n array<int>, y boolean").select(views.ascending(F.col("n")).alias("x")).collect()] == [y for _, y in rows]


def test_routes_and_expired_ids(spark):
    assert paged.route("https://a", {}) == ("https://a", {}) and paged.route("https://a", {"PALIMP_PROXY": "https://p/", "PALIMP_PROXY_KEY": "k"}) == ("https://p", {"x-proxy-key": "k"})
    assert [r["x"] for r in spark.createDataFrame([(400,), (403,), (404,)], "c int").select(paged.expired(F.col("c")).alias("x")).collect()] == [True, True, False]
