"""An archive of files, from reading to the five outputs."""

import json

import pytest

from palimp.operators import export
from palimp.sources import archive


def version(root, exp, day, text, digest, kind="vp", items="1. PARA QUE", docs=1, **more):
    parts = [{"tipo": kind, "secoes": {"(preâmbulo)": "p", "I": f"Nome APRESENTAÇÕES Forma {n} USO ORAL", "1": f"{text} forma {n}", "2": "igual"}} for n in range(docs)]
    body = {"registro": "1", "expediente": exp, "data": day, "tipo": kind, "pdf_sha256": digest, "paginas": 1, "documentos": parts, "historico_tabela": [{"data": "x", "itens": items}], **more}
    (root / f"{day}_{exp}_{kind}.json").write_text(json.dumps(body, ensure_ascii=False))


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "data" / "1"
    d.mkdir(parents=True)
    version(d, "5005", "2019-05-02", "serve contra tosse", "h1")
    version(d, "5011", "2020-11-19", "serve contra rinite", "h2", docs=2)
    version(d, "5023", "2021-03-08", "serve contra tosse e rinite", "h3", docs=2, items="1. PARA e 9. OUTRO")
    version(d, "5011", "2022-08-30", "serve contra rinite", "h2", docs=2)
    version(d, "5031", "2023-02-14", "serve contra tosse", "h1")
    items = [{"expediente": "5005", "descSituacao": "antiga"}, {"expediente": "5005", "descSituacao": "Vigente"}]
    meta = {"produto": {"numeroRegistro": "1", "idProduto": 5, "nomeProduto": "N", "razaoSocial": "E", "cnpj": "c", "data": "2023-02-14T10:00:00.000-0300"}, "historico": {"historico": {"content": items}}, "detalhe": {"apresentacoes": [{"apresentacao": "A"}, {"apresentacao": ""}]}}
    (d / "meta.json").write_text(json.dumps(meta))
    return tmp_path / "data"


def test_export(spark, root, tmp_path):
    rows, metas = archive.versions(spark, str(root)), archive.meta(spark, str(root))
    feed = spark.createDataFrame([("1", "N", "E", "5005", "2019-05-02"), ("2", "M", "F", "9", "2019-05-02")], "registro string, nome string, empresa string, expediente string, data string")
    out = str(tmp_path / "out")
    export.write(rows, metas, feed, feed, out)
    read = lambda name: [r.asDict(recursive=True) for r in spark.read.json(f"{out}/{name}").collect()]
    (product,) = read("produtos")
    assert product["n_versoes"] == 5 and product["diffs"] == ["5005-5011-vp", "5011-5023-vp"] and product["apresentacoes"] == ["A"] and product["ultima_publicacao"] == "2023-02-14"
    assert [r["slug"] for r in read("recentes")] == ["5011-5023-vp", "5005-5011-vp"]
    by = {r["expediente"]: r for r in read("versoes")}
    assert by[5011]["republicada"] == ["2022-08-30"] if 5011 in by else by["5011"]["republicada"] == ["2022-08-30"]
    v = {str(k): x for k, x in by.items()}
    assert v["5031"]["repetida"] and not v["5005"]["repetida"] and v["5005"]["situacao"] == "Vigente" and v["5031"]["situacao"] == ""
    d = {r["slug"]: r for r in read("diffs")}
    assert d["5011-5023-vp"]["alteradas"] == ["1"] and d["5011-5023-vp"]["declarado"] == ["1", "9"]
    docs = d["5011-5023-vp"]["documentos"]
    assert [x["indice"] for x in docs] == [1, 2] and {x["rotulo"] for x in docs} == {"Forma 0", "Forma 1"}
    first = {s["secao"]: s for s in docs[0]["secoes"]}
    assert list(first) == ["I", "1", "2"] and "<ins>tosse e</ins>" in first["1"]["html"] and first["1"]["ancora"] == "sec-vp-1" and first["1"]["declarada"]
    # Of two new documents one is matched; the other is all insertion.
    grown = d["5005-5011-vp"]["documentos"]
    assert len(grown) == 2 and "<del>" not in {s["secao"]: s for s in grown[1]["secoes"]}["2"]["html"]
    assert {r["registro"]: r["arquivado"] for r in read("feed")} == {"1": True, "2": False}
    pairs = export.content_pairs(rows)
    assert {r["para"]: r["bate"] for r in export.validation(pairs, export.section_diffs(pairs)).collect()} == {"5011": False, "5023": False}


def test_comparable_sides(spark):
    df = spark.createDataFrame([(True, False, ["m"], ["l"]), (True, True, ["m"], ["l"]), (False, True, ["m"], ["l"]), (True, False, ["m"], [])], "a boolean, b boolean, d array<string>, l array<string>")
    from pyspark.sql import functions as F

    assert [r["x"] for r in df.select(archive.comparable(F.col("a"), F.col("b"), F.col("d"), F.col("l")).alias("x")).collect()] == [["l"], ["m"], ["m"], ["m"]]
