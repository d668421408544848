"""Archiving products: search, history and detail of each, the files of its newest versions, their text, and what failed.

Products are asked for by `readers` paced tasks; texts are extracted wherever there is room, since that is what costs. A
version that is in the archive isn't fetched again. Whatever fails is a row of the report, and the rest goes on.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.sources import archive
from palimp.sources.paged import PACE, status
from palimp.sources.service import Service, Transport
from palimp.sources.store import kept
from palimp.streaming.actions import EXPIRED

#: Kinds of files and the listing's fields that hold their ids.
KINDS = (("vp", "idBulaPaciente"), ("vps", "idBulaProfissional"))
LISTED = "registro string, idProduto long, produto string, historico string, detalhe string, error string"
FETCHED = "registro string, expediente string, data string, situacao string, tipo string, content binary, attempts int, error string"
SAVED = "registro string, expediente string, data string, tipo string, error string"


def _service(transport: str | Transport, pace: float, turns: int) -> Service:
    """A task's own caller; tasks take turns, so that together they keep the pace. A transport is a function or its import path."""
    from pyspark import TaskContext

    if isinstance(transport, str):
        module, _, name = transport.rpartition(".")
        transport = getattr(importlib.import_module(module), name)
    return Service(transport, pace * turns, late=pace * (TaskContext.get().partitionId() % turns))


def _each(df: DataFrame, work: Callable[..., dict], schema: str, transport: str | Transport, pace: float, readers: int, *by: str) -> DataFrame:
    """work(service, row) of each row, by `readers` tasks."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = _service(transport, pace, readers)
        for b in batches:
            yield pd.DataFrame([work(service, r) for r in b.to_dict("records")], columns=names).astype({n: object for n in names if n not in ("attempts",)})

    return df.repartition(readers, *by).mapInPandas(run, schema)


def _listed(latest: int | None) -> Callable[[Service, dict], dict]:
    def work(service: Service, row: dict) -> dict:
        out: dict = {"registro": row["registro"]}
        try:
            found = next(iter(service.search(numeroRegistro=row["registro"])["content"]), None)
            if found is None:
                raise LookupError(f"{row['registro']} isn't known")
            out |= {"idProduto": found["idProduto"], "produto": json.dumps(found), "historico": json.dumps(service.history(found["idProduto"], latest))}
        except Exception as e:  # noqa: BLE001: a product that can't be had is a row of the report
            return out | {"error": f"{type(e).__name__}: {e}"}
        try:  # the detail is an extra; without it the product is archived all the same
            out["detalhe"] = json.dumps(service.detail(found["idProduto"]))
        except Exception:  # noqa: BLE001
            out["detalhe"] = None
        return out

    return work


def listings(spark: SparkSession, targets: DataFrame, transport: str | Transport, *, latest: int | None = 2, pace: float = PACE, readers: int = 1) -> DataFrame:
    """LISTED of each distinct `registro` of targets: the product, its newest listings and its detail as JSON, or an error."""
    asked = targets.select(F.col("registro").cast("string").alias("registro")).where("registro is not null").distinct()
    return _each(asked, _listed(latest), LISTED, transport, pace, readers, "registro")


def versions_listed(listed: DataFrame, latest: int | None = 2) -> DataFrame:
    """registro, idProduto, idDocumento, expediente, data, situacao, tipo, id: a row for each file of the newest listings; kinds without an id have none."""
    item = f"array<struct<{archive.ITEM}>>"
    rows = listed.where("error is null").select("registro", "idProduto", F.from_json(F.get_json_object("historico", "$.historico.content"), item).alias("items"))
    newest = F.reverse(F.array_sort(F.transform("items", lambda x, i: F.struct(x["dataPublicacao"].alias("d"), (-i).alias("i"), x.alias("x")))))
    one = F.explode(F.slice(newest, 1, latest) if latest is not None else newest).alias("v")
    files = F.array(*(F.struct(F.lit(kind).alias("tipo"), F.col(f"v.x.{field}").alias("id")) for kind, field in KINDS))
    flat = rows.select("registro", "idProduto", one).select("registro", "idProduto", "v.x.idDocumento", "v.x.expediente", F.substring("v.x.dataPublicacao", 1, 10).alias("data"), F.coalesce("v.x.descSituacao", F.lit("")).alias("situacao"), F.explode(files).alias("f"))
    return flat.select("*", "f.tipo", "f.id").drop("f").where("coalesce(id, '') <> ''")


def _file(service: Service, row: dict) -> dict:
    """A version's bytes; an id that has run out is looked up again in the product's history, once."""
    out = {k: row[k] for k in ("registro", "expediente", "data", "situacao", "tipo")}
    name, field = row["id"], dict(KINDS)[row["tipo"]]
    for anew in (False, True):
        try:
            if anew:
                items = service.history(row["idProduto"])["historico"]["content"]
                name = next(x[field] for x in items if x["idDocumento"] == row["idDocumento"])
            return out | {"content": service.file(name), "attempts": 1 + anew}
        except Exception as e:  # noqa: BLE001: a file that can't be had is a row of the report
            if anew or status(e) not in EXPIRED:
                return out | {"attempts": 1 + anew, "error": f"{type(e).__name__}: {e}"}
    raise AssertionError


def files(wanted: DataFrame, transport: str | Transport, *, pace: float = PACE, readers: int = 1) -> DataFrame:
    """FETCHED of each wanted file: its bytes, or an error."""
    return _each(wanted, _file, FETCHED, transport, pace, readers, "registro")


def _put(folder: str, name: str, text: str) -> None:
    """A file under its name with all its content, or not at all."""
    import uuid

    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(f"{root}/{name.rsplit('/', 1)[0]}")
    draft = f"{root}/{name}.{uuid.uuid4().hex}.draft"
    with where.open_output_stream(draft) as f:
        f.write(text.encode())
    where.move(draft, f"{root}/{name}")


def saved(fetched: DataFrame, root: str, extract: Callable[[bytes], dict]) -> DataFrame:
    """SAVED of each fetched file. extract gives paginas, documentos, historico_tabela, marcado, documentos_linhas of a file's bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            out = []
            for r in b.to_dict("records"):
                error = r["error"]
                if error is None:
                    try:
                        version = {k: r[k] for k in ("registro", "expediente", "data", "situacao", "tipo")} | {"pdf_sha256": hashlib.sha256(r["content"]).hexdigest()} | extract(r["content"])
                        _put(root, f"{r['registro']}/{r['data']}_{r['expediente']}_{r['tipo']}.json", json.dumps(version, ensure_ascii=False))
                    except Exception as e:  # noqa: BLE001: a file that can't be read is a row of the report
                        error = f"{type(e).__name__}: {e}"
                out.append((r["registro"], r["expediente"], r["data"], r["tipo"], error))
            yield pd.DataFrame(out, columns=["registro", "expediente", "data", "tipo", "error"]).astype(object)

    return fetched.mapInPandas(run, SAVED)


def save_meta(listed: DataFrame, root: str) -> None:
    """A product's meta.json: product, history and detail, without the ids that run out."""

    def clean(x):
        if isinstance(x, dict):
            return {k: clean(v) for k, v in x.items() if k not in archive.TOKENS}
        return [clean(v) for v in x] if isinstance(x, list) else x

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                whole = {"produto": json.loads(r["produto"]), "historico": json.loads(r["historico"]), "detalhe": json.loads(r["detalhe"] or "{}")}
                _put(root, f"{r['registro']}/meta.json", json.dumps(clean(whole), ensure_ascii=False))
            yield b[["registro"]]

    listed.where("error is null").select("registro", "produto", "historico", "detalhe").mapInPandas(run, "registro string").write.format("noop").mode("overwrite").save()


def known_versions(spark: SparkSession, root: str) -> DataFrame:
    """registro, expediente, data, tipo of the versions in an archive; none if there is no archive yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "registro string, expediente string, data string, tipo string")
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_*_*.json").load(root)
    return names.select(*archive.parts(F.col("path"))).select("registro", "expediente", F.col("data").cast("string").alias("data"), "tipo")


def fetch(spark: SparkSession, targets: DataFrame, root: str, transport: str | Transport, extract: Callable[[bytes], dict], *, latest: int | None = 2, pace: float = PACE, readers: int = 1) -> DataFrame:
    """Archives the newest `latest` versions (None: all) of each `registro`; the report: SAVED of each file, and a row with the error of each product that has none.

    root is a path or URI that driver and executors share.
    """
    uri = root if "://" in root else f"file://{root}"
    listed = kept(listings(spark, targets, transport, latest=latest, pace=pace, readers=readers))
    save_meta(listed, uri)
    keys = ["registro", "expediente", "data", "tipo"]
    new = versions_listed(listed, latest).join(known_versions(spark, root), keys, "left_anti")
    # Kept before the texts are extracted: a lost extraction asks for no file twice.
    got = kept(files(new, transport, pace=pace, readers=readers))
    done = kept(saved(got.repartition("registro", "expediente", "tipo"), uri, extract))
    none = F.lit(None).cast("string")
    return done.unionByName(listed.where("error is not null").select("registro", none.alias("expediente"), none.alias("data"), none.alias("tipo"), "error"))
