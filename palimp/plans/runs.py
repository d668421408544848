"""Queries on what happens over time: feeds by day, actions on them, snapshots, counts of a run, changes between states."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimp.operators import catalog as cat
from palimp.operators import changes, export
from palimp.plans.base import query
from palimp.sources import by_day, snapshots
from palimp.sources.paged import HttpError
from palimp.sources.store import shared
from palimp.streaming import actions, feed


def _folder(t, name: str) -> str:
    return f"{shared(t.spark)}/{name}-{uuid.uuid4().hex}"


def _events_by_day(t) -> tuple[str, list[str]]:
    """The events as a service that is asked by day, and its first, middle and last day."""
    rows = t.events.select(F.col("user_id").cast("string").alias("numeroRegistro"), F.col("event_id").alias("idProduto"), F.col("event_type").alias("expediente"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("data"), F.col("event_id").alias("pos"), F.col("ts").cast("date").cast("string").alias("dia"))
    folder = _folder(t, "days")
    by_day.write(rows.where("dia is not null"), folder)
    first, last = t.events.agg(F.min(F.col("ts").cast("date")), F.max(F.col("ts").cast("date"))).first()
    return folder, [str(d) for d in (first, first + (last - first) / 2, last)]


@query("SELECT registro, expediente, min(data) AS data FROM feed GROUP BY ALL", "feed")
def feed_by_day(t):
    """The feed read day by day: up to the middle, on from there in batches of four days, and once more from its beginning."""
    folder, (first, middle, last) = _events_by_day(t)
    table, state = _folder(t, "feed"), _folder(t, "state")
    options = {"source": by_day.FolderFeed, "pasta": folder, "pace": 0, "count": 500}
    feed.run(t.spark, table, state, desde=first, ate=middle, days=4, **options)
    feed.run(t.spark, table, state, ate=last, days=4, **options)
    feed.run(t.spark, table, state, desde=first, ate=last, days=30, **options)
    return t.spark.read.parquet(table).select("registro", "expediente", "data")


def _visit(registro: str, anew: bool) -> str:
    """An action for trials: some keys always fail, the ids of some have run out."""
    if int(registro) % 17 == 3:
        raise ValueError("no text")
    if int(registro) % 13 == 5 and not anew:
        raise HttpError(403)
    return f"archived {registro}"


@query("""WITH k AS (SELECT registro, expediente, min(CAST(data AS DATE)) AS d FROM feed GROUP BY ALL), b AS (SELECT DISTINCT CAST((d - (SELECT min(d) FROM k)) // 10 AS BIGINT) AS batch, registro FROM k)
SELECT batch, registro AS key, CAST(registro AS BIGINT) % 17 <> 3 AS ok, CASE WHEN CAST(registro AS BIGINT) % 17 <> 3 AND CAST(registro AS BIGINT) % 13 = 5 THEN 2 ELSE 1 END AS attempts, CASE WHEN CAST(registro AS BIGINT) % 17 <> 3 THEN concat('archived ', registro) END AS result, CASE WHEN CAST(registro AS BIGINT) % 17 = 3 THEN 'ValueError: no text' END AS error FROM b""", "feed")
def feed_actions(t):
    """Each batch of ten days: its new products are acted on once, failures are kept apart with their error."""
    folder, (first, _, last) = _events_by_day(t)
    out = _folder(t, "acted")
    feed.run(t.spark, _folder(t, "feed"), _folder(t, "state"), source=by_day.FolderFeed, desde=first, ate=last, days=10, then=actions.on_batch(out, "registro", _visit, readers=4), pasta=folder, pace=0, count=500)
    return actions.results(t.spark, out).select("batch", "key", "ok", "attempts", "result", "error")


def _search_rows(t):
    """Products as a search gives them."""
    return t.products.select(F.col("registro").alias("numeroRegistro"), F.col("nome").alias("nomeProduto"), F.col("empresa").alias("razaoSocial"), "cnpj", F.col("categoria").alias("expediente"), F.when(F.col("registro").cast("long") % 3 > 0, F.lit("2024-01-05T23:10:00.000-0300")).alias("data"))


@query("SELECT registro, nome, empresa, cnpj, categoria AS expediente, CASE WHEN CAST(registro AS BIGINT) % 3 > 0 THEN '2024-01-05' ELSE '' END AS data, CAST(1 AS BIGINT) AS versao, '2024-02-02' AS atualizado FROM products", "products")
def catalog_snapshot(t):
    """The catalog in two versions, the second with what the first lacked; read by the newest manifest."""
    path = _folder(t, "catalog")
    rows = cat.catalog(_search_rows(t))
    odd = F.col("registro").cast("long") % 2 == 1
    snapshots.write(rows.where(odd), path, "2024-02-01")
    snapshots.write(rows.where(~odd), path, "2024-02-02", mode="append")
    about = snapshots.state(t.spark, path)
    return snapshots.read(t.spark, path, rows.schema).withColumns({"versao": F.lit(about["versao"]).cast("long"), "atualizado": F.lit(about["atualizado"])})


@query("SELECT count(*) AS itens, CAST(count_if(declarada <> alterada) AS BIGINT) AS erros, CAST(count_if(alterada) AS BIGINT) AS exportados, count(*) AS gravados FROM marks", "marks")
def run_counts(t):
    """A run's counts, taken in the pass that writes its rows; the manifest has the rows written."""
    path = _folder(t, "marks")
    seen = snapshots.write(t.marks, path, itens=F.count("*"), **snapshots.counted(erros=F.col("declarada") != F.col("alterada"), exportados=F.col("alterada")))
    row = (seen["itens"], seen["erros"], seen["exportados"], snapshots.state(t.spark, path)["rows"])
    return t.spark.createDataFrame([row], "itens long, erros long, exportados long, gravados long")


@query("""WITH s AS (SELECT expediente, bool_and(declarada = alterada) AS bate FROM (SELECT expediente, secao, bool_or(declarada) AS declarada, bool_or(alterada) AS alterada FROM marks WHERE secao <> 'I' GROUP BY ALL) GROUP BY 1)
SELECT registro, o_orderkey AS expediente, bate, CASE WHEN o_orderkey IS NULL THEN concat('LookupError: ', registro) END AS erro FROM products LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS registro, o_orderkey, bate FROM orders JOIN s ON o_orderkey = expediente) USING (registro)""", "products", "marks")
def validation_report(t):
    """Every product's versions, whether declared and detected sections agree, and a row with the error for products without any; written as a whole."""
    sets = t.marks.groupBy("expediente").agg(F.collect_set(F.when(F.col("declarada"), F.col("secao"))).alias("declarado"), F.collect_set(F.when(F.col("alterada"), F.col("secao"))).alias("detectado"))
    checked = cat.agreement(sets).join(t.orders.select(F.col("o_custkey").cast("string").alias("registro"), F.col("o_orderkey").alias("expediente")), "expediente")
    rows = export.report(t.products, checked.select("registro", "expediente", "bate"))
    path = _folder(t, "report")
    snapshots.write(rows, path)
    return snapshots.read(t.spark, path, rows.schema)


@query("""WITH n AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 41 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 37 <> 0 UNION ALL SELECT o_orderkey + 1000000000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 43 = 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'gone' ELSE 'changed' END AS change FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR (o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate) IS DISTINCT FROM (n.o_custkey, n.o_orderstatus, n.o_totalprice, n.o_orderdate)""")
def state_changes(t):
    """What differs between two states of the orders; their priority, which differs everywhere, is left out."""
    key = F.col("o_orderkey")
    new = t.orders.where(key % 37 != 0).withColumn("o_totalprice", F.when(key % 41 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    more = t.orders.where(key % 43 == 0).withColumn("o_orderkey", key + 1_000_000_000_000)
    old_path, new_path = _folder(t, "old"), _folder(t, "new")
    ignore = ("o_orderpriority",)
    changes.write_state(t.orders, old_path, ["o_orderkey"], ignore, 256)
    changes.write_state(new.unionByName(more).withColumn("o_orderpriority", F.lit("x")), new_path, ["o_orderkey"], ignore, 256)
    return changes.changes(t.spark, old_path, new_path, ["o_orderkey"])
