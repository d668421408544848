"""Catalogs, feeds and products: projections, searches, counts and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.functions import text as tx

#: Rows on the start page, in the recent list and on a page of a long list; sections each kind should have.
START, RECENT, PAGE = 12, 24, 100
EXPECTED = {"vp": ("1", "2", "3", "4", "5", "6", "7", "8", "9", "III"), "vps": ("1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "III")}


def catalog(products: DataFrame) -> DataFrame:
    """registro, nome, empresa, cnpj, expediente, data of search rows; the date's day, empty for none."""
    names = {"numeroRegistro": "registro", "nomeProduto": "nome", "razaoSocial": "empresa", "cnpj": "cnpj", "expediente": "expediente"}
    return products.select(*(F.col(a).alias(b) for a, b in names.items()), tx.day(F.col("data")).alias("data"))


def published(products: DataFrame) -> DataFrame:
    """The feed's eight fields of search rows; the date's day, and empty texts for none."""
    names = {"numeroRegistro": "registro", "nomeProduto": "nome", "razaoSocial": "empresa", "cnpj": "cnpj", "expediente": "expediente", "numProcesso": "processo"}
    return products.select(*(tx.or_empty(F.col(a)).alias(b) for a, b in names.items()), F.col("idProduto").alias("id_produto"), tx.day(F.col("data")).alias("data"))


def search(rows: DataFrame, *, nome: str | None = None, cnpj: str | None = None, start: str | None = None, end: str | None = None, today: str | None = None) -> DataFrame:
    """Rows whose name holds `nome` (in any case), of one company, published in an inclusive range; one without an end ends today (the session's, or the one given)."""
    if nome:
        rows = rows.where(F.lower("nome").contains(nome.lower()))
    if cnpj:
        number = "".join(c for c in cnpj if c.isdigit())
        if len(number) != 14:
            raise ValueError("a company number has 14 digits")
        rows = rows.where(tx.digits(F.col("cnpj")) == number)
    if start or end:
        until = end or today
        rows = rows.where(F.col("data").between(F.lit(start or "0000-00-00"), F.lit(until) if until else F.current_date().cast("string")))
    return rows


def containing(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows with the query, in any case, in their columns joined by a space; an empty query takes all."""
    return rows.where(F.lower(F.concat_ws(" ", *columns)).contains(query.strip().lower()))


def marked(rows: DataFrame, archived: DataFrame, key: str = "registro") -> DataFrame:
    """+ arquivado: whether the key is archived."""
    keys = archived.select(key).distinct().withColumn("__in", F.lit(True))
    return rows.join(keys, key, "left").withColumn("arquivado", F.col("__in").isNotNull()).drop("__in")


def letters(rows: DataFrame, name: str = "nome") -> DataFrame:
    return rows.groupBy(tx.initial(F.col(name)).alias("letra")).agg(F.count("*").alias("n"))


def missing(found: DataFrame, keys: list[str], kind: str = "tipo", sections: str = "secoes") -> DataFrame:
    """keys, tipo, faltando: expected sections that are not there, by length and value."""
    expected = F.lit(None).cast("array<string>")
    for k, v in EXPECTED.items():
        expected = F.when(F.col(kind) == k, F.array(*map(F.lit, v))).otherwise(expected)
    gone = F.array_sort(F.transform(F.array_except(expected, F.col(sections)), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))
    return found.select(*keys, kind, F.transform(gone, lambda x: x["s"]).alias("faltando"))


def agreement(rows: DataFrame, declared: str = "declarado", detected: str = "detectado") -> DataFrame:
    """+ bate: declared and detected sections are the same set, identification (I) left out of the detected ones."""
    seen = F.array_remove(F.col(detected), "I")
    return rows.withColumn("bate", (F.size(F.array_except(F.col(declared), seen)) == 0) & (F.size(F.array_except(seen, F.col(declared))) == 0))


def fresh(batch: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows of a batch whose keys aren't known."""
    return batch.join(known.select(*keys).distinct(), list(keys), "left_anti")


def stale(updated: str | None, today: str, days: int = 6) -> bool:
    """Whether a catalog of that day (None: there is none) is to be read again: it is more than `days` days old."""
    import datetime as dt

    return updated is None or (dt.date.fromisoformat(today) - dt.date.fromisoformat(updated)).days > days
