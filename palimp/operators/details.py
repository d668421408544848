"""Products' details out of JSON whose fields come and go and change their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text(v: Column, path: str) -> Column:
    """A field as text; empty where it is missing, null, or no single value."""
    nested = F.coalesce(F.try_variant_get(v, path, "array<variant>").isNotNull(), F.lit(False)) | F.coalesce(F.try_variant_get(v, path, "map<string,variant>").isNotNull(), F.lit(False))
    return F.when(nested, "").otherwise(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")))


def several(v: Column, path: str) -> Column:
    """A list of texts; empty where it is missing, null, or no list of single values."""
    return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))


def summary(rows: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """keep and what is shown of a product's detail; text that isn't JSON has nothing to show.

    The JSON is parsed once, to a variant; no schema is given or inferred, so rows of any shape are read side by side.
    """
    parsed = rows.select(*keep, F.try_parse_json(json).alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.apresentacoes", "array<variant>"), F.array().cast("array<variant>"))
    one = lambda a: F.struct(F.trim(text(a, "$.apresentacao")).alias("apresentacao"), several(a, "$.formasFarmaceuticas").alias("formas"), several(a, "$.viasAdministracao").alias("vias"), several(a, "$.restricaoPrescricao").alias("restricao"), text(a, "$.registro").alias("registro"))
    single = {"principio_ativo": "$.principioAtivo", "categoria": "$.categoriaRegulatoria", "referencia": "$.medicamentoReferencia"}
    many = {"classes": "$.classesTerapeuticas", "atcs": "$.atcs"}
    return parsed.select(
        *keep,
        *(text(F.col("v"), p).alias(n) for n, p in single.items()),
        *(several(F.col("v"), p).alias(n) for n, p in many.items()),
        F.substring(text(F.col("v"), "$.dataVencimentoRegistro"), 1, 10).alias("vencimento"),
        F.transform(items, one).alias("apresentacoes"),
    )


def shapes(rows: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """keys, shape, n: the common shape of each group's JSON, to see drift, and how many rows are JSON."""
    return rows.select(*keys, F.try_parse_json(json).alias("v")).groupBy(*keys).agg(F.schema_of_variant_agg("v").alias("shape"), F.count("v").alias("n"))
