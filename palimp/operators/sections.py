"""Sections of two versions side by side, and what their differences are shown as."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.functions import text as tx
from palimp.functions.worddiff import section_diff


def beside(old: DataFrame, new: DataFrame, keys: list[str], section: str = "secao") -> DataFrame:
    """keys, section, old_text, new_text, pos: all sections of both sides, the old side's in its order, then the new side's own.

    Each side has keys, section, pos and texto; a missing section is empty.
    """
    a = old.select(*keys, section, F.col("pos").alias("__a"), F.col("texto").alias("old_text"))
    b = new.select(*keys, section, F.col("pos").alias("__b"), F.col("texto").alias("new_text"))
    both = a.join(b, [*keys, section], "full_outer")
    order = W.partitionBy(*keys).orderBy(F.col("__a").asc_nulls_last(), "__b")
    return both.select(*keys, section, tx.or_empty(F.col("old_text")).alias("old_text"), tx.or_empty(F.col("new_text")).alias("new_text"), F.row_number().over(order).cast("long").alias("pos"))


def differences(sides: DataFrame) -> DataFrame:
    """sides + html, context, words, ratio, changed. Equal texts never reach Python."""
    same = sides.where(F.col("old_text") == F.col("new_text"))
    other = sides.where(F.col("old_text") != F.col("new_text"))
    nothing = same.select("*", F.lit("").alias("html"), F.lit("").alias("context"), F.lit(0).alias("words"), F.lit(1.0).alias("ratio"))
    shown = other.withColumn("__d", section_diff("old_text", "new_text")).select(*sides.columns, "__d.*")
    return nothing.unionByName(shown).withColumn("changed", F.col("words") > 0)


def with_anchors(rows: DataFrame, keys: list[str], kind: str = "tipo") -> DataFrame:
    """+ ancora: the plain id where the section changed first, with the document's number elsewhere."""
    first = F.min(F.when(F.col("changed"), F.col("documento"))).over(W.partitionBy(*keys, "secao"))
    main = F.coalesce(first == F.col("documento"), F.lit(False))
    return rows.withColumn("ancora", tx.anchor(F.col(kind), F.col("secao"), F.col("documento"), main))


def nested(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, documentos: array of (indice, rotulo, secoes) in order of document and pos."""
    section = F.struct("pos", *fields)
    inner = rows.groupBy(*keys, "documento", "rotulo").agg(F.array_sort(F.collect_list(section)).alias("secoes"))
    return inner.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("documento").alias("indice"), "rotulo", "secoes"))).alias("documentos"))


def summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, summary: a line for each document, its changed sections with their words; named if there are several documents."""
    told = F.concat("secao", F.lit("("), F.col("words").cast("string"), F.lit(")"))
    each = rows.groupBy(*keys, "documento", "rotulo").agg(F.array_sort(F.collect_list(F.when(F.col("changed"), F.struct("pos", told.alias("t"))))).alias("__c"))
    line = F.when(F.size("__c") > 0, F.concat_ws(" ", F.transform("__c", lambda x: x["t"]))).otherwise("sem alterações")
    lines = each.select(*keys, F.struct("documento", "rotulo", line.alias("line")).alias("__l")).groupBy(*keys).agg(F.array_sort(F.collect_list("__l")).alias("__l"))
    named = F.transform("__l", lambda x: F.when(F.size("__l") > 1, F.concat(F.lit("["), x["documento"].cast("string"), F.lit(": "), x["rotulo"], F.lit("] "), x["line"])).otherwise(x["line"]))
    return lines.select(*keys, F.concat_ws("\n", named).alias("summary"))


#: The report's looks.
STYLE = "body{font:15px/1.5 sans-serif;max-width:60em;margin:2em auto}del{background:#fcc}ins{background:#cfc;text-decoration:none}td,th{border:1px solid #bbb;padding:.2em .6em}.alterada{color:#900}.pbr{display:block;height:.6em}"
HEADS = ("Seção", "Status", "Palavras alteradas", "Similaridade")


def html_report(rows: DataFrame, keys: list[str], title: str, subtitle: str = "") -> DataFrame:
    """keys, report: a page with a status table of all sections and the changed ones marked up."""
    many = F.max("documento").over(W.partitionBy(*keys)) > 1
    name = tx.escaped(F.when(many, F.concat(F.lit("["), F.col("documento").cast("string"), F.lit(": "), F.col("rotulo"), F.lit("] "), F.col("secao"))).otherwise(F.col("secao")))
    part = F.concat(F.bround(F.col("ratio") * 100).cast("int").cast("string"), F.lit("%"))
    status = F.when(F.col("changed"), "alterada").otherwise("igual")
    cells = F.concat(F.lit("<tr><td>"), name, F.lit("</td><td class="), status, F.lit(">"), status, F.lit("</td><td>"), F.col("words").cast("string"), F.lit("</td><td>"), part, F.lit("</td></tr>"))
    body = F.when(F.col("changed"), F.concat(F.lit("<h2>"), name, F.lit(" <small>"), F.col("words").cast("string"), F.lit(" palavras, similaridade "), part, F.lit("</small></h2><p>"), F.col("html"), F.lit("</p>")))
    made = rows.select(*keys, F.struct("documento", "pos", cells.alias("c"), body.alias("b")).alias("__r")).groupBy(*keys).agg(F.array_sort(F.collect_list("__r")).alias("__r"))
    heads = "".join(f"<th>{h}</th>" for h in HEADS)
    shown = lambda text: tx.escaped(F.lit(text))
    head = F.concat(F.lit("<!DOCTYPE html><meta charset=utf-8><title>"), shown(title), F.lit(f"</title><style>{STYLE}</style><h1>"), shown(title), F.lit("</h1><p>"), shown(subtitle), F.lit(f"</p><table><thead><tr class=titulo>{heads}</thead>"))
    return made.select(*keys, F.concat(head, F.concat_ws("", F.transform("__r", lambda x: x["c"])), F.lit("</table>"), F.concat_ws("", F.transform("__r", lambda x: x["b"]))).alias("report"))


def two_columns(rows: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, pos, antes, depois: the paragraphs of a marked-up difference, once without what is new and once without what is gone."""
    parts = rows.select(*keys, F.posexplode(F.split(html, '<span class="pbr"></span>')).alias("__n", "__x"))
    without = lambda tag: F.trim(F.regexp_replace(F.regexp_replace("__x", f"(?s)<{tag}>.*?</{tag}>", ""), " +", " "))
    return parts.select(*keys, (F.col("__n") + 1).cast("long").alias("pos"), without("ins").alias("antes"), without("del").alias("depois"))
