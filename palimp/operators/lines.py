"""Pages as lines: normal form, running headers and footers, page numbers. Lines have doc, page, pos and line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.functions import text as tx

#: Lines at each edge of a page, and what a line must be to count as a page number or a heading.
EDGE = 2
PAGE_NUMBER = r"(?U)^[-–]?\s*\d+(\s*(de|/)\s*\d+)?\s*[-–]?$"
CAPITALS = "A-ZÇÁÉÍÓÚÂÊÔÃÕ"
TITLES = ("IDENTIFICAÇÃO DO MEDICAMENTO", "INFORMAÇÕES AO PACIENTE", "INFORMAÇÕES TÉCNICAS AOS PROFISSIONAIS DE SAÚDE", "DIZERES LEGAIS")
HEADING = rf"(?U)^(?:[IVX]{{1,3}}\s*[-–]?\s*)?(?:{'|'.join(TITLES)})\s*:?$|^\d{{1,2}}\s*[.)]\s*[{CAPITALS}][{CAPITALS} ,?/()-]{{5,}}$|(?iu:hist[óo]rico d[aeo]s? altera[çc])|^APRESENTAÇÕES$"


def lines(pages: DataFrame, keys: list[str], text: str = "text", by: str = "\n") -> DataFrame:
    """keys, pos (from 1, blank lines not counted), line: squeezed lines that aren't blank."""
    cut = F.filter(F.transform(F.split(text, by), tx.squeezed), lambda x: x != "")
    return pages.select(*keys, F.posexplode(cut).alias("__p", "line")).select(*keys, (F.col("__p") + 1).cast("long").alias("pos"), "line")


def text_pages(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, page (from 1), text: what stands between form feeds; what follows the last one is no page."""
    cut = F.split(text, "\f")
    return texts.select(*keys, F.posexplode(F.slice(cut, F.lit(1), F.size(cut) - 1)).alias("__p", "text")).select(*keys, (F.col("__p") + 1).cast("long").alias("page"), "text")


def edges(lines_: DataFrame, page: list[str], reach: int = EDGE) -> DataFrame:
    """The distinct first and last lines of each page."""
    whole = W.partitionBy(*page)
    ends = lines_.withColumn("__n", F.count("*").over(whole)).where((F.col("pos") <= reach) | (F.col("pos") > F.col("__n") - reach))
    return ends.select(*page, "line").distinct()


def running(lines_: DataFrame, doc: list[str], page: list[str], least: int = 3) -> DataFrame:
    """doc, key, n_pages: masked edge lines of at least `least` pages of a document."""
    keyed = edges(lines_, page).select(*doc, *(c for c in page if c not in doc), tx.masked(F.col("line")).alias("key")).distinct()
    return keyed.groupBy(*doc, "key").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least)


def stripped(lines_: DataFrame, doc: list[str], page: list[str], least: int = 3) -> DataFrame:
    """Lines without running edge lines (by text, wherever they stand in their page) and page numbers; headings stay.

    Lines are dealt by page once; which of them have the text of an edge line is told there. Only those, a few for each
    page, are dealt again, by document and masked text.
    """
    size = F.count("*").over(W.partitionBy(*page))
    at_edge = (F.col("pos") <= EDGE) | (F.col("pos") > F.col("__n") - EDGE)
    # The patterns are tried before the lines are dealt, once for each line.
    told = lines_.withColumn("__h", F.col("line").rlike(HEADING)).withColumn("__p", F.col("line").rlike(PAGE_NUMBER))
    told = told.withColumn("__n", size).withColumn("__at", at_edge).withColumn("__edge", F.max("__at").over(W.partitionBy(*page, "line")))
    heading, number = F.col("__h"), F.col("__p")
    edge = told.where(F.col("__edge") & ~number & ~heading).withColumn("__key", tx.masked(F.col("line")))
    keys = told.where("__at").select(*page, *(c for c in doc if c not in page), tx.masked(F.col("line")).alias("__key")).distinct()
    often = keys.groupBy(*doc, "__key").agg(F.count("*").alias("__k")).where(F.col("__k") >= least).drop("__k")
    stay = told.where(heading | (~F.col("__edge") & ~number))
    return stay.select(*lines_.columns).unionByName(edge.join(often, [*doc, "__key"], "left_anti").select(*lines_.columns))
