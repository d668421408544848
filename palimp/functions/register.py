"""The functions that SQL users may call by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimp.functions import markup
from palimp.functions.worddiff import section_diff
from palimp.operators.segment import split_column

#: Table functions over a page, for DataFrame.lateralJoin.
blocks_from_html = F.udtf(markup.BlocksFromHtml, returnType=markup.BLOCKS)
tables_from_html = F.udtf(markup.TablesFromHtml, returnType=markup.GRID)


def register(spark: SparkSession) -> None:
    """word_diff(old, new) -> struct(html, context, words, ratio); split_documents(array of lines) -> array of documents;
    the table functions blocks_from_html(html) and tables_from_html(html), to be used with LATERAL."""
    spark.udf.register("word_diff", section_diff)
    spark.udf.register("split_documents", split_column())
    spark.udf.register("split_blocks", split_column(sep="\n\n"))
    spark.udtf.register("blocks_from_html", blocks_from_html)
    spark.udtf.register("tables_from_html", tables_from_html)


def beside(pages: DataFrame, keys: list[str], function, html: str = "html") -> DataFrame:
    """keys and what a table function gives for each page; pages without any have no rows."""
    return pages.select(*keys, html).lateralJoin(function(F.col(html).outer())).drop(html)
