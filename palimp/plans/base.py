"""The registry of named queries, and the domain's tables over the standard ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The domain's tables in SQL, for the queries' SQL equivalents.
VIEWS = {
    "listings": "SELECT CAST(o_custkey AS VARCHAR) AS registro, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS expediente, CAST(o_orderdate AS DATE) AS data, o_orderstatus AS situacao, CASE WHEN o_orderkey % 2 = 1 THEN 'vp' ELSE 'vps' END AS tipo, o_orderpriority AS hash FROM orders",
    "products": "SELECT CAST(c_custkey AS VARCHAR) AS registro, c_name AS nome, n_name AS empresa, lpad(CAST(c_custkey * 7919 AS VARCHAR), 14, '0') AS cnpj, c_mktsegment AS categoria FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "feed": "SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS registro, event_type AS expediente, ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS data FROM events",
    "marks": "SELECT l_orderkey AS expediente, CAST(l_linenumber AS VARCHAR) AS secao, l_linenumber AS n, l_returnflag = 'R' AS declarada, l_linestatus = 'F' AS alterada, l_quantity AS palavras FROM lineitem",
    "rawlines": "SELECT source AS doc, doc_id AS page, r.i AS raw, trim(regexp_replace(r.line, '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g')) AS line FROM (SELECT source, doc_id, unnest(list_zip(string_split(text, chr(10)), range(1, 1 + len(string_split(text, chr(10)))))) AS z FROM documents) d, LATERAL (SELECT z[1] AS line, z[2] AS i) r",
    "lines": "SELECT doc, page, row_number() OVER (PARTITION BY page ORDER BY raw) AS pos, line FROM rawlines WHERE line <> ''",
}
_NEEDS = {"lines": ("rawlines",)}


def sql(body: str, *views: str) -> str:
    """body with the views it names, and those they need, in front."""
    wanted: list[str] = []
    for v in views:
        wanted += [x for x in (*_NEEDS.get(v, ()), v) if x not in wanted]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def query(oracle: str | None = None, *views: str):
    """Registers a function of Tables under its name, with its SQL if it has any."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = sql(oracle, *views)
        return f

    return add


class Tables:
    """The standard tables of a directory, and the domain's tables over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def listings(self) -> DataFrame:
        """Versions of products: customers are products, orders are listings, priorities are contents."""
        kind = F.when(F.col("o_orderkey") % 2 == 1, "vp").otherwise("vps")
        return self.orders.select(F.col("o_custkey").cast("string").alias("registro"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("expediente"), F.col("o_orderdate").cast("date").alias("data"), F.col("o_orderstatus").alias("situacao"), kind.alias("tipo"), F.col("o_orderpriority").alias("hash"))

    @property
    def products(self) -> DataFrame:
        nation = F.broadcast(self.nation)  # 25 rows at every size
        c = self.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return c.select(F.col("c_custkey").cast("string").alias("registro"), F.col("c_name").alias("nome"), F.col("n_name").alias("empresa"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 14, "0").alias("cnpj"), F.col("c_mktsegment").alias("categoria"))

    @property
    def feed(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("registro"), F.col("event_type").alias("expediente"), "ts", F.col("ts").cast("date").cast("string").alias("data"))

    @property
    def marks(self) -> DataFrame:
        """Sections of versions: declared as changed, found changed."""
        return self.lineitem.select(F.col("l_orderkey").alias("expediente"), F.col("l_linenumber").cast("string").alias("secao"), F.col("l_linenumber").alias("n"), (F.col("l_returnflag") == "R").alias("declarada"), (F.col("l_linestatus") == "F").alias("alterada"), F.col("l_quantity").alias("palavras"))

    @property
    def lines(self) -> DataFrame:
        """Documents' lines: a source is a document of many pages, a document is a page."""
        from palimp.operators.lines import lines

        return lines(self.documents.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text"), ["doc", "page"])
