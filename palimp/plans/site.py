"""Queries behind the pages: timelines, lists, titles, lookups and the two columns of a difference."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.functions import text as tx
from palimp.operators import sections, views
from palimp.plans.base import query

HTML = """WITH h AS (SELECT conv_id, turn, concat('<del>', a, '</del> <ins>', b, '</ins> <span class="pbr"></span> ', b) AS html FROM (SELECT conv_id, turn, replace(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '<', '') AS a, replace(text, '<', '') AS b FROM conversations) WHERE a IS NOT NULL)"""


@query(HTML + """, p AS (SELECT conv_id, turn, unnest(string_split(html, '<span class="pbr"></span>')) AS x, generate_subscripts(string_split(html, '<span class="pbr"></span>'), 1) AS n FROM h)
SELECT conv_id, turn, CAST(n AS BIGINT) AS pos, trim(regexp_replace(regexp_replace(x, '(?s)<ins>.*?</ins>', '', 'g'), ' +', ' ', 'g')) AS antes, trim(regexp_replace(regexp_replace(x, '(?s)<del>.*?</del>', '', 'g'), ' +', ' ', 'g')) AS depois FROM p""")
def side_by_side(t):
    """A difference's paragraphs in two columns: the old one without what is new, the new one without what is gone."""
    old = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    c = t.conversations.withColumn("a", F.replace(old, F.lit("<"), F.lit(""))).where("a is not null").withColumn("b", F.replace("text", F.lit("<"), F.lit("")))
    html = F.concat(F.lit("<del>"), "a", F.lit("</del> <ins>"), "b", F.lit('</ins> <span class="pbr"></span> '), "b")
    return sections.two_columns(c.withColumn("html", html), ["conv_id", "turn"])


@query("SELECT registro, expediente, data, CAST(row_number() OVER (PARTITION BY registro ORDER BY data DESC, expediente DESC) AS BIGINT) AS lugar, CASE WHEN situacao <> 'O' THEN situacao ELSE '' END AS situacao FROM listings", "listings")
def product_timeline(t):
    """Versions from the newest, with their status where it isn't the usual one."""
    return views.timeline(t.listings, usual="O").select("registro", "expediente", "data", "lugar", "situacao")


@query("SELECT letra, n, CAST(row_number() OVER (ORDER BY letra = '0-9', letra) AS BIGINT) AS lugar FROM (SELECT CASE WHEN regexp_matches(upper(substr(s, 1, 1)), '[A-Z]') THEN upper(substr(s, 1, 1)) ELSE '0-9' END AS letra, count(*) AS n FROM (SELECT trim(CASE WHEN p_partkey % 9 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_type END) AS s FROM part) GROUP BY 1)")
def letters_in_order(t):
    name = F.when(F.col("p_partkey") % 9 == 0, F.col("p_partkey").cast("string")).otherwise(F.col("p_type"))
    return views.letters(t.part.withColumn("nome", name))


@query("SELECT l_orderkey AS expediente, concat('vp: ', strftime(CAST(min(l_shipdate) AS DATE), '%d/%m/%Y'), ' → ', strftime(CAST(max(l_shipdate) AS DATE), '%d/%m/%Y')) AS titulo, CAST(round(100 * sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) / count(*)) AS BIGINT) AS parte, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) > 1 AS varias FROM lineitem GROUP BY 1")
def diff_titles(t):
    days = t.lineitem.groupBy(F.col("l_orderkey").alias("expediente")).agg(F.min("l_shipdate").cast("date").alias("de"), F.max("l_shipdate").cast("date").alias("para"), F.count_if(F.col("l_linestatus") == "F").alias("k"), F.count("*").alias("n"))
    return days.select("expediente", views.title(F.lit("vp"), F.col("de"), F.col("para")).alias("titulo"), F.round(F.col("k") / F.col("n") * 100).cast("long").alias("parte"), (F.col("k") > 1).alias("varias"))


@query("SELECT expediente, numeros = ordem AND primeiro = 1 AS ordenado, tamanho, numeros = ordem AND primeiro = 1 AND tamanho > 100 AS valido FROM (SELECT l_orderkey AS expediente, list(l_linenumber ORDER BY l_partkey, l_linenumber) AS numeros, list(l_linenumber ORDER BY l_linenumber) AS ordem, arg_min(l_linenumber, (l_partkey, l_linenumber)) AS primeiro, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tamanho FROM lineitem GROUP BY 1)")
def document_validity(t):
    """Section numbers in the order they were opened must ascend from 1, and the document must have some size."""
    opened = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))), lambda x: x["l_linenumber"])
    docs = t.lineitem.groupBy(F.col("l_orderkey").alias("expediente")).agg(opened.alias("numeros"), F.sum(F.col("l_quantity").cast("long")).alias("tamanho"))
    return docs.select("expediente", views.ascending(F.col("numeros")).alias("ordenado"), "tamanho", (views.ascending(F.col("numeros")) & (F.col("tamanho") > 100)).alias("valido"))


@query("SELECT p_partkey AS idDocumento, k AS chave, v AS id FROM (SELECT p_partkey, unnest(['idBulaPaciente', 'idBulaProfissional']) AS k, unnest([CASE WHEN p_size % 3 > 0 THEN p_brand END, CASE WHEN p_size % 4 > 0 THEN p_type END]) AS v FROM part) WHERE v IS NOT NULL AND (k = 'idBulaPaciente' OR p_partkey % 2 = 0)")
def token_lookup(t):
    """Ids by (document, key): columns become rows, null ids are left out, and asked keys are looked up."""
    rows = t.part.select(F.col("p_partkey").alias("idDocumento"), F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).alias("idBulaPaciente"), F.when(F.col("p_size") % 4 > 0, F.col("p_type")).alias("idBulaProfissional"))
    asked = t.part.select(F.col("p_partkey").alias("idDocumento"), F.explode(F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("idBulaPaciente"), F.lit("idBulaProfissional"))).otherwise(F.array(F.lit("idBulaPaciente")))).alias("chave"))
    return views.ids(rows, "idDocumento", ["idBulaPaciente", "idBulaProfissional"]).join(asked, ["idDocumento", "chave"])


@query("WITH o AS (SELECT user_id, event_type AS owner, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events) SELECT e.event_id, e.user_id AS page, CAST(e.event_id % 40 AS BIGINT) AS mcid, o.owner FROM events e JOIN o ON o.user_id = e.user_id AND o.place = e.event_id % 40")
def chunk_owner(t):
    """Owners of chunks by their place in the page's list; places outside it have none. Lists are as long as they are."""
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    owned = t.events.select(F.col("user_id").alias("page"), F.col("event_type").alias("owner"), place.cast("long").alias("mcid"))
    chunks = t.events.select("event_id", F.col("user_id").alias("page"), (F.col("event_id") % 40).alias("mcid"))
    return chunks.join(owned, ["page", "mcid"]).select("event_id", "page", "mcid", "owner")


@query("SELECT user_id, arg_max(event_type, event_id) AS ultima, count(*) AS n, string_agg(event_type, '' ORDER BY event_id) AS texto FROM events GROUP BY 1")
def last_entry(t):
    """The last entry of each table, and its cells' texts in content order."""
    rows = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return t.events.groupBy("user_id").agg(rows.alias("r"), F.count("*").alias("n")).select("user_id", F.try_element_at("r", F.lit(-1))["event_type"].alias("ultima"), "n", F.concat_ws("", F.transform("r", lambda x: x["event_type"])).alias("texto"))


@query("SELECT secao, count(*) AS n, CAST(sum(CASE WHEN alterada THEN 1 ELSE 0 END) AS BIGINT) AS alteradas, round(sum(CASE WHEN alterada THEN palavras ELSE 0 END), 4) AS palavras FROM marks GROUP BY secao", "marks")
def total_changed(t):
    return t.marks.groupBy("secao").agg(F.count("*").alias("n"), F.count_if("alterada").alias("alteradas"), F.round(F.sum(F.when(F.col("alterada"), F.col("palavras")).otherwise(0.0)), 4).alias("palavras"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS registro, CASE WHEN lower(c_name) <> lower(c_mktsegment) AND c_mktsegment <> 'MACHINERY' THEN c_mktsegment ELSE '' END AS referencia, concat('https://example.org/produto/', c_custkey, '?nome=', replace(c_name, '#', '%23')) AS link FROM customer")
def product_links(t):
    reference = F.when((F.lower("c_name") != F.lower("c_mktsegment")) & (F.col("c_mktsegment") != "MACHINERY"), F.col("c_mktsegment")).otherwise("")
    link = F.concat(F.lit("https://example.org/produto/"), F.col("c_custkey").cast("string"), F.lit("?nome="), F.replace("c_name", F.lit("#"), F.lit("%23")))
    return t.customer.select(F.col("c_custkey").cast("string").alias("registro"), reference.alias("referencia"), link.alias("link"))


@query("SELECT role, array_to_string(list(turn ORDER BY first), ',') AS turnos FROM (SELECT role, CAST(turn AS VARCHAR) AS turn, min(conv_id * 100 + turn) AS first FROM conversations GROUP BY ALL) GROUP BY role")
def ordered_union(t):
    """Distinct keys in the order in which they first occur."""
    first = t.conversations.groupBy("role", F.col("turn").cast("string").alias("turn")).agg(F.min(F.col("conv_id") * 100 + F.col("turn")).alias("first"))
    return first.groupBy("role").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("first", "turn"))), lambda x: x["turn"])).alias("turnos"))


@query("SELECT registro, 'explicit' AS origem FROM products WHERE registro IN ('1', '2', '3') UNION ALL SELECT registro, 'curated' FROM products WHERE CAST(registro AS BIGINT) % 50 = 0 OR registro = '2'", "products")
def target_list(t):
    """Ids that were asked for and a curated list, one after the other; an id in both is there twice."""
    asked = t.products.where(F.col("registro").isin("1", "2", "3")).select("registro", F.lit("explicit").alias("origem"))
    curated = t.products.where((F.col("registro").cast("long") % 50 == 0) | (F.col("registro") == "2")).select("registro", F.lit("curated").alias("origem"))
    return asked.unionByName(curated)


@query("SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;') AS html, length(text) AS tamanho FROM conversations")
def html_escape(t):
    return t.conversations.select("conv_id", "turn", tx.escaped(F.col("text")).alias("html"), F.length("text").cast("long").alias("tamanho"))
