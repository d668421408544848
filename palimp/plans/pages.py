"""Queries on pages and details: blocks and tables by table functions, drifting JSON, and the search index."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimp.functions.register import beside, blocks_from_html
from palimp.operators import details, grids, postings
from palimp.plans.base import query
from palimp.sources.store import shared

TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


@query(r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<!DOCTYPE[^>]*>|<(?:script|style|title)\b.*?</(?:script|style|title)>', '', 'g'), '(?i)</?(?:a|b)(?:\s[^>]*)?>|<br>', ' ', 'g') AS h FROM (SELECT page_id, regexp_replace(html, '(?i)</?b>', '', 'g') AS html FROM pages)),
s AS (SELECT page_id, unnest(list_zip(regexp_extract_all(h, '<(/?[a-z0-9]+)[^>]*>([^<]*)', 1), regexp_extract_all(h, '<(/?[a-z0-9]+)[^>]*>([^<]*)', 2), range(1, 1 + len(regexp_extract_all(h, '<(/?[a-z0-9]+)[^>]*>([^<]*)'))))) AS z FROM c),
d AS (SELECT page_id, z[1] AS tag, z[3] AS n, trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(z[2], '&quot;?', '"', 'g'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM s)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) AS pos, tag, CASE tag WHEN 'li' THEN 'nav' WHEN 'footer' THEN 'footer' WHEN 'div' THEN '' ELSE 'article' END AS region, CAST(CASE tag WHEN 'li' THEN 5 WHEN 'div' THEN 3 WHEN 'footer' THEN 3 ELSE 4 END AS INTEGER) AS depth, text FROM d WHERE text <> ''""")
def page_blocks(t):
    """Leaf blocks of pages by a table function, with their element, the part of the page they are in, and their depth."""
    return beside(t.pages, ["page_id"], blocks_from_html)


def _order_pages(t):
    """A page for each order: a table whose first cell spans the rows of the order's lines, and whose last line's note spans two columns."""
    cells = F.concat(F.lit("<td>"), F.col("l_linenumber").cast("string"), F.lit("<td>"), F.col("l_quantity").cast("long").cast("string"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", cells.alias("c")))).alias("r"))
    body = F.array_join(F.transform("r", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit('<td rowspan="'), F.size("r").cast("string"), F.lit('">'), F.col("l_orderkey").cast("string"))).otherwise(""), x["c"])), "")
    page = F.concat(F.lit("<p>Pedido<table><tr><th>pedido<th>linha<th>quantidade"), body, F.lit("<tr><td colspan=3>fim &amp; total</table>"))
    return lines.select(F.col("l_orderkey").alias("pagina"), page.alias("html"))


@query("""WITH l AS (SELECT l_orderkey AS pagina, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS n, l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
g AS (SELECT pagina, n + 1 AS linha, unnest([1, 2, 3]) AS coluna, unnest([CAST(pagina AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(q AS VARCHAR)]) AS texto, false AS cabecalho, unnest([n = 1, true, true]) AS propria FROM l
UNION ALL SELECT pagina, 1, unnest([1, 2, 3]), unnest(['pedido', 'linha', 'quantidade']), true, true FROM (SELECT DISTINCT pagina FROM l)
UNION ALL SELECT pagina, max(n) + 2, unnest([1, 2, 3]), 'fim & total', false, true FROM l GROUP BY pagina)
SELECT pagina, CAST(1 AS INTEGER) AS tabela, CAST(linha AS INTEGER) AS linha, CAST(coluna AS INTEGER) AS coluna, texto, cabecalho, propria FROM g""")
def table_grid(t):
    """The places of tables in pages; an order's number stands in each row that its cell spans."""
    return grids.grid(_order_pages(t), ["pagina"])


@query("""WITH e AS (SELECT o_orderkey, o_custkey AS doc, strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') AS dia, o_orderpriority AS itens FROM orders),
r AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY o_orderkey) AS n, * EXCLUDE doc FROM e),
b AS (SELECT *, n % 3 <> 2 AS novo FROM r), p AS (SELECT *, sum(CASE WHEN novo OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY n) AS entry FROM b)
SELECT doc, CAST(entry AS BIGINT) AS entry, max(CASE WHEN novo THEN dia END) AS data, string_agg(itens, ' ' ORDER BY n) AS itens, max(CASE WHEN novo THEN 'assunto' END) AS assunto FROM p GROUP BY doc, entry""")
def declaration_tables(t):
    """Declaration tables out of pages of ten columns: every third row has no date and goes on with the entry before it."""
    date = F.date_format("o_orderdate", "dd/MM/yyyy")
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", date.alias("dia"), "o_orderpriority")))
    docs = t.orders.groupBy(F.col("o_custkey").alias("doc")).agg(ordered.alias("r"))
    one = lambda x, i: F.concat(F.lit("<tr>"), F.when((i + 1) % 3 != 2, F.concat(F.lit("<td>"), x["dia"], F.lit("<td><td>assunto"))).otherwise(F.lit("<td><td><td>")), F.lit("<td colspan=4><td> "), x["o_orderpriority"], F.lit("<td><td>"))
    page = F.concat(F.lit("<table><tr><td>Data do expediente</td><td colspan=9></tr>"), F.array_join(F.transform("r", one), ""), F.lit("</table>"))
    return grids.declared(docs.select("doc", page.alias("html")), ["doc"]).select("doc", "entry", "data", "itens", "assunto")


@query("""WITH e AS (SELECT event_id, event_type AS y, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('a', k) WHEN 3 THEN k ELSE '' END AS principio_ativo, CASE event_id % 5 WHEN 0 THEN concat('x,', y) ELSE '' END AS classes, CASE event_id % 5 WHEN 0 THEN '2030-01-02' ELSE '' END AS vencimento,
CASE event_id % 5 WHEN 0 THEN concat('c', k, '/f/;//r') WHEN 3 THEN '//' ELSE '' END AS apresentacoes FROM e""")
def detail_projection(t):
    """What is shown of details whose fields are missing, null, of another type, or no JSON at all."""
    k = F.get_json_object("props", "$.k")
    whole = F.concat(F.lit('{"principioAtivo":"a'), k, F.lit('","classesTerapeuticas":["x","'), "event_type", F.lit('"],"dataVencimentoRegistro":"2030-01-02T00:00","apresentacoes":[{"apresentacao":" c'), k, F.lit(' ","formasFarmaceuticas":["f"]},{"registro":"r","viasAdministracao":{"no":"list"}}]}'))
    odd = F.col("event_id") % 5
    json = F.when(odd == 0, whole).when(odd == 1, "{}").when(odd == 2, '{"principioAtivo":null,"classesTerapeuticas":"x","apresentacoes":null,"dataVencimentoRegistro":["a"]}').when(odd == 3, F.concat(F.lit('{"principioAtivo":'), k, F.lit(',"classesTerapeuticas":[],"apresentacoes":[{}]}'))).otherwise("oops {")
    found = details.summary(t.events.select("event_id", json.alias("json")), "json", ["event_id"])
    shown = F.transform("apresentacoes", lambda a: F.concat(a["apresentacao"], F.lit("/"), F.array_join(a["formas"], ","), F.lit("/"), a["registro"]))
    return found.select("event_id", "principio_ativo", F.array_join("classes", ",").alias("classes"), "vencimento", F.array_join(shown, ";").alias("apresentacoes"))


def _index(t) -> str:
    path = f"{shared(t.spark)}/index-{uuid.uuid4().hex}"
    postings.build(t.documents, path, buckets=64)
    return path


def _asked(t, a: int, b: int) -> list[str]:
    """Some tokens of the first document that has any."""
    row = t.documents.select("doc_id", postings.tokens(F.col("text")).alias("t")).where(F.size("t") >= b).orderBy("doc_id").first()
    return row["t"][a:b] if row else []


FIRST = f"WITH RECURSIVE d AS (SELECT doc_id, {TOKENS} AS t FROM documents), q AS (SELECT t AS q FROM d WHERE len(t) >= 6 ORDER BY doc_id LIMIT 1), "


@query(FIRST + "s AS (SELECT doc_id, len(list_filter(range(1, len(t) - 1), lambda i: t[i] = q[4] AND t[i + 1] = q[5] AND t[i + 2] = q[6])) AS n FROM d, q) SELECT doc_id AS doc, CAST(n AS BIGINT) AS n FROM s WHERE n > 0")
def phrase_lookup(t):
    """Documents with three words of a document one behind the other, and how often."""
    return postings.phrase(t.spark, _index(t), _asked(t, 3, 6))


@query(FIRST + """w AS (SELECT DISTINCT unnest(q) AS w FROM q), p AS (SELECT doc_id, len(t) AS size, unnest(t) AS w FROM d), f AS (SELECT doc_id, size, w, count(*) AS tf FROM p WHERE w IN (SELECT w FROM (SELECT DISTINCT unnest(q[1:6]) AS w FROM q)) GROUP BY ALL),
n AS (SELECT w, count(*) AS df FROM f GROUP BY 1), a AS (SELECT count(*) AS docs, sum(len(t)) / count(*) AS mean FROM d)
SELECT doc_id AS doc, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score FROM f JOIN n USING (w), a GROUP BY 1 ORDER BY score DESC, doc LIMIT 20""")
def ranked_lookup(t):
    """The twenty best documents for six words of a document."""
    return postings.ranked(t.spark, _index(t), _asked(t, 0, 6))
