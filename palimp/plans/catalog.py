"""Queries on catalogs, feeds and declared against detected changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimp.functions import text as tx
from palimp.operators import catalog as cat
from palimp.operators import ranking, tables, titles
from palimp.plans.base import query

EXPECT = "CASE WHEN l_orderkey % 2 = 1 THEN ['1','2','3','4','5','6','7','8','9','III'] ELSE ['1','2','3','4','5','6','7','8','9','10','III'] END"
RANK = "coalesce(nullif(list_position(['I','II','1','2','3','4','5','6','7','8','9','10','III'], secao), 0), 14)"


@query("SELECT registro, nome, empresa, cnpj, CAST(row_number() OVER (ORDER BY lower(nome), registro) AS BIGINT) AS pos FROM products", "products")
def catalog_projection_sorted(t):
    return ranking.numbered(t.products.select("registro", "nome", "empresa", "cnpj"), F.lower("nome"), F.col("registro"))


@query("SELECT registro, nome, CAST(ceil(row_number() OVER (ORDER BY lower(nome), registro) / 100.0) AS BIGINT) AS page FROM products", "products")
def catalog_pages(t):
    return ranking.paged(t.products.select("registro", "nome"), cat.PAGE, F.lower("nome"), F.col("registro")).drop("pos")


@query("SELECT CASE WHEN regexp_matches(upper(substr(trim(p_name), 1, 1)), '[A-Z]') THEN upper(substr(trim(p_name), 1, 1)) ELSE '0-9' END AS letra, count(*) AS n FROM part GROUP BY 1")
def catalog_letter_counts(t):
    return cat.letters(t.part, "p_name")


@query("SELECT registro, concat(substr(cnpj,1,2), '.', substr(cnpj,3,3), '.', substr(cnpj,6,3), '/', substr(cnpj,9,4), '-', substr(cnpj,13,2)) AS cnpj FROM products", "products")
def cnpj_format(t):
    return t.products.select("registro", tx.company_number(F.col("cnpj")).alias("cnpj"))


@query("SELECT registro, nome, empresa FROM products WHERE contains(lower(concat_ws(' ', nome, empresa, categoria)), 'building')", "products")
def substring_filter(t):
    return cat.containing(t.products, " Building ", "nome", "empresa", "categoria").select("registro", "nome", "empresa")


@query("SELECT pos, registro, expediente, data FROM feed WHERE data BETWEEN '2024-01-10' AND '2024-01-20'", "feed")
def search_by_period(t):
    return cat.search(t.feed.select("pos", "registro", "expediente", "data"), start="2024-01-10", end="2024-01-20")


@query("SELECT pos, registro, expediente, data FROM feed WHERE data BETWEEN '2024-01-20' AND '2024-01-25'", "feed")
def search_until_today(t):
    """A search with a first day only, on the 25th."""
    return cat.search(t.feed.select("pos", "registro", "expediente", "data"), start="2024-01-20", today="2024-01-25")


@query("SELECT registro, nome, empresa, cnpj FROM products WHERE cnpj = '00000000079190'", "products")
def search_by_company(t):
    return cat.search(t.products.select("registro", "nome", "empresa", "cnpj"), cnpj="00.000.000/0791-90")


@query("SELECT CAST(c_custkey AS VARCHAR) AS registro, c_name AS nome, CASE WHEN length(c_mktsegment) > 8 THEN substr(c_mktsegment, 1, 8) ELSE rpad(c_mktsegment, 8, ' ') END AS celula FROM customer")
def fixed_width_cells(t):
    return t.customer.select(F.col("c_custkey").cast("string").alias("registro"), F.col("c_name").alias("nome"), F.rpad(F.substring("c_mktsegment", 1, 8), 8, " ").alias("celula"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def json_prop(t):
    return t.events.select("event_id", tx.or_empty(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT registro, expediente, min(data) AS data, count(*) AS n FROM feed WHERE data >= '2024-01-03' AND NOT EXISTS (SELECT 1 FROM feed k WHERE k.data < '2024-01-03' AND k.registro = feed.registro AND k.expediente = feed.expediente) GROUP BY ALL", "feed")
def feed_new_only(t):
    feed = t.feed
    new = cat.fresh(feed.where("data >= '2024-01-03'"), feed.where("data < '2024-01-03'"), "registro", "expediente")
    return new.groupBy("registro", "expediente").agg(F.min("data").alias("data"), F.count("*").alias("n"))


@query("SELECT registro, expediente, min(ts) AS ts FROM feed GROUP BY ALL", "feed")
def feed_stream_dedup(t):
    """A file stream of the feed, read to its end: each (registro, expediente) once, at its earliest time."""
    from palimp.streaming.feed import first_publications

    return first_publications(t.spark, f"{t.sf_dir}/events.parquet")


@query("SELECT pos, registro, expediente, data, CAST(row_number() OVER (ORDER BY data DESC, pos) AS BIGINT) AS rank FROM feed QUALIFY rank <= 12", "feed")
def feed_start_page(t):
    from pyspark.sql import Window as W

    order = [F.desc("data"), F.asc("pos")]
    top = t.feed.select("pos", "registro", "expediente", "data").orderBy(*order).limit(cat.START)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


@query("SELECT expediente, array_to_string(list(secao ORDER BY n) FILTER (declarada), ',') AS declarado, array_to_string(list(secao ORDER BY n) FILTER (alterada), ',') AS detectado, bool_and(declarada = alterada) AS bate FROM (SELECT expediente, secao, n, bool_or(declarada) AS declarada, bool_or(alterada) AS alterada FROM marks GROUP BY ALL) GROUP BY expediente", "marks")
def declared_vs_detected(t):
    pick = lambda c: tx.in_order(F.collect_set(F.when(F.col(c), F.col("secao"))))
    sets = t.marks.groupBy("expediente").agg(pick("declarada").alias("declarado"), pick("alterada").alias("detectado"))
    both = cat.agreement(sets)
    return both.select("expediente", F.nullif(F.concat_ws(",", "declarado"), F.lit("")).alias("declarado"), F.nullif(F.concat_ws(",", "detectado"), F.lit("")).alias("detectado"), "bate")


@query(f"SELECT l_orderkey AS expediente, array_to_string(list_sort(list_filter({EXPECT}, lambda x: NOT list_contains(secoes, x))), ',') AS faltando FROM (SELECT l_orderkey, list(DISTINCT CAST(l_linenumber AS VARCHAR)) AS secoes FROM lineitem GROUP BY 1)")
def missing_sections(t):
    found = t.marks.groupBy("expediente").agg(F.collect_set("secao").alias("secoes")).withColumn("tipo", F.when(F.col("expediente") % 2 == 1, "vp").otherwise("vps"))
    return cat.missing(found, ["expediente"]).select("expediente", F.array_join(F.array_sort("faltando"), ",").alias("faltando"))


@query("SELECT expediente, secao, n AS documento, CASE WHEN n = min(CASE WHEN alterada THEN n END) OVER (PARTITION BY expediente // 4, secao) THEN concat('sec-vp-', secao) ELSE concat('sec-vp-', secao, '-d', n) END AS ancora FROM (SELECT expediente, CAST(n % 3 AS VARCHAR) AS secao, n, bool_or(alterada) AS alterada FROM marks GROUP BY ALL)", "marks")
def first_changed_anchor(t):
    from palimp.operators.sections import with_anchors

    rows = t.marks.groupBy("expediente", (F.col("n") % 3).cast("string").alias("secao"), F.col("n").alias("documento")).agg(F.bool_or("alterada").alias("changed"))
    grouped = rows.withColumn("g", F.expr("expediente div 4")).withColumn("tipo", F.lit("vp"))
    return with_anchors(grouped, ["g"]).select("expediente", "secao", "documento", "ancora")


@query("SELECT expediente, array_to_string(list(secao ORDER BY n), ',') AS secoes, count(*) AS n_alteradas FROM (SELECT DISTINCT expediente, secao, n FROM marks WHERE alterada) GROUP BY expediente", "marks")
def canonical_section_order(t):
    return t.marks.where("alterada").groupBy("expediente").agg(F.collect_set("secao").alias("s")).select("expediente", F.concat_ws(",", tx.in_order(F.col("s"))).alias("secoes"), F.size("s").cast("long").alias("n_alteradas"))


@query("SELECT secao, coalesce(titulo, secao) AS titulo, count(*) AS n FROM marks LEFT JOIN (VALUES ('1', 'Indicações'), ('2', 'Como funciona'), ('3', 'Contraindicações')) v(secao, titulo) USING (secao) GROUP BY ALL", "marks")
def section_title_lookup(t):
    titles = F.create_map(*(F.lit(x) for kv in (("1", "Indicações"), ("2", "Como funciona"), ("3", "Contraindicações")) for x in kv))
    return t.marks.groupBy("secao").agg(F.count("*").alias("n")).select("secao", F.coalesce(titles[F.col("secao")], F.col("secao")).alias("titulo"), "n")


TITLE_ROWS = ", ".join(f"('{k}', '{s}', '{t}')" for k, of in titles.TITLES.items() for s, t in of.items())


@query(f"WITH m AS (SELECT CASE WHEN expediente % 3 = 0 THEN 'vp' WHEN expediente % 3 = 1 THEN 'vps' ELSE 'x' END AS tipo, CASE n WHEN 1 THEN 'I' WHEN 2 THEN 'III' WHEN 3 THEN 'zz' ELSE CAST(n + expediente % 7 AS VARCHAR) END AS secao FROM marks) SELECT tipo, secao, CASE WHEN t IS NULL THEN secao WHEN regexp_matches(secao, '^[0-9]+$') THEN concat(secao, '. ', t) ELSE concat(secao, ' – ', t) END AS titulo, count(*) AS n FROM m LEFT JOIN (VALUES {TITLE_ROWS}) v(tipo, secao, t) USING (tipo, secao) GROUP BY ALL", "marks")
def section_titles(t):
    """Sections by their titles, which differ between the kinds of text; unknown sections and kinds have none."""
    key = F.col("expediente")
    kind = F.when(key % 3 == 0, "vp").when(key % 3 == 1, "vps").otherwise("x")
    section = F.when(F.col("n") == 1, "I").when(F.col("n") == 2, "III").when(F.col("n") == 3, "zz").otherwise((F.col("n") + key % 7).cast("string"))
    counted = t.marks.groupBy(kind.alias("tipo"), section.alias("secao")).agg(F.count("*").alias("n"))
    return titles.titled(counted).select("tipo", "secao", "titulo", "n")


@query("SELECT expediente, secao, bool_or(declarada) AS declarada, concat('#sec-vp-', secao) AS link FROM marks WHERE alterada GROUP BY ALL", "marks")
def changed_chips(t):
    return t.marks.where("alterada").groupBy("expediente", "secao").agg(F.bool_or("declarada").alias("declarada")).withColumn("link", F.concat(F.lit("#"), tx.anchor(F.lit("vp"), F.col("secao"), F.lit(1), F.lit(True))))


@query("SELECT pos, registro, expediente, o_orderkey FROM feed JOIN orders ON nullif(regexp_replace(concat('A', registro), '[^0-9]', '', 'g'), '') = regexp_replace(concat(substr(CAST(o_orderkey AS VARCHAR), 1, 1), '/', substr(CAST(o_orderkey AS VARCHAR), 2)), '[^0-9]', '', 'g')", "feed")
def digits_key_join(t):
    left = t.feed.select("pos", "registro", "expediente", F.nullif(tx.digits(F.concat(F.lit("A"), "registro")), F.lit("")).alias("k"))
    key = F.col("o_orderkey").cast("string")
    right = t.orders.select("o_orderkey", tx.digits(F.concat(F.substring(key, 1, 1), F.lit("/"), F.expr("substring(cast(o_orderkey as string), 2)"))).alias("k"))
    return left.join(right, "k").drop("k")


@query("WITH e AS (SELECT o_custkey AS doc, regexp_replace(concat(substr(CAST(o_orderkey AS VARCHAR), 1, 2), '/', substr(CAST(o_orderkey AS VARCHAR), 3)), '[^0-9]', '', 'g') AS k, o_orderkey AS entry FROM orders), a AS (SELECT o_custkey AS doc, o_orderkey AS n, CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE concat(CAST(o_orderkey AS VARCHAR), '-') END AS expediente FROM orders) SELECT a.doc, a.n, a.expediente, min(e.entry) AS entry FROM a LEFT JOIN e ON a.doc = e.doc AND e.k = nullif(regexp_replace(a.expediente, '[^0-9]', '', 'g'), '') GROUP BY ALL")
def entries_by_digits(t):
    """The first entry of a document with the digits of a number, however both are written; a number without digits has none."""
    key = F.col("o_orderkey").cast("string")
    entries = t.orders.select(F.col("o_custkey").alias("doc"), F.concat(F.substring(key, 1, 2), F.lit("/"), F.expr("substring(cast(o_orderkey as string), 3)")).alias("expediente"), F.col("o_orderkey").alias("entry"), F.lit("").alias("itens"))
    asked = t.orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("n"), F.when(F.col("o_orderkey") % 5 == 0, "-").otherwise(F.concat(key, F.lit("-"))).alias("expediente"))
    return tables.by_digits(asked, entries, ["doc"]).select("doc", "n", "expediente", "entry")


@query("SELECT CAST(c_custkey AS VARCHAR) AS registro, c_custkey AS id_produto, c_name AS nome, c_mktsegment AS empresa, '' AS cnpj, CAST(o_orderkey AS VARCHAR) AS expediente, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS data, '' AS processo, CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), c_name, o_orderkey) AS BIGINT) AS pos FROM orders JOIN customer ON o_custkey = c_custkey")
def feed_in_order(t):
    """The feed's eight fields of search rows, in the order of day and name."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    found = rows.select(F.col("c_custkey").cast("string").alias("numeroRegistro"), F.col("c_custkey").alias("idProduto"), F.col("c_name").alias("nomeProduto"), F.col("c_mktsegment").alias("razaoSocial"), F.lit(None).cast("string").alias("cnpj"), F.col("o_orderkey").cast("string").alias("expediente"), F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("T23:30:00.000-0300")).alias("data"), F.lit(None).cast("string").alias("numProcesso"))
    return ranking.numbered(cat.published(found), F.col("data"), F.col("nome"), F.col("expediente").cast("long"))


HISTORY = """WITH rows AS (SELECT registro, pos, CASE WHEN expediente = 'signup' THEN strftime(CAST(data AS DATE), '%d/%m/%Y') ELSE '' END AS dia, concat(CAST(pos % 10 AS VARCHAR), '. ', expediente) AS itens FROM feed),
marked AS (SELECT *, dia <> '' OR row_number() OVER (PARTITION BY registro ORDER BY pos) = 1 AS novo FROM rows),
placed AS (SELECT *, sum(CASE WHEN novo THEN 1 ELSE 0 END) OVER (PARTITION BY registro ORDER BY pos) AS entry FROM marked) """


@query(HISTORY + "SELECT registro, CAST(entry AS BIGINT) AS entry, max(CASE WHEN novo THEN dia END) AS data, string_agg(itens, ' ' ORDER BY pos) AS itens FROM placed GROUP BY registro, entry", "feed")
def history_continuations(t):
    return tables.entries(_history(t), ["registro"]).select("registro", "entry", "data", "itens")


def _history(t):
    date = F.when(F.col("expediente") == "signup", F.date_format(F.col("data").cast("date"), "dd/MM/yyyy")).otherwise("")
    item = F.concat((F.col("pos") % 10).cast("string"), F.lit(". "), "expediente")
    empty = [F.lit("").alias(c) for c in ("expediente", "assunto", "aprovacao", "versoes", "apresentacoes")]
    return t.feed.select("registro", "pos", date.alias("data"), item.alias("itens"), *empty)


@query(HISTORY + ", ids AS (SELECT registro, entry, regexp_extract(itens, '^([0-9]+)', 1) AS id, min(pos) AS p FROM placed GROUP BY ALL) SELECT registro, CAST(entry AS BIGINT) AS entry, string_agg(id, ',' ORDER BY p) AS secoes FROM ids GROUP BY registro, entry", "feed")
def declared_section_ids(t):
    return tables.entries(_history(t), ["registro"]).select("registro", "entry", F.concat_ws(",", tx.declared_sections(F.col("itens"))).alias("secoes"))


@query("WITH p AS (SELECT registro, pos AS page, CASE WHEN expediente = 'error' THEN 0 WHEN expediente = 'signup' THEN 1 END AS e FROM feed) SELECT registro, page, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY registro ORDER BY page ROWS UNBOUNDED PRECEDING), 0) = 1 AS inside FROM p", "feed")
def table_islands(t):
    pages = t.feed.select("registro", F.col("pos").alias("page"), (F.col("expediente") == "signup").alias("titled"), F.when(F.col("expediente") == "error", 0).otherwise(1).alias("n_tables"))
    return tables.islands(pages, ["registro"]).select("registro", "page", "inside")


@query("WITH c AS (SELECT registro, pos, expediente, CASE WHEN expediente IS DISTINCT FROM lag(expediente) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM feed WINDOW w AS (PARTITION BY registro ORDER BY pos)), r AS (SELECT *, sum(c) OVER (PARTITION BY registro ORDER BY pos) AS run FROM c) SELECT registro, CAST(run AS BIGINT) AS run, any_value(expediente) AS expediente, count(*) AS n, min(pos) AS first FROM r GROUP BY registro, run", "feed")
def run_length_blocks(t):
    return tables.runs(t.feed.select("registro", "pos", "expediente"), ["registro"], "expediente")


@query("SELECT n_regionkey AS regiao, CAST(greatest(10.0, 0) AS DOUBLE) AS espera_429, CAST(2 ** (n_nationkey % 3 + 1) AS DOUBLE) AS espera, n_nationkey % 5 = 0 OR n_nationkey = 24 AS repete FROM nation")
def retry_decisions(t):
    """The retry rules as columns: which outcomes are tried again, and how long to wait."""
    from palimp.sources.paged import retried, wait

    code = F.when(F.col("n_nationkey") == 24, 429).when(F.col("n_nationkey") % 5 == 0, 503).otherwise(404)
    return t.nation.select(F.col("n_regionkey").alias("regiao"), wait(F.lit(429), F.lit("3"), F.lit(0)).alias("espera_429"), wait(F.lit(500), F.lit(None).cast("string"), F.col("n_nationkey") % 3).alias("espera"), retried(F.lit("http"), code).alias("repete"))
