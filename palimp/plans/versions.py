"""Queries on listings, version chains and their publication."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.functions import text as tx
from palimp.operators import catalog as cat
from palimp.operators import ranking, versions
from palimp.plans.base import query

CHAIN = """WITH firsts AS (SELECT *, row_number() OVER (PARTITION BY registro, tipo, hash ORDER BY data, expediente) AS k FROM listings),
chain AS (SELECT *, row_number() OVER (PARTITION BY registro, tipo ORDER BY data, expediente) AS pos FROM firsts WHERE k = 1),
pairs AS (SELECT * FROM (SELECT registro, tipo, lag(expediente) OVER w AS de, expediente AS para, lag(data) OVER w AS de_data, data AS para_data FROM chain WINDOW w AS (PARTITION BY registro, tipo ORDER BY data, expediente)) WHERE de IS NOT NULL) """


@query("SELECT registro, data, expediente, array_to_string(list_sort(list(DISTINCT tipo)), ',') AS kinds FROM listings GROUP BY ALL", "listings")
def version_grouping(t):
    return versions.grouped(t.listings).withColumn("kinds", F.concat_ws(",", "kinds"))


@query("SELECT registro, tipo, hash, expediente, data, situacao FROM (SELECT *, row_number() OVER (PARTITION BY registro, tipo, hash ORDER BY data, expediente) AS k FROM listings) WHERE k = 1", "listings")
def version_first_listing(t):
    return versions.first_of(t.listings, "registro", "tipo", "hash").select("registro", "tipo", "hash", "expediente", "data", "situacao")


@query("SELECT registro, hash, min(data) AS data, array_to_string(list_transform(list(data ORDER BY data, expediente)[2:], lambda x: strftime(x, '%Y-%m-%d')), ',') AS republicada, count(*) AS n_listings FROM listings GROUP BY registro, hash", "listings")
def version_relistings(t):
    found = versions.relisted(t.listings, "registro", "hash")
    return found.withColumn("republicada", F.concat_ws(",", F.transform("republicada", lambda d: d.cast("string"))))


@query("SELECT registro, expediente, tipo, hash, min((data, expediente)) OVER (PARTITION BY registro, hash) < (data, expediente) AS repetida FROM listings", "listings")
def version_repeated_flag(t):
    return versions.repeated(t.listings).select("registro", "expediente", "tipo", "hash", "repetida")


@query("WITH l AS (SELECT registro, expediente, data, hash FROM listings UNION ALL SELECT registro, expediente, data, situacao FROM listings), m AS (SELECT registro, hash, min((data, expediente)) AS first FROM l GROUP BY ALL) SELECT registro, expediente, bool_and(first < (data, expediente)) AS repetida FROM l JOIN m USING (registro, hash) GROUP BY ALL", "listings")
def version_repeated_all(t):
    """Versions with a text of each kind (an order's priority and its status) of which all were seen before."""
    both = t.listings.unionByName(t.listings.withColumn("hash", F.col("situacao")))
    return versions.repeated_versions(both)


@query(CHAIN + "SELECT registro, tipo, hash, expediente, data, CAST(pos AS BIGINT) AS pos FROM chain", "listings")
def version_chain_dedup(t):
    return versions.chain(t.listings).select("registro", "tipo", "hash", "expediente", "data", "pos")


@query(CHAIN + "SELECT registro, tipo, de, para, de_data, para_data, concat_ws('-', de, para, tipo) AS slug FROM pairs", "listings")
def consecutive_diff_slugs(t):
    return versions.pairs(versions.chain(t.listings))


@query("SELECT registro, expediente, data, situacao, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY registro ORDER BY data DESC, expediente DESC) AS rank FROM listings) WHERE rank <= 5", "listings")
def history_top_n(t):
    return ranking.best(t.listings, ["registro"], 5, F.desc("data"), F.desc("expediente")).select("registro", "expediente", "data", "situacao", "rank")


@query("SELECT registro, tipo, max(CASE WHEN rank = 1 THEN expediente END) AS para, max(CASE WHEN rank = 2 THEN expediente END) AS de FROM (SELECT *, row_number() OVER (PARTITION BY registro, tipo ORDER BY data DESC, expediente DESC) AS rank FROM listings) WHERE rank <= 2 GROUP BY registro, tipo HAVING count(*) = 2", "listings")
def latest_two_versions(t):
    two = ranking.best(t.listings, ["registro", "tipo"], 2, F.desc("data"), F.desc("expediente"))
    pick = lambda n: F.max(F.when(F.col("rank") == n, F.col("expediente")))
    return two.groupBy("registro", "tipo").agg(pick(1).alias("para"), pick(2).alias("de"), F.count("*").alias("k")).where("k = 2").drop("k")


@query(CHAIN + "SELECT CAST(row_number() OVER (ORDER BY para_data DESC, nome DESC, slug, registro) AS BIGINT) AS pos, registro, nome, empresa, slug, tipo, para_data FROM (SELECT *, concat_ws('-', de, para, tipo) AS slug FROM pairs) JOIN products USING (registro) QUALIFY pos <= 24", "listings", "products")
def recent_top24(t):
    """The most recent differences; the sort keeps 24 rows a task, and only those reach the window that numbers them."""
    found = versions.pairs(versions.chain(t.listings)).join(t.products, "registro").select("registro", "nome", "empresa", "slug", "tipo", "para_data")
    order = [F.desc("para_data"), F.desc("nome"), F.asc("slug"), F.asc("registro")]
    top = found.orderBy(*order).limit(cat.RECENT)
    return top.withColumn("pos", F.row_number().over(W.orderBy(*order)).cast("long"))


@query("SELECT registro, nome, max(data) AS ultima_publicacao, count(DISTINCT (data, expediente)) AS n_versoes FROM listings JOIN products USING (registro) GROUP BY registro, nome", "listings", "products")
def products_by_last_publication(t):
    counted = t.listings.groupBy("registro").agg(F.max("data").alias("ultima_publicacao"), F.countDistinct("data", "expediente").alias("n_versoes"))
    return counted.join(t.products.select("registro", "nome"), "registro").orderBy(F.desc("ultima_publicacao"), "registro")


@query("SELECT p.registro, p.nome, coalesce(s.situacao, '') AS situacao FROM products p LEFT JOIN (SELECT registro, max_by(situacao, (data, expediente)) AS situacao FROM listings GROUP BY registro) s USING (registro)", "products", "listings")
def status_left_join(t):
    history = t.listings.select("registro", F.lit("").alias("expediente"), "situacao", F.struct("data", "expediente").alias("pos"))
    return versions.with_status(t.products.withColumn("expediente", F.lit("")), history).select("registro", "nome", "situacao")


@query("SELECT DISTINCT p.registro, p.nome, l.registro IS NOT NULL AS arquivado FROM products p LEFT JOIN listings l USING (registro)", "products", "listings")
def archived_mark_join(t):
    return cat.marked(t.products.select("registro", "nome"), t.listings)


@query(CHAIN + ", a AS (SELECT registro, para AS expediente, concat_ws('-', de, para, tipo) AS slug FROM pairs) SELECT l.registro, l.expediente, coalesce(a.slug, '') AS slug, CASE WHEN a.slug IS NOT NULL THEN '' WHEN min((l.data, l.expediente)) OVER (PARTITION BY l.registro, l.hash) < (l.data, l.expediente) THEN 'same' ELSE 'first' END AS rotulo FROM listings l LEFT JOIN a USING (registro, expediente)", "listings")
def diffs_arriving(t):
    """The difference that leads to each version, else whether it repeats known contents or is the first."""
    arriving = versions.pairs(versions.chain(t.listings)).select("registro", F.col("para").alias("expediente"), "slug")
    found = versions.repeated(t.listings).join(arriving, ["registro", "expediente"], "left")
    told = F.when(F.col("slug").isNotNull(), "").when(F.col("repetida"), "same").otherwise("first")
    return found.select("registro", "expediente", tx.or_empty(F.col("slug")).alias("slug"), told.alias("rotulo"))


@query(CHAIN + "SELECT p.registro, p.nome, x.slug FROM products p JOIN (SELECT registro, concat_ws('-', de, para, tipo) AS slug FROM pairs) x USING (registro)", "listings", "products")
def unnest_slugs(t):
    lists = versions.pairs(versions.chain(t.listings)).groupBy("registro").agg(F.collect_list("slug").alias("diffs"))
    return t.products.join(lists, "registro").select("registro", "nome", F.explode("diffs").alias("slug"))


@query(CHAIN + "SELECT registro, tipo, de, para FROM pairs WHERE concat_ws('-', de, para, tipo) = (SELECT max(concat_ws('-', de, para, tipo)) FROM pairs)", "listings")
def diff_by_slug(t):
    pairs = versions.pairs(versions.chain(t.listings))
    return pairs.join(F.broadcast(pairs.agg(F.max("slug").alias("slug"))), "slug").select("registro", "tipo", "de", "para")  # one row


@query("SELECT registro, expediente, strftime(data, '%d/%m/%Y') AS publicada, concat('data/', registro, '/', strftime(data, '%Y-%m-%d'), '_', expediente, '_', tipo, '.json') AS arquivo FROM listings", "listings")
def version_file_names(t):
    name = F.concat(F.lit("data/"), F.col("registro"), F.lit("/"), F.concat_ws("_", F.col("data").cast("string"), "expediente", "tipo"), F.lit(".json"))
    return t.listings.select("registro", "expediente", F.date_format("data", "dd/MM/yyyy").alias("publicada"), name.alias("arquivo"))


@query("SELECT registro, expediente, data, tipo FROM listings", "listings")
def version_file_parts(t):
    from palimp.sources.archive import parts

    return version_file_names(t).select(*parts(F.col("arquivo")))
