"""Queries on lines, sections, layouts and differences of texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.functions import text as tx
from palimp.operators import layout, lines, pairing, sections, segment, similarity
from palimp.plans.base import query

EDGES = "ends AS (SELECT DISTINCT doc, page, line FROM (SELECT *, count(*) OVER (PARTITION BY doc, page) AS n FROM lines) WHERE pos <= 2 OR pos > n - 2), running AS (SELECT doc, regexp_replace(line, '[0-9]+', '#', 'g') AS key, count(DISTINCT page) AS n_pages FROM ends GROUP BY ALL HAVING count(DISTINCT page) >= 3)"
NUMBER = r"^[-–]?\s*[0-9]+(\s*(de|/)\s*[0-9]+)?\s*[-–]?$"
SHORT = r"^.{1,40}$"


@query("SELECT doc, page, CAST(pos AS BIGINT) AS pos, line FROM lines", "lines")
def lines_normalized(t):
    return t.lines


@query(f"WITH {EDGES} SELECT * FROM running", "lines")
def running_lines(t):
    return lines.running(t.lines, ["doc"], ["doc", "page"])


@query(f"WITH {EDGES} SELECT doc, page, CAST(pos AS BIGINT) AS pos, line FROM lines WHERE NOT ((EXISTS (SELECT 1 FROM ends e WHERE e.doc = lines.doc AND e.page = lines.page AND e.line = lines.line) AND EXISTS (SELECT 1 FROM running r WHERE r.doc = lines.doc AND r.key = regexp_replace(lines.line, '[0-9]+', '#', 'g'))) OR regexp_matches(line, '{NUMBER}'))", "lines")
def strip_running(t):
    return lines.stripped(t.lines, ["doc"], ["doc", "page"])


@query(f"SELECT conv_id, turn, regexp_matches(coalesce(nullif(regexp_extract(text, '[0-9]+', 0), ''), role), '{NUMBER}') AS numero FROM conversations")
def page_number_filter(t):
    value = F.coalesce(F.nullif(F.regexp_extract("text", "[0-9]+", 0), F.lit("")), F.col("role"))
    return t.conversations.select("conv_id", "turn", value.rlike(lines.PAGE_NUMBER).alias("numero"))


@query("SELECT doc, page, CAST(sum(length(line)) AS BIGINT) AS tamanho, count(*) AS n_lines FROM lines GROUP BY ALL HAVING sum(length(line)) > 1000", "lines")
def document_size_filter(t):
    sized = t.lines.groupBy("doc", "page").agg(F.sum(F.length("line")).alias("tamanho"), F.count("*").alias("n_lines"))
    return sized.where("tamanho > 1000")


@query(f"WITH h AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{SHORT}') THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY pos) AS section_pos, regexp_matches(line, '{SHORT}') AS head FROM lines) SELECT page, CAST(section_pos AS BIGINT) AS section_pos, coalesce(max(CASE WHEN head THEN line END), '') AS secao, coalesce(string_agg(CASE WHEN NOT head THEN line END, ' ' ORDER BY pos), '') AS texto FROM h GROUP BY page, section_pos", "lines")
def section_concat(t):
    """Short lines stand in for headings: each opens a section that runs to the next."""
    return segment.numbered_sections(t.lines, ["page"], SHORT)


@query("SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS primeiro, array_to_string(list(CAST(doc_id AS VARCHAR) ORDER BY doc_id), ',') AS docs FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(t):
    found = t.documents.groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("primeiro"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return found.where("n > 1").select("hash", "n", "primeiro", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("docs"))


@query("WITH s AS (SELECT doc_id, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'), ' :.-') AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 70 THEN concat(rtrim(CASE WHEN contains(substr(x, 1, 70), ' ') THEN regexp_replace(substr(x, 1, 70), ' [^ ]*$', '') ELSE substr(x, 1, 70) END, ' ,;:(-'), '…') ELSE x END AS rotulo FROM s")
def label_text(t):
    return t.documents.select("doc_id", tx.label(F.lit(""), F.col("text")).alias("rotulo"))


@query("WITH s AS (SELECT doc_id, trim(regexp_replace(substr(text, 1, 10 + doc_id % 90), '[\\s\\p{Z}]+', ' ', 'g'), ' :.-') AS x FROM documents) SELECT doc_id, CASE WHEN length(x) > 70 THEN concat(rtrim(CASE WHEN contains(substr(x, 1, 70), ' ') THEN regexp_replace(substr(x, 1, 70), ' [^ ]*$', '') ELSE substr(x, 1, 70) END, ' ,;:(-'), '…') ELSE x END AS rotulo FROM s")
def label_between_marks(t):
    """Presentations stand behind their heading and before the use or the composition."""
    piece = F.substring("text", F.lit(1), (F.lit(10) + F.col("doc_id") % 90).cast("int"))
    mark = F.when(F.col("doc_id") % 2 == 0, " USO ORAL APRESENTAÇÕES").otherwise(" COMPOSIÇÃO")
    whole = F.concat(F.lit("Nome APRESENTAÇÕES : "), piece, mark, F.lit(" resto"))
    return t.documents.select("doc_id", tx.label(whole, F.lit("nothing")).alias("rotulo"))


def _consecutive(t):
    """Each conversation's consecutive texts of one role: the old and the new version of a text."""
    order = W.partitionBy("conv_id", "role").orderBy("turn")
    return t.conversations.select("conv_id", "turn", "role", F.lag("text").over(order).alias("old_text"), F.col("text").alias("new_text")).where("old_text is not null")


CONSECUTIVE = "WITH p AS (SELECT * FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS a, text AS b FROM conversations) WHERE a IS NOT NULL) "


@query(CONSECUTIVE + ", s AS (SELECT conv_id, turn, c, sum(x) AS na, sum(y) AS nb FROM (SELECT conv_id, turn, unnest(string_split(substr(a, 1, 20000), '')) AS c, 1 AS x, 0 AS y FROM p UNION ALL SELECT conv_id, turn, unnest(string_split(substr(b, 1, 20000), '')), 0, 1 FROM p) WHERE c <> '' GROUP BY ALL), r AS (SELECT conv_id, turn, sum(least(na, nb)) AS shared, sum(na + nb) AS size FROM s GROUP BY ALL) SELECT p.conv_id, p.turn, round(coalesce(2 * shared / size, 1), 9) AS ratio FROM p LEFT JOIN r USING (conv_id, turn)")
def quick_ratio_pairs(t):
    return similarity.quick_ratio(_consecutive(t), ["conv_id", "turn"], "old_text", "new_text").withColumn("ratio", F.round("ratio", 9))


@query("""WITH RECURSIVE s AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, abs(length(a.text) - length(b.text)) % 50 AS score FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, i DESC, j DESC) AS k FROM s),
f AS (SELECT conv_id, 0 AS k, []::BIGINT[] AS ui, []::BIGINT[] AS uj FROM (SELECT DISTINCT conv_id FROM s)
  UNION ALL SELECT f.conv_id, o.k, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN ui ELSE list_append(ui, i) END, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN uj ELSE list_append(uj, j) END FROM f JOIN o ON f.conv_id = o.conv_id AND o.k = f.k + 1),
e AS (SELECT conv_id, max_by(ui, k) AS ui, max_by(uj, k) AS uj FROM f GROUP BY conv_id)
SELECT conv_id, n AS documento, ui[n] AS i, uj[n] AS j FROM (SELECT conv_id, ui, uj, unnest(range(1, len(ui) + 1)) AS n FROM e)""")
def greedy_pairing(t):
    c = t.conversations
    a = c.where("role = 'user'").select("conv_id", F.col("turn").alias("i"), F.length("text").alias("x"))
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("j"), F.length("text").alias("y"))
    scored = a.join(b, "conv_id").select("conv_id", "i", "j", (F.abs(F.col("x") - F.col("y")) % 50).alias("score"))
    return similarity.greedy(scored, ["conv_id"])


@query("""WITH RECURSIVE a AS (SELECT conv_id, turn AS i, substr(text, 1, 20000) AS x FROM conversations WHERE role <> 'assistant'), b AS (SELECT conv_id, turn AS j, substr(text, 1, 20000) AS y FROM conversations WHERE role = 'assistant'),
ca AS (SELECT conv_id, i, c, count(*) AS n FROM (SELECT conv_id, i, unnest(string_split(x, '')) AS c FROM a) GROUP BY ALL), cb AS (SELECT conv_id, j, c, count(*) AS n FROM (SELECT conv_id, j, unnest(string_split(y, '')) AS c FROM b) GROUP BY ALL),
m AS (SELECT conv_id, i, j, CAST(sum(least(ca.n, cb.n)) AS BIGINT) AS shared FROM ca JOIN cb USING (conv_id, c) WHERE c <> '' GROUP BY ALL),
s AS (SELECT conv_id, i, j, CASE WHEN length(x) + length(y) > 0 THEN 2 * coalesce(shared, 0) / (length(x) + length(y)) ELSE 1.0::DOUBLE END AS score FROM a JOIN b USING (conv_id) LEFT JOIN m USING (conv_id, i, j)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, i DESC, j DESC) AS k FROM s),
f AS (SELECT conv_id, 0 AS k, []::BIGINT[] AS ui, []::BIGINT[] AS uj FROM (SELECT DISTINCT conv_id FROM s)
  UNION ALL SELECT f.conv_id, o.k, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN ui ELSE list_append(ui, i) END, CASE WHEN list_contains(ui, i) OR list_contains(uj, j) THEN uj ELSE list_append(uj, j) END FROM f JOIN o ON f.conv_id = o.conv_id AND o.k = f.k + 1),
e AS (SELECT conv_id, max_by(ui, k) AS ui, max_by(uj, k) AS uj FROM f GROUP BY conv_id),
t AS (SELECT conv_id, ui[n] AS i, uj[n] AS j, n FROM (SELECT conv_id, ui, uj, unnest(range(1, len(ui) + 1)) AS n FROM e)),
r AS (SELECT conv_id, i, j, score, n, 0 AS side FROM t JOIN s USING (conv_id, i, j) UNION ALL SELECT conv_id, i, NULL, NULL, i, 1 FROM a WHERE (conv_id, i) NOT IN (SELECT (conv_id, i) FROM t) UNION ALL SELECT conv_id, NULL, j, NULL, j, 2 FROM b WHERE (conv_id, j) NOT IN (SELECT (conv_id, j) FROM t))
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY side, n) AS BIGINT) AS documento, i, j, score FROM r""")
def text_pairing(t):
    """Each conversation's questions and answers one to one by the signs they share, the best pair first, and what is left."""
    c = t.conversations
    a = c.where("role <> 'assistant'").select("conv_id", F.col("turn").alias("i"), F.col("text").alias("x"))
    b = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("j"), F.col("text").alias("y"))
    return pairing.paired(a, b, ["conv_id"])


@query(CONSECUTIVE + ", w AS (SELECT conv_id, turn, w, sum(x) AS x FROM (SELECT conv_id, turn, unnest(regexp_extract_all(a, '[^\\s\\p{Z}]+')) AS w, -1 AS x FROM p UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(b, '[^\\s\\p{Z}]+')), 1 FROM p) GROUP BY ALL) SELECT p.conv_id, p.turn, CAST(coalesce(sum(abs(x)), 0) AS BIGINT) AS diferenca FROM p LEFT JOIN w USING (conv_id, turn) GROUP BY ALL")
def token_bag_diff(t):
    """How many words, as a bag, two versions differ by: a lower bound of the words that an alignment marks."""
    p = _consecutive(t)
    words = lambda c, n: p.select("conv_id", "turn", F.explode(tx.tokens(F.col(c))).alias("w"), F.lit(n).alias("x"))
    bag = words("old_text", -1).unionByName(words("new_text", 1)).where(F.col("w") != "\n\n").groupBy("conv_id", "turn", "w").agg(F.sum("x").alias("x"))
    return p.select("conv_id", "turn").join(bag.groupBy("conv_id", "turn").agg(F.sum(F.abs("x")).alias("d")), ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("d", F.lit(0)).alias("diferenca"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\\s\\p{Z}]+')) AS BIGINT) AS n FROM documents")
def token_counts(t):
    return t.documents.select("doc_id", F.size(tx.tokens(F.col("text"))).cast("long").alias("n"))


def _sides(t):
    """A conversation's first half and its second (by turn, the middle one in the second), each role's texts of a half as one section."""
    half = F.col("turn") < F.ceil(F.count("*").over(W.partitionBy("conv_id")) / 2)
    rows = t.conversations.withColumn("first", F.coalesce(half, F.lit(False)))
    inside = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("x"))))
    made = rows.groupBy("first", "conv_id", F.col("role").alias("secao")).agg(F.min("turn").alias("pos"), F.array_join(F.transform(inside, lambda r: r["x"]), "\n\n").alias("texto"))
    return tuple(made.where(F.col("first") == side).drop("first") for side in (True, False))


SIDES = "WITH h AS (SELECT *, coalesce(turn < ceil(count(*) OVER (PARTITION BY conv_id) / 2), false) AS first FROM conversations), m AS (SELECT first, conv_id, role AS secao, min(turn) AS p, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text) AS x FROM h GROUP BY ALL), o AS (SELECT conv_id, secao, p, x FROM m WHERE first), n AS (SELECT conv_id, secao, p, x FROM m WHERE NOT first) "


@query(SIDES + "SELECT conv_id, secao, coalesce(o.x, '') AS old_text, coalesce(n.x, '') AS new_text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY o.p NULLS LAST, n.p) AS BIGINT) AS pos FROM o FULL JOIN n USING (conv_id, secao)")
def section_full_outer(t):
    return sections.beside(*_sides(t), ["conv_id"])


def _steps(t):
    """The old and the new sides of all steps (documento): each role's k-th text and its next, so that every row is in one.

    A role's only text has nothing on the other side: it is old in the first exchange (turns 0 and 1), new after it.
    """
    of = W.partitionBy("conv_id", "role")
    c = t.conversations.select("conv_id", F.col("role").alias("secao"), F.col("turn").alias("pos"), F.col("text").alias("texto"), F.row_number().over(of.orderBy("turn", "text")).alias("k"), F.count("*").over(of).alias("n"))
    old = c.where("k < n or (n = 1 and pos < 2)")
    new = c.where("k > 1 or (n = 1 and not coalesce(pos < 2, false))")
    return tuple(d.select("conv_id", documento.alias("documento"), "secao", "pos", "texto") for d, documento in ((old, F.col("k")), (new, F.greatest(F.col("k") - 1, F.lit(1)))))


def _differences(t):
    rows = sections.differences(sections.beside(*_steps(t), ["conv_id", "documento"]))
    return rows.withColumn("rotulo", F.lit("conversa")).withColumn("tipo", F.lit("vp"))


@query()
def word_diff_summary(t):
    """Aligned differences of sections; sequence alignment isn't SQL, so tests compare with invariants."""
    return _differences(t).select("conv_id", "documento", "secao", "pos", "words", F.round("ratio", 9).alias("ratio"), "changed", "html", "context")


@query()
def diff_text_summary(t):
    return sections.summary(_differences(t), ["conv_id"])


@query()
def diff_html_report(t):
    return sections.html_report(_differences(t), ["conv_id"], "conversas")


@query()
def nested_export(t):
    """Differences nested by document, as the export's details are."""
    rows = sections.with_anchors(_differences(t), ["conv_id"])
    return sections.nested(rows, ["conv_id"], ["secao", "changed", "words", "ratio", "html", "context", "ancora"])


@query()
def split_documents_exact(t):
    """Documents and sections of made-up leaflets whose sections are the documents' lines."""
    body = lines.lines(t.documents.select("doc_id", "text"), ["doc_id"])
    titles = F.array(*map(F.lit, (lines.TITLES[0], lines.TITLES[1], "1. PARA QUE SERVE ISTO?", "2. COMO FUNCIONA ISTO?", lines.TITLES[3])))
    rows = body.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    woven = F.flatten(F.transform("l", lambda x, i: F.when(i < 5, F.array(F.get(titles, i), x["line"])).otherwise(F.array(x["line"]))))
    found = rows.select("doc_id", segment.split_column()(woven).alias("documentos"))
    return found.select("doc_id", F.explode("documentos").alias("d")).select("doc_id", F.col("d.tipo").alias("tipo"), F.explode("d.secoes").alias("s")).select("doc_id", "tipo", "s.pos", "s.secao", F.length("s.texto").alias("tamanho"))


@query(r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<nav\b.*?</nav>', '', 'g'), '(?is)<footer\b.*?</footer>', '', 'g'), '(?is)<div class="ad">.*?</div>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, unnest(list_zip(x, range(1, len(x) + 1))) AS z FROM (SELECT page_id, regexp_extract_all(h, '(?is)<(?:h1|h2|h3|p|li|td)\b[^>]*>.*?</(?:h1|h2|h3|p|li|td)>') AS x FROM c)),
r AS (SELECT page_id, CAST(z[2] AS BIGINT) AS pos, lower(regexp_extract(z[1], '^<([A-Za-z0-9]+)', 1)) AS tag, trim(regexp_replace(regexp_replace(z[1], '(?s)<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM b)
SELECT * FROM r WHERE text <> ''""")
def html_blocks(t):
    return layout.html_blocks(t.pages, ["page_id"])


@query("""WITH RECURSIVE e AS (SELECT c_custkey // 1000 AS doc, c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'P' WHEN c_custkey % 11 = 0 THEN 'TR' ELSE 'Span' END AS tag, CASE WHEN c_custkey % 1000 < 2 THEN NULL ELSE c_custkey - 1 - c_custkey % 2 END AS parent FROM customer),
c AS (SELECT doc, id, id AS node, tag, parent, 0 AS level FROM e UNION ALL SELECT c.doc, c.id, e.id, e.tag, e.parent, level + 1 FROM c JOIN e ON c.doc = e.doc AND c.parent = e.id)
SELECT doc, id AS element_id, coalesce(arg_min(node, level) FILTER (tag <> 'Span'), arg_max(node, level)) AS block, arg_min(node, level) FILTER (tag = 'TR') AS "row" FROM c GROUP BY doc, id""")
def ancestor_chain(t):
    key = F.col("c_custkey")
    tag = F.when(key % 7 == 0, "X-P").when(key % 11 == 0, "TR").otherwise("Span")
    tree = t.customer.select(F.expr("c_custkey div 1000").alias("doc"), key.alias("element_id"), tag.alias("tag"), F.when(key % 1000 < 2, None).otherwise(key - 1 - key % 2).alias("parent_id"))
    return layout.owners(tree, t.spark.createDataFrame([("X-P", "P")], "tag string, standard_tag string"), ["doc"])


@query(r"""WITH l AS (SELECT item_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM benchmark),
w AS (SELECT doc, n, array_to_string(regexp_extract_all(line, '\S+'), ' ') AS text FROM l)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY n) AS pos, text FROM w WHERE text <> ''""")
def glyph_blocks(t):
    """Blocks of glyphs laid out from texts: every sign 5 points wide, lines 12 points apart, a chunk for each line."""
    rows = lines.lines(t.benchmark.select(F.col("item_id").alias("doc"), F.col("text")), ["doc"])
    signs = rows.select("doc", F.lit(1).alias("page"), F.col("pos").alias("mcid"), "pos", F.posexplode(F.filter(F.split("line", ""), lambda c: c != "")).alias("k", "text"))
    glyphs = signs.select("doc", "page", (F.col("pos") * 100_000 + F.col("k")).alias("seq"), "mcid", "text", (F.col("k") * 5.0).alias("x0"), (F.col("k") * 5.0 + 5).alias("x1"), (F.col("pos") * 12.0).alias("top"))
    owned = rows.select("doc", F.lit(1).alias("page"), F.col("pos").alias("mcid"), F.concat(F.lit("p"), F.col("pos").cast("string")).alias("block"), F.lit(None).cast("string").alias("row"))
    return layout.blocks(glyphs, owned)


@query("SELECT w AS token, count(*) AS n_docs, count(*) * 1.0 / (SELECT count(*) FROM benchmark) AS parte FROM (SELECT DISTINCT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark) GROUP BY 1")
def inverted_index(t):
    """Documents of each token of a small text table, as a search index holds them."""
    tokens = t.benchmark.select("item_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).select("item_id", F.lower("w").alias("token")).distinct()
    n = t.benchmark.agg(F.count("*").alias("n"))
    return tokens.groupBy("token").agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(n)).select("token", "n_docs", (F.col("n_docs") / F.col("n")).alias("parte"))  # one row
