"""From an archive's versions to what is published: differences between contents, products, recent changes, feed and catalog.

Everything is one lazy plan over the versions DataFrame of palimp.sources.archive; only the alignment of unequal section
texts runs in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimp.functions import text as tx
from palimp.operators import catalog as cat
from palimp.operators import pairing, sections, versions
from palimp.operators.segment import PREAMBLE
from palimp.sources.archive import comparable

PAIR = ["registro", "tipo", "de", "para"]


def declared(history: F.Column) -> F.Column:
    """Sections that the last row of the declaration table names; none without rows."""
    return F.when(F.size(history) > 0, tx.declared_sections(F.element_at(history, -1)["itens"])).otherwise(F.array().cast("array<string>"))


def content_pairs(archived: DataFrame) -> DataFrame:
    """PAIR, dates, marcado, declarado and the documents of both sides, of each content with the one before it.

    A listing that repeats an expediente counts at its first date, with that file's text; contents are told by hash.
    """
    first = versions.first_of(archived, "registro", "expediente", "tipo").withColumnRenamed("pdf_sha256", "hash")
    chained = versions.chain(first)
    order = W.partitionBy("registro", "tipo").orderBy("data", "expediente")
    fields = ("expediente", "data", "marcado", "documentos", "documentos_linhas")
    both = chained.withColumn("o", F.lag(F.struct(*fields)).over(order)).where("o is not null")
    old = comparable(F.col("o.marcado"), F.col("marcado"), F.col("o.documentos"), F.col("o.documentos_linhas"))
    new = comparable(F.col("marcado"), F.col("o.marcado"), F.col("documentos"), F.col("documentos_linhas"))
    return both.select("registro", "tipo", F.col("o.expediente").alias("de"), F.col("expediente").alias("para"), F.col("o.data").alias("de_data"), F.col("data").alias("para_data"), (F.col("o.marcado") & F.col("marcado")).alias("marcado"), declared(F.col("historico_tabela")).alias("declarado"), old.alias("antes"), new.alias("depois"))


def _documents(pairs: DataFrame, side: str, at: str) -> DataFrame:
    """PAIR, place and document of one side; the document's label and the text it is compared by."""
    text_of = lambda name: F.get(F.filter("d.secoes", lambda s: s["secao"] == name), F.lit(0))["texto"]
    rows = pairs.select(*PAIR, F.posexplode(side).alias(at, "d"))
    return rows.select(*PAIR, at, F.col("d.secoes").alias("secoes"), F.concat_ws(" ", F.transform("d.secoes", lambda s: s["texto"])).alias("texto"), tx.label(text_of("I"), text_of(PREAMBLE)).alias("rotulo"))


def paired_documents(pairs: DataFrame) -> DataFrame:
    """PAIR, documento (from 1), i, j: documents matched one to one by similarity, then those left over on either side."""
    a, b = _documents(pairs, "antes", "i").select(*PAIR, "i", F.col("texto").alias("x")), _documents(pairs, "depois", "j").select(*PAIR, "j", F.col("texto").alias("y"))
    return pairing.paired(a, b, PAIR).select(*PAIR, "documento", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))


def section_diffs(pairs: DataFrame, skip_preamble: bool = True) -> DataFrame:
    """PAIR, documento, rotulo, secao, pos, html, context, words, ratio, changed for each section of the paired documents."""
    matched = paired_documents(pairs)
    side = lambda name, at: matched.join(_documents(pairs, name, at), [*PAIR, at]).select(*PAIR, "documento", "rotulo", F.explode("secoes").alias("s")).select(*PAIR, "documento", "rotulo", "s.secao", "s.pos", "s.texto")
    old, new = side("antes", "i"), side("depois", "j")
    keys = [*PAIR, "documento"]
    named = old.select(*keys, F.col("rotulo").alias("__a")).distinct().join(new.select(*keys, F.col("rotulo").alias("__b")).distinct(), keys, "full_outer").select(*keys, F.coalesce("__a", "__b").alias("rotulo"))
    both = sections.beside(old, new, keys)
    if skip_preamble:
        both = both.where(F.col("secao") != PREAMBLE)
    return sections.differences(both).join(named, keys)


def diffs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """PAIR, slug, dates, alteradas, declarado, marcado and nested documents; pairs without documents have none."""
    told = rows.join(pairs.select(*PAIR, "declarado"), PAIR).withColumn("declarada", F.array_contains("declarado", F.col("secao"))).drop("declarado")
    nested = sections.nested(sections.with_anchors(told, PAIR), PAIR, ["secao", "changed", "declarada", "words", "ratio", "html", "context", "ancora"])
    changed = rows.groupBy(*PAIR).agg(tx.in_order(F.collect_set(F.when(F.col("changed"), F.col("secao")))).alias("alteradas"))
    out = pairs.drop("antes", "depois").join(changed, PAIR, "left").join(nested, PAIR, "left")
    return out.withColumn("slug", tx.slug(F.col("de"), F.col("para"), F.col("tipo"))).withColumn("declarado", tx.in_order(F.col("declarado"))).withColumn("alteradas", F.coalesce("alteradas", F.array().cast("array<string>")))


def version_rows(archived: DataFrame, metas: DataFrame) -> DataFrame:
    """registro, expediente, data, republicada, situacao, declarado (map by kind), repetida: one row for each expediente."""
    dated = archived.groupBy("registro", "data", "expediente").agg(F.count("*").alias("k"))
    listed = versions.relisted(dated, "registro", "expediente").drop("n_listings")
    first = versions.first_of(archived, "registro", "expediente", "tipo")
    own = first.groupBy("registro", "expediente").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tipo", declared(F.col("historico_tabela")).alias("d"))))).alias("declarado"))
    again = versions.repeated_versions(first.withColumnRenamed("pdf_sha256", "hash"))
    items = metas.select("registro", F.posexplode("historico.historico.content").alias("pos", "h")).select("registro", F.col("h.expediente").alias("expediente"), F.col("h.descSituacao").alias("situacao"), "pos")
    return versions.with_status(listed.join(own, ["registro", "expediente"]).join(again, ["registro", "expediente"]), items)


def products(archived: DataFrame, metas: DataFrame, made: DataFrame) -> DataFrame:
    """The products' entries; products without metadata have none."""
    counted = archived.select("registro", "data", "expediente").distinct().groupBy("registro").agg(F.count("*").alias("n_versoes"))
    slugs = made.groupBy("registro").agg(F.transform(F.array_sort(F.collect_list(F.struct("tipo", "para_data", "para", "slug"))), lambda x: x["slug"]).alias("diffs"))
    shown = F.filter(F.transform(F.coalesce("detalhe.apresentacoes", F.array().cast("array<struct<apresentacao:string>>")), lambda a: a["apresentacao"]), lambda x: x.isNotNull() & (x != ""))
    text = lambda c: tx.or_empty(F.col(f"detalhe.{c}"))
    entry = metas.where("produto is not null").select("registro", "produto.idProduto", F.col("produto.nomeProduto").alias("nome"), F.col("produto.razaoSocial").alias("empresa"), "produto.cnpj", text("principioAtivo").alias("principio_ativo"), F.coalesce("detalhe.classesTerapeuticas", F.array().cast("array<string>")).alias("classes"), text("categoriaRegulatoria").alias("categoria"), text("medicamentoReferencia").alias("referencia"), shown.alias("apresentacoes"), tx.day(F.col("produto.data")).alias("ultima_publicacao"))
    out = entry.join(counted, "registro", "left").join(slugs, "registro", "left")
    return out.withColumn("n_versoes", F.coalesce("n_versoes", F.lit(0))).withColumn("diffs", F.coalesce("diffs", F.array().cast("array<string>"))).orderBy(F.desc("ultima_publicacao"), "registro")


def recent(entries: DataFrame, made: DataFrame) -> DataFrame:
    """The newest differences without their texts: only the columns shown are read for the sort."""
    rows = made.select("registro", "slug", "tipo", "para_data", "alteradas", "declarado").join(entries.select("registro", "nome", "empresa"), "registro")
    return rows.orderBy(F.desc("para_data"), F.desc("nome"), "registro", "tipo", "slug").limit(cat.RECENT)


def write(archived: DataFrame, metas: DataFrame, feed: DataFrame, catalog: DataFrame, out: str) -> None:
    """The five outputs: produtos, detalhes (a folder for each product), recentes, feed and catalogo."""
    from palimp.sources.store import kept

    pairs = kept(content_pairs(archived))
    made = kept(diffs(pairs, section_diffs(pairs)))
    entries = kept(products(archived, metas, made))
    entries.write.mode("overwrite").json(f"{out}/produtos")
    made.join(entries.select("registro"), "registro", "left_semi").repartition("registro").write.mode("overwrite").partitionBy("registro").json(f"{out}/diffs")
    version_rows(archived, metas).repartition("registro").write.mode("overwrite").partitionBy("registro").json(f"{out}/versoes")
    recent(entries, made).write.mode("overwrite").json(f"{out}/recentes")
    cat.marked(feed.select("registro", "nome", "empresa", "expediente", "data"), entries).write.mode("overwrite").json(f"{out}/feed")
    cat.marked(catalog, entries).write.mode("overwrite").json(f"{out}/catalogo")


def validation(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """PAIR, declarado, detectado and bate for each pair: identification changes aren't declared."""
    found = rows.groupBy(*PAIR).agg(F.array_sort(F.collect_set(F.when(F.col("changed"), F.col("secao")))).alias("detectado"))
    both = pairs.select(*PAIR, "declarado").join(found, PAIR, "left").withColumn("detectado", F.coalesce("detectado", F.array().cast("array<string>")))
    return cat.agreement(both)


def report(targets: DataFrame, checked: DataFrame) -> DataFrame:
    """checked (registro, ...) for each distinct target, and erro: a target that isn't there is a row of its own with the error."""
    rows = targets.select("registro").distinct().join(checked.withColumn("__in", F.lit(True)), "registro", "left")
    lost = F.concat(F.lit("LookupError: "), F.col("registro"))
    return rows.withColumn("erro", F.when(F.col("__in").isNull(), lost)).drop("__in")
