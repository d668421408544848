"""python -m palimp: archiving, feeds, catalogs, exports and views of an archive of versions."""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import sys

from pyspark.sql import functions as F

from palimp.functions import text as tx
from palimp.operators import catalog, export, ranking, sections
from palimp.session import session
from palimp.sources import archive, ingest, paged, snapshots

#: Options of the commands, besides the archive's folder.
SERVICE = {"--service": {"required": True, "help": "import path of the service's transport"}, "--pace": {"type": float, "default": paged.PACE}}
COMMANDS: dict[str, tuple[str, dict[str, dict]]] = {
    "export": ("write the five outputs", {"out": {}}),
    "diff": ("summaries of the last difference of a product", {"registro": {}}),
    "sections": ("sections of a product's documents", {"registro": {}}),
    "history": ("declared changes of a product", {"registro": {}}),
    "search": ("products of the archive", {"--nome": {}, "--cnpj": {}, "--de": {}, "--ate": {}}),
    "fetch": ("archive the newest versions of products", {"registro": {"nargs": "*"}, "--curated": {"help": "file with one product a line, all versions"}, "--latest": {"type": int, "default": 2}, "--all": {"action": "store_true"}, "--extract": {"required": True, "help": "import path of a function from a file's bytes to its texts"}, **SERVICE}),
    "feed": ("append what was published", {"state": {}, "--de": {}, "--ate": {}, **SERVICE}),
    "catalog": ("write the catalog, if it is older than six days", {"out": {}, "--force": {"action": "store_true"}, **SERVICE}),
}


def imported(path: str):
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="palimp")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (help_, options) in COMMANDS.items():
        c = commands.add_parser(name, help=help_)
        c.add_argument("root", help="the archive's folder")
        for option, settings in options.items():
            c.add_argument(option, **settings)
    a = top.parse_args(argv)
    spark = session()
    if a.command == "export":
        rows = archive.versions(spark, a.root)
        metas = archive.meta(spark, a.root)
        every = catalog.catalog(metas.select("produto.*"))
        export.write(rows, metas, every, every, a.out)
    elif a.command == "search":
        found = catalog.search(catalog.catalog(archive.meta(spark, a.root).select("produto.*")), nome=a.nome, cnpj=a.cnpj, start=a.de, end=a.ate)
        found.orderBy(F.lower("nome"), "registro").show(1000, False)
    elif a.command == "fetch":
        asked = spark.createDataFrame([(r,) for r in a.registro], "registro string")
        if a.curated:
            asked = asked.unionByName(archive.curated(spark, a.curated).withColumnRenamed("value", "registro"))
        report = ingest.fetch(spark, asked, a.root, a.service, imported(a.extract), latest=None if a.all or a.curated else a.latest, pace=a.pace)
        report.orderBy("registro", "expediente", "tipo").show(1000, False)
        if failed := report.where("error is not null").count():
            sys.exit(f"{failed} with errors; what could be had is saved")
    elif a.command == "feed":
        from palimp.streaming import feed

        print("covered up to", feed.run(spark, a.root, a.state, desde=a.de, ate=a.ate, fetch=a.service, pace=a.pace))
    elif a.command == "catalog":
        today = str(dt.date.today())
        if a.force or catalog.stale(snapshots.state(spark, a.out)["atualizado"], today):
            paged.register(spark)
            rows = spark.read.format("paged").option("fetch", a.service).option("count", 1000).option("pace", a.pace).load()
            print(snapshots.write(ranking.numbered(catalog.catalog(rows), F.lower("nome"), F.col("registro")), a.out, today, products=F.count("*")))
    else:
        own = archive.versions(spark, a.root, a.registro)
        if a.command == "diff":
            pairs = export.content_pairs(own)
            sections.summary(export.section_diffs(pairs), export.PAIR).orderBy("para").show(1000, False)
        elif a.command == "sections":
            own.select("data", "expediente", "tipo", F.posexplode("documentos").alias("n", "d")).select("data", "expediente", "tipo", "n", F.explode("d.secoes").alias("s")).select("data", "expediente", "tipo", "n", "s.secao", F.length("s.texto").alias("tamanho")).show(1000, False)
        else:
            told = F.concat_ws(", ", tx.declared_sections(F.col("h.itens")))
            own.select("tipo", F.explode("historico_tabela").alias("h")).select("tipo", "h.data", "h.expediente", "h.versoes", F.when(told == "", "-").otherwise(told).alias("secoes"), F.substring("h.itens", 1, 70).alias("itens")).show(1000, False)


if __name__ == "__main__":
    main()
