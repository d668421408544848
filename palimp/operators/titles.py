"""The sections' titles, which depend on the kind of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Titles of the sections of each kind of text.
TITLES = {
    "vp": {
        "I": "Identificação do medicamento",
        "II": "Informações ao paciente",
        "1": "Para que este medicamento é indicado?",
        "2": "Como este medicamento funciona?",
        "3": "Quando não devo usar este medicamento?",
        "4": "O que devo saber antes de usar este medicamento?",
        "5": "Onde, como e por quanto tempo posso guardar este medicamento?",
        "6": "Como devo usar este medicamento?",
        "7": "O que devo fazer quando eu me esquecer de usar este medicamento?",
        "8": "Quais os males que este medicamento pode me causar?",
        "9": "O que fazer se alguém usar uma quantidade maior do que a indicada?",
        "III": "Dizeres legais",
    },
    "vps": {
        "I": "Identificação do medicamento",
        "II": "Informações técnicas aos profissionais de saúde",
        "1": "Indicações",
        "2": "Resultados de eficácia",
        "3": "Características farmacológicas",
        "4": "Contraindicações",
        "5": "Advertências e precauções",
        "6": "Interações medicamentosas",
        "7": "Cuidados de armazenamento do medicamento",
        "8": "Posologia e modo de usar",
        "9": "Reações adversas",
        "10": "Superdose",
        "III": "Dizeres legais",
    },
}


def dimension(spark: SparkSession) -> DataFrame:
    """tipo, secao, titulo."""
    return spark.createDataFrame([(k, s, t) for k, of in TITLES.items() for s, t in of.items()], "tipo string, secao string, titulo string")


def titled(rows: DataFrame, kind: str = "tipo", section: str = "secao") -> DataFrame:
    """+ titulo: a section's name with its title; a section without a title, or of another kind of text, is its own."""
    names = dimension(rows.sparkSession).select(F.col("tipo").alias(kind), F.col("secao").alias(section), F.col("titulo").alias("__t"))
    between = F.when(F.col(section).rlike(r"^\d+$"), ". ").otherwise(" – ")
    found = rows.join(F.broadcast(names), [kind, section], "left")  # as many rows as there are titles
    return found.withColumn("titulo", F.coalesce(F.concat(F.col(section), between, F.col("__t")), F.col(section))).drop("__t")
