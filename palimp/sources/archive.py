"""The archive of versions: JSON files by product, their names, product metadata, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SECTIONS = "array<struct<tipo:string,secoes:map<string,string>>>"
_HISTORY = "array<struct<data:string,expediente:string,assunto:string,itens:string,versoes:string,apresentacoes:string,aprovacao:string>>"
VERSION = f"registro string, expediente string, data string, situacao string, tipo string, pdf_sha256 string, paginas int, documentos {_SECTIONS}, historico_tabela {_HISTORY}, marcado boolean, documentos_linhas {_SECTIONS}"
PRODUCT = "numeroRegistro:string,idProduto:bigint,nomeProduto:string,razaoSocial:string,cnpj:string,expediente:string,data:string,numProcesso:string"
ITEM = "idDocumento:bigint,expediente:string,dataPublicacao:string,descSituacao:string,idBulaPaciente:string,idBulaProfissional:string"
DETAIL = "principioAtivo:string,classesTerapeuticas:array<string>,categoriaRegulatoria:string,medicamentoReferencia:string,apresentacoes:array<struct<apresentacao:string>>"
META = f"produto struct<{PRODUCT}>, historico struct<registroProduto:string,nomeProduto:string,historico:struct<content:array<struct<{ITEM}>>,totalElements:bigint>>, detalhe struct<{DETAIL}>"
#: Keys that hold short-lived tokens; they are dropped so that files stay the same.
TOKENS = ("idBulaPacienteProtegido", "idBulaProfissionalProtegido", "idBulaPaciente", "idBulaProfissional")
NAME = r"([^/]+)/([^/_]+)_([^/_]+)_([^/_]+)\.json$"


def parts(path: Column) -> list[Column]:
    """registro, data, expediente and tipo from a version file's path."""
    cut = lambda i: F.regexp_extract(path, NAME, i)
    return [cut(1).alias("registro"), cut(2).cast("date").alias("data"), cut(3).alias("expediente"), cut(4).alias("tipo")]


def ordered(documents: Column) -> Column:
    """Sections in their order in the file, as arrays: maps would not keep it through grouping."""
    one = lambda d: F.struct(d["tipo"].alias("tipo"), F.transform(F.map_entries(d["secoes"]), lambda e, i: F.struct(i.alias("pos"), e["key"].alias("secao"), e["value"].alias("texto"))).alias("secoes"))
    return F.transform(F.coalesce(documents, F.array().cast(_SECTIONS)), one)


def versions(spark: SparkSession, root: str, registro: str | None = None) -> DataFrame:
    """Version files of an archive (of one product, if given, reading only its folder); what old files lack is false or empty."""
    raw = spark.read.schema(VERSION).option("multiLine", True).json(f"{root}/{registro or '*'}/*_*_*.json")
    return raw.withColumn("marcado", F.coalesce("marcado", F.lit(False))).withColumn("documentos", ordered(F.col("documentos"))).withColumn("documentos_linhas", ordered(F.col("documentos_linhas")))


def meta(spark: SparkSession, root: str, registro: str | None = None) -> DataFrame:
    """registro (the folder) and the product's metadata."""
    raw = spark.read.schema(META).option("multiLine", True).json(f"{root}/{registro or '*'}/meta.json")
    return raw.withColumn("registro", F.regexp_extract("_metadata.file_path", r"([^/]+)/meta\.json$", 1))


def keys(spark: SparkSession, root: str) -> DataFrame:
    return meta(spark, root).select("registro").distinct().orderBy("registro")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """registro, data, expediente and a map from kind to file, without reading the files' contents."""
    files = spark.read.format("binaryFile").load(f"{root}/*/*_*_*.json").select("path")
    named = files.select("path", *parts(F.col("path")))
    return named.groupBy("registro", "data", "expediente").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tipo", "path")))).alias("textos"))


def either(marked, plain):
    """The documents found by the structure; where there are none, those found by lines."""
    return F.when(F.size(marked) > 0, marked).otherwise(plain)


def comparable(marked: Column, other_marked: Column, documents: Column, by_lines: Column) -> Column:
    """Documents to compare: those by lines if only this side has a structure tree and they exist."""
    return F.when(marked & ~other_marked & (F.size(by_lines) > 0), by_lines).otherwise(documents)


def without_fields(df: DataFrame, names: tuple[str, ...] = TOKENS) -> DataFrame:
    """df without the named fields at any depth of structs and arrays."""
    from pyspark.sql import types as T

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in names)))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields if f.name not in names))


def curated(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file without what follows a #, blank ones left out; a missing file is empty."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path).select(uncommented(F.col("value")).alias("value")).where("value <> ''")


def uncommented(c: Column) -> Column:
    return F.trim(F.get(F.split(c, "#", 2), F.lit(0)))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file: an archived version's, or (binary) a PDF's bytes, whose text a caller extracts."""
    if path.endswith(".json"):
        return spark.read.schema(VERSION).option("multiLine", True).json(path).select(ordered(F.col("documentos")).alias("documentos"))
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("pdf_sha256"))
