"""Nested documents and sequence files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROTEIN_SCHEMA = """
  proteinDescription struct<
    recommendedName: struct<ecNumbers: array<struct<value: string>>>,
    alternativeNames: array<struct<ecNumbers: array<struct<value: string>>>>>,
  comments array<struct<commentType: string, reaction: struct<ecNumber: string>>>,
  keywords array<struct<id: string>>,
  uniProtKBCrossReferences array<struct<database: string, id: string>>
"""


def parse_annotation(df: DataFrame, *, key: str, document: str, database: str) -> DataFrame:
    """EC numbers, keyword ids and the first cross-reference of one database, per JSON document."""
    none = F.array().cast("array<string>")
    d = F.from_json(F.col(document), PROTEIN_SCHEMA)
    n = df.select(key, d.alias("d"))
    blocks = F.concat(
        F.array(F.col("d.proteinDescription.recommendedName")),
        F.coalesce(F.col("d.proteinDescription.alternativeNames"), F.array()),
    )
    named = F.flatten(
        F.transform(blocks, lambda b: F.coalesce(F.transform(b["ecNumbers"], lambda e: e["value"]), none))
    )
    catalytic = F.transform(
        F.filter(F.coalesce(F.col("d.comments"), F.array()), lambda c: c["commentType"] == "CATALYTIC ACTIVITY"),
        lambda c: c["reaction"]["ecNumber"],
    )
    filled = lambda a: F.filter(a, lambda x: x.isNotNull() & (x != ""))
    refs = F.filter(F.coalesce(F.col("d.uniProtKBCrossReferences"), F.array()), lambda r: r["database"] == database)
    return n.select(
        key,
        F.array_distinct(filled(F.concat(named, catalytic))).alias("ec"),
        F.coalesce(filled(F.transform("d.keywords", lambda k: k["id"])), none).alias("keywords"),
        F.get(refs, F.lit(0))["id"].alias("xref"),
    )


def parse_fasta_record(record: str | Column) -> list[Column]:
    """``accession`` (second pipe field, isoform suffix removed) and ``sequence`` of one ``>`` record."""
    r = F.col(record) if isinstance(record, str) else record
    head = F.substring_index(r, "\n", 1)
    body = F.substring(r, F.length(head) + 2, F.length(r))
    fields = F.split(F.substring_index(F.trim(head), " ", 1), r"\|")
    accession = F.when(F.size(fields) > 1, F.get(fields, F.lit(1))).otherwise(F.get(fields, F.lit(0)))
    return [
        F.regexp_replace(accession, r"-\d+$", "").alias("accession"),
        F.regexp_replace(body, r"\s", "").alias("sequence"),
    ]


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; the reader splits on ``>``, so a file is read in parallel."""
    lines = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    return lines.select(*parse_fasta_record("value"))


def flatten_json(df: DataFrame, *, keys: list[str], document: str, max_depth: int = 8) -> DataFrame:
    """Every scalar leaf of every document as (keys, path, value, kind).

    Paths read ``a.b[0].c``. The document is parsed once and opened level by level in
    one chain: a leaf passes through, a container becomes its entries. Documents
    nested deeper than ``max_depth`` raise, so no leaf is lost; unreadable documents
    are listed by :func:`unreadable_json`.
    """
    spark = df.sparkSession
    level = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(document).alias("node")).where("node IS NOT NULL")
    nested = F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)")
    for _ in range(max_depth):
        opened = level.withColumns({"_nested": nested, "_in": F.when(nested, F.col("node"))}).lateralJoin(
            spark.tvf.variant_explode_outer(F.col("_in").outer())
        )
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(
            F.when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), F.col("key")))
        )
        level = opened.where(~F.col("_nested") | F.col("value").isNotNull()).select(
            *keys,
            F.when(F.col("_nested"), F.concat("path", step)).otherwise(F.col("path")).alias("path"),
            F.when(F.col("_nested"), F.col("value")).otherwise(F.col("node")).alias("node"),
        )
    kind = F.regexp_extract(F.schema_of_variant("node"), r"^[A-Z]+", 0)
    deep = F.raise_error(F.lit("document nested deeper than max_depth")).cast("string")
    return level.select(*keys, "path", F.when(nested, deep).otherwise(F.col("node").cast("string")).alias("value"), kind.alias("kind"))


def unreadable_json(df: DataFrame, *, keys: list[str], document: str) -> DataFrame:
    return df.where(F.try_parse_json(document).isNull()).select(*keys)
