"""Views over the given tables, shaped like the inputs the operators expect.

Each view has an equal SQL text, so a query over it can be checked elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.hashing import draw_int
from kinfold.operators.splits import group_folds

CLASSES = ("F", "O", "P")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with a group (customer) and a family (nation)."""
    orders = table(spark, sf, "orders")
    customer = table(spark, sf, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("gene"),
        F.col("c_nationkey").alias("family"),
        F.col("o_orderstatus").alias("label"),
        F.col("c_mktsegment").alias("source"),
        F.col("o_totalprice").alias("score"),
        F.col("c_acctbal").alias("gene_score"),
    )


VARIANTS_SQL = """variants AS (
  SELECT o_orderkey AS row_id, o_custkey AS gene, c_nationkey AS family, o_orderstatus AS label,
         c_mktsegment AS source, o_totalprice AS score, c_acctbal AS gene_score
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated records with conflicting labels and one provenance id each."""
    return table(spark, sf, "lineitem").select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("key"),
        F.col("l_orderkey").alias("gene"),
        F.col("l_linenumber").alias("aa_pos"),
        F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("tier"),
        F.col("l_partkey").alias("prov_id"),
        F.col("l_suppkey").alias("sub_id"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_quantity").alias("quantity"),
        F.unix_timestamp("l_shipdate").alias("stamp"),
    )


REPEATS_SQL = """repeats AS (
  SELECT concat_ws('_', l_orderkey, l_linenumber) AS key, l_orderkey AS gene, l_linenumber AS aa_pos,
         l_returnflag AS label, l_linestatus AS tier, l_partkey AS prov_id, l_suppkey AS sub_id,
         l_extendedprice AS amount, l_quantity AS quantity, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS stamp
  FROM lineitem)"""


def binary(spark: SparkSession, sf: str, target: str = "quality") -> DataFrame:
    """A 0/1 task with a score, a group and a family."""
    return (
        table(spark, sf, "labels")
        .join(table(spark, sf, "documents"), "doc_id")
        .select(
            F.col("doc_id").alias("row_id"),
            F.col(target).cast("int").alias("y"),
            F.col("n_chars").cast("double").alias("score"),
            F.col("source").alias("gene"),
            F.col("lang").alias("family"),
        )
    )


BINARY_SQL = """binrows AS (
  SELECT doc_id AS row_id, CAST(quality AS INTEGER) AS y, CAST(n_chars AS DOUBLE) AS score, source AS gene, lang AS family
  FROM labels JOIN documents USING (doc_id))"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").alias("label"),
        F.floor(F.col("vec_id") / 5).alias("gene"),
        F.pmod(F.floor(F.col("vec_id") / 5), F.lit(17)).alias("family"),
    )


VECTORS_SQL = """vectors AS (
  SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vec, label, vec_id // 5 AS gene, (vec_id // 5) % 17 AS family
  FROM embeddings)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Wildtype and mutant vectors: even and odd ids."""
    v = vectors(spark, sf)
    wt = v.where("row_id % 2 = 0").select(
        F.floor(F.col("row_id") / 2).alias("row_id"), F.col("vec").alias("wt"), "label"
    )
    mut = v.where("row_id % 2 = 1").select(F.floor(F.col("row_id") / 2).alias("row_id"), F.col("vec").alias("mut"))
    return wt.join(mut, "row_id").select(
        "row_id",
        "wt",
        "mut",
        "label",
        F.floor(F.col("row_id") / 5).alias("gene"),
        F.pmod(F.floor(F.col("row_id") / 5), F.lit(7)).alias("family"),
    )


PAIRS_SQL = (
    VECTORS_SQL
    + """, pairs AS (
  SELECT a.row_id // 2 AS row_id, a.vec AS wt, b.vec AS mut, a.label AS label, (a.row_id // 2) // 5 AS gene,
         ((a.row_id // 2) // 5) % 7 AS family
  FROM vectors a JOIN vectors b ON a.row_id % 2 = 0 AND b.row_id = a.row_id + 1)"""
)


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Long strings with a position, its letter and a letter to put there."""
    pos = 1 + F.pmod(F.col("doc_id") * 37, F.col("n_chars"))
    return table(spark, sf, "documents").where("n_chars > 0").select(
        F.col("doc_id").alias("row_id"),
        F.col("text").alias("sequence"),
        F.col("source").alias("gene"),
        F.col("lang").alias("family"),
        F.col("n_chars").alias("seq_len"),
        pos.cast("int").alias("aa_pos"),
        F.substring("text", pos.cast("int"), F.lit(1)).alias("aa_wt"),
        F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (1 + F.pmod(F.col("doc_id"), F.lit(20))).cast("int"), F.lit(1)).alias("aa_mut"),
    )


SEQUENCES_SQL = """sequences AS (
  SELECT doc_id AS row_id, text AS sequence, source AS gene, lang AS family, n_chars AS seq_len,
         CAST(1 + (doc_id * 37) % n_chars AS INTEGER) AS aa_pos,
         substring(text, CAST(1 + (doc_id * 37) % n_chars AS BIGINT), 1) AS aa_wt,
         substring('ACDEFGHIKLMNPQRSTVWY', CAST(1 + doc_id % 20 AS BIGINT), 1) AS aa_mut
  FROM documents WHERE n_chars > 0)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey").alias("a"), F.concat(F.lit("S"), "l_suppkey").alias("b")
    )


EDGES_SQL = """edges AS (SELECT 'P' || l_partkey AS a, 'S' || l_suppkey AS b FROM lineitem)"""


def attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Group-level numbers with declared gaps (every seventh id) and a sparse family."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("gene"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("family"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("price"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("double")).alias("size"),
        F.col("p_type").alias("kind"),
    )


ATTRIBUTES_SQL = """attributes AS (
  SELECT p_partkey AS gene, CASE WHEN p_partkey % 11 <> 0 THEN p_brand END AS family,
         CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS price,
         CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS size, p_type AS kind
  FROM part)"""


def prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("user_id").alias("gene"),
        F.col("event_type").alias("outcome"),
        F.col("value").alias("latency"),
        F.col("props"),
        "ts",
    )


LOG_SQL = """prediction_log AS (
  SELECT event_id AS row_id, user_id AS gene, event_type AS outcome, value AS latency, props, ts FROM events)"""


def with_shares(df: DataFrame, arm: str, classes=CLASSES, label: str = "label") -> DataFrame:
    """Class shares that lean towards the true label; they stand for a model's output."""
    weights = [
        (1 + draw_int(f"{arm}{i}", "row_id") % 97 + F.when(F.col(label) == c, 40).otherwise(0)).cast("double")
        for i, c in enumerate(classes)
    ]
    total = sum(weights[1:], weights[0])
    return df.withColumn("proba", F.array(*[w / total for w in weights]))


def shares_sql(source: str, arm: str, out: str, classes=CLASSES) -> str:
    w = [
        f"CAST(1 + {h_sql(f'{arm}{i}', 'row_id')} % 97 + CASE WHEN label = '{c}' THEN 40 ELSE 0 END AS DOUBLE)"
        for i, c in enumerate(classes)
    ]
    cols = ", ".join(f"{x} AS w{i}" for i, x in enumerate(w))
    total = " + ".join(f"w{i}" for i in range(len(w)))
    shares = ", ".join(f"w{i} / ({total})" for i in range(len(w)))
    return (
        f"{out}_w AS (SELECT *, {cols} FROM {source}), "
        f"{out} AS (SELECT * EXCLUDE ({', '.join(f'w{i}' for i in range(len(w)))}), [{shares}] AS proba FROM {out}_w)"
    )


def h_sql(seed, *parts: str) -> str:
    return f"CAST('0x' || substr({hex_sql(seed, *parts)}, 1, 8) AS BIGINT)"


def hex_sql(seed, *parts: str) -> str:
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5(concat_ws('|', '{seed}', {inner}))"


def group_folds_sql(source: str, group: str, n_folds: int, seed: int, out: str) -> str:
    return (
        f"{out} AS (SELECT {group}, CAST(ntile({n_folds}) OVER (ORDER BY {hex_sql(seed, group)}, {group}) - 1 AS INTEGER) AS fold "
        f"FROM (SELECT DISTINCT {group} FROM {source} WHERE {group} IS NOT NULL))"
    )


def predictions(spark: SparkSession, sf: str, arm: str = "a", unit: str = "gene", n_folds: int = 5, seed: int = 0) -> DataFrame:
    """An out-of-fold prediction table: row, group, family, label, fold, shares."""
    rows = variants(spark, sf)
    return with_shares(rows.join(group_folds(rows, unit, n_folds, seed), unit), arm)


def predictions_sql(arm: str = "a", unit: str = "gene", n_folds: int = 5, seed: int = 0, out: str = "preds") -> str:
    return (
        VARIANTS_SQL
        + ", "
        + group_folds_sql("variants", unit, n_folds, seed, "folds")
        + f", joined AS (SELECT * FROM variants JOIN folds USING ({unit})), "
        + shares_sql("joined", arm, out)
    )


PRED_SQL = "CASE WHEN proba[1] >= proba[2] AND proba[1] >= proba[3] THEN 'F' WHEN proba[2] >= proba[3] THEN 'O' ELSE 'P' END"
