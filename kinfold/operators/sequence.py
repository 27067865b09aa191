"""Sequence feature operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.notation import LETTERS, lookup

# Residue hydropathy, charge and volume.
HYDROPATHY = {
    "A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5,
    "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2,
}
CHARGE = {**dict.fromkeys(LETTERS, 0.0), "D": -1.0, "E": -1.0, "K": 1.0, "R": 1.0, "H": 0.5}
VOLUME = {
    "A": 88.6, "R": 173.4, "N": 114.1, "D": 111.1, "C": 108.5, "Q": 143.8, "E": 138.4, "G": 60.1, "H": 153.2, "I": 166.7,
    "L": 166.7, "K": 168.6, "M": 162.9, "F": 189.9, "P": 112.7, "S": 89.0, "T": 116.1, "W": 227.8, "Y": 193.6, "V": 140.0,
}
PROBE_LETTERS = ("A", "D", "W")


def biochemistry(df: DataFrame, substitution_scores: DataFrame, *, wt: str, mut: str) -> DataFrame:
    """Substitution score, hydropathy, charge and volume changes; null for an undeclared letter.

    ``substitution_scores`` is a (wt, mut, score) table with one row per ordered
    pair of letters, such as a published substitution matrix.
    """
    a, b = F.col(wt), F.col(mut)

    def change(table) -> Column:
        return lookup(table, b) - lookup(table, a)

    scores = substitution_scores.select(F.col("wt").alias(wt), F.col("mut").alias(mut), F.col("score").alias("substitution_score"))
    return df.join(scores, [wt, mut], "left").withColumns(
        {
            "hydropathy_change": change(HYDROPATHY),
            "hydropathy_distance": F.abs(change(HYDROPATHY)),
            "charge_change": change(CHARGE),
            "charge_distance": F.abs(change(CHARGE)),
            "volume_distance": F.abs(change(VOLUME)),
        }
    )


def read_substitution_matrix(spark, path: str) -> DataFrame:
    """A (wt, mut, score) table from a whitespace matrix with a letter header and ``#`` comments."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = lines.select(F.split(F.trim("value"), r"\s+").alias("c"), F.col("value").startswith(" ").alias("head"))
    head = cells.where("head").select(F.posexplode("c").alias("i", "mut"))
    body = cells.where("NOT head").select(F.get("c", F.lit(0)).alias("wt"), F.posexplode(F.slice("c", 2, F.size("c"))).alias("i", "s"))
    return body.join(head, "i").select("wt", "mut", F.col("s").cast("double").alias("score"))


def probe_positions(length: Column, n_positions: int = 100) -> Column:
    """Distinct evenly spaced 1-based positions, truncated to integers."""
    n = F.least(F.lit(n_positions), length).cast("int")
    step = (length - 1) / (n - 1).cast("double")
    spots = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(i == n - 1, length.cast("int")).otherwise(F.floor(i * step + F.lit(1.0)).cast("int")),
    )
    return F.array_distinct(spots)


def probe_list(
    df: DataFrame, *, sequence: str, keys: Sequence[str], n_positions: int = 100, min_length: int = 10,
    letters: Sequence[str] = PROBE_LETTERS,
) -> DataFrame:
    """One row per (sequence, position, probe letter), identity left out.

    The expansions are explodes of bounded arrays inside the row, so nothing is
    joined or shuffled, and only the one letter needed leaves the long text.
    """
    sized = df.select(*keys, sequence, F.length(sequence).alias("seq_len")).where(F.col("seq_len") >= min_length)
    spots = F.transform(
        probe_positions(F.col("seq_len"), n_positions),
        lambda p: F.struct(p.alias("aa_pos"), F.substring(F.col(sequence), p, F.lit(1)).alias("aa_wt")),
    )
    sites = sized.select(*keys, "seq_len", F.explode(spots).alias("_s")).select(*keys, "seq_len", "_s.*")
    return sites.withColumn("aa_mut", F.explode(F.array(*[F.lit(x) for x in letters]))).where("aa_wt <> aa_mut")
