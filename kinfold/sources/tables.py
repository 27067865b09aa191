"""Reading, aligning and publishing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.notation import lookup, parse_substitution
from kinfold.operators.cleaning import waterfall

NULL_TEXT = ("", "NA", "NaN", "nan", "n/a", "-")


def clean_number(c: Column) -> Column:
    """A finite double, or null for a blank, a null marker or anything unreadable."""
    x = F.trim(c.cast("string")).try_cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.when(finite, x)


def with_aliases(
    df: DataFrame, aliases: Mapping[str, Sequence[str]], *, numeric: Sequence[str] = (), required: Sequence[str] = ()
) -> DataFrame:
    """Columns under their declared names, taken from whichever header names are present."""
    out = []
    for name, options in aliases.items():
        present = [F.col(f"`{o}`") for o in options if o in df.columns]
        if not present:
            if name in required:
                raise ValueError(f"none of {list(options)} is a column; {name} is required")
            present = [F.lit(None).cast("string")]
        c = F.coalesce(*present)
        text = F.when(~F.trim(c).isin(*NULL_TEXT), F.trim(c))
        out.append((clean_number(c) if name in numeric else text).alias(name))
    return df.select(*out)


def read_delimited(
    spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]], *, sep: str = "\t",
    numeric: Sequence[str] = (), required: Sequence[str] = (),
) -> DataFrame:
    return with_aliases(spark.read.csv(path, sep=sep, header=True), aliases, numeric=numeric, required=required)


def read_bulk_scores(spark: SparkSession, path: str, names: Sequence[str], *, sep: str = "\t") -> DataFrame:
    """A large ``#``-commented headerless table, read as text columns."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).csv(path, sep=sep, comment="#")


def wanted_scores(
    bulk: DataFrame, targets: DataFrame, *, keys: Sequence[str], score: str, order: str, target_id: str
) -> DataFrame:
    """Scores of the wanted keys only.

    Several targets with one key: the first by ``target_id`` wins and the others are
    counted. Several bulk records of one key: the last by ``order`` wins. The join
    comes before the aggregation, so only wanted records are shuffled when the
    targets are small enough for Spark to broadcast.
    """
    wanted = targets.groupBy(*keys).agg(F.min(target_id).alias(target_id), (F.count("*") - 1).alias("n_collisions"))
    finite = bulk.withColumn("_score", clean_number(F.col(score))).where(F.col("_score").isNotNull())
    last = (
        finite.join(wanted.select(*keys), list(keys), "left_semi")
        .groupBy(*keys)
        .agg(F.max_by("_score", F.struct(order, "_score")).alias(score))
    )
    return wanted.join(last, list(keys))


def parse_variant_sheet(
    df: DataFrame, *, cls: str, wanted: str, mechanism: str, mapping: Mapping[str, str], change: str,
    number: str, keep: Sequence[str],
) -> DataFrame:
    """Typed rows of one class with a ``reject`` reason for rows that cannot be used."""
    rows = df.where(F.lower(F.col(cls)).contains(wanted.lower()))
    typed = rows.select(
        *keep,
        lookup(mapping, F.lower(F.trim(F.col(mechanism)))).alias("mechanism"),
        parse_substitution(change).alias("_p"),
        clean_number(F.col(number)).alias(number),
    ).select("*", F.col("_p.wt").alias("aa_wt"), F.col("_p.pos").alias("aa_pos"), F.col("_p.mut").alias("aa_mut"))
    return waterfall(
        typed, {"unknown_mechanism": F.col("mechanism").isNull(), "unparsed_change": F.col("_p").isNull()}
    ).drop("_p")


def read_assays(spark: SparkSession, folder: str) -> DataFrame:
    """Every CSV of a folder with the name of the file it came from."""
    return spark.read.csv(folder, header=True, pathGlobFilter="*.csv").withColumn(
        "file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    )


def join_assays(
    rows: DataFrame, index: DataFrame, *, file: str, mutant: str, score: str, sequence: str
) -> DataFrame:
    """Single substitutions of indexed assays with a reject reason each."""
    j = rows.join(index, file).withColumn("_p", parse_substitution(mutant)).withColumn(score, clean_number(F.col(score)))
    j = j.select("*", F.col("_p.wt").alias("aa_wt"), F.col("_p.pos").alias("aa_pos"), F.col("_p.mut").alias("aa_mut"))
    return waterfall(
        j,
        {
            "multi_mutant": F.col(mutant).contains(":"),
            "unparsed": F.col("_p").isNull(),
            "out_of_bounds": (F.col("aa_pos") < 1) | (F.col("aa_pos") > F.length(sequence)),
            "letter_mismatch": F.substring(sequence, F.col("aa_pos"), F.lit(1)) != F.col("aa_wt"),
            "no_score": F.col(score).isNull(),
        },
    ).drop("_p")


def load_stability(
    df: DataFrame, *, domain: str, kind: str, sequence: str, target: str, wt_kind: str = "wt",
    bare: Column | None = None, missing: str = "-", strict: bool = True,
) -> DataFrame:
    """Substitution rows joined to their domain's reference sequence, with a reject reason each.

    The reference comes from the table's own ``wt`` rows; two different ones for a
    domain are an error, or drop the domain when ``strict`` is off.
    """
    natural = F.lit(True) if bare is None else bare
    wt = (
        df.where((F.col(kind) == wt_kind) & natural & (F.trim(F.col(sequence)) != ""))
        .groupBy(domain)
        .agg(F.min(F.trim(F.col(sequence))).alias("wt_seq"), F.max(F.trim(F.col(sequence))).alias("_hi"))
    )
    clash = F.col("wt_seq") != F.col("_hi")
    if strict:
        wt = wt.withColumn(
            "wt_seq",
            F.when(clash, F.raise_error(F.concat(F.lit("conflicting reference of "), F.col(domain).cast("string")))).otherwise(F.col("wt_seq")),
        )
    else:
        wt = wt.where(~clash)
    pattern = r"^([A-Z])(\d+)([A-Z])$"
    rows = df.where(F.trim(F.col(kind)) != wt_kind).join(wt.drop("_hi"), domain, "left")
    code, raw, mut_seq = F.trim(F.col(kind)), F.trim(F.col(target)), F.trim(F.col(sequence))
    pos = F.regexp_extract(code, pattern, 2).try_cast("int")
    rows = rows.withColumns({"mutation_code": code, "var_pos": pos, "mut_seq": mut_seq, "_raw": raw, "ddg": clean_number(raw), "_bare": natural})
    return waterfall(
        rows,
        {
            "not_bare_natural": ~F.col("_bare"),
            "no_wt_seq": F.col("wt_seq").isNull(),
            "not_substitution": ~F.col("mutation_code").rlike(pattern),
            "ddg_missing": F.col("_raw").isNull() | F.col("_raw").isin("", missing),
            "ddg_unparseable": F.col("ddg").isNull(),
            "length_mismatch": F.length("mut_seq") != F.length("wt_seq"),
            "pos_out_of_range": (F.col("var_pos") < 1) | (F.col("var_pos") > F.length("wt_seq")),
            "wt_residue_mismatch": F.substring("wt_seq", F.col("var_pos"), F.lit(1)) != F.regexp_extract("mutation_code", pattern, 1),
            "mut_residue_mismatch": F.substring("mut_seq", F.col("var_pos"), F.lit(1)) != F.regexp_extract("mutation_code", pattern, 3),
        },
    ).drop("_raw", "_bare")


def join_vectors(rows: DataFrame, vectors: DataFrame, *, row_id: str) -> DataFrame:
    """Rows with their vectors, aligned by key."""
    return rows.join(vectors, row_id)


def alignment_report(rows: DataFrame, vectors: DataFrame, *, row_id: str) -> DataFrame:
    """Row counts of both sides, keys without a partner on each, and repeated vector keys."""
    a = rows.groupBy(row_id).agg(F.count("*").alias("_a"))
    b = vectors.groupBy(row_id).agg(F.count("*").alias("_b"))
    return a.join(b, row_id, "full_outer").agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("_b"), F.lit(0)).alias("n_vectors"),
        F.count_if(F.col("_b").isNull()).alias("rows_without_vector"),
        F.count_if(F.col("_a").isNull()).alias("vectors_without_row"),
        F.count_if(F.col("_b") > 1).alias("repeated_vector_keys"),
    )


def stamp(df: DataFrame, *, run: str, seed: int | None = None, source: str | None = None) -> DataFrame:
    return df.withColumns(
        {"run": F.lit(run), "seed": F.lit(seed).cast("int"), "source_id": F.lit(source).cast("string")}
    )


def publish(df: DataFrame, path: str, *, run: str, seed: int, source: str) -> None:
    """Write one run's result whole or not at all, one partition per run and seed."""
    stamp(df, run=run, seed=seed, source=source).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run", "seed").parquet(path)


def seed_partition_report(found: DataFrame, expected: Sequence[int], *, seed: str, recorded: str) -> DataFrame:
    """One row per expected or found seed: ok, missing, unexpected, duplicate or mislabelled."""
    spark = found.sparkSession
    want = spark.createDataFrame([(int(s),) for s in expected], f"{seed} int").withColumn("_want", F.lit(True))
    have = found.groupBy(F.col(seed).cast("int").alias(seed)).agg(
        F.count("*").alias("n"), F.count_if(F.col(seed) != F.col(recorded)).alias("_wrong")
    )
    state = (
        F.when(F.col("_want").isNull(), "unexpected")
        .when(F.col("n").isNull(), "missing")
        .when(F.col("_wrong") > 0, "mislabelled")
        .when(F.col("n") > 1, "duplicate")
        .otherwise("ok")
    )
    return want.join(have, seed, "full_outer").select(seed, state.alias("state"))


def load_group_map(df: DataFrame, *, key: str, group: str) -> DataFrame:
    """A group table in which a null group means known but unannotated."""
    return df.select(key, F.nullif(F.trim(F.col(group).cast("string")), F.lit("")).alias(group), F.lit(True).alias("known"))


def attach_group(df: DataFrame, groups: DataFrame, *, key: str, group: str) -> DataFrame:
    """Rows with their group; ``known`` tells an unannotated key from an absent one."""
    return df.join(groups, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def still_wanted(wanted: DataFrame, held: DataFrame, absent: DataFrame, *, key: str) -> DataFrame:
    """Wanted keys that are neither held nor known to be absent."""
    return wanted.select(key).distinct().join(held, key, "left_anti").join(absent, key, "left_anti")


def overlay(base: DataFrame, newer: DataFrame, *, key: str, value: str) -> DataFrame:
    """The newer value where there is one, else the base value."""
    return base.select(key, F.col(value).alias("_old")).join(
        newer.select(key, F.col(value).alias("_new")), key, "full_outer"
    ).select(key, F.coalesce("_new", "_old").alias(value))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


