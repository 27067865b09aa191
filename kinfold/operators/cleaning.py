"""Keys, label merging, conflict-aware deduplication, balancing and audits.

Per-key choices are aggregates over an ordering struct (``min_by``), not windows,
so they combine on the map side and a hot key costs no more than a cold one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.hashing import draw_hex
from kinfold.functions.notation import reject_reason
from kinfold.functions.rows import attach_row
from kinfold.functions.ranking import hash_rank, value_rank


def merge_label_sources(
    primary: DataFrame, secondary: DataFrame, *, key: str, label: str, unknown: str = "Unknown",
    names: tuple[str, str] = ("primary", "secondary"), aliases: DataFrame | None = None,
) -> DataFrame:
    """Primary label when known, else the secondary one; a differing secondary label is recorded."""
    a = primary.select(key, F.nullif(F.col(label), F.lit(unknown)).alias("_a"))
    b = secondary.select(key, F.col(label).alias("_b"))
    merged = (
        a.join(b, key, "full_outer")
        .where(F.coalesce("_a", "_b").isNotNull())
        .select(
            key,
            F.coalesce("_a", "_b").alias(label),
            F.when(F.col("_a").isNotNull(), names[0]).otherwise(names[1]).alias("source"),
            F.when(F.col("_a") != F.col("_b"), F.col("_b")).alias("disagrees"),
        )
    )
    if aliases is None:
        return merged
    return merged.unionByName(aliases.join(merged, key, "left_anti"), allowMissingColumns=True)


def resolve_by_tier(df: DataFrame, *, key: str, value: str, tier: str, top: str) -> DataFrame:
    """One value per key: the only one, else the top tier's only one, else the key goes."""
    strong = F.when(F.col(tier) == top, F.col(value))
    return (
        df.groupBy(key)
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.min(strong).alias("_slo"), F.max(strong).alias("_shi"))
        .select(
            key,
            F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
            .when(F.col("_slo") == F.col("_shi"), F.col("_slo"))
            .alias(value),
        )
        .where(F.col(value).isNotNull())
    )


def majority_value(
    df: DataFrame, *, key: str, value: str, ties: str = "error", order: str | None = None
) -> DataFrame:
    """The most frequent value per key with its count.

    ``ties``: ``error`` raises, ``first`` / ``last`` take the tied value seen first or
    last by ``order``.
    """
    spot = {"first": F.min(order or F.lit(0)), "last": -F.max(order or F.lit(0))}.get(ties, F.lit(0))
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(
        F.count("*").alias("n"), spot.alias("_spot")
    )
    best = counts.groupBy(key).agg(
        F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("a"), "_spot", value)).alias("_best"),
        F.max("n").alias("_top"),
    )
    if ties == "error":
        tied = counts.join(best, key).where(F.col("n") == F.col("_top")).groupBy(key).agg(F.count("*").alias("_k"))
        best = best.join(tied, key).where(
            F.when(F.col("_k") == 1, F.lit(True)).otherwise(
                F.raise_error(F.concat(F.lit("tied majority for key "), F.col(key).cast("string"))).cast("boolean")
            )
        )
    return best.select(key, F.col(f"_best.{value}").alias(value), F.col("_best.n").alias("n"))


def best_per_key(df: DataFrame, *, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """The record that comes first in the declared order, per key."""
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*keep), rank).alias("_r"))
    return best.select(*keys, "_r.*")


def first_duplicate(df: DataFrame, *, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The first record per key by an explicit order, and how many later ones were dropped."""
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*keep), F.struct(*order)).alias("_r"), (F.count("*") - 1).alias("n_dropped")
    )
    return best.select(*keys, "_r.*", "n_dropped")


def dedup_drop_conflicts(df: DataFrame, *, keys: Sequence[str], label: str, prov: str) -> DataFrame:
    """One row per key whose records agree on the label; conflicting keys go entirely."""
    return (
        df.groupBy(*keys)
        .agg(
            F.min(label).alias(label), F.max(label).alias("_hi"), F.count("*").alias("n_records"),
            F.min(prov).alias("first_id"),
        )
        .where(F.col(label) == F.col("_hi"))
        .drop("_hi")
    )


def provenance_links(df: DataFrame, *, keys: Sequence[str], label: str, prov: str) -> DataFrame:
    """(key, id) pairs of the kept keys, one row each, so that no key's id list has to fit one row."""
    kept = dedup_drop_conflicts(df, keys=keys, label=label, prov=prov).select(*keys)
    return df.select(*keys, prov).distinct().join(kept, list(keys))


def dedup_counters(df: DataFrame, *, keys: Sequence[str], label: str) -> DataFrame:
    """Rows in, keys, repeated keys, rows removed, conflicting keys."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("conflict"))
    return per.agg(
        F.sum("n").alias("n_rows"),
        F.count("*").alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_duplicate_keys"),
        F.sum(F.col("n") - 1).alias("n_rows_removed"),
        F.count_if("conflict").alias("n_conflicting_keys"),
    )


def union_with_precedence(primary: DataFrame, secondary: DataFrame, *, key: str) -> DataFrame:
    """All primary rows, and secondary rows only for keys the primary does not have."""
    return primary.unionByName(
        secondary.join(primary.select(key).distinct(), key, "left_anti"), allowMissingColumns=True
    )


def waterfall(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Each row with the name of the first rule it fails (null = kept)."""
    return df.withColumn("reject", reject_reason(rules))


def waterfall_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return waterfall(df, rules).groupBy(F.coalesce("reject", F.lit("kept")).alias("bucket")).agg(F.count("*").alias("n"))


def cap_and_balance(
    df: DataFrame, *, group: str, label: str, row_id: str, cap: int, seed: int, n_classes: int = 2
) -> DataFrame:
    """At most ``cap`` seeded rows per (group, class), then every class cut to the group's smallest.

    The first cut is a ranking limit, which Spark applies before the shuffle; after
    it a group holds at most ``cap`` rows per class.
    """
    w = Window.partitionBy(group, label).orderBy("_draw", row_id)
    capped = (
        df.withColumn("_draw", draw_hex(seed, row_id))
        .withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= cap)
    )
    per_class = capped.groupBy(group, label).agg(F.count("*").alias("_n"))
    floor = per_class.groupBy(group).agg(F.count("*").alias("_k"), F.min("_n").alias("_floor"))
    return (
        capped.join(floor.where(F.col("_k") == n_classes), group)
        .where(F.col("_rank") <= F.col("_floor"))
        .drop("_draw", "_rank", "_k", "_floor")
    )


def rebalance(df: DataFrame, *, group: str, label: str, row_id: str, n_classes: int = 2) -> DataFrame:
    """The first rows by id of every class, as many as the group's smallest class has."""
    per_class = df.groupBy(group, label).agg(F.count("*").alias("_n"))
    floor = per_class.groupBy(group).agg(F.count("*").alias("_k"), F.min("_n").alias("_floor"))
    ranked = value_rank(df, [group, label], row_id, out="_rank")
    return (
        ranked.join(floor.where(F.col("_k") == n_classes), group)
        .where(F.col("_rank") < F.col("_floor"))
        .drop("_rank", "_k", "_floor")
    )


def balance_report(
    df: DataFrame, *, group: str, label: str, keys: Sequence[str], classes: Sequence[str], strict: bool = False
) -> DataFrame:
    """Defects of a balanced table, one row per check; ``strict`` turns any defect into an error."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("conflict"))
    sides = [F.count_if(F.col(label) == c).alias(f"_c{i}") for i, c in enumerate(classes)]
    uneven = reduce(lambda a, b: a | b, [F.col("_c0") != F.col(f"_c{i}") for i in range(1, len(classes))])
    per_group = df.groupBy(group).agg(*sides)
    parts = [
        df.agg(F.count_if(~F.col(label).isin(*classes)).alias("n")).withColumn("check", F.lit("unknown_label")),
        per_key.agg(F.count_if("conflict").alias("n")).withColumn("check", F.lit("conflicting_label")),
        per_key.agg(F.count_if(F.col("n") > 1).alias("n")).withColumn("check", F.lit("duplicate_key")),
        per_group.agg(F.count_if(uneven).alias("n")).withColumn("check", F.lit("unequal_classes")),
    ]
    report = reduce(DataFrame.unionByName, parts).select("check", "n")
    if strict:
        report = report.withColumn(
            "n", F.when(F.col("n") == 0, F.col("n")).otherwise(F.raise_error(F.concat("check", F.lit(" failed"))).cast("long"))
        )
    return report


def group_size_summary(df: DataFrame, *, group: str) -> DataFrame:
    """Number of groups and the smallest, mean and largest group."""
    return df.groupBy(group).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.min("n").alias("min_size"),
        F.avg("n").alias("mean_size"), F.max("n").alias("max_size"),
    )


def attach_id(df: DataFrame, ids: DataFrame, *, key: str, value: str, order: str, keep: str = "last") -> DataFrame:
    """Attach the mapped id; rows whose key is unmapped are dropped. ``keep``: last or first id by ``order``."""
    pick = F.max_by if keep == "last" else F.min_by
    mapped = ids.where(F.col(value).isNotNull()).groupBy(key).agg(pick(value, order).alias(value))
    return df.join(mapped, key)


def unmapped_keys(df: DataFrame, ids: DataFrame, *, key: str, value: str) -> DataFrame:
    """Keys that :func:`attach_id` drops, with their row counts."""
    known = ids.where(F.col(value).isNotNull()).select(key).distinct()
    return df.groupBy(key).agg(F.count("*").alias("n")).join(known, key, "left_anti")


def priority_class(rules: Mapping[str, Column], otherwise: Column) -> Column:
    """The first rule that fires names the class."""
    out = otherwise
    for name, fires in reversed(list(rules.items())):
        out = F.when(fires, F.lit(name)).otherwise(out)
    return out


def multi_hit(rules: Mapping[str, Column]) -> Column:
    """Whether more than one rule fires."""
    return sum([F.coalesce(r, F.lit(False)).cast("int") for r in rules.values()], F.lit(0)) > 1


def enzyme_rules(ec: str, keywords: str) -> dict[str, Column]:
    """Fixed rules of the four-class gene task, most specific first."""
    return {
        "kinase": F.array_contains(keywords, "KW-0418") | F.exists(ec, lambda x: x.startswith("2.7.")),
        "protease": F.exists(ec, lambda x: x.startswith("3.4.")),
        "oxidoreductase": F.exists(ec, lambda x: x.rlike(r"^1\.[^.]")),
    }


def enzyme_class(ec: str, keywords: str) -> Column:
    """kinase, protease, oxidoreductase, non-enzyme, or null for other enzymes."""
    return priority_class(enzyme_rules(ec, keywords), F.when(F.size(ec) == 0, F.lit("non-enzyme")))


def coverage_check(
    name: str, left: DataFrame, right: DataFrame, *, key: str, mode: str = "subset", n_samples: int = 5
) -> DataFrame:
    """PASS / FAIL / INCOMPLETE for ``left ⊆ right`` or ``left = right``, with the first offending keys."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    missing = a.join(b, key, "left_anti").select(F.col(key).cast("string").alias("k"))
    if mode == "equal":
        missing = missing.unionByName(b.join(a, key, "left_anti").select(F.col(key).cast("string").alias("k")))
    sample = missing.orderBy("k").limit(n_samples).agg(F.array_join(F.sort_array(F.collect_list("k")), ",").alias("sample"))
    row = a.agg(F.count("*").alias("n_left"))
    for part in (b.agg(F.count("*").alias("n_right")), missing.agg(F.count("*").alias("n_missing")), sample):
        row = attach_row(row, part)
    return (
        row.select(
            F.lit(name).alias("check"),
            F.when((F.col("n_left") == 0) | (F.col("n_right") == 0), "INCOMPLETE")
            .when(F.col("n_missing") == 0, "PASS")
            .otherwise("FAIL")
            .alias("state"),
            "n_left", "n_right", "n_missing", "sample",
        )
    )


def agreement_audit(
    df: DataFrame, sequences: DataFrame, *, key: str, pos: str, wt: str, sequence: str, letters: str
) -> DataFrame:
    """Per key: rows checked, missing sequence, out of bounds, letter mismatch, invalid letters."""
    seq = sequences.select(key, F.col(sequence).alias("_s"))
    j = df.join(seq, key, "left")
    missing = F.col("_s").isNull()
    out = ~missing & ((F.col(pos) < 1) | (F.col(pos) > F.length("_s")))
    checked = ~missing & ~out
    return j.groupBy(key).agg(
        F.count_if(checked).alias("n_checked"),
        F.count_if(missing).alias("n_missing"),
        F.count_if(out).alias("n_out_of_bounds"),
        F.count_if(checked & (F.substring("_s", F.col(pos), F.lit(1)) != F.col(wt))).alias("n_mismatch"),
        F.count_if(~F.col(wt).rlike(f"^[{letters}]$")).alias("n_invalid_letter"),
    )


def fingerprint(df: DataFrame, fields: Sequence[str], *, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """A digest of a table's contents that does not depend on partitioning.

    Each row is hashed (with its order column where order matters), the row hashes
    are summed as exact numbers, and the sums are hashed. Sums merge, so any number
    of rows costs one partial aggregation.
    """
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ([order] if order else []) + list(fields)]
    digest = F.sha2(F.concat_ws("\x1f", *cols), 256)
    words = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    sums = df.select(*by, *[w.alias(f"_w{i}") for i, w in enumerate(words)]).groupBy(*by).agg(
        F.count("*").alias("n_rows"), *[F.sum(f"_w{i}").cast("string").alias(f"_s{i}") for i in range(4)]
    )
    return sums.select(
        *by, "n_rows", F.sha2(F.concat_ws("-", F.col("n_rows").cast("string"), "_s0", "_s1", "_s2", "_s3"), 256).alias("digest")
    )


def complete_rows(df: DataFrame, used: Sequence[str]) -> DataFrame:
    """Rows with a finite value in every used column."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in used]))


def mask_report(df: DataFrame, used: Sequence[str], *, source: str, wanted: str) -> DataFrame:
    """Rows of one source, how many are complete, how many were dropped."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in used])
    return df.where(F.col(source) == wanted).agg(
        F.count("*").alias("n_source"), F.count_if(whole).alias("n_complete"), F.count_if(~whole).alias("n_dropped")
    )


def ensemble_mean(df: DataFrame, *, key: Sequence[str], score: str, members: int) -> DataFrame:
    """Mean of a key's scores when all ``members`` are finite, else null; the count is kept."""
    value = F.when(~F.isnan(score), F.col(score))
    return df.groupBy(*key).agg(F.count(value).alias("n_members"), F.avg(value).alias("_m")).select(
        *key, "n_members", F.when(F.col("n_members") == members, F.col("_m")).alias("score")
    )


def seeded_sample(df: DataFrame, *, row_id: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in seeded order (a distributed top-n, not a global sort)."""
    return df.withColumn("_draw", draw_hex(seed, row_id)).orderBy("_draw", row_id).limit(n).drop("_draw")


def unpack_flags(packed: str, names: Sequence[str], sep: str = "|") -> list[Column]:
    """Integer flags from a packed text plus ``any_flag``; an unreadable flag is null."""
    parts = F.split(F.col(packed), F.lit(f"\\{sep}"))
    flags = [F.get(parts, F.lit(i)).try_cast("int") for i in range(len(names))]
    hit = reduce(lambda a, b: a | b, [F.coalesce(f == 1, F.lit(False)) for f in flags])
    return [*[f.alias(n) for f, n in zip(flags, names)], hit.cast("int").alias("any_flag")]


def select_clinical(
    df: DataFrame, *, significance: str, allowed: Sequence[str], consequences: str, change: str,
    gene: str, order: str, wanted: str = "missense",
) -> DataFrame:
    """Allowed records with a wanted consequence, parsed, one per (gene, pos, wt, mut)."""
    from kinfold.functions.notation import parse_substitution

    kept = (
        df.where(F.col(significance).isin(*allowed) & F.exists(consequences, lambda x: F.lower(x).contains(wanted)))
        .withColumn("_p", parse_substitution(change))
        .where(F.col("_p").isNotNull())
        .select(gene, order, significance, F.col("_p.wt").alias("aa_wt"), F.col("_p.pos").alias("aa_pos"), F.col("_p.mut").alias("aa_mut"))
    )
    return best_per_key(
        kept, keys=[gene, "aa_pos", "aa_wt", "aa_mut"], order=[F.col(order), F.col(significance)], keep=[order, significance]
    )


def shuffle_positions(df: DataFrame, *, keys: Sequence[str], row_id: str, seed: int) -> DataFrame:
    """Each row's position in the seeded shuffle of its group, and the group's size."""
    return hash_rank(df, keys, [row_id], seed, out="position", total="group_size")
