"""Fold assignment as tables: (row or group, fold). The training side of a fold is every other fold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.hashing import draw_int
from kinfold.functions.ranking import array_split_part, hash_rank, nested_hash_rank
from kinfold.functions.rows import attach_totals
from kinfold.session import durable


def random_folds(df: DataFrame, *, row_id: str, n_folds: int, seed: int) -> DataFrame:
    """Rows dealt into near-equal folds in seeded order."""
    ranked = hash_rank(df, [], [row_id], seed, out="_rank", total="_n")
    return ranked.withColumn("fold", array_split_part(F.col("_rank"), F.col("_n"), n_folds)).drop("_rank", "_n")


def group_folds(df: DataFrame, group: str, n_folds: int, seed: int) -> DataFrame:
    """(group, fold): distinct groups dealt in seeded order into near-equal chunks; null groups get none."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    ranked = hash_rank(groups, [], [group], seed, total="_n")
    return ranked.select(group, array_split_part(F.col("rank"), F.col("_n"), n_folds).alias("fold"))


def assign_group_folds(df: DataFrame, *, group: str, n_folds: int, seed: int) -> DataFrame:
    """Rows with the fold of their group. Rows without a group are on neither side of any fold."""
    return df.join(group_folds(df, group, n_folds, seed), group)


def round_robin_folds(df: DataFrame, *, group: str, n_folds: int, seed: int, null_group: str = "raise") -> DataFrame:
    """Rows with their group's position in the seeded order modulo ``n_folds``.

    A row without a group raises, or gets fold −1 when ``null_group='hold'``.
    """
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    dealt = hash_rank(groups, [], [group], seed).select(group, F.pmod("rank", F.lit(n_folds)).cast("int").alias("fold"))
    none = (
        F.lit(-1)
        if null_group == "hold"
        else F.raise_error(F.lit("a row has no group; select the annotated cohort first")).cast("int")
    )
    joined = df.join(dealt, group, "left")
    return joined.withColumn("fold", F.when(F.col(group).isNull(), none).otherwise(F.col("fold")))


def family_or_solo(family: str, gene: str, prefix: str = "solo_") -> Column:
    """The family, or the gene as a group of its own."""
    return F.coalesce(F.col(family).cast("string"), F.concat(F.lit(prefix), F.col(gene).cast("string")))


def family_folds_with_solo(df: DataFrame, *, gene: str, family: str, n_folds: int, seed: int) -> DataFrame:
    grouped = df.withColumn("_unit", family_or_solo(family, gene))
    return round_robin_folds(grouped, group="_unit", n_folds=n_folds, seed=seed).drop("_unit")


def qualifying_groups(df: DataFrame, *, group: str, gene: str, label: str, min_second: int = 20, min_genes: int = 3) -> DataFrame:
    """Groups that can each be held out: second-largest class and gene count both large enough."""
    per_class = df.where(F.col(group).isNotNull()).groupBy(group, label).agg(F.count("*").alias("_n"))
    second = per_class.groupBy(group).agg(
        F.sort_array(F.collect_list("_n"), asc=False).alias("_c"), F.sum("_n").alias("n_rows")
    )
    genes = df.select(group, gene).distinct().groupBy(group).agg(F.count("*").alias("n_genes"))
    return (
        second.join(genes, group)
        .withColumn("n_second", F.coalesce(F.get("_c", F.lit(1)), F.lit(0)))
        .where((F.col("n_second") >= min_second) & (F.col("n_genes") >= min_genes))
        .drop("_c")
    )


def scheme_bundle(df: DataFrame, *, row_id: str, domain: str, family: str, n_folds: int, seed: int) -> DataFrame:
    """(row, scheme, fold) for the random, domain and family schemes."""
    base = df.select(row_id, domain, family)
    parts = {
        "random": random_folds(base, row_id=row_id, n_folds=n_folds, seed=seed),
        "domain": assign_group_folds(base, group=domain, n_folds=n_folds, seed=seed),
        "family": assign_group_folds(base, group=family, n_folds=n_folds, seed=seed),
    }
    return reduce(
        DataFrame.unionByName, [p.select(row_id, F.lit(name).alias("scheme"), "fold") for name, p in parts.items()]
    )


def half_partitions(df: DataFrame, *, group: str, n_partitions: int, seed: int) -> DataFrame:
    """(partition, group, half): repeated seeded halves of the groups."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    draws = groups.withColumn("partition", F.explode(F.sequence(F.lit(0), F.lit(n_partitions - 1))))
    ranked = hash_rank(draws, ["partition"], [group], seed, total="_n", salt=[F.col("partition")])
    return ranked.select("partition", group, (F.col("rank") >= F.floor(F.col("_n") / 2)).cast("int").alias("half"))


def usable_halves(df: DataFrame, halves: DataFrame, *, group: str, y: str, min_per_class: int = 5) -> DataFrame:
    """(partition, train_half, test_half) in both directions where each side has enough of each class."""
    sides = df.join(halves, group).groupBy("partition", "half").agg(
        F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n")
    )
    ok = sides.where((F.col("_p") >= min_per_class) & (F.col("_n") >= min_per_class)).groupBy("partition").agg(F.count("*").alias("_k"))
    return ok.where("_k = 2").select("partition", F.explode(F.array(F.lit(0), F.lit(1))).alias("train_half")).withColumn(
        "test_half", 1 - F.col("train_half")
    )


def stratified_folds(df: DataFrame, *, row_id: str, stratum: str, n_folds: int, seed: int, min_size: int = 3) -> DataFrame:
    """Rows of every stratum of at least ``min_size`` dealt over the folds in turn."""
    ranked = hash_rank(df, [stratum], [row_id], seed, out="_rank", total="_n")
    return ranked.where(F.col("_n") >= min_size).withColumn("fold", F.pmod("_rank", F.lit(n_folds)).cast("int")).drop("_rank", "_n")


def validation_groups(df: DataFrame, *, group: str, fold: str, n_folds: int, seed: int, fraction: float = 0.15) -> DataFrame:
    """(fold, group): whole training groups held back for early stopping, per fold.

    The share is truncated, but at least one group is held back and at least one stays;
    nothing is held back for a fold whose training side has fewer than two groups.
    """
    groups = df.select(group, F.col(fold).alias("_own")).distinct()
    every = groups.withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    training = every.where(F.col("_own") != F.col(fold)).select(fold, group).distinct()
    ranked = hash_rank(training, [fold], [group], seed, total="_n", salt=[F.col(fold)])
    held = F.least(F.greatest(F.lit(1), F.floor(F.col("_n") * fraction)), F.col("_n") - 1)
    return ranked.where((F.col("_n") >= 2) & (F.col("rank") < held)).select(fold, group)


def contract_failures(
    sides: DataFrame, rows: DataFrame, *, row_id: str, label: str, fold: str = "fold", side: str = "side",
    n_folds: int, classes: Sequence, group: str | None = None,
) -> DataFrame:
    """One row per broken rule of a split set; none means the split is valid.

    ``sides`` lists (row, fold, side) with side ``train`` or ``test``. Checked: the
    fold count, rows on both sides of a fold, every eligible row tested exactly once,
    every class present on each side, and no group on both sides.
    """
    both = sides.groupBy(row_id, fold).agg(F.count_distinct(side).alias("_s")).where("_s > 1").groupBy(fold).agg(F.count("*").alias("n"))
    tested = sides.where(F.col(side) == "test").groupBy(row_id).agg(F.count("*").alias("_t"))
    cover = rows.select(row_id).join(tested, row_id, "left").where(F.coalesce("_t", F.lit(0)) != 1).agg(F.count("*").alias("n"))
    extra = tested.join(rows.select(row_id), row_id, "left_anti").agg(F.count("*").alias("n"))
    seen = sides.agg(F.count_distinct(fold).alias("n")).where(F.col("n") != n_folds)
    have = sides.join(rows.select(row_id, label), row_id).groupBy(fold, side).agg(
        *[F.count_if(F.col(label) == c).alias(f"_c{i}") for i, c in enumerate(classes)]
    )
    absent = have.select(
        fold, side, F.explode(F.array(*[F.struct(F.lit(str(c)).alias("cls"), F.col(f"_c{i}").alias("n")) for i, c in enumerate(classes)])).alias("_e")
    ).where("_e.n = 0")
    blank = F.lit(None).cast("string")
    out = [
        both.select(F.lit("overlap").alias("failure"), F.col(fold).cast("int").alias("fold"), blank.alias("detail"), "n"),
        cover.where("n > 0").select(F.lit("coverage").alias("failure"), F.lit(None).cast("int").alias("fold"), blank.alias("detail"), "n"),
        extra.where("n > 0").select(F.lit("ineligible_row").alias("failure"), F.lit(None).cast("int").alias("fold"), blank.alias("detail"), "n"),
        seen.select(F.lit("fold_count").alias("failure"), F.lit(None).cast("int").alias("fold"), blank.alias("detail"), "n"),
        absent.select(F.lit("missing_class").alias("failure"), F.col(fold).cast("int").alias("fold"), F.concat_ws(":", side, "_e.cls").alias("detail"), F.col("_e.n").alias("n")),
    ]
    if group:
        cross = (
            sides.join(rows.select(row_id, group), row_id)
            .groupBy(fold, group)
            .agg(F.count_distinct(side).alias("_s"))
            .where("_s > 1")
            .groupBy(fold)
            .agg(F.count("*").alias("n"))
        )
        out.append(cross.select(F.lit("group_crossing").alias("failure"), F.col(fold).cast("int").alias("fold"), blank.alias("detail"), "n"))
    return reduce(DataFrame.unionByName, out)


def contract_status(failures: DataFrame) -> DataFrame:
    return failures.agg(F.count("*").alias("n_failures")).select(
        F.when(F.col("n_failures") == 0, "valid").otherwise("unscorable").alias("status"), "n_failures"
    )


def fold_sides(folds: DataFrame, *, row_id: str, n_folds: int) -> DataFrame:
    """(row, fold, side) of a one-fold-per-row table."""
    every = folds.select(row_id, F.col("fold").alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    return every.select(row_id, "fold", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train").alias("side"))


def fold_index(sides: DataFrame, *, row_id: str) -> DataFrame:
    """The one fold that tests each row; a row tested twice raises."""
    t = sides.where("side = 'test'").groupBy(row_id).agg(F.min("fold").alias("fold"), F.count("*").alias("_k"))
    one = F.when(F.col("_k") == 1, F.col("fold")).otherwise(F.raise_error(F.lit("a row is tested by more than one fold")).cast("int"))
    return t.select(row_id, one.alias("fold"))


def select_families(df: DataFrame, *, family: str, gene: str, label: str, min_genes: int, min_classes: int) -> DataFrame:
    """Families with enough genes and classes, with their sizes."""
    per = df.where(F.col(family).isNotNull()).groupBy(family, gene, label).agg(F.count("*").alias("_n"))
    out = per.groupBy(family).agg(
        F.count_distinct(gene).alias("n_genes"), F.count_distinct(label).alias("n_classes"), F.sum("_n").alias("n_rows")
    )
    return out.where((F.col("n_genes") >= min_genes) & (F.col("n_classes") >= min_classes))


def _turn(df: DataFrame, *, unit: Sequence[str], slot: str, row_id: str, seed: int) -> DataFrame:
    """0-based turn of each row when its unit deals rows out one per slot and cycle.

    A row's cycle is its seeded rank inside (unit, slot). Its turn follows from the
    slot counts alone: full cycles before it plus the slots ahead of it in its own
    cycle. Slots are few and declared, so the counts fit one array per unit.
    """
    unit = list(unit)
    cyc = hash_rank(df, [*unit, slot], [row_id], seed, out="_cycle")
    counts = df.groupBy(*unit, slot).agg(F.count("*").alias("_n"))
    table = counts.groupBy(*unit).agg(F.collect_list(F.struct(F.col(slot).alias("s"), F.col("_n").alias("n"))).alias("_slots"))
    # collected per unit: one entry per declared slot
    before = F.aggregate(
        "_slots",
        F.lit(0).cast("long"),
        lambda a, e: a
        + F.least(e["n"], F.col("_cycle"))
        + F.when((e["s"] < F.col(slot)) & (e["n"] > F.col("_cycle")), 1).otherwise(0),
    )
    joined = attach_totals(cyc, table, unit)
    return joined.withColumn("_turn", before).drop("_cycle", "_slots")


def family_matched_rows(df: DataFrame, *, row_id: str, family: str, positive: str, slot: str, seed: int, by: Sequence[str] = (), target_ratio: float = 1.0) -> DataFrame:
    """Training rows in which no family tells the class.

    Families holding one side only go; in the others both sides are cut to the
    smaller count, chosen in turns over ``slot`` (clusters or classes). A target
    ratio above one tops the positive side up from the families with positives only.
    Rows carry ``pick``: matched or topped_up.
    """
    by = list(by)
    sizes = df.groupBy(*by, family).agg(F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_q"))
    mixed = sizes.where("_p > 0 AND _q > 0").select(*by, family, F.least("_p", "_q").alias("_keep"))
    turned = _turn(df.join(mixed, [*by, family]), unit=[*by, family, positive], slot=slot, row_id=row_id, seed=seed)
    kept = turned.where(F.col("_turn") < F.col("_keep")).drop("_turn", "_keep").withColumn("pick", F.lit("matched"))
    if target_ratio <= 1.0:
        return kept
    quota = kept.groupBy(*by).agg(
        (F.round(F.lit(target_ratio) * F.count_if(~F.col(positive))) - F.count_if(F.col(positive))).cast("long").alias("_quota")
    )
    only = sizes.where("_q = 0").select(*by, family)
    spare = _turn(df.join(only, [*by, family]), unit=by, slot=slot, row_id=row_id, seed=seed)
    spare = attach_totals(spare, quota, by)
    return kept.unionByName(spare.where(F.col("_turn") < F.col("_quota")).drop("_turn", "_quota").withColumn("pick", F.lit("topped_up")))


def size_matched_rows(df: DataFrame, matched: DataFrame, *, row_id: str, positive: str, slot: str, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """As many rows of each side as ``matched`` has, in turns over ``slot``, ignoring families."""
    by = list(by)
    counts = matched.groupBy(*by, positive).agg(F.count("*").alias("_keep"))
    turned = _turn(df, unit=[*by, positive], slot=slot, row_id=row_id, seed=seed)
    return turned.join(counts, [*by, positive]).where(F.col("_turn") < F.col("_keep")).drop("_turn", "_keep")


def cross_family_triplets(df: DataFrame, *, row_id: str, label: str, family: str, per_anchor: int = 10, seed: int = 42) -> DataFrame:
    """(anchor, draw, positive, negative): positives share the class but not the family, negatives differ in class.

    Rows are numbered so that a class, and inside it a family, is one run of numbers.
    A draw from a pool is then a number that skips one run, and fetching the partner
    is an equi-join on the number: no pool is materialised and no pair formed.
    """
    rows = durable(df.select(row_id, label, family))
    annotated = rows.where(F.col(family).isNotNull())
    fam = annotated.groupBy(label, family).agg(F.count("*").alias("_nf"))
    fam = hash_rank(fam, [label], [family], "family", out="_start", total="_nc", weight="_nf")
    cls = rows.groupBy(label).agg(F.count("*").alias("_m"))
    cls = durable(hash_rank(cls, [], [label], "class", out="_cstart", total="_all", weight="_m"))
    fam = durable(fam.select(label, family, "_start", "_nf"))
    members = annotated.groupBy(label).agg(F.count("*").alias("_nl_total"))
    numbered = durable(
        nested_hash_rank(rows, label, family, [row_id], "row")
        .join(cls.select(label, "_cstart"), label)
        .join(fam.select(label, family, "_start"), [label, family], "left")
        .select(F.col(row_id).alias("_id"), (F.col("_cstart") + F.col("_outer")).alias("_g"), (F.col("_cstart") + F.col("_start") + F.col("_inner")).alias("_p"))
    )
    pool = numbered.where(F.col("_p").isNotNull()).select("_p", F.col("_id").alias("positive"))
    every = numbered.select("_g", F.col("_id").alias("negative"))
    anchors = (
        rows.join(cls, label)
        .join(members, label)
        .join(fam, [label, family], "left")
        .withColumns({"_nf": F.coalesce("_nf", F.lit(0)), "_start": F.coalesce("_start", F.lit(0))})
        .withColumns({"_np": F.col("_nl_total") - F.col("_nf"), "_nn": F.col("_all") - F.col("_m")})
        .withColumn("_k", F.least(F.lit(per_anchor), F.col("_np"), F.col("_nn")).cast("int"))
        .where("_k > 0")
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    )
    u = F.pmod(draw_int(f"{seed}p", row_id, "draw"), F.col("_np"))
    v = F.pmod(draw_int(f"{seed}n", row_id, "draw"), F.col("_nn"))
    drawn = anchors.select(
        F.col(row_id).alias("anchor"), "draw",
        (F.col("_cstart") + F.when(u >= F.col("_start"), u + F.col("_nf")).otherwise(u)).alias("_p"),
        F.when(v >= F.col("_cstart"), v + F.col("_m")).otherwise(v).alias("_g"),
    )
    return drawn.join(pool, "_p").join(every, "_g").select("anchor", "draw", "positive", "negative")
