"""Operators over vector columns (``array<double>``)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.ranking import hash_rank
from kinfold.functions.rows import attach_row
from kinfold.functions.vector_expr import difference, direction, dot, norm
from kinfold.operators.factors import BLOCK_ROWS, centred, group_factors
from kinfold.operators.gram import gram_rows, vector_mean, vector_sum
from kinfold.operators.shuffles import class_sums, shuffled_labels

#: Sums that a task may hold for all draws and families of a null.
DRAWN_SUMS = 1 << 22


def paired_features(df: DataFrame, *, wt: str, mut: str) -> DataFrame:
    """``delta`` = mut − wt and ``both`` = wt followed by mut."""
    return df.withColumns({"delta": difference(mut, wt), "both": F.concat(wt, mut)})


def decompose(df: DataFrame, *, vec: str) -> DataFrame:
    return df.withColumns({"magnitude": norm(vec), "direction": direction(vec)})


def group_mean(df: DataFrame, *, keys: Sequence[str], vec: str, out: str = "vec") -> DataFrame:
    return df.groupBy(*keys).agg(vector_mean(vec).alias(out), F.count("*").alias("n"))


def group_first(df: DataFrame, *, keys: Sequence[str], vec: str, order: str, out: str = "vec") -> DataFrame:
    """The vector of the group's first row by an explicit order."""
    return df.groupBy(*keys).agg(F.min_by(vec, order).alias(out))


def scale_stats(df: DataFrame, *, vec: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of every dimension."""
    v = array_to_vector(F.col(vec))
    s = df.groupBy(*by).agg(
        vector_to_array(Summarizer.mean(v)).alias("_mean"),
        vector_to_array(Summarizer.variance(v)).alias("_var"),
        F.count("*").alias("_n"),
    )
    return s.withColumn(
        "_std", F.transform("_var", lambda x: F.sqrt(x * (F.col("_n") - 1) / F.greatest(F.col("_n"), F.lit(1))))
    ).drop("_var")


def standardize(df: DataFrame, *, vec: str, training: Column, out: str = "scaled", eps: float = 1e-8, constant_scale: float | None = None) -> DataFrame:
    """(x − mean) / (std + eps) with the training rows' statistics.

    ``constant_scale`` replaces the divisor of a constant column and drops the eps.
    """
    stats = scale_stats(df.where(training), vec=vec)
    if constant_scale is None:
        stats = stats.withColumn("_scale", F.transform("_std", lambda s: s + F.lit(eps)))
    else:
        stats = stats.withColumn("_scale", F.transform("_std", lambda s: F.when(s == 0, F.lit(constant_scale)).otherwise(s)))
    joined = attach_row(df, stats.select("_mean", "_scale"))
    centred = F.zip_with(vec, "_mean", lambda x, m: x - m)
    return joined.withColumn(out, F.zip_with(centred, "_scale", lambda x, s: x / s)).drop("_mean", "_scale")


def orthonormal(basis: np.ndarray) -> np.ndarray:
    """k×d orthonormal rows spanning a small basis."""
    q, _ = np.linalg.qr(np.asarray(basis, dtype="float64").T)
    return q.T


def _lit(values: np.ndarray) -> Column:
    return F.lit(np.asarray(values, dtype="float64"))


def project_out(df: DataFrame, *, vec: str, basis: np.ndarray, out: str = "projected") -> DataFrame:
    """x minus its part inside the basis; the basis is a driver-side k×d array of any spanning rows."""
    x = F.col(vec)
    result = x
    for q in orthonormal(basis):
        result = F.zip_with(result, _scaled(_lit(q), dot(x, _lit(q))), lambda a, b: a - b)
    return df.withColumn(out, result)


def _scaled(values: Column, factor: Column) -> Column:
    return F.transform(values, lambda e: e * factor)


def coordinates(vec: str, basis: np.ndarray) -> Column:
    return F.array(*[dot(vec, _lit(q)) for q in orthonormal(basis)])


def residual_variance(df: DataFrame, *, vec: str, basis: np.ndarray) -> DataFrame:
    """Largest variance left along any basis direction."""
    cols = [F.var_pop(dot(vec, _lit(q))) for q in orthonormal(basis)]
    return df.agg((F.greatest(*cols) if len(cols) > 1 else cols[0]).alias("residual_variance"))


def _var_total(df: DataFrame, keys: Sequence[str], vec: str) -> DataFrame:
    v = array_to_vector(F.col(vec))
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.variance(v)).alias("_v"), F.count("*").alias("n"))


def subspace_share(df: DataFrame, *, vec: str, label: str, basis: np.ndarray, min_rows: int = 5) -> DataFrame:
    """Share of each class's variance that lies inside the basis."""
    both = df.select(label, vec, coordinates(vec, basis).alias("_c"))
    total = _var_total(both, [label], vec).select(label, "n", F.aggregate("_v", F.lit(0.0), lambda a, x: a + x).alias("_t"))
    inside = _var_total(both, [label], "_c").select(label, F.aggregate("_v", F.lit(0.0), lambda a, x: a + x).alias("_i"))
    ratio = (F.col("n") - 1) / F.col("n")
    return total.where(F.col("n") >= min_rows).join(inside, label).select(
        label, "n", (F.col("_i") * ratio / (F.col("_t") * ratio + 1e-10)).alias("share")
    )


def share_asymmetry(shares: DataFrame, *, label: str, low: str, high: str, threshold: float = 0.3) -> DataFrame:
    """(high − low) / high between two classes' shares and whether it clears the threshold."""
    wide = shares.agg(
        F.max(F.when(F.col(label) == low, F.col("share"))).alias("_lo"), F.max(F.when(F.col(label) == high, F.col("share"))).alias("_hi")
    )
    a = (F.col("_hi") - F.col("_lo")) / (F.col("_hi") + 1e-10)
    return wide.select(a.alias("asymmetry"), (a >= threshold).alias("holds"))


def target_direction(df: DataFrame, *, vec: str, target: str, alpha: float = 1.0, leave_out: str | None = None, min_rest: int = 20) -> DataFrame:
    """(dim, weight): ridge slope of every dimension on a scalar target, scaled to unit length.

    One pass of sums. With ``leave_out`` the slopes are averaged over fits that each
    leave one group out, obtained as total minus part.
    """
    rows = df.where(F.col(target).isNotNull()).select(
        *( [F.col(leave_out).alias("_g")] if leave_out else [F.lit(0).alias("_g")]),
        F.col(target).cast("double").alias("_y"),
        F.col(vec).alias("_x"),
    ).withColumn("_xy", F.transform("_x", lambda x: x * F.col("_y")))
    parts = rows.groupBy("_g").agg(
        F.count("*").alias("_n"), F.sum("_y").alias("_sy"), F.sum(F.col("_y") * F.col("_y")).alias("_syy"),
        vector_sum("_x").alias("_sx"), vector_sum("_xy").alias("_sxy"),
    )
    long = parts.select("_g", "_n", "_sy", "_syy", F.posexplode(F.arrays_zip("_sx", "_sxy")).alias("dim", "_z")).select(
        "_g", "dim", "_n", "_sy", "_syy", F.col("_z._sx").alias("_sx"), F.col("_z._sxy").alias("_sxy")
    )
    names = ["_n", "_sy", "_syy", "_sx", "_sxy"]
    if leave_out:
        total = long.groupBy("dim").agg(*[F.sum(c).alias(f"{c}_t") for c in names])
        used = long.join(total, "dim").select("_g", "dim", *[(F.col(f"{c}_t") - F.col(c)).alias(c) for c in names]).where(F.col("_n") >= min_rest)
    else:
        used = long
    slope = (F.col("_sxy") - F.col("_sx") * F.col("_sy") / F.col("_n")) / (
        F.col("_syy") - F.col("_sy") * F.col("_sy") / F.col("_n") + F.lit(alpha)
    )
    mean = used.groupBy("dim").agg(F.avg(slope).alias("_w"))
    length = mean.agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_l"))
    return attach_row(mean, length).select("dim", (F.col("_w") / (F.col("_l") + 1e-10)).alias("weight"))


def principal_directions(df: DataFrame, *, vec: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k×d directions, shares) of the centred vectors, from distributed second moments (d×d on the driver)."""
    from kinfold.operators.gram import collect_gram

    g = collect_gram(gram_rows(df.withColumn("_all", F.lit(0)), key="_all", vec=vec), key="_all")[0]
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    return columns[:, order].T, np.maximum(values[order], 0) / max(np.trace(cov), 1e-300)


def aligned_subspace(df: DataFrame, *, vec: str, target: str, n_components: int, leave_out: str | None = None) -> np.ndarray:
    """The target direction followed by the leading directions of what is left."""
    rows = target_direction(df, vec=vec, target=target, leave_out=leave_out).orderBy("dim").collect()
    first = np.array([r.weight for r in rows])
    rest = project_out(df.where(F.col(target).isNotNull()), vec=vec, basis=first[None, :], out="_rest")
    others, _ = principal_directions(rest, vec="_rest", k=n_components - 1)
    return np.vstack([first[None, :], others])[:n_components]


def choose_subspace(df: DataFrame, *, vec: str, target: str, transferred: np.ndarray | None, n_components: int, leave_out: str | None, threshold: float = 0.3):
    """(subspace, path, rho): the transferred one when its first axis ranks the target well enough, else a direct fit."""
    from kinfold.operators.metrics import spearman

    rho = float("nan")
    if transferred is not None:
        scored = df.where(F.col(target).isNotNull()).select(dot(vec, _lit(transferred[0])).alias("_p"), F.col(target).cast("double").alias("_t"))
        found = spearman(scored, [], x="_p", y="_t").first()
        rho = float(found.rho) if found is not None and found.rho is not None else 0.0
        if rho >= threshold:
            return transferred, "transfer", rho
    return aligned_subspace(df, vec=vec, target=target, n_components=n_components, leave_out=leave_out), "direct", rho


def within_between(df: DataFrame, *, vec: str, family: str, by: Sequence[str] = (), min_pairs: int = 5) -> DataFrame:
    """Mean cosine distance inside families over that between families.

    No pair is formed: the sum of cosines over the pairs of a set of unit vectors is
    (‖Σu‖² − n)/2, so one sum per family and one in total are enough.
    """
    u = df.select(*by, family, F.transform(vec, lambda x: x / F.greatest(norm(vec), F.lit(1e-12))).alias("_u"))
    return _pair_ratio(u.groupBy(*by, family).agg(vector_sum("_u").alias("_s"), F.count("*").cast("double").alias("_n")), by, min_pairs)


def _pair_ratio(fam: DataFrame, by: Sequence[str], min_pairs: int) -> DataFrame:
    """:func:`within_between` from the sum of unit vectors and the number of rows of every family."""
    inside = fam.select(
        *by, "_s", "_n", ((dot("_s", "_s") - F.col("_n")) / 2).alias("_c"), (F.col("_n") * (F.col("_n") - 1) / 2).alias("_p")
    )
    total = inside.groupBy(*by).agg(
        vector_sum("_s").alias("_S"), F.sum("_n").alias("_N"), F.sum("_c").alias("_wc"), F.sum("_p").alias("_wp")
    )
    all_pairs = F.col("_N") * (F.col("_N") - 1) / 2
    all_cos = (dot("_S", "_S") - F.col("_N")) / 2
    bp = all_pairs - F.col("_wp")
    enough = (F.col("_wp") >= min_pairs) & (bp >= min_pairs)
    within = 1 - F.col("_wc") / F.col("_wp")
    between = 1 - (all_cos - F.col("_wc")) / bp
    return total.select(
        *by,
        F.col("_wp").cast("long").alias("within_pairs"),
        bp.cast("long").alias("between_pairs"),
        F.when(enough, within / (between + 1e-10)).alias("ratio"),
    )


def permuted_labels(df: DataFrame, *, row_id: str, label: str, n: int, seed: int) -> DataFrame:
    """(perm, row_id, label): ``n`` seeded permutations of a label column over all rows, by keyed bijections of the row numbers."""
    lists = shuffled_labels(df.select(row_id, label), row_id=row_id, label=label, n=n, seed=seed)
    return lists.select(F.posexplode("_shuffled").alias("perm", "_label"), row_id).select("perm", row_id, F.col("_label").alias(label))


def within_between_null(df: DataFrame, *, row_id: str, vec: str, family: str, n: int = 1000, seed: int) -> DataFrame:
    """The ratio under ``n`` relabellings. A task adds up its vectors for all draws and families, so no row is repeated for a draw.

    Where these sums are more than ``DRAWN_SUMS`` numbers, or a family is null, each row carries its drawn labels instead and is summed by draw and family.
    """
    names = [r[0] for r in df.select(family).distinct().limit(DRAWN_SUMS + 1).collect()]
    some = df.select(F.size(vec)).first()
    width = (some[0] if some else 0) + 1
    if not names or None in names or len(names) * width * n > DRAWN_SUMS:
        wide = shuffled_labels(df.select(row_id, vec, family), row_id=row_id, label=family, n=n, seed=seed)
        return within_between(wide.select(vec, F.posexplode("_shuffled").alias("perm", "_f")).withColumnRenamed("_f", family), vec=vec, family=family, by=["perm"])
    unit = F.transform(vec, lambda x: x.cast("double") / F.greatest(norm(vec), F.lit(1e-12)))
    rows = df.select(row_id, family, F.lit(0).alias("_all"), F.concat(unit, F.array(F.lit(1.0))).alias("_v"))
    drawn = class_sums(rows, unit=row_id, label=family, within="_all", values="_v", n_values=width, labels=sorted(names), n=n, seed=seed, keyed=False)
    each = drawn.select(F.col("draw").alias("perm"), "sums", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("_i"))
    at = F.col("_i") * width + 1
    return _pair_ratio(each.select("perm", F.slice("sums", at, width - 1).alias("_s"), F.get("sums", at + width - 2).alias("_n")), ["perm"], 5)


def two_level_mean(df: DataFrame, *, protein: str, window: str, vec: str) -> DataFrame:
    """Mean inside identical windows, then the equal-weight mean of a protein's windows, given to every row."""
    inner = group_mean(df, keys=[protein, window], vec=vec, out="_w")
    outer = inner.groupBy(protein).agg(vector_mean("_w").alias("protein_mean"), F.count("*").alias("n_windows"))
    return df.join(outer, protein)


def spread_features(df: DataFrame, *, group: str, delta: str, pos: str, min_rows: int = 3) -> DataFrame:
    """Magnitude and position spread per group with at least ``min_rows`` rows."""
    m = df.select(group, pos, norm(delta).alias("_m"))
    g = m.groupBy(group).agg(
        F.count("*").alias("n"), F.avg("_m").alias("mag_mean"), F.stddev_pop("_m").alias("mag_std"),
        F.avg(pos).alias("_pm"), F.stddev_pop(pos).alias("_ps"), F.max(pos).alias("_px"),
    ).where(F.col("n") >= min_rows)
    return g.select(
        group, "n", "mag_mean", "mag_std",
        (F.col("mag_std") / (F.col("mag_mean") + 1e-8)).alias("mag_cv"),
        (F.col("_pm") / (F.col("_px") + 1e-8)).alias("pos_mean_norm"),
        (F.col("_ps") / F.col("_px")).alias("pos_std_norm"),
        F.log1p("n").alias("n_log"),
    )


def principal_shares(df: DataFrame, *, group: str, vec: str, min_rows: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """First and second variance shares, the mean vector and its absolute projection on the first axis, per group.

    A group's rows are condensed to a triangular factor (``factors.group_factors``), whose centred block has the
    rows' singular values. Shares are null for a group without any spread, the second one also for vectors of one component.
    """

    def decompose(n: int, r: np.ndarray) -> tuple:
        mean, rest = centred(r)
        _, s, axes = np.linalg.svd(rest, full_matrices=False)
        if not len(s) or s[0] <= 1e-13 * np.linalg.norm(r):
            return n, None, None, None, mean.tolist()
        share = s**2 / (s**2).sum()
        return n, float(share[0]), float(share[1]) if len(share) > 1 else None, abs(float(mean @ axes[0])), mean.tolist()

    fields = "n long, pc1_share double, pc2_share double, pc1_mean_abs double, mean_vector array<double>"
    return group_factors(df, key=group, vec=vec, finish=decompose, fields=fields, min_rows=min_rows, block_rows=block_rows)


def scan_features(df: DataFrame, *, group: str, delta: str, pos: str, seq_len: str, min_rows: int = 3, top: int = 5, axes: bool = True, min_axis_rows: int = 4) -> DataFrame:
    """Per-group profile of a substitution scan: magnitude spread, hotspots, within-position variance, skew, top range.

    With ``axes`` also the share of the first principal axis and its ratio to the second one's, null in groups
    of fewer than ``min_axis_rows`` rows, where they say nothing.
    """
    m = df.select(group, pos, seq_len, norm(delta).alias("_m"))
    basic = m.groupBy(group).agg(
        F.count("*").alias("n"), F.avg("_m").alias("mag_mean"), F.stddev_pop("_m").alias("_sd"), F.max(seq_len).alias("_len")
    ).where(F.col("n") >= min_rows)
    z = m.join(basic, group)
    away = F.col("_m") - F.col("mag_mean")
    shape = z.groupBy(group).agg(
        F.avg((F.col("_m") > F.col("mag_mean") + F.col("_sd")).cast("double")).alias("hotspot_share"),
        (F.avg(away * away * away) / F.pow(F.avg(away * away), F.lit(1.5))).alias("mag_skew"),
    )
    site = m.groupBy(group, pos).agg(F.var_pop("_m").alias("_v"), F.count("*").alias("_k")).where("_k >= 2")
    site = site.groupBy(group).agg(F.avg("_v").alias("site_variance"))
    w = Window.partitionBy(group).orderBy(F.desc("_m"), pos)
    best = m.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    spread = best.groupBy(group).agg((F.max(pos) - F.min(pos)).alias("_range"))
    profile = (
        basic.join(shape, group).join(site, group, "left").join(spread, group)
        .select(
            group, "n", "mag_mean", (F.col("_sd") / (F.col("mag_mean") + 1e-8)).alias("mag_cv"), "hotspot_share", "site_variance", "mag_skew",
            (F.col("_range") / F.greatest(F.col("_len"), F.lit(1))).alias("top_range"),
        )
    )
    if not axes:
        return profile
    shares = principal_shares(df.select(group, delta), group=group, vec=delta, min_rows=max(min_rows, min_axis_rows))
    return profile.join(shares.select(group, "pc1_share", (F.col("pc1_share") / (F.col("pc2_share") + 1e-8)).alias("pc1_pc2_ratio")), group, "left")


def likelihood_features(df: DataFrame, *, group: str, pos: str, ll_wt: str, probes: Sequence[str], probs: str, min_positions: int = 3, top: int = 10) -> DataFrame:
    """Per-group profile of log-likelihood drops over observed positions only."""
    drop = F.col(ll_wt) - sum([F.col(p) for p in probes[1:]], F.col(probes[0])) / len(probes)
    total = F.aggregate(probs, F.lit(0.0), lambda a, p: a + p) + 1e-12
    entropy = F.aggregate(probs, F.lit(0.0), lambda a, p: a - (p / total) * F.ln(p / total + 1e-12))
    seen = df.select(group, pos, F.col(ll_wt).alias("_wt"), drop.alias("_d"), entropy.alias("_e")).where(F.col("_d").isNotNull() & ~F.isnan("_d"))
    basic = seen.groupBy(group).agg(
        F.count("*").alias("n"), F.avg("_wt").alias("ll_wt_mean"), F.avg("_d").alias("ll_delta_mean"), F.stddev_pop("_d").alias("_sd")
    ).where(F.col("n") >= min_positions)
    hot = seen.join(basic, group).groupBy(group).agg(
        F.avg((F.col("_d") > F.col("ll_delta_mean") + F.col("_sd")).cast("double")).alias("ll_hotspot_share")
    )
    w = Window.partitionBy(group).orderBy(F.desc("_d"), pos)
    peak = seen.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).groupBy(group).agg(F.avg("_e").alias("ll_top_entropy"))
    return basic.join(hot, group).join(peak, group).select(
        group, "n", "ll_wt_mean", "ll_delta_mean", (F.col("_sd") / (F.abs("ll_delta_mean") + 1e-8)).alias("ll_delta_cv"), "ll_hotspot_share", "ll_top_entropy"
    )


def conservation_features(df: DataFrame, *, keys: Sequence[str], probs: str, wt_index: str, mut_index: str) -> DataFrame:
    """log p of both letters, position entropy and their difference; finite rows only."""
    p_wt = F.get(probs, F.col(wt_index))
    p_mut = F.get(probs, F.col(mut_index))
    entropy = F.aggregate(probs, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.ln(p)).otherwise(0.0))
    out = df.select(*keys, F.ln(p_wt).alias("logp_wt"), F.ln(p_mut).alias("logp_mut"), entropy.alias("entropy"))
    return out.withColumn("masked_marginal", F.col("logp_mut") - F.col("logp_wt")).where(
        F.col("masked_marginal").isNotNull() & ~F.isnan("masked_marginal")
    )

