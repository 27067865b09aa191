"""V: vector-column operators."""

import numpy as np
from pyspark.sql import functions as F

from kinfold.catalog.registry import query
from kinfold.catalog.resample import permute_sql
from kinfold.functions.vector_expr import difference
from kinfold.operators import neighbors as K
from kinfold.operators import vectors as V
from kinfold.operators.resample import null_standard_score
from kinfold.plans import bindings as B
from kinfold.session import durable

T = B.table
_NORM = "sqrt(list_dot_product({0}, {0}))"
_DELTA = "[mut[i] - wt[i] FOR i IN range(1, 65)]"
_LONG = "SELECT {keys}, unnest(range(0, 64)) AS dim, unnest({vec}) AS x FROM {src}"


def _explode(df, keys, vec):
    return df.select(*keys, F.posexplode(vec).alias("dim", "x")).select(*keys, F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"))


@query(
    "v1_difference_concat",
    f"WITH {B.PAIRS_SQL}, d AS (SELECT row_id, {_DELTA} AS delta, list_concat(wt, mut) AS both_v FROM pairs) SELECT row_id, dim, round(x, 6) AS x, len(both_v) AS n_both, round(both_v[65], 6) AS first_mut "
    "FROM (SELECT row_id, both_v, unnest(range(0, 64)) AS dim, unnest(delta) AS x FROM d)",
)
def v1(spark, sf):
    d = V.paired_features(B.pairs(spark, sf), wt="wt", mut="mut")
    return d.select("row_id", "both", F.posexplode("delta").alias("dim", "x")).select(
        "row_id", F.col("dim").cast("long").alias("dim"), (F.round("x", 6) + 0.0).alias("x"),
        F.size("both").cast("long").alias("n_both"), F.round(F.get("both", F.lit(64)), 6).alias("first_mut"),
    )


@query(
    "v2_magnitude_direction",
    f"""WITH {B.PAIRS_SQL}, d AS (SELECT row_id, {_DELTA} AS delta FROM pairs), m AS (SELECT *, {_NORM.format('delta')} AS mag FROM d)
    SELECT row_id, round(mag, 6) AS magnitude, round(delta[1] / (mag + 1e-8), 6) AS first_dir, round(delta[64] / (mag + 1e-8), 6) AS last_dir FROM m""",
)
def v2(spark, sf):
    d = V.decompose(V.paired_features(B.pairs(spark, sf), wt="wt", mut="mut"), vec="delta")
    return d.select(
        "row_id", F.round("magnitude", 6).alias("magnitude"),
        (F.round(F.get("direction", F.lit(0)), 6) + 0.0).alias("first_dir"), (F.round(F.get("direction", F.lit(63)), 6) + 0.0).alias("last_dir"),
    )


@query(
    "v3_group_mean",
    f"WITH {B.VECTORS_SQL}, l AS ({_LONG.format(keys='gene', vec='vec', src='vectors')}) SELECT gene, dim, round(avg(x), 6) AS x FROM l GROUP BY gene, dim",
)
def v3(spark, sf):
    return _explode(V.group_mean(B.vectors(spark, sf), keys=["gene"], vec="vec"), ["gene"], "vec")


@query(
    "v3_group_first",
    f"WITH {B.VECTORS_SQL}, f AS (SELECT family, arg_min(vec, row_id) AS vec FROM vectors GROUP BY family) SELECT family, dim, round(x, 6) AS x FROM ({_LONG.format(keys='family', vec='vec', src='f')})",
)
def v3_first(spark, sf):
    return _explode(V.group_first(B.vectors(spark, sf), keys=["family"], vec="vec", order="row_id"), ["family"], "vec")


@query(
    "v4_standardize",
    f"""WITH {B.VECTORS_SQL}, l AS ({_LONG.format(keys='row_id', vec='vec', src='vectors')}), s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM l WHERE row_id % 5 <> 0 GROUP BY dim)
    SELECT row_id, dim, round((x - m) / (sd + 1e-8), 6) AS x FROM l JOIN s USING (dim)""",
)
def v4(spark, sf):
    return _explode(V.standardize(B.vectors(spark, sf), vec="vec", training=F.col("row_id") % 5 != 0), ["row_id"], "scaled")


@query("v5_pca_per_fold")
def v5(spark, sf):
    """Variance shares of a reduction fitted on each fold's training rows (sign-free)."""
    from kinfold.operators.models import fold_pca

    rows = B.vectors(spark, sf)
    return fold_pca(rows.join(B.group_folds(rows, "gene", 3, 0), "gene"), vec="vec", k=8).shares


@query("v6_fit_direction")
def v6(spark, sf):
    from kinfold.operators.models import fit_direction

    rows = B.vectors(spark, sf).withColumn("y", (F.col("label") < 5).cast("int"))
    w = fit_direction(rows, vec="vec", label="y")
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "dim int, weight double")


def class_basis(rows, classes=(0, 1)):
    """A small basis from class means; it is k×d whatever the row count."""
    means = V.group_mean(rows.where(F.col("label").isin(*classes)), keys=["label"], vec="vec").orderBy("label").collect()
    return np.array([r.vec for r in means])


_BASIS = """l AS (SELECT row_id, label, unnest(range(0, 64)) AS dim, unnest(vec) AS x FROM vectors),
    m AS (SELECT label, dim, avg(x) AS m FROM l WHERE label IN (0, 1) GROUP BY 1, 2),
    q1 AS (SELECT dim, m / sqrt(sum(m * m) OVER ()) AS q FROM m WHERE label = 0),
    r2 AS (SELECT b.dim, b.m - q1.q * (sum(b.m * q1.q) OVER ()) AS r FROM m b JOIN q1 ON b.label = 1 AND b.dim = q1.dim),
    q2 AS (SELECT dim, r / sqrt(sum(r * r) OVER ()) AS q FROM r2),
    c AS (SELECT row_id, sum(x * q1.q) AS c1, sum(x * q2.q) AS c2 FROM l JOIN q1 USING (dim) JOIN q2 USING (dim) GROUP BY row_id)"""


@query(
    "v7_project_out",
    f"WITH {B.VECTORS_SQL}, {_BASIS} SELECT row_id, dim, round(x - c1 * q1.q - c2 * q2.q, 6) AS x FROM l JOIN c USING (row_id) JOIN q1 USING (dim) JOIN q2 USING (dim)",
)
def v7(spark, sf):
    rows = B.vectors(spark, sf)
    return _explode(V.project_out(rows, vec="vec", basis=class_basis(rows)), ["row_id"], "projected")


@query("v7_residual_variance", "SELECT true AS clean")
def v7_check(spark, sf):
    rows = B.vectors(spark, sf)
    basis = class_basis(rows)
    left = V.residual_variance(V.project_out(rows, vec="vec", basis=basis), vec="projected", basis=basis)
    return left.select((F.col("residual_variance") <= 1e-8).alias("clean"))


@query(
    "v8_subspace_share",
    f"""WITH {B.VECTORS_SQL}, {_BASIS}, t AS (SELECT label, sum(v) AS t FROM (SELECT label, dim, var_pop(x) AS v FROM l GROUP BY 1, 2) GROUP BY 1),
    i AS (SELECT label, count(*) AS n, var_pop(c1) + var_pop(c2) AS i FROM c JOIN vectors USING (row_id) GROUP BY 1)
    SELECT label, n, round(i / (t + 1e-10), 6) AS share FROM t JOIN i USING (label)""",
)
def v8(spark, sf):
    rows = B.vectors(spark, sf)
    return V.subspace_share(rows, vec="vec", label="label", basis=class_basis(rows)).withColumn("share", F.round("share", 6))


@query(
    "v8_share_asymmetry",
    f"""WITH {B.VECTORS_SQL}, {_BASIS}, t AS (SELECT label, sum(v) AS t FROM (SELECT label, dim, var_pop(x) AS v FROM l GROUP BY 1, 2) GROUP BY 1),
    i AS (SELECT label, var_pop(c1) + var_pop(c2) AS i FROM c JOIN vectors USING (row_id) GROUP BY 1), s AS (SELECT label, i / (t + 1e-10) AS share FROM t JOIN i USING (label)),
    w AS (SELECT max(share) FILTER (label = 3) AS lo, max(share) FILTER (label = 0) AS hi FROM s)
    SELECT round((hi - lo) / (hi + 1e-10), 6) AS asymmetry, (hi - lo) / (hi + 1e-10) >= 0.3 AS holds FROM w""",
)
def v8_asym(spark, sf):
    rows = B.vectors(spark, sf)
    shares = V.subspace_share(rows, vec="vec", label="label", basis=class_basis(rows))
    return V.share_asymmetry(shares, label="label", low=3, high=0).withColumn("asymmetry", F.round("asymmetry", 6) + 0.0)


_TARGETS = B.VECTORS_SQL + ", t AS (SELECT row_id, gene, vec, CASE WHEN row_id % 9 <> 0 THEN 10 * vec[1] + vec[2] + label END AS y FROM vectors), z AS (SELECT row_id, gene, y, unnest(range(0, 64)) AS dim, unnest(vec) AS x FROM t WHERE y IS NOT NULL)"


def _targets(spark, sf):
    y = F.when(F.col("row_id") % 9 != 0, 10 * F.get("vec", F.lit(0)) + F.get("vec", F.lit(1)) + F.col("label"))
    return B.vectors(spark, sf).withColumn("y", y)


@query(
    "v9_target_direction",
    f"""WITH {_TARGETS}, s AS (SELECT dim, (sum(x * y) - sum(x) * sum(y) / count(*)) / (sum(y * y) - sum(y) * sum(y) / count(*) + 1.0) AS w FROM z GROUP BY dim)
    SELECT dim, round(w / (sqrt(sum(w * w) OVER ()) + 1e-10), 6) AS weight FROM s""",
)
def v9(spark, sf):
    d = V.target_direction(_targets(spark, sf), vec="vec", target="y")
    return d.select(F.col("dim").cast("long").alias("dim"), (F.round("weight", 6) + 0.0).alias("weight"))


@query(
    "v9_leave_group_out_direction",
    f"""WITH {_TARGETS}, p AS (SELECT gene, dim, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy, sum(x) AS sx, sum(x * y) AS sxy FROM z GROUP BY 1, 2),
    a AS (SELECT dim, sum(n) AS n, sum(sy) AS sy, sum(syy) AS syy, sum(sx) AS sx, sum(sxy) AS sxy FROM p GROUP BY 1),
    r AS (SELECT p.dim, a.n - p.n AS n, a.sy - p.sy AS sy, a.syy - p.syy AS syy, a.sx - p.sx AS sx, a.sxy - p.sxy AS sxy FROM p JOIN a USING (dim)),
    s AS (SELECT dim, avg((sxy - sx * sy / n) / (syy - sy * sy / n + 1.0)) AS w FROM r GROUP BY dim)
    SELECT dim, round(w / (sqrt(sum(w * w) OVER ()) + 1e-10), 6) AS weight FROM s""",
)
def v9_loo(spark, sf):
    d = V.target_direction(_targets(spark, sf), vec="vec", target="y", leave_out="gene")
    return d.select(F.col("dim").cast("long").alias("dim"), (F.round("weight", 6) + 0.0).alias("weight"))


@query("v9_aligned_subspace")
def v9_space(spark, sf):
    """Variance share of the chosen subspace per class, and which path was taken."""
    rows = _targets(spark, sf)
    basis, path, rho = V.choose_subspace(rows, vec="vec", target="y", transferred=class_basis(rows), n_components=5, leave_out="gene")
    return V.subspace_share(rows, vec="vec", label="label", basis=basis).withColumns({"path": F.lit(path), "transfer_rho": F.lit(rho)})


_KNN = """pairs_d AS (SELECT a.row_id AS query, b.row_id AS neighbor, round(1 - list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 9) AS distance
      FROM vectors a JOIN vectors b ON a.row_id <> b.row_id),
    knn AS (SELECT query, neighbor, distance, row_number() OVER (PARTITION BY query ORDER BY distance, neighbor) AS rank FROM pairs_d QUALIFY rank <= 5)"""


@query("v10_knn_join", f"WITH {B.VECTORS_SQL}, {_KNN} SELECT query, neighbor, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM knn")
def v10(spark, sf):
    return K.knn_join(B.vectors(spark, sf), B.vectors(spark, sf), k=5).withColumn("distance", F.round("distance", 6))


@query(
    "v10_neighbor_purity",
    f"""WITH {B.VECTORS_SQL}, {_KNN} SELECT round(avg(p), 6) AS purity, count(*) AS n_queries FROM
    (SELECT query, count(*) FILTER (a.label = b.label) / 5::DOUBLE AS p FROM knn JOIN vectors a ON a.row_id = query JOIN vectors b ON b.row_id = neighbor GROUP BY query)""",
)
def v10_purity(spark, sf):
    rows = B.vectors(spark, sf)
    return K.neighbor_purity(K.knn_join(rows, rows, k=5), rows, row_id="row_id", label="label", k=5).withColumn("purity", F.round("purity", 6))


_Z = """SELECT round(o, 6) AS observed, round((o - avg(v)) / stddev_samp(v), 6) AS z_score, round(avg(v), 6) AS null_mean, count(v) AS n_draws FROM {null}, {obs} GROUP BY o"""


@query(
    "v10_purity_null",
    f"""WITH RECURSIVE {B.VECTORS_SQL}, {_KNN}, {permute_sql('vectors', 'row_id', 1000, 5, fold='0')},
    obs AS (SELECT avg(p) AS o FROM (SELECT query, count(*) FILTER (a.label = b.label) / 5::DOUBLE AS p FROM knn JOIN vectors a ON a.row_id = query JOIN vectors b ON b.row_id = neighbor GROUP BY query)),
    nul AS (SELECT perm, avg(p) AS v FROM (SELECT a.perm, query, count(*) FILTER (a.label = b.label) / 5::DOUBLE AS p FROM knn JOIN permuted a ON a.row_id = query JOIN permuted b ON b.row_id = neighbor AND a.perm = b.perm GROUP BY 1, 2) GROUP BY 1)
    {_Z.format(null='nul', obs='obs')}""",
)
def v10_null(spark, sf):
    rows = B.vectors(spark, sf)
    graph = durable(K.knn_join(rows, rows, k=5))
    observed = K.neighbor_purity(graph, rows, row_id="row_id", label="label", k=5).select(F.col("purity").alias("observed"))
    nulls = K.purity_null(graph, rows, row_id="row_id", label="label", k=5, seed=5)
    return _z(null_standard_score(observed, nulls, observed="observed", value="purity", expected=1000))


def _z(df):
    return df.select(
        F.round("observed", 6).alias("observed"), (F.round("z_score", 6) + 0.0).alias("z_score"), F.round("null_mean", 6).alias("null_mean"), F.col("n_null_draws").alias("n_draws")
    )


_WB = """fam AS (SELECT {by} family, dim, sum(x) AS s, count(DISTINCT row_id) AS n FROM u GROUP BY ALL),
    f2 AS (SELECT {by} family, (sum(s * s) - max(n)) / 2 AS c, max(n) * (max(n) - 1) / 2 AS p, max(n) AS n FROM fam GROUP BY ALL),
    tot AS (SELECT {by} dim, sum(s) AS s FROM fam GROUP BY ALL), t2 AS (SELECT {by} sum(s * s) AS ss FROM tot {g}),
    agg AS (SELECT {by} sum(c) AS wc, sum(p) AS wp, sum(n) AS n FROM f2 {g}),
    wb AS (SELECT {by} CAST(wp AS BIGINT) AS within_pairs, CAST(n * (n - 1) / 2 - wp AS BIGINT) AS between_pairs,
      (1 - wc / wp) / (1 - ((ss - n) / 2 - wc) / (n * (n - 1) / 2 - wp) + 1e-10) AS ratio FROM agg {j})"""
_UNIT = f"ul AS (SELECT row_id, unnest(range(0, 64)) AS dim, unnest([v / n FOR v IN vec]) AS x FROM (SELECT *, {_NORM.format('vec')} AS n FROM vectors))"


@query(
    "v11_within_between",
    f"WITH {B.VECTORS_SQL}, {_UNIT}, u AS (SELECT ul.*, family FROM ul JOIN vectors USING (row_id)), {_WB.format(by='', g='', j=', t2')} SELECT within_pairs, between_pairs, round(ratio, 6) AS ratio FROM wb",
)
def v11(spark, sf):
    return V.within_between(B.vectors(spark, sf), vec="vec", family="family").withColumn("ratio", F.round("ratio", 6))


@query(
    "v11_ratio_null",
    f"""WITH RECURSIVE {B.VECTORS_SQL}, {_UNIT}, {permute_sql('vectors', 'row_id', 1000, 8, label='family', fold='0')}, u AS (SELECT ul.*, family, perm FROM ul JOIN permuted USING (row_id)), {_WB.format(by='perm,', g='GROUP BY perm', j='JOIN t2 USING (perm)')}
    SELECT perm, round(ratio, 6) AS ratio FROM wb""",
)
def v11_null(spark, sf):
    nulls = V.within_between_null(B.vectors(spark, sf), row_id="row_id", vec="vec", family="family", n=1000, seed=8)
    return nulls.select(F.col("perm").cast("long").alias("perm"), F.round("ratio", 6).alias("ratio"))


@query(
    "v12_knn_classify",
    f"""WITH {B.VECTORS_SQL}, te AS (SELECT * FROM vectors WHERE row_id % 4 = 0), tr AS (SELECT * FROM vectors WHERE row_id % 4 <> 0),
    d AS (SELECT a.row_id, b.row_id AS nb, b.label, round(1 - list_dot_product(a.vec, b.vec) / (sqrt(list_dot_product(a.vec, a.vec)) * sqrt(list_dot_product(b.vec, b.vec))), 9) AS distance FROM te a, tr b),
    k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, nb) <= 10), v AS (SELECT row_id, label, count(*) AS n FROM k GROUP BY 1, 2)
    SELECT row_id, label AS pred, round(n / 10::DOUBLE, 6) AS share FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) = 1""",
)
def v12(spark, sf):
    rows = B.vectors(spark, sf)
    near = K.knn_join(rows.where("row_id % 4 = 0"), rows.where("row_id % 4 <> 0"), k=10, exclude_self=False)
    out = K.knn_vote(near, rows, row_id="row_id", label="label", classes=list(range(10)), k=10)
    return out.select("row_id", "pred", F.round(F.array_max("proba"), 6).alias("share"))


@query(
    "v13_two_level_mean",
    f"""WITH {B.VECTORS_SQL}, l AS (SELECT family, row_id % 3 AS win, unnest(range(0, 64)) AS dim, unnest(vec) AS x FROM vectors), w AS (SELECT family, win, dim, avg(x) AS x FROM l GROUP BY ALL),
    p AS (SELECT family, dim, avg(x) AS x, count(*) AS n_windows FROM w GROUP BY ALL) SELECT row_id, dim, round(p.x, 6) AS x, n_windows FROM vectors JOIN p USING (family)""",
)
def v13(spark, sf):
    rows = B.vectors(spark, sf).withColumn("win", F.col("row_id") % 3)
    return _explode(V.two_level_mean(rows, protein="family", window="win", vec="vec"), ["row_id", "n_windows"], "protein_mean")


def scan_rows(spark, sf):
    return B.pairs(spark, sf).select(
        "row_id", "family", difference("mut", "wt").alias("delta"), (1 + F.pmod(F.col("row_id") * 7, F.lit(40))).alias("pos"),
        (40 + F.col("family") % 3).alias("seq_len"), "label",
    )


_SCAN = B.PAIRS_SQL + f", scan AS (SELECT row_id, family, 1 + (row_id * 7) % 40 AS pos, 40 + family % 3 AS seq_len, {_NORM.format('delta')} AS m FROM (SELECT *, {_DELTA} AS delta FROM pairs))"


@query(
    "v14_spread_features",
    f"""WITH {_SCAN} SELECT family, count(*) AS n, round(avg(m), 6) AS mag_mean, round(stddev_pop(m), 6) AS mag_std, round(stddev_pop(m) / (avg(m) + 1e-8), 6) AS mag_cv,
    round(avg(pos) / (max(pos) + 1e-8), 6) AS pos_mean_norm, round(stddev_pop(pos) / max(pos), 6) AS pos_std_norm, round(ln(1 + count(*)), 6) AS n_log FROM scan GROUP BY family HAVING count(*) >= 3""",
)
def v14(spark, sf):
    f = V.spread_features(scan_rows(spark, sf), group="family", delta="delta", pos="pos")
    return f.select("family", "n", *[F.round(c, 6).alias(c) for c in ("mag_mean", "mag_std", "mag_cv", "pos_mean_norm", "pos_std_norm", "n_log")])


@query("v14_principal_shares")
def v14_pc(spark, sf):
    return V.principal_shares(scan_rows(spark, sf), group="family", vec="delta")


@query(
    "v14_mean_vector",
    f"""WITH {B.PAIRS_SQL}, d AS (SELECT family, {_DELTA} AS delta FROM pairs), e AS (SELECT family, unnest(delta) AS v, unnest(range(len(delta))) AS i FROM d)
    SELECT family, CAST(i AS INTEGER) AS component, count(*) AS n, round(avg(v), 6) AS mean FROM e GROUP BY family, i HAVING count(*) >= 3""",
)
def v14_mean(spark, sf):
    f = V.principal_shares(scan_rows(spark, sf), group="family", vec="delta")
    return f.select("family", "n", F.posexplode("mean_vector").alias("component", "_m")).select("family", "component", "n", (F.round("_m", 6) + 0.0).alias("mean"))


@query("v15_scan_axes")
def v15_axes(spark, sf):
    return V.scan_features(scan_rows(spark, sf), group="family", delta="delta", pos="pos", seq_len="seq_len").select("family", "n", "pc1_share", "pc1_pc2_ratio")


@query(
    "v15_scan_features",
    f"""WITH {_SCAN}, b AS (SELECT family, count(*) AS n, avg(m) AS mu, stddev_pop(m) AS sd, max(seq_len) AS len FROM scan GROUP BY 1 HAVING count(*) >= 3),
    s AS (SELECT family, avg(CASE WHEN m > mu + sd THEN 1.0 ELSE 0.0 END) AS hot, avg(pow(m - mu, 3)) / pow(avg(pow(m - mu, 2)), 1.5) AS sk FROM scan JOIN b USING (family) GROUP BY 1),
    p AS (SELECT family, avg(v) AS sv FROM (SELECT family, pos, var_pop(m) AS v FROM scan GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1),
    t AS (SELECT family, max(pos) - min(pos) AS r FROM (SELECT * FROM scan QUALIFY row_number() OVER (PARTITION BY family ORDER BY m DESC, pos) <= 5) GROUP BY 1)
    SELECT family, n, round(mu, 6) AS mag_mean, round(sd / (mu + 1e-8), 6) AS mag_cv, round(hot, 6) AS hotspot_share, round(sv, 6) AS site_variance, round(sk, 6) AS mag_skew, round(r / greatest(len, 1)::DOUBLE, 6) AS top_range
    FROM b JOIN s USING (family) LEFT JOIN p USING (family) JOIN t USING (family)""",
)
def v15(spark, sf):
    f = V.scan_features(scan_rows(spark, sf), group="family", delta="delta", pos="pos", seq_len="seq_len", axes=False)
    return f.select("family", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mag_mean", "mag_cv", "hotspot_share", "site_variance", "mag_skew", "top_range")])


_LL = B.VECTORS_SQL + """, ll AS (SELECT family, row_id AS pos, ln(abs(vec[1]) + 0.01) AS w, CASE WHEN row_id % 13 <> 0 THEN ln(abs(vec[2]) + 0.01) END AS a, ln(abs(vec[3]) + 0.01) AS b, ln(abs(vec[4]) + 0.01) AS c,
      [abs(x) FOR x IN vec[1:20]] AS probs FROM vectors)"""


def likelihood_rows(spark, sf):
    g = lambda i: F.ln(F.abs(F.get("vec", F.lit(i))) + 0.01)
    return B.vectors(spark, sf).select(
        "family", F.col("row_id").alias("pos"), g(0).alias("w"), F.when(F.col("row_id") % 13 != 0, g(1)).alias("a"), g(2).alias("b"), g(3).alias("c"),
        F.transform(F.slice("vec", 1, 20), lambda x: F.abs(x)).alias("probs"),
    )


@query(
    "v16_likelihood_features",
    f"""WITH {_LL}, s AS (SELECT family, pos, w, w - (a + b + c) / 3 AS d, probs, list_sum(probs) + 1e-12 AS t FROM ll WHERE a IS NOT NULL),
    e AS (SELECT *, -list_sum([(p / t) * ln(p / t + 1e-12) FOR p IN probs]) AS ent FROM s),
    b AS (SELECT family, count(*) AS n, avg(w) AS wm, avg(d) AS dm, stddev_pop(d) AS sd FROM e GROUP BY 1 HAVING count(*) >= 3),
    h AS (SELECT family, avg(CASE WHEN d > dm + sd THEN 1.0 ELSE 0.0 END) AS hot FROM e JOIN b USING (family) GROUP BY 1),
    k AS (SELECT family, avg(ent) AS te FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY family ORDER BY d DESC, pos) <= 10) GROUP BY 1)
    SELECT family, n, round(wm, 6) AS ll_wt_mean, round(dm, 6) AS ll_delta_mean, round(sd / (abs(dm) + 1e-8), 6) AS ll_delta_cv, round(hot, 6) AS ll_hotspot_share, round(te, 6) AS ll_top_entropy
    FROM b JOIN h USING (family) JOIN k USING (family)""",
)
def v16(spark, sf):
    f = V.likelihood_features(likelihood_rows(spark, sf), group="family", pos="pos", ll_wt="w", probes=["a", "b", "c"], probs="probs")
    return f.select("family", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("ll_wt_mean", "ll_delta_mean", "ll_delta_cv", "ll_hotspot_share", "ll_top_entropy")])


@query(
    "v17_conservation_features",
    f"""WITH {B.VECTORS_SQL}, p AS (SELECT row_id, [abs(x) FOR x IN vec[1:20]] AS r FROM vectors), q AS (SELECT row_id, [x / list_sum(r) FOR x IN r] AS p FROM p),
    o AS (SELECT row_id, ln(p[CAST(1 + row_id % 23 AS BIGINT)]) AS lw, ln(p[CAST(1 + row_id % 7 AS BIGINT)]) AS lm, -list_sum([x * ln(x) FOR x IN p]) AS e FROM q)
    SELECT row_id, round(lw, 6) AS logp_wt, round(lm, 6) AS logp_mut, round(e, 6) AS entropy, round(lm - lw, 6) AS masked_marginal FROM o WHERE lm - lw IS NOT NULL""",
)
def v17(spark, sf):
    raw = F.transform(F.slice("vec", 1, 20), lambda x: F.abs(x))
    rows = B.vectors(spark, sf).select("row_id", raw.alias("r"), (F.col("row_id") % 23).cast("int").alias("wi"), (F.col("row_id") % 7).cast("int").alias("mi"))
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("t", total).withColumn("p", F.transform("r", lambda x: x / F.col("t")))
    f = V.conservation_features(rows, keys=["row_id"], probs="p", wt_index="wi", mut_index="mi")
    return f.select("row_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("logp_wt", "logp_mut", "entropy", "masked_marginal")])


@query("v18_cluster_class_rows")
def v18(spark, sf):
    from kinfold.operators.models import cluster_rows

    rows = B.vectors(spark, sf).where("label < 6")
    return cluster_rows(rows, vec="vec", row_id="row_id", n_clusters=8, n_components=16, seed=0).groupBy("cluster").agg(F.count("*").alias("size"))
