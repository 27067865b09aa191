"""P: split and fold assignment."""

from pyspark.sql import functions as F

from kinfold.catalog.registry import query
from kinfold.operators import splits as P
from kinfold.plans import bindings as B

H = B.hex_sql


@query(
    "p1_random_folds",
    f"WITH {B.VARIANTS_SQL} SELECT row_id, CAST(ntile(5) OVER (ORDER BY {H(42, 'row_id')}, row_id) - 1 AS INTEGER) AS fold FROM variants",
)
def p1(spark, sf):
    return P.random_folds(B.variants(spark, sf).select("row_id"), row_id="row_id", n_folds=5, seed=42)


@query(
    "p2_group_folds",
    f"WITH {B.VARIANTS_SQL}, {B.group_folds_sql('variants', 'gene', 5, 42, 'folds')} SELECT row_id, gene, fold FROM variants JOIN folds USING (gene)",
)
def p2(spark, sf):
    return P.assign_group_folds(B.variants(spark, sf).select("row_id", "gene"), group="gene", n_folds=5, seed=42)


_SPARSE = B.VARIANTS_SQL.replace("c_nationkey AS family", "CASE WHEN c_custkey % 6 <> 0 THEN c_nationkey END AS family")


def sparse(spark, sf):
    """Variants with every sixth group unannotated."""
    return B.variants(spark, sf).withColumn("family", F.when(F.col("gene") % 6 != 0, F.col("family")))


@query(
    "p3_family_folds",
    f"WITH {_SPARSE}, {B.group_folds_sql('variants', 'family', 5, 1, 'folds')} SELECT row_id, family, fold FROM variants JOIN folds USING (family)",
)
def p3(spark, sf):
    return P.assign_group_folds(sparse(spark, sf).select("row_id", "family"), group="family", n_folds=5, seed=1)


@query(
    "p4_round_robin_folds",
    f"""WITH {_SPARSE}, g AS (SELECT family, CAST((row_number() OVER (ORDER BY {H(2, 'family')}, family) - 1) % 4 AS INTEGER) AS fold FROM (SELECT DISTINCT family FROM variants WHERE family IS NOT NULL))
    SELECT row_id, variants.family, coalesce(fold, -1) AS fold FROM variants LEFT JOIN g ON variants.family = g.family""",
)
def p4(spark, sf):
    return P.round_robin_folds(sparse(spark, sf).select("row_id", "family"), group="family", n_folds=4, seed=2, null_group="hold")


@query(
    "p5_family_folds_with_solo",
    f"""WITH {_SPARSE}, u AS (SELECT row_id, coalesce(family::VARCHAR, 'solo_' || gene) AS unit FROM variants),
    g AS (SELECT unit, CAST((row_number() OVER (ORDER BY {H(3, 'unit')}, unit) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT unit FROM u)) SELECT row_id, fold FROM u JOIN g USING (unit)""",
)
def p5(spark, sf):
    return P.family_folds_with_solo(sparse(spark, sf).select("row_id", "gene", "family"), gene="gene", family="family", n_folds=5, seed=3).select("row_id", "fold")


@query(
    "p6_leave_one_group_out",
    f"""WITH {B.VARIANTS_SQL}, c AS (SELECT family, label, count(*) AS n FROM variants GROUP BY 1, 2), s AS (SELECT family, CAST(sum(n) AS BIGINT) AS n_rows, coalesce(list_sort(list(n), 'DESC')[2], 0) AS n_second FROM c GROUP BY 1),
    g AS (SELECT family, count(DISTINCT gene) AS n_genes FROM variants GROUP BY 1) SELECT family, n_rows, n_genes, n_second FROM s JOIN g USING (family) WHERE n_second >= 180 AND n_genes >= 50""",
)
def p6(spark, sf):
    return P.qualifying_groups(B.variants(spark, sf), group="family", gene="gene", label="label", min_second=180, min_genes=50)


@query(
    "p7_scheme_bundle",
    f"""WITH {B.VARIANTS_SQL}, {B.group_folds_sql('variants', 'gene', 5, 9, 'gf')}, {B.group_folds_sql('variants', 'family', 5, 9, 'ff')}
    SELECT row_id, 'random' AS scheme, CAST(ntile(5) OVER (ORDER BY {H(9, 'row_id')}, row_id) - 1 AS INTEGER) AS fold FROM variants
    UNION ALL SELECT row_id, 'domain', fold FROM variants JOIN gf USING (gene) UNION ALL SELECT row_id, 'family', fold FROM variants JOIN ff USING (family)""",
)
def p7(spark, sf):
    return P.scheme_bundle(B.variants(spark, sf), row_id="row_id", domain="gene", family="family", n_folds=5, seed=9)


@query(
    "p8_half_partitions",
    f"""WITH {B.VARIANTS_SQL}, d AS (SELECT gene, unnest(range(0, 3)) AS p FROM (SELECT DISTINCT gene FROM variants)),
    r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY {H(4, 'p', 'gene')}, gene) - 1 AS k, count(*) OVER (PARTITION BY p) AS n FROM d)
    SELECT CAST(p AS INTEGER) AS partition, gene, CAST(k >= n // 2 AS INTEGER) AS half FROM r""",
)
def p8(spark, sf):
    return P.half_partitions(B.variants(spark, sf), group="gene", n_partitions=3, seed=4)


@query(
    "p8_usable_halves",
    f"""WITH {B.BINARY_SQL}, d AS (SELECT family, unnest(range(0, 6)) AS p FROM (SELECT DISTINCT family FROM binrows)),
    r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY {H(4, 'p', 'family')}, family) - 1 AS k, count(*) OVER (PARTITION BY p) AS n FROM d), h AS (SELECT p, family, CAST(k >= n // 2 AS INTEGER) AS half FROM r),
    s AS (SELECT p, half FROM h JOIN binrows USING (family) GROUP BY 1, 2 HAVING count(*) FILTER (y = 1) >= 12 AND count(*) FILTER (y = 0) >= 12), ok AS (SELECT p FROM s GROUP BY 1 HAVING count(*) = 2)
    SELECT CAST(p AS INTEGER) AS partition, CAST(t AS INTEGER) AS train_half, CAST(1 - t AS INTEGER) AS test_half FROM (SELECT p, unnest([0, 1]) AS t FROM ok)""",
)
def p8_usable(spark, sf):
    rows = B.binary(spark, sf)
    halves = P.half_partitions(rows, group="family", n_partitions=6, seed=4)
    return P.usable_halves(rows, halves, group="family", y="y", min_per_class=12)


@query(
    "p9_stratified_folds",
    f"""WITH {B.VARIANTS_SQL}, r AS (SELECT row_id, family, row_number() OVER (PARTITION BY family ORDER BY {H(5, 'row_id')}, row_id) - 1 AS k, count(*) OVER (PARTITION BY family) AS n FROM variants)
    SELECT row_id, family, CAST(k % 4 AS INTEGER) AS fold FROM r WHERE n >= 550""",
)
def p9(spark, sf):
    return P.stratified_folds(B.variants(spark, sf).select("row_id", "family"), row_id="row_id", stratum="family", n_folds=4, seed=5, min_size=550)


@query(
    "p10_validation_groups",
    f"""WITH {B.VARIANTS_SQL}, {B.group_folds_sql('variants', 'gene', 5, 0, 'folds')}, t AS (SELECT f.fold, g.gene FROM (SELECT DISTINCT fold FROM folds) f JOIN folds g ON f.fold <> g.fold),
    r AS (SELECT fold, gene, row_number() OVER (PARTITION BY fold ORDER BY {H(6, 'fold', 'gene')}, gene) - 1 AS k, count(*) OVER (PARTITION BY fold) AS n FROM t) SELECT fold, gene FROM r WHERE k < least(greatest(1, floor(n * CAST(0.15 AS DOUBLE))), n - 1)""",
)
def p10(spark, sf):
    rows = P.assign_group_folds(B.variants(spark, sf).select("row_id", "gene"), group="gene", n_folds=5, seed=0)
    return P.validation_groups(rows, group="gene", fold="fold", n_folds=5, seed=6)


@query(
    "p11_contract_failures",
    f"""WITH {B.VARIANTS_SQL}, {B.group_folds_sql('variants', 'gene', 4, 0, 'folds')}, f AS (SELECT row_id, label, gene, family, fold FROM variants JOIN folds USING (gene)),
    s AS (SELECT row_id, k AS fold, CASE WHEN k = fold THEN 'test' ELSE 'train' END AS side FROM (SELECT row_id, fold, unnest([0, 1, 2, 3]) AS k FROM f)),
    sides AS (SELECT * FROM s WHERE NOT (row_id % 50 = 0 AND side = 'test') UNION ALL SELECT row_id, fold, 'train' FROM s WHERE row_id % 40 = 1 AND side = 'test')
    SELECT 'overlap' AS failure, CAST(fold AS INTEGER) AS fold, NULL AS detail, count(*) AS n FROM (SELECT fold, row_id FROM sides GROUP BY 1, 2 HAVING count(DISTINCT side) > 1) GROUP BY fold
    UNION ALL SELECT 'coverage', NULL, NULL, count(*) FROM (SELECT v.row_id, count(side) AS c FROM variants v LEFT JOIN (SELECT * FROM sides WHERE side = 'test') t USING (row_id) GROUP BY 1 HAVING count(side) <> 1)
    UNION ALL SELECT 'group_crossing', CAST(fold AS INTEGER), NULL, count(*) FROM (SELECT fold, family FROM sides JOIN variants USING (row_id) GROUP BY 1, 2 HAVING count(DISTINCT side) > 1) GROUP BY fold""",
)
def p11(spark, sf):
    """A split set broken on purpose: untested rows, rows on both sides, families on both sides."""
    rows = B.variants(spark, sf)
    folds = P.assign_group_folds(rows.select("row_id", "gene"), group="gene", n_folds=4, seed=0)
    s = P.fold_sides(folds, row_id="row_id", n_folds=4)
    sides = s.where("NOT (row_id % 50 = 0 AND side = 'test')").unionByName(
        s.where("row_id % 40 = 1 AND side = 'test'").withColumn("side", F.lit("train"))
    )
    return P.contract_failures(sides, rows, row_id="row_id", label="label", n_folds=4, classes=B.CLASSES, group="family")


@query("p11_contract_status", "SELECT 'valid' AS status, CAST(0 AS BIGINT) AS n_failures")
def p11_status(spark, sf):
    rows = B.variants(spark, sf)
    folds = P.assign_group_folds(rows.select("row_id", "gene"), group="gene", n_folds=4, seed=0)
    sides = P.fold_sides(folds, row_id="row_id", n_folds=4)
    return P.contract_status(P.contract_failures(sides, rows, row_id="row_id", label="label", n_folds=4, classes=B.CLASSES, group="gene"))


@query(
    "p12_fold_index",
    f"WITH {B.VARIANTS_SQL}, {B.group_folds_sql('variants', 'gene', 4, 0, 'folds')} SELECT row_id, fold FROM variants JOIN folds USING (gene)",
)
def p12(spark, sf):
    folds = P.assign_group_folds(B.variants(spark, sf).select("row_id", "gene"), group="gene", n_folds=4, seed=0)
    return P.fold_index(P.fold_sides(folds, row_id="row_id", n_folds=4), row_id="row_id")


@query(
    "p13_select_families",
    f"""WITH {_SPARSE} SELECT family, count(DISTINCT gene) AS n_genes, count(DISTINCT label) AS n_classes, count(*) AS n_rows FROM variants WHERE family IS NOT NULL GROUP BY 1 HAVING count(DISTINCT gene) >= 48 AND count(DISTINCT label) >= 2""",
)
def p13(spark, sf):
    return P.select_families(sparse(spark, sf), family="family", gene="gene", label="label", min_genes=48, min_classes=2)


# the (gene, tier) unit keeps one-sided families; the slot is the label on one side and a cluster on the other
_MATCH = f"""{B.VARIANTS_SQL}, m AS (SELECT row_id, gene AS fam, label = 'F' AS pos, CASE WHEN label = 'F' THEN 'k' || row_id % 3 ELSE label END AS slot FROM variants),
    z AS (SELECT fam, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM m GROUP BY 1),
    c AS (SELECT m.*, least(p, q) AS keep, row_number() OVER (PARTITION BY fam, pos, slot ORDER BY {H(11, 'row_id')}, row_id) AS cyc FROM m JOIN z USING (fam) WHERE p > 0 AND q > 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY fam, pos ORDER BY cyc, slot) AS turn FROM c), kept AS (SELECT row_id, fam, pos, slot FROM t WHERE turn <= keep)"""


def _match_rows(spark, sf):
    return B.variants(spark, sf).select(
        "row_id", F.col("gene").alias("fam"), (F.col("label") == "F").alias("pos"),
        F.when(F.col("label") == "F", F.concat(F.lit("k"), (F.col("row_id") % 3).cast("string"))).otherwise(F.col("label")).alias("slot"),
    )


@query(
    "p14_family_matched_rows",
    f"""WITH {_MATCH}, quota AS (SELECT CAST(round(1.05 * count(*) FILTER (NOT pos)) AS BIGINT) - count(*) FILTER (pos) AS quota FROM kept),
    s AS (SELECT m.*, row_number() OVER (PARTITION BY slot ORDER BY {H(11, 'row_id')}, row_id) AS cyc FROM m JOIN z USING (fam) WHERE q = 0),
    u AS (SELECT *, row_number() OVER (ORDER BY cyc, slot) AS turn FROM s)
    SELECT row_id, fam, pos, 'matched' AS pick FROM kept UNION ALL SELECT row_id, fam, pos, 'topped_up' FROM u, quota WHERE turn <= quota""",
)
def p14(spark, sf):
    out = P.family_matched_rows(_match_rows(spark, sf), row_id="row_id", family="fam", positive="pos", slot="slot", seed=11, target_ratio=1.05)
    return out.select("row_id", "fam", "pos", "pick")


@query(
    "p15_size_matched_rows",
    f"""WITH {_MATCH}, n AS (SELECT pos, count(*) AS keep FROM kept GROUP BY 1),
    a AS (SELECT *, row_number() OVER (PARTITION BY pos, slot ORDER BY {H(12, 'row_id')}, row_id) AS cyc FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY cyc, slot) AS turn FROM a)
    SELECT row_id, pos, slot FROM b JOIN n USING (pos) WHERE turn <= keep""",
)
def p15(spark, sf):
    rows = _match_rows(spark, sf)
    matched = P.family_matched_rows(rows, row_id="row_id", family="fam", positive="pos", slot="slot", seed=11)
    return P.size_matched_rows(rows, matched, row_id="row_id", positive="pos", slot="slot", seed=12).select("row_id", "pos", "slot")


@query(
    "p16_cross_family_triplets",
    f"""WITH {_SPARSE}, f AS (SELECT label, family, count(*) AS nf FROM variants WHERE family IS NOT NULL GROUP BY 1, 2),
    f2 AS (SELECT *, coalesce(sum(nf) OVER (PARTITION BY label ORDER BY {H('family', 'family')}, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM f),
    pool AS (SELECT v.label, s + row_number() OVER (PARTITION BY v.label, v.family ORDER BY {H('row', 'row_id')}, row_id) - 1 AS idx, row_id AS positive FROM variants v JOIN f2 ON v.label = f2.label AND v.family = f2.family),
    c AS (SELECT label, count(*) AS m, count(family) AS np FROM variants GROUP BY 1),
    c2 AS (SELECT *, coalesce(sum(m) OVER (ORDER BY {H('class', 'label')}, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cs, sum(m) OVER () AS total FROM c),
    every AS (SELECT cs + row_number() OVER (PARTITION BY v.label ORDER BY {H('row', 'row_id')}, row_id) - 1 AS g, row_id AS negative FROM variants v JOIN c2 USING (label)),
    a AS (SELECT row_id, v.label, coalesce(nf, 0) AS nf, coalesce(s, 0) AS s, m, cs, np - coalesce(nf, 0) AS pp, total - m AS nn FROM variants v JOIN c2 USING (label) LEFT JOIN f2 ON v.label = f2.label AND v.family = f2.family),
    d AS (SELECT *, unnest(range(0, CAST(least(4, pp, nn) AS BIGINT))) AS draw FROM a),
    x AS (SELECT *, {B.h_sql('42p', 'row_id', 'draw')} % pp AS u, {B.h_sql('42n', 'row_id', 'draw')} % nn AS w FROM d),
    y AS (SELECT row_id AS anchor, draw, label, CASE WHEN u >= s THEN u + nf ELSE u END AS idx, CASE WHEN w >= cs THEN w + m ELSE w END AS g FROM x)
    SELECT anchor, CAST(draw AS INTEGER) AS draw, positive, negative FROM y JOIN pool USING (label, idx) JOIN every USING (g)""",
)
def p16(spark, sf):
    return P.cross_family_triplets(sparse(spark, sf), row_id="row_id", label="label", family="family", per_anchor=4)
