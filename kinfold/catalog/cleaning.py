"""C: keys, cleaning, joins and deduplication."""

from pyspark.sql import functions as F

from kinfold.catalog.registry import query
from kinfold.functions import notation as N
from kinfold.functions.hashing import draw_hex
from kinfold.operators import cleaning as C
from kinfold.plans import bindings as B

T = B.table
LETTERS = N.LETTERS

_three = "[" + ", ".join(f"'{k}'" for k in sorted(N.RESIDUES, key=N.RESIDUES.get)) + ", 'Ter']"
_one = "[" + ", ".join(f"'{c}'" for c in LETTERS) + ", '*']"
_CHANGE_SQL = f"""raw AS (
  SELECT l_orderkey AS gene, l_linenumber AS rec, l_partkey % 21 AS a, l_suppkey % 21 AS b, 1 + CAST(l_quantity AS BIGINT) AS pos,
         l_partkey AS prov_id, l_returnflag AS significance, l_linestatus AS status FROM lineitem),
changes AS (
  SELECT *, CASE WHEN prov_id % 2 = 0 THEN 'p.' || ({_three})[a + 1] || pos || ({_three})[b + 1]
                 ELSE ({_one})[a + 1] || pos || ({_one})[b + 1] END AS change FROM raw),
parsed AS (
  SELECT *, CASE WHEN a < 20 AND b < 20 AND a <> b THEN substr('{LETTERS}', a + 1, 1) END AS aa_wt,
         CASE WHEN a < 20 AND b < 20 AND a <> b THEN pos END AS aa_pos,
         CASE WHEN a < 20 AND b < 20 AND a <> b THEN substr('{LETTERS}', b + 1, 1) END AS aa_mut FROM changes)"""


def _changes(spark, sf):
    """Substitution texts in both notations, with stops and synonyms among them."""
    by_letter = [n for n, _ in sorted(N.RESIDUES.items(), key=lambda p: p[1])]
    three = F.array(*[F.lit(x) for x in [*by_letter, "Ter"]])
    one = F.array(*[F.lit(x) for x in [*LETTERS, "*"]])
    a, b = (F.col("l_partkey") % 21 + 1).cast("int"), (F.col("l_suppkey") % 21 + 1).cast("int")
    pos = (1 + F.col("l_quantity").cast("long")).cast("string")
    return T(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("gene"),
        F.col("l_linenumber").alias("rec"),
        F.col("l_partkey").alias("prov_id"),
        F.col("l_returnflag").alias("significance"),
        F.col("l_linestatus").alias("status"),
        F.when(
            F.col("l_partkey") % 2 == 0,
            F.concat(F.lit("p."), F.element_at(three, a), pos, F.element_at(three, b)),
        )
        .otherwise(F.concat(F.element_at(one, a), pos, F.element_at(one, b)))
        .alias("change"),
    )


@query(
    "c1_parse_substitution",
    f"""WITH {_CHANGE_SQL} SELECT coalesce(aa_wt, '-') AS aa_wt, coalesce(aa_mut, '-') AS aa_mut, count(*) AS n,
    CAST(coalesce(sum(aa_pos), 0) AS BIGINT) AS sum_pos FROM parsed GROUP BY 1, 2""",
)
def c1(spark, sf):
    p = _changes(spark, sf).select(N.parse_substitution("change").alias("p"))
    return p.groupBy(
        F.coalesce("p.wt", F.lit("-")).alias("aa_wt"), F.coalesce("p.mut", F.lit("-")).alias("aa_mut")
    ).agg(F.count("*").alias("n"), F.coalesce(F.sum("p.pos"), F.lit(0)).alias("sum_pos"))


@query(
    "c2_row_key",
    f"WITH {B.SEQUENCES_SQL} SELECT row_id, concat_ws('_', gene, aa_pos, aa_wt, aa_mut) AS key FROM sequences",
)
def c2(spark, sf):
    return B.sequences(spark, sf).select("row_id", N.row_key("gene", "aa_pos", "aa_wt", "aa_mut").alias("key"))


@query(
    "c3_map_labels",
    f"""WITH {B.VARIANTS_SQL} SELECT label AS raw, CASE label WHEN 'F' THEN 'LOF' WHEN 'P' THEN 'LOF' ELSE 'GOF' END AS cls,
    CASE label WHEN 'F' THEN 'LOF' WHEN 'O' THEN 'GOF' END AS strict, count(*) AS n FROM variants GROUP BY 1, 2, 3""",
)
def c3(spark, sf):
    return (
        B.variants(spark, sf)
        .select(
            F.col("label").alias("raw"),
            N.class_of("label", {"F": "LOF", "P": "LOF", "O": "GOF"}).alias("cls"),
            N.class_of("label", {"F": "LOF", "O": "GOF"}, unexpected="drop").alias("strict"),
        )
        .groupBy("raw", "cls", "strict")
        .agg(F.count("*").alias("n"))
    )


@query(
    "c4_merge_label_sources",
    """WITH a AS (SELECT c_custkey AS gene, nullif(CASE WHEN c_custkey % 4 = 0 THEN 'Unknown' ELSE c_mktsegment END, 'Unknown') AS a
      FROM customer WHERE c_custkey % 9 <> 1),
    b AS (SELECT o_custkey AS gene, max(c_mktsegment) AS b FROM orders JOIN customer ON c_custkey = 1 + o_custkey % 100 GROUP BY 1),
    m AS (SELECT gene, coalesce(a, b) AS label, CASE WHEN a IS NOT NULL THEN 'sheet' ELSE 'panel' END AS source,
      CASE WHEN a <> b THEN b END AS disagrees FROM a FULL JOIN b USING (gene) WHERE coalesce(a, b) IS NOT NULL)
    SELECT * FROM m UNION ALL
    SELECT s_suppkey * 1000 AS gene, 'ALIAS' AS label, 'legacy' AS source, NULL AS disagrees FROM supplier
    WHERE s_suppkey * 1000 NOT IN (SELECT gene FROM m)""",
)
def c4(spark, sf):
    customer = T(spark, sf, "customer")
    primary = customer.where("c_custkey % 9 <> 1").select(
        F.col("c_custkey").alias("gene"),
        F.when(F.col("c_custkey") % 4 == 0, "Unknown").otherwise(F.col("c_mktsegment")).alias("label"),
    )
    secondary = (
        T(spark, sf, "orders")
        .select(F.col("o_custkey").alias("gene"), (1 + F.col("o_custkey") % 100).alias("c_custkey"))
        .distinct()
        .join(customer, "c_custkey")
        .groupBy("gene")
        .agg(F.max("c_mktsegment").alias("label"))
    )
    aliases = T(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 1000).alias("gene"), F.lit("ALIAS").alias("label"), F.lit("legacy").alias("source")
    )
    return C.merge_label_sources(
        primary, secondary, key="gene", label="label", names=("sheet", "panel"), aliases=aliases
    )


@query(
    "c5_resolve_by_tier",
    f"""WITH {B.REPEATS_SQL}, g AS (SELECT gene, count(DISTINCT label) AS k, count(DISTINCT CASE WHEN tier = 'O' THEN label END) AS ks,
      min(label) AS lo, min(CASE WHEN tier = 'O' THEN label END) AS slo FROM repeats GROUP BY gene)
    SELECT gene, CASE WHEN k = 1 THEN lo ELSE slo END AS label FROM g WHERE k = 1 OR ks = 1""",
)
def c5(spark, sf):
    return C.resolve_by_tier(B.repeats(spark, sf), key="gene", value="label", tier="tier", top="O")


@query(
    "c6_majority_value",
    f"""WITH {B.REPEATS_SQL}, n AS (SELECT gene, label, count(*) AS n, min(stamp * 10 + aa_pos) AS spot FROM repeats GROUP BY 1, 2)
    SELECT gene, label, n FROM n QUALIFY row_number() OVER (PARTITION BY gene ORDER BY n DESC, spot, label) = 1""",
)
def c6(spark, sf):
    rows = B.repeats(spark, sf).withColumn("seen", F.col("stamp") * 10 + F.col("aa_pos"))
    return C.majority_value(rows, key="gene", value="label", ties="first", order="seen")


@query(
    "c7_best_record",
    f"""WITH {B.REPEATS_SQL} SELECT gene, tier, amount, prov_id FROM repeats
    QUALIFY row_number() OVER (PARTITION BY gene ORDER BY (tier = 'F') DESC, amount DESC, prov_id) = 1""",
)
def c7(spark, sf):
    return C.best_per_key(
        B.repeats(spark, sf),
        keys=["gene"],
        order=[(F.col("tier") != "F").cast("int"), -F.col("amount"), F.col("prov_id")],
        keep=["tier", "amount", "prov_id"],
    )


@query(
    "c8_first_duplicate",
    f"""WITH {B.REPEATS_SQL} SELECT key, stamp, prov_id, label, count(*) OVER (PARTITION BY key) - 1 AS n_dropped FROM repeats
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY stamp, prov_id, sub_id, amount) = 1""",
)
def c8(spark, sf):
    return C.first_duplicate(
        B.repeats(spark, sf), keys=["key"], order=["stamp", "prov_id", "sub_id", "amount"], keep=["stamp", "prov_id", "label"]
    )


@query(
    "c9_dedup_drop_conflicts",
    f"""WITH {B.REPEATS_SQL} SELECT key, min(label) AS label, count(*) AS n_records, min(prov_id) AS first_id
    FROM repeats GROUP BY key HAVING count(DISTINCT label) = 1""",
)
def c9(spark, sf):
    return C.dedup_drop_conflicts(B.repeats(spark, sf), keys=["key"], label="label", prov="prov_id")


@query(
    "c9_provenance_links",
    f"""WITH {B.REPEATS_SQL}, kept AS (SELECT key FROM repeats GROUP BY key HAVING count(DISTINCT label) = 1)
    SELECT DISTINCT key, prov_id FROM repeats JOIN kept USING (key)""",
)
def c9_links(spark, sf):
    return C.provenance_links(B.repeats(spark, sf), keys=["key"], label="label", prov="prov_id")


@query(
    "c9_counters",
    f"""WITH {B.REPEATS_SQL}, k AS (SELECT key, count(*) AS n, count(DISTINCT label) AS c FROM repeats GROUP BY key)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (n > 1) AS n_duplicate_keys,
    CAST(sum(n - 1) AS BIGINT) AS n_rows_removed, count(*) FILTER (c > 1) AS n_conflicting_keys FROM k""",
)
def c9_counters(spark, sf):
    return C.dedup_counters(B.repeats(spark, sf), keys=["key"], label="label")


_C10 = """p AS (SELECT o_custkey AS gene, o_orderkey AS rec, o_orderstatus AS mech, CAST(NULL AS BOOLEAN) AS validated, 'orders' AS source
      FROM orders WHERE o_custkey % 3 <> 0),
    s AS (SELECT l_suppkey AS gene, l_orderkey * 10 + l_linenumber AS rec, CASE WHEN l_returnflag = 'R' THEN 'HI' ELSE l_returnflag END AS mech,
      l_linestatus = 'F' AS validated, 'lineitem' AS source FROM lineitem)"""


@query(
    "c10_union_with_precedence",
    f"WITH {_C10} SELECT * FROM p UNION ALL SELECT * FROM s WHERE gene NOT IN (SELECT gene FROM p)",
)
def c10(spark, sf):
    primary = T(spark, sf, "orders").where("o_custkey % 3 <> 0").select(
        F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("rec"), F.col("o_orderstatus").alias("mech"),
        F.lit(None).cast("boolean").alias("validated"), F.lit("orders").alias("source"),
    )
    secondary = T(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("gene"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec"),
        F.when(F.col("l_returnflag") == "R", "HI").otherwise(F.col("l_returnflag")).alias("mech"),
        (F.col("l_linestatus") == "F").alias("validated"), F.lit("lineitem").alias("source"),
    )
    return C.union_with_precedence(primary, secondary, key="gene")


@query(
    "c11_reject_waterfall",
    f"""WITH {B.SEQUENCES_SQL}, j AS (SELECT s.*, CASE WHEN row_id % 6 = 0 THEN aa_pos + 100000 ELSE aa_pos END AS spot FROM sequences s)
    SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN seq_len < 50 THEN 'too_short' WHEN spot < 1 OR spot > seq_len THEN 'out_of_bounds'
      WHEN NOT regexp_matches(aa_wt, '^[A-Za-z]$') THEN 'not_a_letter' WHEN aa_wt = aa_mut THEN 'synonymous' ELSE 'kept' END AS bucket FROM j) GROUP BY 1""",
)
def c11(spark, sf):
    rows = B.sequences(spark, sf).withColumn(
        "at", F.when(F.col("row_id") % 6 == 0, F.col("aa_pos") + 100000).otherwise(F.col("aa_pos"))
    )
    return C.waterfall_counts(
        rows,
        {
            "too_short": F.col("seq_len") < 50,
            "out_of_bounds": (F.col("at") < 1) | (F.col("at") > F.col("seq_len")),
            "not_a_letter": ~F.col("aa_wt").rlike("^[A-Za-z]$"),
            "synonymous": F.col("aa_wt") == F.col("aa_mut"),
        },
    )


@query(
    "c12_cap_and_balance",
    f"""WITH {B.VARIANTS_SQL}, d AS (SELECT row_id, gene, CASE WHEN label = 'F' THEN 'pathogenic' ELSE 'benign' END AS label FROM variants),
    r AS (SELECT *, row_number() OVER (PARTITION BY gene, label ORDER BY {B.hex_sql(7, 'row_id')}, row_id) AS k FROM d),
    c AS (SELECT * FROM r WHERE k <= 4), n AS (SELECT gene, label, count(*) AS n FROM c GROUP BY 1, 2),
    f AS (SELECT gene, min(n) AS floor_n FROM n GROUP BY 1 HAVING count(*) = 2)
    SELECT gene, row_id, label FROM c JOIN f USING (gene) WHERE k <= floor_n""",
)
def c12(spark, sf):
    rows = B.variants(spark, sf).select(
        "row_id", "gene", F.when(F.col("label") == "F", "pathogenic").otherwise("benign").alias("label")
    )
    return C.cap_and_balance(rows, group="gene", label="label", row_id="row_id", cap=4, seed=7)


@query(
    "c13_rebalance",
    f"""WITH {B.VARIANTS_SQL}, d AS (SELECT row_id, family, CASE WHEN label = 'F' THEN 'pathogenic' ELSE 'benign' END AS label FROM variants
      WHERE score > 50000),
    r AS (SELECT *, row_number() OVER (PARTITION BY family, label ORDER BY row_id) AS k FROM d),
    n AS (SELECT family, label, count(*) AS n FROM d GROUP BY 1, 2), f AS (SELECT family, min(n) AS m FROM n GROUP BY 1 HAVING count(*) = 2)
    SELECT family, row_id, label FROM r JOIN f USING (family) WHERE k <= m""",
)
def c13(spark, sf):
    rows = B.variants(spark, sf).where("score > 50000").select(
        "row_id", "family", F.when(F.col("label") == "F", "pathogenic").otherwise("benign").alias("label")
    )
    return C.rebalance(rows, group="family", label="label", row_id="row_id")


@query(
    "c14_balance_report",
    f"""WITH {B.REPEATS_SQL}, k AS (SELECT key, count(*) AS n, count(DISTINCT label) AS c FROM repeats GROUP BY 1),
    g AS (SELECT gene, count(*) FILTER (label = 'A') AS a, count(*) FILTER (label = 'N') AS n, count(*) FILTER (label = 'R') AS r FROM repeats GROUP BY 1)
    SELECT 'unknown_label' AS check, count(*) FILTER (label NOT IN ('A', 'N', 'R')) AS n FROM repeats
    UNION ALL SELECT 'conflicting_label', count(*) FILTER (c > 1) FROM k
    UNION ALL SELECT 'duplicate_key', count(*) FILTER (n > 1) FROM k
    UNION ALL SELECT 'unequal_classes', count(*) FILTER (a <> n OR a <> r) FROM g""",
)
def c14(spark, sf):
    return C.balance_report(B.repeats(spark, sf), group="gene", label="label", keys=["key"], classes=["A", "N", "R"])


@query(
    "c14_group_sizes",
    f"""WITH {B.VARIANTS_SQL}, g AS (SELECT gene, count(*) AS n FROM variants GROUP BY 1)
    SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows, min(n) AS min_size, avg(n) AS mean_size, max(n) AS max_size FROM g""",
)
def c14_sizes(spark, sf):
    return C.group_size_summary(B.variants(spark, sf), group="gene")


_C15 = """ids AS (SELECT l_suppkey AS gene, l_partkey AS mapped, l_orderkey * 100 + l_linenumber AS seen FROM lineitem WHERE l_suppkey % 5 <> 0),
    m AS (SELECT gene, mapped FROM ids QUALIFY row_number() OVER (PARTITION BY gene ORDER BY seen DESC, mapped DESC) = 1)"""


def _ids(spark, sf):
    return T(spark, sf, "lineitem").where("l_suppkey % 5 <> 0").select(
        F.col("l_suppkey").alias("gene"),
        F.col("l_partkey").alias("mapped"),
        F.struct((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seen"), F.col("l_partkey").alias("mapped")).alias("seen"),
    )


@query(
    "c15_attach_id",
    f"""WITH {_C15} SELECT s_suppkey AS gene, s_name, mapped FROM supplier JOIN m ON s_suppkey = gene""",
)
def c15(spark, sf):
    s = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("gene"), "s_name")
    return C.attach_id(s, _ids(spark, sf), key="gene", value="mapped", order="seen")


@query(
    "c15_unmapped_keys",
    f"""WITH {_C15} SELECT o_custkey AS gene, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT gene FROM m) GROUP BY 1""",
)
def c15_unmapped(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_custkey").alias("gene"))
    return C.unmapped_keys(o, _ids(spark, sf), key="gene", value="mapped")


_C16 = """a AS (SELECT p_partkey AS gene,
      [e FOR e IN [CASE WHEN p_size % 4 = 0 THEN '2.7.' || p_size END, CASE WHEN p_size % 6 = 0 THEN '3.4.' || p_size END,
                   CASE WHEN p_size % 9 = 0 THEN '1.' || p_size END, CASE WHEN p_size % 7 = 0 THEN '4.1.' || p_size END] IF e IS NOT NULL] AS ec,
      CASE WHEN p_partkey % 13 = 0 THEN ['KW-0418'] ELSE ['KW-0001'] END AS kw FROM part),
    f AS (SELECT gene, ec, list_contains(kw, 'KW-0418') OR len([x FOR x IN ec IF x LIKE '2.7.%']) > 0 AS k,
      len([x FOR x IN ec IF x LIKE '3.4.%']) > 0 AS p, len([x FOR x IN ec IF x LIKE '1.%']) > 0 AS o FROM a)"""


@query(
    "c16_priority_class",
    f"""WITH {_C16} SELECT gene, CASE WHEN k THEN 'kinase' WHEN p THEN 'protease' WHEN o THEN 'oxidoreductase' WHEN len(ec) = 0 THEN 'non-enzyme' END AS cls,
    (CAST(k AS INT) + CAST(p AS INT) + CAST(o AS INT)) > 1 AS multi FROM f""",
)
def c16(spark, sf):
    size = F.col("p_size")

    def tag(mod, prefix):
        return F.when(size % mod == 0, F.concat(F.lit(prefix), size.cast("string")))

    a = T(spark, sf, "part").select(
        F.col("p_partkey").alias("gene"),
        F.array_compact(F.array(tag(4, "2.7."), tag(6, "3.4."), tag(9, "1."), tag(7, "4.1."))).alias("ec"),
        F.when(F.col("p_partkey") % 13 == 0, F.array(F.lit("KW-0418"))).otherwise(F.array(F.lit("KW-0001"))).alias("kw"),
    )
    return a.select("gene", C.enzyme_class("ec", "kw").alias("cls"), C.multi_hit(C.enzyme_rules("ec", "kw")).alias("multi"))


_CUT = """SELECT '{name}' AS "check", CASE WHEN nl = 0 OR nr = 0 THEN 'INCOMPLETE' WHEN nm = 0 THEN 'PASS' ELSE 'FAIL' END AS state,
    nl AS n_left, nr AS n_right, nm AS n_missing, sample FROM
    (SELECT count(DISTINCT k) AS nl FROM ({a})), (SELECT count(DISTINCT k) AS nr FROM ({b})), (SELECT count(*) AS nm FROM ({m})),
    (SELECT string_agg(k, ',' ORDER BY k) AS sample FROM (SELECT CAST(k AS VARCHAR) AS k FROM ({m}) ORDER BY 1 LIMIT 5))"""
_parts = "SELECT l_partkey AS k FROM lineitem"
_even = "SELECT p_partkey AS k FROM part WHERE p_partkey % 10 <> 3"


@query(
    "c17_coverage_checks",
    _CUT.format(name="parts_known", a=_parts, b="SELECT p_partkey AS k FROM part", m="SELECT DISTINCT k FROM (" + _parts + ") WHERE k NOT IN (SELECT p_partkey FROM part)")
    + " UNION ALL "
    + _CUT.format(name="parts_reduced", a=_parts, b=_even, m=f"SELECT DISTINCT k FROM ({_parts}) WHERE k NOT IN ({_even})")
    + " UNION ALL "
    + _CUT.format(
        name="same_parts", a=_parts, b=_even,
        m=f"SELECT DISTINCT k FROM ({_parts}) WHERE k NOT IN ({_even}) UNION ALL SELECT k FROM ({_even}) WHERE k NOT IN ({_parts})",
    ),
)
def c17(spark, sf):
    items = T(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"))
    part = T(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    fewer = part.where("k % 10 <> 3")
    return (
        C.coverage_check("parts_known", items, part, key="k")
        .unionByName(C.coverage_check("parts_reduced", items, fewer, key="k"))
        .unionByName(C.coverage_check("same_parts", items, fewer, key="k", mode="equal"))
        .withColumn("sample", F.nullif("sample", F.lit("")))
    )


@query(
    "c18_agreement_audit",
    f"""WITH v AS (SELECT l_partkey AS gene, CAST(l_quantity AS INTEGER) - 1 AS aa_pos, substr('ACDEFGHIKLMNPQRSTVWY*', CAST(1 + l_suppkey % 21 AS BIGINT), 1) AS aa_wt FROM lineitem),
    s AS (SELECT p_partkey AS gene, upper(p_name) AS seq FROM part WHERE p_partkey % 8 <> 0),
    j AS (SELECT v.*, seq, seq IS NULL AS miss, seq IS NOT NULL AND (aa_pos < 1 OR aa_pos > length(seq)) AS oob FROM v LEFT JOIN s USING (gene))
    SELECT gene, count(*) FILTER (NOT miss AND NOT oob) AS n_checked, count(*) FILTER (miss) AS n_missing, count(*) FILTER (oob) AS n_out_of_bounds,
    count(*) FILTER (NOT miss AND NOT oob AND substr(seq, aa_pos, 1) <> aa_wt) AS n_mismatch, count(*) FILTER (NOT regexp_matches(aa_wt, '^[{LETTERS}]$')) AS n_invalid_letter
    FROM j GROUP BY gene""",
)
def c18(spark, sf):
    v = T(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("gene"),
        (F.col("l_quantity").cast("int") - 1).alias("aa_pos"),
        F.substring(F.lit(LETTERS + "*"), (1 + F.col("l_suppkey") % 21).cast("int"), F.lit(1)).alias("aa_wt"),
    )
    s = T(spark, sf, "part").where("p_partkey % 8 <> 0").select(F.col("p_partkey").alias("gene"), F.upper("p_name").alias("seq"))
    return C.agreement_audit(v, s, key="gene", pos="aa_pos", wt="aa_wt", sequence="seq", letters=LETTERS)


def _print_sql(by, fields, order, source):
    cols = [f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in ([order] if order else []) + fields]
    words = ", ".join(f"CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT) AS w{i}" for i in range(4))
    sums = ", ".join(f"CAST(sum(CAST(w{i} AS HUGEINT)) AS VARCHAR) AS s{i}" for i in range(4))
    return (
        f"d AS (SELECT {by}, sha256(concat_ws(chr(31), {', '.join(cols)})) AS d FROM {source}), w AS (SELECT {by}, {words} FROM d), "
        f"s AS (SELECT {by}, count(*) AS n_rows, {sums} FROM w GROUP BY {by}) "
        f"SELECT {by}, n_rows, sha256(concat_ws('-', CAST(n_rows AS VARCHAR), s0, s1, s2, s3)) AS digest FROM s"
    )


@query("c19_fingerprint", f"WITH {B.VARIANTS_SQL}, " + _print_sql("source", ["gene", "label", "family"], "row_id", "variants"))
def c19(spark, sf):
    return C.fingerprint(B.variants(spark, sf), ["gene", "label", "family"], by=["source"], order="row_id")


@query(
    "c20_complete_case_mask",
    f"""WITH {B.ATTRIBUTES_SQL} SELECT count(*) AS n_source, count(*) FILTER (price IS NOT NULL AND size IS NOT NULL) AS n_complete,
    count(*) FILTER (price IS NULL OR size IS NULL) AS n_dropped FROM attributes WHERE family = 'Brand#13'""",
)
def c20(spark, sf):
    return C.mask_report(B.attributes(spark, sf), ["price", "size"], source="family", wanted="Brand#13")


@query(
    "c20_complete_rows",
    f"WITH {B.ATTRIBUTES_SQL} SELECT gene, price, size FROM attributes WHERE price IS NOT NULL AND size IS NOT NULL",
)
def c20_rows(spark, sf):
    return C.complete_rows(B.attributes(spark, sf), ["price", "size"]).select("gene", "price", "size")


@query(
    "c21_ensemble_mean",
    f"""WITH {B.REPEATS_SQL}, v AS (SELECT gene, CASE WHEN prov_id % 10 <> 0 THEN amount END AS s FROM repeats)
    SELECT gene, count(s) AS n_members, round(CASE WHEN count(s) = 4 THEN avg(s) END, 6) AS score FROM v GROUP BY gene""",
)
def c21(spark, sf):
    v = B.repeats(spark, sf).select("gene", F.when(F.col("prov_id") % 10 != 0, F.col("amount")).alias("s"))
    return C.ensemble_mean(v, key=["gene"], score="s", members=4).withColumn("score", F.round("score", 6))


@query(
    "c22_seeded_sample",
    f"WITH {B.VARIANTS_SQL} SELECT row_id, gene, label FROM variants ORDER BY {B.hex_sql(3, 'row_id')}, row_id LIMIT 200",
)
def c22(spark, sf):
    return C.seeded_sample(B.variants(spark, sf).select("row_id", "gene", "label"), row_id="row_id", n=200, seed=3)


@query(
    "c23_unpack_flags",
    """WITH p AS (SELECT l_orderkey AS gene, l_linenumber AS rec, l_partkey AS part_id, CASE WHEN l_returnflag = 'N' THEN '1' WHEN l_returnflag = 'A' THEN '0' ELSE 'x' END
      || '|' || (l_suppkey % 2) || '|' || CASE WHEN l_linestatus = 'F' THEN '1' ELSE '0' END AS packed FROM lineitem),
    u AS (SELECT gene, rec, part_id, TRY_CAST(split_part(packed, '|', 1) AS INTEGER) AS f0, TRY_CAST(split_part(packed, '|', 2) AS INTEGER) AS f1,
      TRY_CAST(split_part(packed, '|', 3) AS INTEGER) AS f2 FROM p)
    SELECT f0, f1, f2, CASE WHEN f0 = 1 OR f1 = 1 OR f2 = 1 THEN 1 ELSE 0 END AS any_flag, p_brand AS family, count(*) AS n
    FROM u LEFT JOIN part ON p_partkey = part_id GROUP BY ALL""",
)
def c23(spark, sf):
    flag = F.when(F.col("l_returnflag") == "N", "1").when(F.col("l_returnflag") == "A", "0").otherwise("x")
    p = T(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        F.concat_ws("|", flag, (F.col("l_suppkey") % 2).cast("string"), F.when(F.col("l_linestatus") == "F", "1").otherwise("0")).alias("packed"),
    )
    u = p.select("p_partkey", *C.unpack_flags("packed", ["f0", "f1", "f2"]))
    fam = T(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("family"))
    return u.join(fam, "p_partkey", "left").groupBy("f0", "f1", "f2", "any_flag", "family").agg(F.count("*").alias("n"))


@query(
    "c24_select_clinical",
    f"""WITH {_CHANGE_SQL} SELECT gene, aa_pos, aa_wt, aa_mut, prov_id, significance FROM parsed
    WHERE significance IN ('R', 'A') AND status = 'F' AND aa_wt IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY gene, aa_pos, aa_wt, aa_mut ORDER BY prov_id, significance) = 1""",
)
def c24(spark, sf):
    rows = _changes(spark, sf).withColumn(
        "consequences",
        F.when(F.col("status") == "F", F.array(F.lit("Missense variant"), F.lit("exon"))).otherwise(F.array(F.lit("intron"))),
    )
    return C.select_clinical(
        rows, significance="significance", allowed=["R", "A"], consequences="consequences", change="change", gene="gene", order="prov_id"
    ).withColumn("aa_pos", F.col("aa_pos").cast("long"))
