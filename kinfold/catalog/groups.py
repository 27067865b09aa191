"""G: group-level feature engineering."""

from pyspark.sql import functions as F

from kinfold.catalog.registry import query
from kinfold.operators import groups as G
from kinfold.plans import bindings as B

T = B.table


@query(
    "g1_undirected_degree",
    f"""WITH {B.EDGES_SQL} SELECT node, count(DISTINCT partner) AS degree FROM
    (SELECT a AS node, b AS partner FROM edges UNION ALL SELECT b, a FROM edges) GROUP BY node""",
)
def g1(spark, sf):
    return G.symbol_degree(B.edges(spark, sf), a="a", b="b", id_pattern=r"^\d+$")


_G2 = """ids AS (SELECT 'ID' || p_partkey || '.' || (p_size % 3) AS id, p_brand || '_' || (p_partkey % 40) AS symbol, p_partkey AS seen FROM part),
    v AS (SELECT 'ID' || l_partkey || '.' || (l_linenumber % 4) AS id, CASE WHEN l_suppkey % 6 <> 0 THEN l_extendedprice END AS x,
      l_orderkey * 10 + l_linenumber AS seen FROM lineitem),
    n AS (SELECT regexp_replace(id, '\\.\\d+$', '') AS id, symbol FROM ids QUALIFY row_number() OVER (PARTITION BY regexp_replace(id, '\\.\\d+$', '') ORDER BY seen) = 1)"""


@query(
    "g2_two_hop_value",
    f"""WITH {_G2} SELECT symbol, x FROM (SELECT symbol, x, seen FROM n JOIN (SELECT regexp_replace(id, '\\.\\d+$', '') AS id, x, seen FROM v WHERE x IS NOT NULL) USING (id))
    QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seen, x) = 1""",
)
def g2(spark, sf):
    ids = T(spark, sf, "part").select(
        F.concat(F.lit("ID"), "p_partkey", F.lit("."), F.col("p_size") % 3).alias("id"),
        F.concat("p_brand", F.lit("_"), F.col("p_partkey") % 40).alias("symbol"),
        F.col("p_partkey").alias("id_seen"),
    )
    v = T(spark, sf, "lineitem").select(
        F.concat(F.lit("ID"), "l_partkey", F.lit("."), F.col("l_linenumber") % 4).alias("id"),
        F.when(F.col("l_suppkey") % 6 != 0, F.col("l_extendedprice")).alias("x"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"),
    )
    return G.two_hop_value(v, ids, id_col="id", symbol="symbol", value="x", order="seen", id_order="id_seen")


@query(
    "g3_thresholded_log10",
    "SELECT event_id, round(CASE WHEN value / 1000 >= 1e-3 THEN log10(value / 1000) END, 6) AS abundance FROM events",
)
def g3(spark, sf):
    return T(spark, sf, "events").select("event_id", F.round(G.thresholded_log10(F.col("value") / 1000), 6).alias("abundance"))


_WORDS = {0: " Tissue enriched", 1: "group enriched ", 2: "Tissue Enhanced", 3: "low tissue specificity", 4: "not detected"}


@query(
    "g4_ordinal_score",
    """SELECT p_partkey AS gene, CASE p_size % 5 WHEN 0 THEN 0.8::DOUBLE WHEN 1 THEN 0.7::DOUBLE WHEN 2 THEN 0.6::DOUBLE WHEN 3 THEN 0.2::DOUBLE END AS specificity FROM part""",
)
def g4(spark, sf):
    from kinfold.functions.notation import lookup

    text = lookup(_WORDS, F.col("p_size") % 5)
    return T(spark, sf, "part").withColumn("t", text).select(F.col("p_partkey").alias("gene"), G.ordinal_score("t").alias("specificity"))


@query(
    "g5_count_nested",
    "SELECT doc_id AS gene, len([w FOR w IN string_split(text, ' ') IF contains(lower(w), 'an')]) AS n_paralogs FROM documents",
)
def g5(spark, sf):
    """Every word of a document stands for one nested item."""
    items = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("type")))
    return T(spark, sf, "documents").select(
        F.col("doc_id").alias("gene"), G.count_nested(items, "type", "an").cast("long").alias("n_paralogs")
    )


@query(
    "g6_assemble_groups",
    """WITH d AS (SELECT o_custkey AS gene, count(*) AS degree FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    b AS (SELECT o_custkey AS gene, max(o_totalprice) AS top FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1)
    SELECT c_custkey AS gene, c_nationkey AS family, degree, top, CAST(degree IS NULL AS INTEGER) AS degree_missing, CAST(top IS NULL AS INTEGER) AS top_missing
    FROM customer LEFT JOIN d ON c_custkey = d.gene LEFT JOIN b ON c_custkey = b.gene""",
)
def g6(spark, sf):
    universe = T(spark, sf, "customer").select(F.col("c_custkey").alias("gene"), F.col("c_nationkey").alias("family"))
    orders = T(spark, sf, "orders").withColumnRenamed("o_custkey", "gene")
    return G.assemble_groups(
        universe,
        {
            "degree": orders.where("o_orderstatus <> 'P'").groupBy("gene").agg(F.count("*").alias("n")),
            "top": orders.where("gene % 3 <> 0").groupBy("gene").agg(F.max("o_totalprice").alias("m")),
        },
        key="gene",
    )


@query(
    "g7_family_residuals",
    f"""WITH {B.ATTRIBUTES_SQL}, s AS (SELECT family, count(*) AS m, avg(price) AS ap, count(price) AS np, avg(size) AS az, count(size) AS nz
      FROM attributes WHERE family IS NOT NULL GROUP BY 1),
    r AS (SELECT gene, CASE WHEN np >= 2 THEN price - ap END AS pr, CASE WHEN nz >= 2 THEN size - az END AS sr, m FROM attributes LEFT JOIN s USING (family))
    SELECT gene, round(pr, 6) AS price_residual, round(sr, 6) AS size_residual, CAST(pr IS NULL AS INTEGER) AS price_residual_missing,
    CAST(sr IS NULL AS INTEGER) AS size_residual_missing, CAST(coalesce(m = 1, false) AS INTEGER) AS family_singleton FROM r""",
)
def g7(spark, sf):
    r = G.family_residuals(B.attributes(spark, sf), family="family", values=["price", "size"])
    return r.select(
        "gene",
        (F.round("price_residual", 6) + 0.0).alias("price_residual"),
        (F.round("size_residual", 6) + 0.0).alias("size_residual"),
        "price_residual_missing",
        "size_residual_missing",
        "family_singleton",
    )


@query(
    "g7_score_residuals",
    f"""WITH {B.ATTRIBUTES_SQL}, k AS (SELECT gene, kind AS family, price FROM attributes),
    s AS (SELECT family, avg(price) AS ap, count(price) AS np FROM k GROUP BY 1)
    SELECT gene, round(CASE WHEN np >= 2 THEN price - ap END, 6) AS price_residual, CAST(coalesce(np < 2, true) AS INTEGER) AS family_singleton FROM k LEFT JOIN s USING (family)""",
)
def g7_scores(spark, sf):
    k = B.attributes(spark, sf).select("gene", F.col("kind").alias("family"), "price")
    r = G.family_residuals(k, family="family", values=["price"], singleton_by="observed")
    return r.select("gene", (F.round("price_residual", 6) + 0.0).alias("price_residual"), "family_singleton")


@query(
    "g8_numeric_matrix",
    """SELECT event_id, TRY_CAST(props->>'k' AS DOUBLE) AS a, value, TRY_CAST(event_type AS DOUBLE) AS kind_number FROM events""",
)
def g8(spark, sf):
    e = T(spark, sf, "events").withColumn("a", F.get_json_object("props", "$.k")).withColumn("kind_number", F.col("event_type"))
    return G.numeric_matrix(e, ["a", "value", "kind_number"], ["event_id"])


@query("g8_empty_columns", "SELECT 'kind_number' AS feature WHERE (SELECT count(TRY_CAST(event_type AS DOUBLE)) FROM events) = 0")
def g8_empty(spark, sf):
    e = T(spark, sf, "events").withColumn("kind_number", F.col("event_type"))
    return G.empty_columns(G.numeric_matrix(e, ["value", "kind_number"], ["event_id"]), ["value", "kind_number"])


@query(
    "g9_coverage_table",
    f"""WITH {B.ATTRIBUTES_SQL} SELECT 'price' AS feature, count(price) AS covered, count(*) AS total, 100.0::DOUBLE * count(price) / count(*) AS percent FROM attributes
    UNION ALL SELECT 'size', count(size), count(*), 100.0::DOUBLE * count(size) / count(*) FROM attributes""",
)
def g9(spark, sf):
    return G.coverage_by_column(B.attributes(spark, sf), ["price", "size"])


@query(
    "g10_attach_group_features",
    f"""WITH {B.ATTRIBUTES_SQL} SELECT count(*) AS n_rows, CAST(sum(CASE WHEN gene IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unmatched, count(price) AS n_price, l_returnflag AS label
    FROM lineitem LEFT JOIN (SELECT gene, price FROM attributes WHERE gene % 4 <> 0) ON l_partkey = gene GROUP BY l_returnflag""",
)
def g10(spark, sf):
    rows = T(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"), F.col("l_returnflag").alias("label"))
    out = G.attach_group_features(rows, B.attributes(spark, sf).where("gene % 4 <> 0"), key="gene", columns=["price"])
    return out.groupBy("label").agg(
        F.count("*").alias("n_rows"), F.sum("features_missing").alias("n_unmatched"), F.count("price").alias("n_price")
    )


@query(
    "g11_drop_feature_class",
    f"""WITH {B.ATTRIBUTES_SQL}, s AS (SELECT family, avg(size) AS az, count(size) AS nz FROM attributes WHERE family IS NOT NULL GROUP BY 1)
    SELECT gene, size, round(CASE WHEN nz >= 2 THEN size - az END, 6) AS size_residual,
    CAST((CASE WHEN nz >= 2 THEN size - az END) IS NULL AS INTEGER) AS size_residual_missing FROM attributes LEFT JOIN s USING (family)""",
)
def g11(spark, sf):
    r = G.family_residuals(B.attributes(spark, sf), family="family", values=["price", "size"])
    wide = r.select("gene", "price", "price_residual", "price_residual_missing", "size", (F.round("size_residual", 6) + 0.0).alias("size_residual"), "size_residual_missing")
    return wide.select(*G.drop_feature_class(wide.columns, ["price"]))
