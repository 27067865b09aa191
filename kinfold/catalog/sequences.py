"""Q: sequence and text windows."""

from pyspark.sql import functions as F

from kinfold.catalog.registry import query
from kinfold.functions import notation as N
from kinfold.operators import sequence as Q
from kinfold.plans import bindings as B

T = B.table
_OK = "aa_pos >= 1 AND aa_pos <= length(sequence) AND substring(sequence, aa_pos, 1) = aa_wt"


@query(
    "q1_apply_substitution",
    f"""WITH {B.SEQUENCES_SQL}, s AS (SELECT * REPLACE (CASE WHEN row_id % 5 = 0 THEN '#' ELSE aa_wt END AS aa_wt, CASE WHEN row_id % 11 = 0 THEN -1 ELSE aa_pos END AS aa_pos) FROM sequences)
    SELECT row_id, md5(CASE WHEN {_OK} THEN substring(sequence, 1, aa_pos - 1) || aa_mut || substring(sequence, aa_pos + 1) END) AS digest FROM s""",
)
def q1(spark, sf):
    s = B.sequences(spark, sf).withColumns(
        {
            "aa_wt": F.when(F.col("row_id") % 5 == 0, "#").otherwise(F.col("aa_wt")),
            "aa_pos": F.when(F.col("row_id") % 11 == 0, -1).otherwise(F.col("aa_pos")),
        }
    )
    return s.select("row_id", F.md5(N.apply_substitution("sequence", "aa_pos", "aa_wt", "aa_mut")).alias("digest"))


def _window_sql(half, size):
    return f"""w0 AS (SELECT *, length(sequence) AS n, aa_pos - 1 AS idx FROM sequences),
    w1 AS (SELECT *, greatest(0, idx - {half}) AS s0, least(n, idx + {half}) AS e0 FROM w0),
    w2 AS (SELECT *, CASE WHEN n <= {size} THEN 0 WHEN e0 - s0 > {size} THEN greatest(0, idx - {size // 2}) ELSE s0 END AS start FROM w1),
    w3 AS (SELECT *, CASE WHEN n <= {size} THEN n WHEN e0 - s0 > {size} THEN least(n, start + {size}) ELSE e0 END AS stop FROM w2),
    w AS (SELECT *, substring(sequence, start + 1, stop - start) AS win, CAST(idx - start + 1 AS INTEGER) AS new_pos FROM w3)"""


@query(
    "q2_sequence_window",
    f"""WITH {B.SEQUENCES_SQL}, {_window_sql(40, 64)} SELECT row_id, md5(win) AS digest, new_pos AS pos, CAST(start AS INTEGER) AS start FROM w""",
)
def q2(spark, sf):
    w = B.sequences(spark, sf).select("row_id", N.sequence_window("sequence", "aa_pos", half=40, max_len=64).alias("w"))
    return w.select("row_id", F.md5("w.window").alias("digest"), F.col("w.pos").alias("pos"), F.col("w.start").alias("start"))


@query(
    "q3_windowed_pair",
    f"""WITH {B.SEQUENCES_SQL}, {_window_sql(511, 1022)} SELECT row_id, md5(CASE WHEN ok THEN win END) AS wt_digest,
    md5(CASE WHEN ok THEN substring(win, 1, new_pos - 1) || aa_mut || substring(win, new_pos + 1) END) AS mut_digest FROM
    (SELECT *, substring(win, new_pos, 1) = CASE WHEN row_id % 5 = 0 THEN '#' ELSE aa_wt END AS ok FROM w)""",
)
def q3(spark, sf):
    s = B.sequences(spark, sf).withColumn("aa_wt", F.when(F.col("row_id") % 5 == 0, "#").otherwise(F.col("aa_wt")))
    p = s.select("row_id", N.windowed_pair("sequence", "aa_pos", "aa_wt", "aa_mut").alias("p"))
    return p.select("row_id", F.md5("p.wt_window").alias("wt_digest"), F.md5("p.mut_window").alias("mut_digest"))


@query(
    "q4_pair_onehot",
    f"""WITH {B.SEQUENCES_SQL} SELECT row_id, list_aggregate([CASE WHEN substr('{N.LETTERS}', i, 1) = upper(aa_wt) THEN '1' ELSE '0' END FOR i IN range(1, 21)], 'string_agg', '')
      || list_aggregate([CASE WHEN substr('{N.LETTERS}', i, 1) = upper(aa_mut) THEN '1' ELSE '0' END FOR i IN range(1, 21)], 'string_agg', '') AS bits FROM sequences""",
)
def q4(spark, sf):
    bits = N.pair_onehot("aa_wt", "aa_mut")
    return B.sequences(spark, sf).select("row_id", F.array_join(F.transform(bits, lambda x: x.cast("string")), "").alias("bits"))


def _map_sql(table, col):
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + " END"


@query(
    "q5_biochemistry",
    f"""WITH l AS (SELECT substr('{N.LETTERS}X', CAST(1 + l_partkey % 21 AS BIGINT), 1) AS wt, substr('{N.LETTERS}', CAST(1 + l_suppkey % 20 AS BIGINT), 1) AS mut FROM lineitem),
    s AS (SELECT wt, mut, CAST(count(*) % 9 - 4 AS DOUBLE) AS score FROM l WHERE wt <> 'X' GROUP BY 1, 2), d AS (SELECT DISTINCT wt, mut FROM l),
    f AS (SELECT d.wt, d.mut, score, {_map_sql(Q.HYDROPATHY, 'd.mut')} - {_map_sql(Q.HYDROPATHY, 'd.wt')} AS h, {_map_sql(Q.CHARGE, 'd.mut')} - {_map_sql(Q.CHARGE, 'd.wt')} AS c,
      {_map_sql(Q.VOLUME, 'd.mut')} - {_map_sql(Q.VOLUME, 'd.wt')} AS v FROM d LEFT JOIN s USING (wt, mut))
    SELECT wt, mut, score AS substitution_score, round(h, 6) AS hydropathy_change, round(abs(h), 6) AS hydropathy_distance, c AS charge_change, abs(c) AS charge_distance, round(abs(v), 6) AS volume_distance FROM f""",
)
def q5(spark, sf):
    letters = T(spark, sf, "lineitem").select(
        F.substring(F.lit(N.LETTERS + "X"), (1 + F.col("l_partkey") % 21).cast("int"), F.lit(1)).alias("wt"),
        F.substring(F.lit(N.LETTERS), (1 + F.col("l_suppkey") % 20).cast("int"), F.lit(1)).alias("mut"),
    )
    scores = letters.where("wt <> 'X'").groupBy("wt", "mut").agg((F.count("*") % 9 - 4).cast("double").alias("score"))
    out = Q.biochemistry(letters.distinct(), scores, wt="wt", mut="mut")
    return out.select(
        "wt", "mut", "substitution_score",
        *[(F.round(c, 6) + 0.0).alias(c) for c in ("hydropathy_change", "hydropathy_distance", "charge_change", "charge_distance", "volume_distance")],
    )


@query(
    "q6_probe_list",
    f"""WITH {B.SEQUENCES_SQL}, l AS (SELECT row_id, sequence, seq_len AS n, least(100, seq_len) AS k FROM sequences WHERE seq_len >= 10),
    p AS (SELECT DISTINCT row_id, sequence, CASE WHEN i = k - 1 THEN CAST(n AS INTEGER) ELSE CAST(floor(i * ((n - 1)::DOUBLE / (k - 1)::DOUBLE) + 1.0::DOUBLE) AS INTEGER) END AS pos
      FROM (SELECT row_id, sequence, n, k, unnest(range(0, k)) AS i FROM l)),
    q AS (SELECT row_id, pos, substring(sequence, pos, 1) AS w, unnest(['A', 'D', 'W']) AS m FROM p)
    SELECT row_id, count(*) AS n_probes, CAST(sum(pos) AS BIGINT) AS sum_pos, max(pos) AS last_pos FROM q WHERE w <> m GROUP BY row_id""",
)
def q6(spark, sf):
    probes = Q.probe_list(B.sequences(spark, sf), sequence="sequence", keys=["row_id"])
    return probes.groupBy("row_id").agg(
        F.count("*").alias("n_probes"), F.sum("aa_pos").alias("sum_pos"), F.max("aa_pos").alias("last_pos")
    )
