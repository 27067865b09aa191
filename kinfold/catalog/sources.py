"""S: scans, sources and sinks, over text and documents derived from the given tables."""

from pyspark.sql import functions as F

from kinfold.catalog.registry import query
from kinfold.functions import notation as N
from kinfold.plans import bindings as B
from kinfold.sources import documents as D
from kinfold.sources import tables as S

T = B.table


@query(
    "s1_header_aliases",
    """SELECT p_partkey::VARCHAR AS gene, CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS pli, CAST(NULL AS DOUBLE) AS loeuf FROM part""",
)
def s1(spark, sf):
    text = F.when(F.col("p_size") % 5 == 0, F.when(F.col("p_size") % 2 == 0, "NA").otherwise("bad")).otherwise(F.col("p_retailprice").cast("string"))
    raw = T(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("gene_symbol"), text.alias("lof.pLI"))
    return S.with_aliases(
        raw, {"gene": ["gene", "gene_symbol"], "pli": ["pLI", "lof.pLI"], "loeuf": ["oe_lof_upper"]}, numeric=["pli", "loeuf"], required=["gene", "pli"]
    )


_S2 = """t AS (SELECT p_partkey AS acc, p_size % 10 AS sub, min(p_partkey * 7 % 1000) AS target, count(*) - 1 AS n_collisions FROM
      (SELECT p_partkey % 300 AS p_partkey, p_size FROM part WHERE p_brand = 'Brand#13' OR p_brand = 'Brand#22') GROUP BY 1, 2),
    b AS (SELECT l_partkey AS acc, l_suppkey % 10 AS sub, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_extendedprice END AS score,
      l_orderkey * 10 + l_linenumber AS seen FROM lineitem)"""


@query(
    "s2_wanted_scores",
    f"""WITH {_S2} SELECT acc, sub, target, n_collisions, score FROM t JOIN b USING (acc, sub) WHERE score IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY acc, sub ORDER BY seen DESC, score DESC) = 1""",
)
def s2(spark, sf):
    targets = T(spark, sf, "part").where(F.col("p_brand").isin("Brand#13", "Brand#22")).select(
        (F.col("p_partkey") % 300).alias("acc"), (F.col("p_size") % 10).cast("long").alias("sub"), ((F.col("p_partkey") % 300) * 7 % 1000).alias("target")
    )
    bulk = T(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("acc"),
        (F.col("l_suppkey") % 10).alias("sub"),
        F.when(F.col("l_linenumber") % 5 == 0, "NaN").otherwise(F.col("l_extendedprice").cast("string")).alias("score"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seen"),
    )
    return S.wanted_scores(bulk, targets, keys=["acc", "sub"], score="score", order="seen", target_id="target")


_KINDS = ["Gain of function", "dominant negative ", "Loss of function", "unclear"]
_MAP = {"gain of function": "GOF", "dominant negative": "DN", "loss of function": "LOF"}


@query(
    "s3_variant_sheet",
    f"""WITH t AS (SELECT p_partkey AS rec, p_type, p_size, substr('{N.LETTERS}', 1 + p_size % 20, 1) AS w, substr('{N.LETTERS}', CAST(1 + p_partkey % 20 AS BIGINT), 1) AS m,
      CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_retailprice END AS ddg FROM part WHERE lower(p_brand) LIKE '%brand#1%'),
    r AS (SELECT rec, CASE p_size % 4 WHEN 0 THEN 'GOF' WHEN 1 THEN 'DN' WHEN 2 THEN 'LOF' END AS mechanism, ddg, CASE WHEN w <> m THEN w END AS aa_wt,
      CASE WHEN w <> m THEN p_size END AS aa_pos, CASE WHEN w <> m THEN m END AS aa_mut FROM t)
    SELECT *, CASE WHEN mechanism IS NULL THEN 'unknown_mechanism' WHEN aa_wt IS NULL THEN 'unparsed_change' END AS reject FROM r""",
)
def s3(spark, sf):
    kind = N.lookup(dict(enumerate(_KINDS)), F.col("p_size") % 4)
    raw = T(spark, sf, "part").select(
        F.col("p_partkey").alias("rec"),
        "p_brand",
        kind.alias("mech"),
        F.concat(
            F.substring(F.lit(N.LETTERS), 1 + F.col("p_size") % 20, F.lit(1)),
            F.col("p_size").cast("string"),
            F.substring(F.lit(N.LETTERS), (1 + F.col("p_partkey") % 20).cast("int"), F.lit(1)),
        ).alias("change"),
        F.when(F.col("p_size") % 6 == 0, "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("ddg"),
    )
    return S.parse_variant_sheet(raw, cls="p_brand", wanted="BRAND#1", mechanism="mech", mapping=_MAP, change="change", number="ddg", keep=["rec"])


@query(
    "s4_nested_annotation",
    """SELECT p_partkey AS gene, '2.7.' || p_size || CASE WHEN p_size % 2 = 0 THEN ',3.4.' || p_partkey % 9 ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ',1.1.7' ELSE '' END AS ec,
    CASE WHEN p_size % 5 = 0 THEN 'KW-1,KW-0418' ELSE 'KW-1' END AS keywords, CASE WHEN p_partkey % 4 <> 0 THEN 'PF' || p_partkey END AS xref FROM part""",
)
def s4(spark, sf):
    size, key = F.col("p_size"), F.col("p_partkey")
    doc = F.concat(
        F.lit('{"proteinDescription":{"recommendedName":{"ecNumbers":[{"value":"2.7.'), size.cast("string"), F.lit('"}]},"alternativeNames":['),
        F.when(size % 2 == 0, F.concat(F.lit('{"ecNumbers":[{"value":"3.4.'), (key % 9).cast("string"), F.lit('"}]}'))).otherwise(F.lit("{}")),
        F.lit(']},"comments":['),
        F.when(size % 3 == 0, F.lit('{"commentType":"CATALYTIC ACTIVITY","reaction":{"ecNumber":"1.1.7"}},{"commentType":"CATALYTIC ACTIVITY","reaction":{"ecNumber":"1.1.7"}}')).otherwise(
            F.lit('{"commentType":"FUNCTION","reaction":{"ecNumber":"9.9"}}')
        ),
        F.lit('],"keywords":[{"id":"KW-1"}'),
        F.when(size % 5 == 0, F.lit(',{"id":"KW-0418"}')).otherwise(F.lit("")),
        F.lit('],"uniProtKBCrossReferences":[{"database":"PDB","id":"X"}'),
        F.when(key % 4 != 0, F.concat(F.lit(',{"database":"Pfam","id":"PF'), key.cast("string"), F.lit('"},{"database":"Pfam","id":"later"}'))).otherwise(F.lit("")),
        F.lit("]}"),
    )
    raw = T(spark, sf, "part").select(key.alias("gene"), doc.alias("doc"))
    return D.parse_annotation(raw, key="gene", document="doc", database="Pfam").select(
        "gene", F.array_join("ec", ",").alias("ec"), F.array_join("keywords", ",").alias("keywords"), "xref"
    )


@query(
    "s5_fasta",
    r"""SELECT 'A' || doc_id AS accession, md5(regexp_replace(regexp_replace(text, '>', ' ', 'g'), '[ \t\n\v\f\r]', '', 'g')) AS body FROM documents""",
)
def s5(spark, sf):
    record = F.concat(
        F.lit("sp|A"), F.col("doc_id").cast("string"), F.lit("-2|NAME_HUMAN some description\n"), F.regexp_replace("text", ">", " ")
    )
    r = T(spark, sf, "documents").select(record.alias("value"))
    return r.select(*D.parse_fasta_record("value")).select("accession", F.md5("sequence").alias("body"))


_S6 = f"""i AS (SELECT 'A' || s_suppkey || '.csv' AS file, upper(s_name) AS seq, s_nationkey AS selection FROM supplier WHERE s_suppkey % 3 <> 0),
    r AS (SELECT 'A' || l_suppkey || '.csv' AS file, CASE WHEN l_linenumber = 3 THEN 'A1C:D2E' WHEN l_linenumber = 4 THEN 'p.?'
        ELSE substr('{N.LETTERS}', CAST(1 + l_partkey % 20 AS BIGINT), 1) || CAST(l_quantity AS INTEGER) || substr('{N.LETTERS}', CAST(1 + (l_partkey + 3) % 20 AS BIGINT), 1) END AS mutant,
      substr('{N.LETTERS}', CAST(1 + l_partkey % 20 AS BIGINT), 1) AS w, CAST(l_quantity AS INTEGER) AS pos, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END AS score, l_linenumber FROM lineitem),
    j AS (SELECT *, CASE WHEN l_linenumber = 3 THEN 'multi_mutant' WHEN l_linenumber = 4 THEN 'unparsed' WHEN pos < 1 OR pos > length(seq) THEN 'out_of_bounds'
      WHEN substr(seq, pos, 1) <> w THEN 'letter_mismatch' WHEN score IS NULL THEN 'no_score' ELSE 'kept' END AS bucket FROM r JOIN i USING (file))"""


@query("s6_assay_folder", f"WITH {_S6} SELECT file, selection, bucket, count(*) AS n FROM j GROUP BY ALL")
def s6(spark, sf):
    index = T(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(
        F.concat(F.lit("A"), "s_suppkey", F.lit(".csv")).alias("file"), F.upper("s_name").alias("seq"), F.col("s_nationkey").alias("selection")
    )
    letter = lambda shift: F.substring(F.lit(N.LETTERS), (1 + (F.col("l_partkey") + shift) % 20).cast("int"), F.lit(1))
    rows = T(spark, sf, "lineitem").select(
        F.concat(F.lit("A"), "l_suppkey", F.lit(".csv")).alias("file"),
        F.when(F.col("l_linenumber") == 3, "A1C:D2E").when(F.col("l_linenumber") == 4, "p.?")
        .otherwise(F.concat(letter(0), F.col("l_quantity").cast("int").cast("string"), letter(3))).alias("mutant"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_extendedprice").cast("string")).alias("score"),
    )
    out = S.join_assays(rows, index, file="file", mutant="mutant", score="score", sequence="seq")
    return out.groupBy("file", "selection", F.coalesce("reject", F.lit("kept")).alias("bucket")).agg(F.count("*").alias("n"))


_S7 = """wt AS (SELECT p_partkey AS domain, upper(p_name) AS wt_seq FROM part WHERE p_partkey % 10 <> 0),
    v AS (SELECT l_partkey AS domain, CAST(l_quantity AS INTEGER) AS pos, l_linenumber AS ln, l_suppkey AS s, l_returnflag AS f, upper(p_name) AS src FROM lineitem JOIN part ON p_partkey = l_partkey),
    m AS (SELECT v.*, wt_seq, CASE WHEN ln = 2 THEN 'G' WHEN pos <= length(src) AND regexp_matches(substr(src, pos, 1), '[A-Z]') THEN substr(src, pos, 1) ELSE 'W' END AS w, substr('ACDY', CAST(1 + s % 4 AS BIGINT), 1) AS mu FROM v LEFT JOIN wt USING (domain)),
    q AS (SELECT *, CASE WHEN ln = 1 THEN src || 'Z' WHEN ln = 5 THEN src ELSE substr(src, 1, pos - 1) || mu || substr(src, pos + 1) END AS mut_seq FROM m),
    b AS (SELECT CASE WHEN domain % 9 = 0 THEN 'not_bare_natural' WHEN wt_seq IS NULL THEN 'no_wt_seq' WHEN ln = 6 THEN 'not_substitution'
      WHEN f = 'A' AND s % 2 = 0 THEN 'ddg_missing' WHEN f = 'A' AND s % 3 = 0 THEN 'ddg_unparseable'
      WHEN length(mut_seq) <> length(wt_seq) THEN 'length_mismatch' WHEN pos < 1 OR pos > length(wt_seq) THEN 'pos_out_of_range'
      WHEN substr(wt_seq, pos, 1) <> w THEN 'wt_residue_mismatch' WHEN substr(mut_seq, pos, 1) <> mu THEN 'mut_residue_mismatch' ELSE 'kept' END AS bucket FROM q)"""


@query("s7_stability_load", f"WITH {_S7} SELECT bucket, count(*) AS n FROM b GROUP BY 1")
def s7(spark, sf):
    part = T(spark, sf, "part").select(F.col("p_partkey").alias("domain"), F.upper("p_name").alias("src"))
    wt = part.where("domain % 10 <> 0").select("domain", F.lit("wt").alias("mut_type"), F.col("src").alias("aa_seq"), F.lit("-").alias("ddg_ml"))
    pos, ln, s = F.col("l_quantity").cast("int"), F.col("l_linenumber"), F.col("l_suppkey")
    here = F.substring("src", pos, F.lit(1))
    w = F.when(ln == 2, "G").when((pos <= F.length("src")) & here.rlike("[A-Z]"), here).otherwise("W")
    mu = F.substring(F.lit("ACDY"), (1 + s % 4).cast("int"), F.lit(1))
    replaced = F.concat(F.substring("src", F.lit(1), pos - 1), mu, F.substring("src", pos + 1, F.length("src")))
    mutants = T(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("domain")).select(
        "domain",
        F.when(ln == 6, F.lit("ins1")).otherwise(F.concat(w, pos.cast("string"), mu)).alias("mut_type"),
        F.when(ln == 1, F.concat("src", F.lit("Z"))).when(ln == 5, F.col("src")).otherwise(replaced).alias("aa_seq"),
        F.when((F.col("l_returnflag") == "A") & (s % 2 == 0), "-").when((F.col("l_returnflag") == "A") & (s % 3 == 0), "n/a")
        .otherwise(F.col("l_extendedprice").cast("string")).alias("ddg_ml"),
    )
    out = S.load_stability(
        wt.unionByName(mutants), domain="domain", kind="mut_type", sequence="aa_seq", target="ddg_ml", bare=F.col("domain") % 9 != 0
    )
    return out.groupBy(F.coalesce("reject", F.lit("kept")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "s8_alignment_report",
    """SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM embeddings) AS n_vectors,
    (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS rows_without_vector,
    (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS vectors_without_row, CAST(0 AS BIGINT) AS repeated_vector_keys""",
)
def s8(spark, sf):
    docs = T(spark, sf, "documents").select(F.col("doc_id").alias("row_id"))
    return S.alignment_report(docs, B.vectors(spark, sf).select("row_id"), row_id="row_id")


@query(
    "s8_join_vectors",
    f"WITH {B.VECTORS_SQL} SELECT row_id, lang, round(list_dot_product(vec, vec), 6) AS len2 FROM documents JOIN vectors ON row_id = doc_id",
)
def s8_join(spark, sf):
    from kinfold.functions.vector_expr import dot

    docs = T(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    j = S.join_vectors(docs, B.vectors(spark, sf).select("row_id", "vec"), row_id="row_id")
    return j.select("row_id", "lang", F.round(dot("vec", "vec"), 6).alias("len2"))


@query(
    "s9_stamp_result",
    f"WITH {B.VARIANTS_SQL} SELECT family, count(*) AS n, 'run1' AS run, CAST(3 AS INTEGER) AS seed, 'orders' AS source_id FROM variants GROUP BY family",
)
def s9(spark, sf):
    return S.stamp(B.variants(spark, sf).groupBy("family").agg(F.count("*").alias("n")), run="run1", seed=3, source="orders")


_DOC_SQL = """SELECT event_id, 'arm.name' AS path, event_type AS value, 'STRING' AS kind FROM events
    UNION ALL SELECT event_id, 'arm.k', props->>'k', 'BIGINT' FROM events
    UNION ALL SELECT event_id, 'seeds[0]', (event_id % 5)::VARCHAR, 'BIGINT' FROM events
    UNION ALL SELECT event_id, 'seeds[1].ok', CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, 'BOOLEAN' FROM events
    UNION ALL SELECT event_id, 'none', NULL, 'VOID' FROM events"""


def event_documents(spark, sf):
    return T(spark, sf, "events").select(
        "event_id",
        F.concat(
            F.lit('{"arm":{"name":"'), "event_type", F.lit('","k":'), F.get_json_object("props", "$.k"), F.lit('},"seeds":['),
            (F.col("event_id") % 5).cast("string"), F.lit(',{"ok":'), (F.col("user_id") % 2 == 0).cast("string"), F.lit('}],"none":null}'),
        ).alias("doc"),
    )


@query("s10_flatten_json", _DOC_SQL)
def s10(spark, sf):
    return D.flatten_json(event_documents(spark, sf), keys=["event_id"], document="doc", max_depth=4)


@query("s10_unreadable_json", "SELECT event_id FROM events WHERE event_id % 7 = 0")
def s10_bad(spark, sf):
    docs = event_documents(spark, sf).withColumn("doc", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("{"), "doc")).otherwise(F.col("doc")))
    return D.unreadable_json(docs, keys=["event_id"], document="doc")


@query(
    "s11_seed_partitions",
    """WITH f AS (SELECT CAST(l_linenumber AS INTEGER) AS seed, count(*) AS n FROM (SELECT DISTINCT l_linenumber, l_linestatus FROM lineitem WHERE l_linenumber <> 2 AND (l_linenumber = 4 OR l_linestatus = 'F')) GROUP BY 1)
    SELECT seed, CASE WHEN w IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN seed = 3 THEN 'mislabelled' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS state
    FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS seed, true AS w) FULL JOIN f USING (seed)""",
)
def s11(spark, sf):
    found = (
        T(spark, sf, "lineitem")
        .where("l_linenumber <> 2 AND (l_linenumber = 4 OR l_linestatus = 'F')")
        .select(F.col("l_linenumber").alias("seed"), "l_linestatus")
        .distinct()
        .withColumn("recorded", F.when(F.col("seed") == 3, 99).otherwise(F.col("seed")))
    )
    return S.seed_partition_report(found, [0, 1, 2, 3, 4, 5], seed="seed", recorded="recorded")


@query(
    "s12_group_map",
    """WITH g AS (SELECT p_partkey AS gene, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS family FROM part WHERE p_partkey % 5 <> 0)
    SELECT family, gene IS NOT NULL AS known, count(*) AS n FROM lineitem LEFT JOIN g ON gene = l_partkey GROUP BY ALL""",
)
def s12(spark, sf):
    raw = T(spark, sf, "part").where("p_partkey % 5 <> 0").select(
        F.col("p_partkey").alias("gene"), F.when(F.col("p_partkey") % 6 == 0, " ").otherwise(F.col("p_brand")).alias("family")
    )
    rows = T(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"))
    out = S.attach_group(rows, S.load_group_map(raw, key="gene", group="family"), key="gene", group="family")
    return out.groupBy("family", "known").agg(F.count("*").alias("n"))


@query(
    "s13_still_wanted",
    """SELECT DISTINCT l_partkey AS gene FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)
    AND l_partkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def s13(spark, sf):
    wanted = T(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene"))
    held = T(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("gene"))
    absent = T(spark, sf, "supplier").select(F.col("s_suppkey").alias("gene"))
    return S.still_wanted(wanted, held, absent, key="gene")


@query(
    "s13_overlay",
    """SELECT coalesce(p_partkey, s_suppkey) AS gene, coalesce(s_name, p_name) AS value FROM part FULL JOIN supplier ON p_partkey = s_suppkey * 30""".replace(
        "coalesce(p_partkey, s_suppkey)", "coalesce(p_partkey, s_suppkey * 30)"
    ),
)
def s13_overlay(spark, sf):
    base = T(spark, sf, "part").select(F.col("p_partkey").alias("gene"), F.col("p_name").alias("value"))
    newer = T(spark, sf, "supplier").select((F.col("s_suppkey") * 30).alias("gene"), F.col("s_name").alias("value"))
    return S.overlay(base, newer, key="gene", value="value")
