"""Queries over sheets, scripts and manifests, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sheets

# Cells of sheets of 8 columns and 8 rows: one or two blocks, shifted in some sheets.
CELLS = """cells AS (SELECT CAST(floor(p_partkey / 64) AS BIGINT) AS sheet, CAST(floor(p_partkey / 8) AS BIGINT) % 8 AS row, p_partkey % 8 AS col,
  CASE WHEN CAST(floor(p_partkey / 8) AS BIGINT) % 8 = 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'D/F 2.0' WHEN 1 THEN ' F 30 ' ELSE 'N/A' END
    WHEN CAST(floor(p_partkey / 8) AS BIGINT) % 8 = 1 THEN CASE (p_partkey + CAST(floor(p_partkey / 64) AS BIGINT) % 3) % 4 WHEN 0 THEN 'oar' WHEN 1 THEN ' Metric' WHEN 2 THEN 'GOAL' ELSE 'Value ' END
    ELSE CASE (p_partkey + CAST(floor(p_partkey / 64) AS BIGINT) % 3) % 4 WHEN 0 THEN CASE p_size % 5 WHEN 0 THEN 'Lung_L/R' WHEN 1 THEN 'Cord, Heart ,' WHEN 2 THEN '' ELSE p_name END
      WHEN 1 THEN CASE p_size % 4 WHEN 0 THEN 'V20Gy' WHEN 1 THEN ' Mean ' WHEN 2 THEN 'D2cc' END WHEN 2 THEN CASE p_size % 3 WHEN 0 THEN '<=' WHEN 1 THEN '>' END
      ELSE CASE WHEN p_size % 4 < 2 THEN ' 30% ' END END END AS value,
  CASE WHEN CAST(floor(p_partkey / 8) AS BIGINT) % 8 >= 2 AND (p_partkey + CAST(floor(p_partkey / 64) AS BIGINT) % 3) % 4 = 3 AND p_size % 4 >= 2 THEN CAST(p_size AS DOUBLE) / 64 END AS num,
  CASE WHEN p_size % 7 = 0 THEN '0%' ELSE '' END AS number_format FROM {part})"""
CHECKS = """checks AS (SELECT o_custkey % 50 AS patient_id, o_orderkey AS check_no, CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'Heart' WHEN 2 THEN 'ptv 70' ELSE 'Lung L' END AS plan_name,
  CASE o_orderkey % 3 WHEN 0 THEN 'Cord' ELSE 'Bowel  bag' END AS template_name, CASE o_orderkey % 5 WHEN 0 THEN 'V 20 Gy ≤' WHEN 1 THEN 'Mean' ELSE 'D2cc <' END AS first_clause,
  CAST(o_custkey % 6 AS VARCHAR(20)) || '.50 GY' AS first_goal, 'Max <=' AS second_clause, CASE o_orderkey % 2 WHEN 0 THEN '' ELSE '12 cm3' END AS second_goal,
  CASE o_orderkey % 3 WHEN 1 THEN ' met ' END AS result, CASE o_orderkey % 7 WHEN 0 THEN o_orderpriority END AS comment FROM {orders})"""
FILES = """files AS (SELECT c_custkey % 40 AS patient_id, 'f' || CAST(c_custkey AS VARCHAR(20)) || CASE c_custkey % 6 WHEN 5 THEN CASE c_nationkey % 2 WHEN 0 THEN '_ctable.xml' ELSE '.xml' END ELSE '.dcm' END AS path,
  CASE c_custkey % 6 WHEN 0 THEN 'CT' WHEN 1 THEN 'RTDOSE' WHEN 2 THEN 'RTPLAN' WHEN 3 THEN 'RTSTRUCT' WHEN 4 THEN 'CT' ELSE 'XML' END AS modality, c_custkey * 10 AS size, c_custkey * 1000 AS mtime FROM {customer})"""


def _frame(spark, sf, cte, *tables):
    return spark.sql(cte.split(" AS (", 1)[1].rsplit(")", 1)[0], **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in tables})


def _cells(spark, sf):
    return _frame(spark, sf, CELLS, "part")


def s9_sheet_blocks(spark, sf):
    return sheets.blocks(_cells(spark, sf))


def s12_sheet_goals(spark, sf):
    c = _cells(spark, sf)
    return sheets.goals(sheets.block_rows(c, sheets.blocks(c))).select("sheet", "block_no", "row", "part", "structure_norm", "metric", "comparator", "value_text")


def s13_script_goals(spark, sf):
    return sheets.script_goals(_frame(spark, sf, CHECKS, "orders"))


def s8_person_names(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    raw = F.concat_ws("^", "c_name", F.when(F.col("c_custkey") % 3 > 0, " Ann ").otherwise(""), F.when(F.col("c_custkey") % 4 == 1, "B."), F.when(F.col("c_custkey") % 5 == 2, "Dr"))
    return c.select("c_custkey", sheets.person_name(raw).alias("shown"))


def s1_manifest(spark, sf):
    return sheets.manifest(_frame(spark, sf, FILES, "customer"))


def s17_stale_results(spark, sf):
    f = _frame(spark, sf, FILES, "customer").select("patient_id", "path", "size", "mtime")
    saved = f.filter("not (patient_id % 5 = 1 and size % 70 = 0)").withColumn("mtime", F.when(F.col("patient_id") % 3 == 0, F.lit(None)).otherwise(F.col("mtime"))).withColumn("size", F.when((F.col("patient_id") % 7 == 2) & (F.col("size") % 50 == 0), F.col("size") + 1).otherwise(F.col("size")))
    return sheets.stale(f, saved)


def s19_signatures(spark, sf):
    f = _frame(spark, sf, FILES, "customer")
    return f.select("path", sheets.signature("patient_id", "path", "size").alias("signature"))


def s21_chosen_sets(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    available = p.select((F.col("p_partkey") % 60).alias("patient_id"), F.col("p_brand").alias("set_id"), (F.col("p_size") % 9 == 0).alias("is_script"))
    plans = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("patient_id"), (F.col("c_custkey") % 11 == 0).alias("wants_none"), F.concat(F.lit("Brand#"), (F.col("c_nationkey") + 1).cast("string")).alias("preferred"), F.concat(F.lit("Brand#"), (F.col("c_custkey") % 60).cast("string")).alias("current"))
    return sheets.chosen_set(plans, available)


QUERIES = {f.__name__: f for f in (s9_sheet_blocks, s12_sheet_goals, s13_script_goals, s8_person_names, s1_manifest, s17_stale_results, s19_signatures, s21_chosen_sets)}

_C, _K, _F = CELLS.format(part="part"), CHECKS.format(orders="orders"), FILES.format(customer="customer")
NUM = r"[-+]?\d*\.?\d+"
BLOCKS = """hd AS (SELECT sheet, col, upper(trim(coalesce(value, ''))) AS h FROM cells WHERE row = 1),
st AS (SELECT sheet, col FROM (SELECT *, lead(h, 1) OVER w AS h1, lead(h, 2) OVER w AS h2, lead(h, 3) OVER w AS h3, lead(col, 3) OVER w AS c3 FROM hd WINDOW w AS (PARTITION BY sheet ORDER BY col)) WHERE h = 'OAR' AND h1 = 'METRIC' AND h2 = 'GOAL' AND h3 = 'VALUE' AND c3 = col + 3),
bl AS (SELECT st.sheet, (row_number() OVER (PARTITION BY st.sheet ORDER BY st.col) - 1)::INT AS block_no, st.col AS first_col, coalesce(trim(l.value), '') AS label FROM st LEFT JOIN cells l ON l.sheet = st.sheet AND l.col = st.col AND l.row = 0)"""


def _numtext(v: str) -> str:
    return f"CASE WHEN abs({v} - round_even({v}, 0)) <= 1e-8 + 1e-5 * abs(round_even({v}, 0)) THEN round_even({v}, 0)::BIGINT::VARCHAR ELSE round({v}, greatest(0, 5 - floor(log10(abs({v})))::INT))::DOUBLE::VARCHAR END"


ORACLE_SQL = {
    "s9_sheet_blocks": f"WITH {_C}, {BLOCKS} SELECT * FROM bl",
    "s12_sheet_goals": f"""WITH {_C}, {BLOCKS}, b AS (SELECT c.sheet, block_no, c.row, max(CASE col - first_col WHEN 0 THEN value END) AS oar, max(CASE col - first_col WHEN 1 THEN value END) AS m, max(CASE col - first_col WHEN 2 THEN value END) AS g,
          max(CASE col - first_col WHEN 3 THEN value END) AS v, max(CASE col - first_col WHEN 3 THEN num END) AS num, max(CASE col - first_col WHEN 3 THEN number_format END) AS nf
        FROM cells c JOIN bl ON bl.sheet = c.sheet AND c.col BETWEEN first_col AND first_col + 3 WHERE c.row >= 2 GROUP BY 1, 2, 3),
        k AS (SELECT *, trim(coalesce(m, '')) AS metric, trim(coalesce(g, '')) AS comparator,
          CASE WHEN num IS NOT NULL THEN CASE WHEN contains(nf, '%') OR starts_with(upper(replace(trim(coalesce(m, '')), ' ', '')), 'V') AND num BETWEEN 0 AND 1 THEN {_numtext('(num * 100)')} || '%' ELSE {_numtext('num')} END ELSE trim(coalesce(v, '')) END AS value_text,
          list_filter(list_transform(string_split(coalesce(oar, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM b WHERE length(trim(concat(oar, m, g, v))) > 0),
        n AS (SELECT *, flatten(list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '(?i)^(.+)_L/R$') THEN [trim(regexp_extract(x, '(?i)^(.+)_L/R$', 1)) || '_L', trim(regexp_extract(x, '(?i)^(.+)_L/R$', 1)) || '_R'] ELSE [x] END)) AS names FROM k),
        u AS (SELECT *, unnest(names) AS nm, generate_subscripts(names, 1) - 1 AS part FROM n)
        SELECT sheet, block_no, row, part::INT AS part, upper(trim(regexp_replace(nm, '\\s+', ' ', 'g'))) AS structure_norm, metric, comparator, value_text FROM u WHERE metric || comparator || value_text <> '' AND trim(nm) <> ''""",
    "s13_script_goals": rf"""WITH {_K}, a AS (SELECT *, upper(trim(regexp_replace(CASE WHEN trim(coalesce(plan_name, '')) <> '' THEN plan_name ELSE template_name END, '\s+', ' ', 'g'))) AS s FROM checks),
        c AS (SELECT *, 0 AS clause_no, first_clause AS cl, first_goal AS gl FROM a UNION ALL SELECT *, 1, second_clause, second_goal FROM a),
        p AS (SELECT *, regexp_extract(replace(replace(cl, '≤', '<='), '≥', '>='), '^(.*?)(<=|>=|==|=|<|>)\s*$', ['m', 'c']) AS k, try_cast(nullif(regexp_extract(gl, '(?i)({NUM})\s*(%|CC|CM3|GY)', 1), '') AS DOUBLE) AS n, upper(regexp_extract(gl, '(?i)({NUM})\s*(%|CC|CM3|GY)', 2)) AS un FROM c WHERE s <> '' AND NOT starts_with(s, 'PTV')),
        r AS (SELECT patient_id, check_no, clause_no, s AS structure_norm, replace(k.m, ' ', '') AS metric, k.c AS comparator,
          CASE WHEN n IS NULL THEN trim(gl) ELSE (CASE WHEN n = round(n) THEN n::BIGINT::VARCHAR ELSE n::VARCHAR END) || CASE un WHEN '%' THEN '%' WHEN 'GY' THEN ' Gy' ELSE ' cc' END END AS value_text,
          concat_ws('    ', CASE WHEN trim(coalesce(result, '')) <> '' THEN 'Eclipse: ' || trim(result) END, CASE WHEN trim(coalesce(comment, '')) <> '' THEN 'Comment: ' || trim(comment) END) AS note FROM p WHERE k.c <> '' AND replace(k.m, ' ', '') <> '')
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, structure_norm, upper(metric), comparator, upper(value_text) ORDER BY check_no, clause_no) AS rn FROM r WHERE value_text <> '') WHERE rn = 1""",
    "s8_person_names": """SELECT c_custkey, trim(concat_ws(' ', CASE WHEN c_custkey % 5 = 2 AND c_custkey % 4 = 1 THEN 'Dr' END, CASE WHEN c_custkey % 3 > 0 THEN 'Ann' END,
        CASE WHEN c_custkey % 4 = 1 THEN 'B.' WHEN c_custkey % 5 = 2 THEN 'Dr' END, c_name)) AS shown FROM customer""",
    "s1_manifest": f"""WITH {_F} SELECT patient_id, min(CASE WHEN modality = 'RTSTRUCT' THEN path END) AS structure_set, min_by(path, (CASE WHEN path LIKE '%\\_ctable.xml' ESCAPE '\\' THEN 0 ELSE 1 END, lower(path))) FILTER (modality = 'XML') AS script,
        sum((modality = 'CT')::INT)::BIGINT AS n_ct, sum((modality = 'RTDOSE')::INT)::BIGINT AS n_rtdose, sum((modality = 'RTPLAN')::INT)::BIGINT AS n_rtplan, sum((modality = 'RTSTRUCT')::INT)::BIGINT AS n_rtstruct FROM files GROUP BY 1""",
    "s17_stale_results": f"""WITH {_F}, sv AS (SELECT patient_id, path, CASE WHEN patient_id % 7 = 2 AND size % 50 = 0 THEN size + 1 ELSE size END AS s, CASE WHEN patient_id % 3 = 0 THEN NULL ELSE mtime END AS m FROM files WHERE NOT (patient_id % 5 = 1 AND size % 70 = 0))
        SELECT f.patient_id, max(CASE WHEN sv.path IS NULL OR sv.s <> f.size OR sv.m <> f.mtime THEN 1 ELSE 0 END) = 1 AS recompute FROM files f LEFT JOIN sv USING (patient_id, path) GROUP BY 1""",
    "s19_signatures": f"WITH {_F} SELECT path, substr(sha256(patient_id::VARCHAR || '|' || path || '|' || size::VARCHAR), 1, 16) AS signature FROM files",
    "s21_chosen_sets": """WITH av AS (SELECT DISTINCT p_partkey % 60 AS patient_id, p_brand AS set_id FROM part), sc AS (SELECT p_partkey % 60 AS patient_id, min(p_brand) AS script FROM part WHERE p_size % 9 = 0 GROUP BY 1),
        pl AS (SELECT c_custkey AS patient_id, c_custkey % 11 = 0 AS none, 'Brand#' || (c_nationkey + 1)::VARCHAR AS pref, 'Brand#' || (c_custkey % 60)::VARCHAR AS cur FROM customer)
        SELECT pl.patient_id, CASE WHEN NOT none THEN coalesce(CASE WHEN EXISTS (SELECT 1 FROM av WHERE av.patient_id = pl.patient_id AND av.set_id = pref) THEN pref END, CASE WHEN EXISTS (SELECT 1 FROM av WHERE av.patient_id = pl.patient_id AND av.set_id = cur) THEN cur END, script) END AS set_id FROM pl LEFT JOIN sc USING (patient_id)""",
}
