"""Dose tables derived from the general tables (lineitem, orders, part, supplier, customer, nation, events).

Every view is one SQL text that Spark and DuckDB both read; its base tables stand in braces. The shapes are those of
cohort tables: patient_id leads, structures and plans follow. Work grows with the base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # six structures for each patient; whole-number volumes, so sums are exact
    "dose_sample": """SELECT l_suppkey AS patient_id, l_returnflag || l_linestatus AS structure, l_extendedprice / 1000 AS dose_gy,
        CASE WHEN l_linenumber = 7 THEN -l_quantity ELSE l_quantity END AS weight_cc FROM {lineitem}""",
    # structures with their place in the list
    "structure": """SELECT s_suppkey AS patient_id, s.structure, s.ordinal FROM {supplier} CROSS JOIN
        (SELECT 'AF' AS structure, 1 AS ordinal UNION ALL SELECT 'NF', 2 UNION ALL SELECT 'NO', 3 UNION ALL SELECT 'RF', 4 UNION ALL SELECT 'AO', 5) s""",
    # about twenty goals for each patient, of every kind
    "goal": """SELECT p_partkey % (SELECT count(*) FROM {supplier}) AS patient_id, p_brand AS set_id, p_partkey AS goal_no,
        CASE p_partkey % 5 WHEN 0 THEN 'AF' WHEN 1 THEN ' nf ' WHEN 2 THEN 'No' WHEN 3 THEN 'RF' ELSE 'ZZ' END AS structure,
        CASE p_size % 14 WHEN 0 THEN 'Mean' WHEN 1 THEN 'D95%' WHEN 2 THEN 'V20Gy' WHEN 3 THEN 'v 20 gy' WHEN 4 THEN 'Max' WHEN 5 THEN 'D2cc'
            WHEN 6 THEN 'Min' WHEN 7 THEN 'V30' WHEN 8 THEN 'D95' WHEN 9 THEN 'D0.5 %' WHEN 10 THEN 'DMean' WHEN 11 THEN 'D300CC' WHEN 12 THEN 'V47.5Gy' ELSE 'DMax' END AS metric,
        CASE p_size % 14 WHEN 1 THEN '>=' WHEN 4 THEN '<' WHEN 6 THEN ' >= ' WHEN 8 THEN '>=' WHEN 10 THEN '=' WHEN 11 THEN '>' WHEN 13 THEN '~' ELSE '<=' END AS comparator,
        CASE p_size % 14 WHEN 0 THEN '50 Gy' WHEN 1 THEN '10 Gy' WHEN 2 THEN '75%' WHEN 3 THEN '5000' WHEN 4 THEN '<104.5 Gy' WHEN 5 THEN '90-104 Gy'
            WHEN 6 THEN '1 Gy' WHEN 7 THEN '60 - 70 %' WHEN 8 THEN '30 Gy' WHEN 9 THEN '100 Gy' WHEN 10 THEN '51.5' WHEN 11 THEN '80-40 Gy' WHEN 12 THEN '12.5 cm3' ELSE '99 Gy' END AS value_text
        FROM {part}""",
    # a dose grid of 32 x 32 cells a slice, 16 slices a grid; a grid is a patient's
    "dose_voxel": """SELECT CAST(floor(o_orderkey / 16384) AS BIGINT) AS patient_id, CAST(floor(o_orderkey / 1024) AS BIGINT) % 16 AS k, CAST(floor((o_orderkey % 1024) / 32) AS BIGINT) AS r,
        o_orderkey % 32 AS c, o_totalprice / 10000 AS dose_gy FROM {orders}""",
    # plan phases: up to four for each patient, of which some have no grid
    "plan_phase": """SELECT c_custkey % (SELECT count(*) FROM {supplier}) AS patient_id, 'plan-' || CAST(c_custkey AS VARCHAR(20)) AS plan_uid,
        CASE WHEN c_acctbal < 0 THEN 0.0 ELSE CAST(20 + 2 * (c_custkey % 25) AS DOUBLE) END AS rx_gy, CAST(c_nationkey % 7 AS INT) * 5 AS fractions,
        CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'grid-' || CAST(c_custkey AS VARCHAR(20)) END AS dose_grid_id,
        'PTV' || CAST(2000 + 200 * (c_custkey % 25) AS VARCHAR(20)) AS target_norm, c_mktsegment AS label FROM {customer}""",
    # structure names in the forms people type them
    "named_structure": """SELECT p_partkey % (SELECT count(*) FROM {supplier}) AS patient_id, p_partkey AS ordinal,
        CASE p_size % 13 WHEN 0 THEN 'PTV_' || CAST(2000 + 200 * (p_partkey % 25) AS VARCHAR(20)) WHEN 1 THEN ' ptv  54 ' WHEN 2 THEN 'GTV' || CAST(p_size AS VARCHAR(20)) WHEN 3 THEN 'CTV boost'
            WHEN 4 THEN 'Lung_L' WHEN 5 THEN 'zRing' WHEN 6 THEN 'CouchSurface' WHEN 7 THEN 'BB1' WHEN 8 THEN 'Brain' WHEN 9 THEN 'BrainStem' WHEN 10 THEN 'Brain - PTV' WHEN 11 THEN 'Hand Rail' ELSE p_name END AS name FROM {part}""",
    # notched shapes with a hole, one or two contours for each slice; vertices are rows. Of a patient's structures every third is
    # large, every third is small and lies within the first of the large ones, every third has a large hole
    "contour_point": """SELECT s.patient_id, s.structure_id, s.k, s.contour_no, p.i, s.r0 + p.y * s.h AS r, s.c0 + p.x * s.w AS c FROM
        (SELECT q.patient_id, q.structure_id, t.k, t.contour_no,
            CAST(2 + q.patient_id + CASE WHEN q.kind = 1 THEN 3 ELSE q.turn % 4 END + CASE WHEN q.kind = 2 THEN 2 ELSE 1 END * t.contour_no AS DOUBLE) AS r0,
            CAST(1.5 + q.patient_id + CASE WHEN q.kind = 1 THEN 3.25 ELSE q.turn % 5 END + CASE WHEN q.kind = 2 THEN 2.25 ELSE 1 END * t.contour_no AS DOUBLE) AS c0,
            CAST(CASE WHEN t.contour_no = 1 THEN CASE q.kind WHEN 2 THEN 9.5 ELSE 2 END WHEN q.kind = 1 THEN 7 - q.turn % 3 ELSE 14 END AS DOUBLE) AS h,
            CAST(CASE WHEN t.contour_no = 1 THEN CASE q.kind WHEN 2 THEN 10.5 ELSE 2 END WHEN q.kind = 1 THEN 7.75 ELSE 15.5 END AS DOUBLE) AS w
          FROM (SELECT s_suppkey AS structure_id, s_suppkey % 7 AS patient_id, CAST(floor(s_suppkey / 7) AS BIGINT) AS turn, CAST(floor(s_suppkey / 7) AS BIGINT) % 3 AS kind FROM {supplier}) q CROSS JOIN
            (SELECT 1 AS k, 0 AS contour_no UNION ALL SELECT 2, 0 UNION ALL SELECT 2, 1 UNION ALL SELECT 3, 0 UNION ALL SELECT 3, 1 UNION ALL SELECT 5, 0) t) s
        CROSS JOIN (SELECT 0 AS i, 0.0 AS y, 0.0 AS x UNION ALL SELECT 1, 0.0, 1.0 UNION ALL SELECT 2, 0.5, 0.75 UNION ALL SELECT 3, 1.0, 1.0 UNION ALL SELECT 4, 1.0, 0.1) p""",
    # seven structures for each patient: targets that overlap or lie within one another, a lesion, the brain and a cord
    "target_structure": """SELECT s_suppkey AS structure_id, CAST(floor(s_suppkey / 7) AS BIGINT) AS patient_id, s_suppkey % 7 AS role,
        CASE s_suppkey % 7 WHEN 0 THEN 'PTV A' WHEN 1 THEN 'PTV B' WHEN 2 THEN 'PTV C' WHEN 3 THEN 'PTV D' WHEN 4 THEN 'GTV' WHEN 5 THEN 'BRAIN' ELSE 'CORD' END AS name_norm,
        CAST(18 + 4 * (s_suppkey % 3) AS DOUBLE) AS rx_gy, CASE WHEN s_suppkey % 7 = 2 THEN 3 WHEN floor(s_suppkey / 7) % 2 = 0 THEN 1 ELSE 5 END AS fractions FROM {supplier}""",
    "target_point": """SELECT s.patient_id, s.structure_id, t.k, 0 AS contour_no, p.i, s.r0 + p.y * s.h AS r, s.c0 + p.x * s.w AS c FROM
        (SELECT s_suppkey AS structure_id, CAST(floor(s_suppkey / 7) AS BIGINT) AS patient_id, s_suppkey % 7 AS role,
            CAST(floor(s_suppkey / 7) % 3 + CASE s_suppkey % 7 WHEN 0 THEN 4.25 WHEN 1 THEN 9 WHEN 2 THEN 18.5 WHEN 3 THEN 11 WHEN 4 THEN 12 WHEN 5 THEN 1 ELSE 24 END AS DOUBLE) AS r0,
            CAST(floor(s_suppkey / 7) % 3 + CASE s_suppkey % 7 WHEN 0 THEN 5 WHEN 1 THEN 11 WHEN 2 THEN 3.5 WHEN 3 THEN 13.25 WHEN 4 THEN 14 WHEN 5 THEN 1 ELSE 22 END AS DOUBLE) AS c0,
            CAST(CASE s_suppkey % 7 WHEN 0 THEN 13 WHEN 1 THEN 12 WHEN 2 THEN 6 WHEN 3 THEN 4 WHEN 4 THEN 3 WHEN 5 THEN 28 ELSE 4 END AS DOUBLE) AS h,
            CAST(CASE s_suppkey % 7 WHEN 0 THEN 14 WHEN 1 THEN 13 WHEN 2 THEN 7 WHEN 3 THEN 5 WHEN 4 THEN 3 WHEN 5 THEN 28 ELSE 5 END AS DOUBLE) AS w FROM {supplier}) s
        JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 8 UNION ALL SELECT 9) t
          ON CASE s.role WHEN 2 THEN t.k IN (5, 6, 8) WHEN 3 THEN t.k IN (3, 4) WHEN 4 THEN t.k IN (3, 4) WHEN 5 THEN t.k < 10 ELSE t.k BETWEEN 2 AND 6 END
        CROSS JOIN (SELECT 0 AS i, 0.0 AS y, 0.0 AS x UNION ALL SELECT 1, 0.0, 1.0 UNION ALL SELECT 2, 0.5, 0.75 UNION ALL SELECT 3, 1.0, 1.0 UNION ALL SELECT 4, 1.0, 0.1) p""",
    # grids of the same shape, an eighth of whose cells have a dose, for more patients
    "target_dose": """SELECT CAST(floor(o_orderkey / 2048) AS BIGINT) AS patient_id, CAST(floor(o_orderkey / 128) AS BIGINT) % 16 AS k, CAST(floor((o_orderkey % 128) / 4) AS BIGINT) AS r,
        (o_orderkey % 4) * 8 + CAST(floor((o_orderkey % 128) / 4) + floor(o_orderkey / 128) AS BIGINT) % 8 AS c, o_totalprice / 10000 AS dose_gy FROM {orders}""",
    # grids of 8 x 8 x 8 cells, with cavities at middle doses
    "fine_dose": """SELECT CAST(floor(o_orderkey / 512) AS BIGINT) AS patient_id, CAST(floor((o_orderkey % 512) / 64) AS BIGINT) AS k, CAST(floor((o_orderkey % 64) / 8) AS BIGINT) AS r,
        o_orderkey % 8 AS c, o_totalprice / 10000 AS dose_gy FROM {orders}""",
    # where slices stand, unevenly
    "slice_position": """SELECT s_suppkey % 7 AS patient_id, CAST(floor(s_suppkey / 7) AS BIGINT) AS k, CAST(floor(s_suppkey / 7) * 2.5 + CASE WHEN s_suppkey % 3 = 0 THEN 0.25 ELSE 0 END AS DOUBLE) AS z FROM {supplier}""",
}


def tables_of(sql: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", sql))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(sql)})


def with_views(sql: str, *names: str) -> str:
    """A DuckDB query that begins with the named views."""
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in tables_of(VIEWS[n])})})" for n in names]
    body = sql.strip()
    return "WITH " + ",\n".join(parts) + (",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body)
