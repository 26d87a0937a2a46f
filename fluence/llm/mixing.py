"""Mixing to target weights by iterative proportional fitting, with DataFrame functions only.

Token counts of the cells (source, language, topic) are raked, one marginal after another, until every marginal has its
target share; documents are then sampled with their cell's calibrated probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, small

DIMENSIONS = ("source", "lang", "topic")
SWEEPS = 12
#: Up to so many cells are raked in one task, without shuffles; more stay distributed, with so many sweeps in one plan.
ONE_TASK_CELLS = 100_000
SWEEPS_AT_ONCE = 3
#: Target share of a level: its share of all tokens to this power, made to sum to one (1 keeps the mix, 0 evens it out).
TEMPER = 0.5
#: Expected tokens of the sample, as a share of all.
KEEP = 0.5
SEED = "mix"

# What makes a topic, in this order; any other text is prose.
TOPICS = [("table", " | "), ("contact", "@"), ("notice", "icense"), ("notice", "ights reserved")]
WORD = r"[^ \t\n\r\f\x0B]+"


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, part in reversed(TOPICS):
        out = F.when(F.contains(text, F.lit(part)), F.lit(name)).otherwise(out)
    return out


def tempered(cells: DataFrame, dimension: str, power: float = TEMPER) -> DataFrame:
    """(level, share): the target shares that tempering gives."""
    seen = cells.groupBy(F.col(dimension).alias("level")).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("p", F.pow("t", F.lit(power)))
    whole = seen.agg(F.sum("p").alias("whole"))
    return seen.join(F.broadcast(whole)).select("level", (F.col("p") / F.col("whole")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """cells (the dimensions and tokens) with weight: tokens as every marginal's target wants them, all tokens in sum.

    targets has (level, share) for each dimension; a level without one gets no weight. Cells without tokens get none.
    """
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))
    out = cells.join(F.broadcast(total)).withColumn("weight", F.col("tokens").cast("double"))
    for d, t in targets.items():
        out = out.join(small(t.select(F.col("level").alias(d), F.col("share").alias(f"to_{d}"))), d, "left")
    out = settle(out.fillna(0.0, [f"to_{d}" for d in targets]))
    few = out.limit(ONE_TASK_CELLS + 1).count() <= ONE_TASK_CELLS
    if few:
        out = out.coalesce(1)
    for k in range(sweeps):
        for d in targets:
            now = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"to_{d}") * F.col("total") / now).otherwise(0.0))
        if not few and (k + 1) % SWEEPS_AT_ONCE == 0:
            out = settle(out)
    return settle(out).drop(*(f"to_{d}" for d in targets))


def _marked(docs: DataFrame) -> DataFrame:
    """All columns as one struct, and the cell and tokens of each row."""
    level = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), level("source"), level("lang"), topic_of(F.coalesce(F.col("text"), F.lit(""))).alias("topic"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP, sweeps: int = SWEEPS, id_col: str = "doc_id") -> DataFrame:
    """(row, source, lang, topic, tokens, weight, probability, draw, copies) for every row of docs.

    weight: the row's calibrated tokens; probability: expected copies, the same for all rows of a cell, so that the sample's
    expected tokens have the target marginals and are `keep` of all; draw: uniform by a hash of the id; copies: the whole
    part of probability, and one more if draw is below its rest. Null keys and texts count as empty ones; rows without
    words have weight 0 and are never drawn; a repeated id is drawn alike. An empty table gives no rows. Further columns
    stay in row, clashing names included.
    """
    rows = _marked(docs)
    # grouped in two steps, so that a cell with a third of all rows is summed in many tasks
    cells = settle(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    raked = rake(cells, targets or {d: tempered(cells, d) for d in DIMENSIONS}, sweeps)
    rate = raked.select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias("rate"))
    p = F.when(F.col("tokens") > 0, F.col("rate") * keep).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = rows.join(small(rate), list(DIMENSIONS), "left").select("row", *DIMENSIONS, "tokens", (F.col("tokens") * F.col("rate")).alias("weight"), p.alias("probability"), draw.alias("draw"))
    return out.withColumn("copies", (F.floor("probability") + F.when(F.col("draw") < F.col("probability") - F.floor("probability"), 1).otherwise(0)).cast("int"))


def op3_mix_to_targets(spark, sf_dir):
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("row.doc_id").alias("doc_id"), *DIMENSIONS, "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 9).alias("probability"), "copies")


def _sql() -> str:
    """The same in DuckDB: every sweep of every marginal as a common table."""
    topic = "CASE " + " ".join(f"WHEN contains(coalesce(text, ''), '{part}') THEN '{name}'" for name, part in TOPICS) + " ELSE 'prose' END"
    parts = [f"d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')), 0) AS tokens FROM documents)"]
    parts.append("c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL)")
    for k in DIMENSIONS:
        parts.append(f"t_{k} AS (SELECT {k}, pow(t, {TEMPER}) / sum(pow(t, {TEMPER})) OVER () AS share FROM (SELECT {k}, sum(tokens) AS t FROM c GROUP BY 1) WHERE t > 0)")
    parts.append("w0 AS (SELECT *, tokens AS weight, sum(tokens) OVER () AS total FROM c)")
    n = 0
    for _ in range(SWEEPS):
        for k in DIMENSIONS:
            parts.append(f"w{n + 1} AS (SELECT source, lang, topic, tokens, total, CASE WHEN sum(weight) OVER (PARTITION BY {k}) > 0 THEN weight * coalesce(share, 0) * total / sum(weight) OVER (PARTITION BY {k}) ELSE 0 END AS weight FROM w{n} LEFT JOIN t_{k} USING ({k}))")
            n += 1
    parts.append(f"r AS (SELECT d.*, CASE WHEN w.tokens > 0 THEN w.weight / w.tokens ELSE 0 END AS rate, ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::UBIGINT / 4294967296.0 AS draw FROM d JOIN w{n} w USING (source, lang, topic))")
    parts.append(f"q AS (SELECT *, CASE WHEN tokens > 0 THEN rate * {KEEP} ELSE 0 END AS p FROM r)")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(tokens * rate, 6) AS weight, round(p, 9) AS probability, (floor(p) + CASE WHEN draw < p - floor(p) THEN 1 ELSE 0 END)::INT AS copies FROM q"


OP3_SQL = _sql()
