import duckdb
import pytest
from fluence.llm import mixing
from pyspark.sql import functions as F


def docs(spark, n=600):
    rows = [(i, ("word " * (1 + i % 9)) + ("| x" if i % 4 == 0 else ""), ["en", "fr", None][i % 3], "big" if i % 5 else "small", 0.5) for i in range(n)] + [(None, None, None, None, 0.1), (n, "", "en", "big", 0.1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight double")


def test_marginals_have_their_targets(spark):
    out = mixing.mix(docs(spark), sweeps=24)
    total = out.agg(F.sum("weight")).first()[0]
    for d in mixing.DIMENSIONS:
        cells = out.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
        want = {r.level: r.share for r in mixing.tempered(cells, d).collect()}
        got = {r[d]: r.w / total for r in out.groupBy(d).agg(F.sum("weight").alias("w")).collect()}
        assert all(got[k] == pytest.approx(v, abs=1e-4) for k, v in want.items())


def test_given_targets_and_sample_size(spark):
    t = spark.createDataFrame([("big", 0.5), ("small", 0.5)], "level string, share double")
    rows = mixing.mix(docs(spark, 4000), {"source": t}, keep=0.4).select("source", "tokens", "weight", "copies", "probability").collect()
    drawn = {s: sum(r.copies * r.tokens for r in rows if r.source == s) for s in ("big", "small")}
    total = sum(r.tokens for r in rows)
    assert drawn["big"] / total == pytest.approx(0.2, abs=0.02) and drawn["small"] / total == pytest.approx(0.2, abs=0.02)
    assert all(r.weight == 0 and r.copies == 0 for r in rows if not r.source)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    cols = ["doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "copies"]
    got = sorted(tuple(r) for r in mixing.op3_mix_to_targets(spark, sf).select(cols).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(f"select {','.join(cols)} from ({mixing.OP3_SQL})").fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[7] == b[7] and a[5] == pytest.approx(b[5], abs=2e-6) and a[6] == pytest.approx(b[6], abs=2e-9)


def test_empty_table(spark):
    assert mixing.mix(docs(spark).limit(0)).collect() == []
