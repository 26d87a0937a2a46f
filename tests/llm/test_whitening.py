import math

import numpy as np
import pytest
from fluence.llm import whitening
from fluence.llm.whitening import op11_embedding_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, x string, idx int"


def plain(rows, most=4):
    """{(vec_id, component): (n, deviation, whitened, explained)} for rows with all entries finite."""
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in xs}), np.int64)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    out = []
    for i, x in xs:
        dev = sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True))
        for k in range(min(most, len(e))):
            j = len(e) - 1 - k
            out.append((i, k + 1, n, dev, abs(float((np.array(x) - s / n) @ v[:, j]) / math.sqrt(e[j])), e[j] / e.sum()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def found(df):
    rows = [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))


def same(got, want):
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-8, atol=1e-9)


def test_whole_table(spark):
    """All rows of the 0.01 scale against numpy; one sign a component; the covariance of the whitened fit list is the identity."""
    out = op11_embedding_whitening(spark, "/root/testdata/sf0.01").cache()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    same(found(out), plain(rows))
    assert out.select("identity_error").distinct().count() == 1 and out.first().identity_error < 1e-9
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]


def random_rows(seed, n, d):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) * np.linspace(1, 3, d)
    return [(i, base[i % (n - 5)].tolist()) for i in range(n)]


def test_edge_rows(spark, monkeypatch):
    """Nulls, non-finite entries, empty and shorter vectors go; repeated rows and null ids stay; clashing columns do no harm."""
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 5 * 7)  # seven rows a block, several blocks a task
    rows = random_rows(1, 60, 5)
    rows += [(None, rows[0][1]), (3, rows[3][1]), (100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "a", 7) for i, v in rows], SCHEMA)
    want = plain([(i, v) for i, v in rows if i != 105])
    got = found(whiten(df))
    assert len(got) == 62 * 4
    same(got, want)


def test_few_vectors_and_empty_table(spark):
    make = lambda rows: whiten(spark.createDataFrame([(i, v, "a", 7) for i, v in rows], SCHEMA))
    assert make([]).collect() == []
    assert make([(1, [0.5, 0.25]), (2, [0.5, 0.25])]).collect() == []  # one distinct vector has no spread
    line = make([(1, [0.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0]), (2, [1.0, 0.0, 1.0])]).collect()  # rank 1: one component
    assert sorted((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in line) == [(1, 1, 2, 65536, 1.0, 1.0), (2, 1, 2, 65536, 1.0, 1.0), (2, 1, 2, 65536, 1.0, 1.0)]


def test_wide_vectors_and_large_numbers(spark, monkeypatch):
    """Several column blocks; sums beyond a long are exact or null."""
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    rows = random_rows(2, 40, 10)
    same(found(whiten(spark.createDataFrame([(i, v, "a", 7) for i, v in rows], SCHEMA))), plain(rows))
    huge = whiten(spark.createDataFrame([(1, [2.0**40, 0.0], "a", 7), (2, [0.0, 2.0**40], "a", 7), (3, [2.0**20, 1.0], "a", 7)], SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in huge} == {1: None, 2: None, 3: None}


@pytest.mark.parametrize("d", [1, 3])
def test_fewer_dimensions_than_components(spark, d):
    rows = random_rows(3, 30, d)
    same(found(whiten(spark.createDataFrame([(i, v, "a", 7) for i, v in rows], SCHEMA))), plain(rows))
