import random

import numpy as np
import pyarrow as pa
from brute import near_duplicates as brute
from fluence.llm import neardup
from fluence.llm.neardup import band_keys, components, estimate, may_link, near_duplicates, registers, shingle_hashes, sketches
from fluence.llm.shared import arrow_rows, mix, text_bytes

SCHEMA = "doc_id long, text string, regs string, node int"


def run(spark, rows):
    out = near_duplicates(spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None), out


def family(seed, n, words=60, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"z{rng.randrange(500)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    texts = [t for s in range(6) for t in family(s, 12)]
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"q{rng.randrange(900)}" for _ in range(40)) for _ in range(40)]
    texts += ["", None, "one", "One", "one two", "one two three four five", "one  two\tthree four FIVE", " \n ", "ä ö ü ß"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got, out = run(spark, rows)
    assert got == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_nulls_repeats_and_empty_table(spark):
    _, out = run(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (5, "a b c d e f"), (9, None)])
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (5, 5, True), (7, 5, False), (7, 5, False), (9, 9, True)]
    assert run(spark, [])[0] == []


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "leader long, member long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert set(got.values()) == {0, 500} and len(got) == 203


def test_chains_of_any_order_are_one_component(spark):
    """Ids that descend along a chain and ids in random order: the smallest must not move one edge a round."""
    rng, edges = random.Random(11), []
    for k, chain in enumerate([[0, *range(499, 0, -1)], rng.sample(range(400), 400), rng.sample(range(700), 700)]):
        chain = [1000 * k + i for i in chain]
        edges += zip(chain, chain[1:], strict=False)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "leader long, member long")).collect()}
    assert len(got) == 1600 and all(c == n // 1000 * 1000 for n, c in got.items())


def test_registers_estimate_similarity():
    a = np.sort(mix(np.arange(4000, dtype=np.uint64)))
    b = np.sort(mix(np.arange(500, 4500, dtype=np.uint64)))
    r = registers([a, b, a[:3]])
    assert abs(estimate(r[0], r[1]) - 3500 / 4500) < 0.1
    assert band_keys(r).shape == (3, 51) and len(set(r[2].tolist())) <= 3


def test_registers_do_not_depend_on_the_batch(spark):
    rows = [(i, t) for i, t in enumerate(family(1, 9))]
    one = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((r.doc_id, bytes(r.regs), r.key1) for r in sketches(one).collect()) == sorted((r.doc_id, bytes(r.regs), r.key1) for r in sketches(many).collect())


def test_all_rows_of_a_table_against_brute_force(spark):
    """No link is lost among all documents of the 0.01 scale: all components are those of plain set comparisons."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got, _ = run(spark, rows)
    assert got == brute(rows)
    assert sum(d != c for d, _, c in got) > 50


def test_a_hot_leader_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SALT_ROWS", 7)
    monkeypatch.setattr(neardup, "HOLD_SHINGLES", 500)
    texts = family(4, 150, words=80, edits=2) + family(5, 20)
    rows = list(enumerate(texts))
    assert run(spark, rows)[0] == brute(rows)


def test_very_long_and_repeated_texts(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(3, long), (1, long + " end"), (2, "other " * 100_000), (2, "other " * 100_000), (4, None)]
    assert run(spark, rows)[0] == [(1, 149_997, 1), (2, 1, 2), (2, 1, 2), (3, 149_996, 1), (4, 0, 4)]


def test_the_estimate_never_drops_a_link():
    """Of many true pairs of all sizes none is dropped; pairs far below the threshold mostly are."""
    rng, kept, gone = np.random.default_rng(5), [], []
    for n in [2, 5, 12, 40, 90, 250, 1000, 5000] * 40:
        pool = np.unique(mix(rng.integers(0, 2**63, 4 * n).astype(np.uint64)))
        rng.shuffle(pool)
        both = -(-6 * n // 7)  # of two sets of n, just enough for three quarters
        a, b = np.sort(pool[:n]), np.sort(np.r_[pool[:both], pool[n : 2 * n - both]])
        r = registers([a, b])
        kept.append(may_link(r[0], r[1], len(a), len(b), 75))
        if n >= 250:
            c = np.sort(np.r_[pool[: n // 4], pool[n : 2 * n - n // 4]])
            gone.append(not may_link(r[0], registers([c])[0], n, len(c), 75))
    assert all(kept) and np.mean(gone) > 0.99


def test_tasks_hold_small_batches_and_the_setting_comes_back(spark):
    """Batches of 10,000 rows, held by Spark and Python, took an executor's memory."""
    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    with arrow_rows(spark, neardup.BATCH_ROWS):
        rows = [r.n for r in spark.range(5000, numPartitions=1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    assert sum(rows) == 5000 and max(rows) <= 1000
    seen = []
    real = neardup.settle
    neardup.settle = lambda df: (seen.append(int(spark.conf.get(key))), real(df))[1]
    try:
        near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    finally:
        neardup.settle = real
    assert seen and set(seen) == {neardup.BATCH_ROWS} and spark.conf.get(key) == before


def test_ranks_of_rare_shingles_match_a_plain_count(spark):
    texts = {i: " ".join(f"w{k}" if k != 9 * i else "other" for k in range(3 * i, 60)) for i in range(1, 7)}
    sets, _, _ = shingle_hashes(*text_bytes(pa.array(texts.values())))
    sets = dict(zip(texts, (x.view("int64").tolist() for x in sets), strict=True))
    of = {s: [i for i in sets if s in sets[i]] for x in sets.values() for s in x}
    want = set()
    for i, x in sets.items():
        shared = sorted((len(of[s]), s) for s in x if len(of[s]) > 1)
        for place, (_, s) in enumerate(shared):
            rank = len(x) - len(shared) + place
            if rank <= len(x) - -(-75 * len(x) // 100):
                want.add((s, i, i, len(x), rank))
    labelled = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "node long, component long, text string")
    assert want and {tuple(r) for r in neardup._rare(labelled, 75).collect()} == want
