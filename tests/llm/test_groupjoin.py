import random
import zlib

import duckdb
import numpy as np
import pytest
from brute import near_duplicates as brute
from fluence.llm import groupjoin
from fluence.llm.groupjoin import OP13_SQL, _pairs_of, frequent_slots, op13_group_jaccard_join, similar_documents, unions
from fluence.llm.shared import mix

SCHEMA = "doc_id long, text string, tokens string, component int, grp int"


def run(spark, rows, least=80):
    out = similar_documents(spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA).repartition(5), least_percent=least).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=lambda r: (r[0] is None, *map(str, r)))


def same(spark, rows, least=80):
    want = sorted(brute(rows, least), key=lambda r: (r[0] is None, *map(str, r)))
    assert run(spark, rows, least) == want
    return sum(d != c for d, _, c in want)


def family(seed, n, words=60, edits=3, kinds=500):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(kinds)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n - 1):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"z{rng.randrange(500)}"
        out.append(" ".join(w))
    return out


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in op13_group_jaccard_join(spark, sf).collect())
    assert got == sorted(con.execute(OP13_SQL).fetchall())


@pytest.fixture
def tight(monkeypatch):
    """Small groups and lots, few slots: groups of a component split, frequent tokens exist, a token's rows are paired in parts."""
    monkeypatch.setattr(groupjoin, "GROUP_DOCS", 3)
    monkeypatch.setattr(groupjoin, "PAIR_ROWS", 5)
    monkeypatch.setattr(groupjoin, "SLOT_BITS", (8, 9))
    monkeypatch.setattr(groupjoin, "BINS", 2)


def test_families_and_a_common_passage(spark, tight):
    """Families of all distances and texts that share a long passage and little else."""
    rng = random.Random(3)
    texts = [t for s in range(8) for t in family(s, 12, edits=s)]
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"q{rng.randrange(900)}" for _ in range(k)) for k in [2, 4, 6, 8, 12, 20, 40] * 6]
    texts += ["", None, "one", "One", "one two", "one two three four five", "one  two\tthree four FIVE", " \n ", "ä ö ü ß"]
    rng.shuffle(texts)
    assert same(spark, list(enumerate(texts))) > 60


def test_links_at_the_threshold(spark, tight):
    """Sets of which exactly 80 % (4 of 5, 8 of 10, 20 of 25) and just less are shared; every length from one word on."""
    rows = []
    for k, (n, extra) in enumerate([(4, 1), (8, 2), (20, 5), (20, 6), (3, 1), (36, 9), (36, 10), (1, 0), (40, 10)]):
        words = [f"t{k}_{i}" for i in range(n + 4 + extra)]
        rows += [(2 * k, " ".join(words[: n + 4])), (2 * k + 1, " ".join(words))]
    assert same(spark, rows) == 6  # 4 of 5, 8 of 10, 20 of 25, 36 of 45, 40 of 50, and a copy
    rng = random.Random(4)
    grown = [" ".join(f"g{i}" for i in range(rng.randrange(1, 70))) for _ in range(120)]
    assert same(spark, list(enumerate(grown)), 80) > 50
    same(spark, list(enumerate(grown)), 60)


def test_few_kinds_of_words(spark, tight):
    """Random texts over few words share tokens by chance at every similarity."""
    rng = random.Random(9)
    rows = []
    for i in range(250):
        w = [rng.choice("ab") for _ in range(rng.randrange(3, 40))]
        rows.append((i, " ".join(w)))
    assert same(spark, rows) > 10


def test_edge_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (5, "a b c d e f"), (9, None), (10, ""), (11, None)]
    got = run(spark, rows)
    assert got == [(10, 0, 10), (11, 0, 11), (5, 2, 5), (7, 2, 5), (7, 2, 5), (9, 0, 9), (None, 2, None)]
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]
    long = " ".join(f"w{i}" for i in range(100_000))
    assert run(spark, [(3, long), (1, long + " end"), (2, "other " * 100_000), (2, "other " * 100_000)]) == [(1, 99_997, 1), (2, 1, 2), (2, 1, 2), (3, 99_996, 1)]


def test_frequent_slots_count_all_texts(spark):
    """A passage of all texts is found, a text's own words are not."""
    texts = [" ".join(f"p{i}" for i in range(30)) + " " + " ".join(f"u{k}_{i}" for i in range(100)) for k in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    found = frequent_slots(df, 300 * 126)
    own = groupjoin.shingle_hashes(*_flat(texts[0]))[0][0]
    late = found[(own & np.uint64(len(found) - 1)).astype(np.int64)]
    assert 26 <= late.sum() <= 60


def _flat(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_unions_and_pairs(spark, monkeypatch):
    """Unions of signatures hold every document's tokens, whatever their widths; pairs are all that fit, in any lots."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(groupjoin, "NARROW", 15)
    sets = [np.unique(mix(rng.integers(0, 50, 20).astype(np.uint64)))[: 10 + i] for i in range(30)]
    signs = [groupjoin.signature(s) for s in sets]
    assert {s.itemsize for s in signs} == {2, 4}
    df = spark.createDataFrame([(i % 4, (s.itemsize, bytearray(s.tobytes()))) for i, s in enumerate(signs)], "grp long, tokens struct<width: int, bits: binary>").repartition(3)
    got = {r.node: groupjoin._signature_of(bytes(r.tokens.bits), r.tokens.width) for r in unions(df).collect()}
    bound = groupjoin._Bound(100)
    assert all(bound.links(got[i % 4], s) for i, s in enumerate(signs))
    assert not bound.links(got[0], groupjoin.signature(mix(np.arange(1000, 1020, dtype=np.uint64))))
    monkeypatch.setattr(groupjoin, "PAIR_ROWS", 3)
    token = np.sort(rng.integers(0, 12, 60))
    component, low = rng.integers(0, 5, 60), rng.integers(5, 30, 60)
    columns = [token, np.arange(60), component, low, low + rng.integers(0, 5, 60), np.zeros(60, np.int64)]
    pairs = sorted((int(min(a, b)), int(max(a, b))) for i, j in _pairs_of(columns, 80) for a, b in zip(i, j, strict=True))
    high = columns[4]
    want = sorted((a, b) for a in range(60) for b in range(a + 1, 60) if token[a] == token[b] and component[a] != component[b] and 100 * high[a] >= 80 * low[b] and 100 * high[b] >= 80 * low[a])
    assert pairs == want


def test_slot_counts_take_little_room():
    """Counts of eight bytes were compressed as they stood; they made the shuffle grow faster than its input."""
    rng = np.random.default_rng(3)
    counts = np.bincount(rng.integers(0, groupjoin.CHUNK, groupjoin.CHUNK // 4), minlength=groupjoin.CHUNK).astype(np.uint32)
    counts[5], counts[6] = 2**32 - 1, 70_000
    raw = groupjoin._squeezed(counts)
    assert np.array_equal(groupjoin._spread(raw), counts)
    assert len(raw) < 0.5 * len(zlib.compress(counts.astype("<u8").tobytes(), 1))
