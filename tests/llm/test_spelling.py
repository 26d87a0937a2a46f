import random
import re
import zlib
from collections import Counter

import duckdb
from fluence.llm import spelling
from fluence.llm.spelling import OP12_SQL, neighbours, op12_spelling_variants, roots, variants, word_counts

SCHEMA = "doc_id long, text string, word string, n int, key int"


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, least_length=7, least_count=2, ratio=10, damage=31):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}
    form, size = {}, {}
    for w, n in words.items():
        by = sorted((-words[v], v) for v in words if near(w, v))
        size[w] = len(by)
        if by and -by[0][0] >= ratio * n:
            form[w] = by[0][1]
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, size[w], words.get(form.get(w))))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = sorted(tuple(r) for r in op12_spelling_variants(spark, sf).collect())
    assert got == sorted(con.execute(OP12_SQL).fetchall())
    assert sum(r[4] > 0 for r in got) > 100


def test_against_brute_force(spark, monkeypatch):
    """Few letters, so that all kinds of edits, runs of one letter and groups of many words occur; lots of a few words."""
    monkeypatch.setattr(spelling, "HOLD_WORDS", 50)
    rng = random.Random(5)
    pool = ["".join(rng.choice("abÄß") for _ in range(rng.randrange(7, 10))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(pool, weights=[1 + (k % 37 == 0) * 60 for k in range(300)], k=60)).title()) for i in range(80)]
    rows += [(None, pool[0]), (3, None), (3, ""), (4, "1234 - !"), (5, rows[5][1]), (5, rows[5][1]), (6, "Straßenbahn" * 3 + "_" + "Größenwahn×÷")]
    got = sorted(tuple(r) for r in variants(table(spark, rows).repartition(7), damage=31).collect())
    want = plain(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 5


def test_neighbours_of_every_edit(spark):
    words = [("aabbaab", 5), ("aabbaabb", 4), ("abbaab", 9), ("aabbab", 9), ("xabbaab", 7), ("aabbaax", 7), ("aaabbaab", 1), ("zzzzzzz", 3), ("zzzzzzzz", 3)]
    got = {r.word: (r.n_near, r.near, r.near_n) for r in neighbours(spark.createDataFrame(words, "word string, n long")).collect()}
    for w, _ in words:
        by = sorted((-n, v) for v, n in words if near(w, v))
        assert got.get(w) == ((len(by), by[0][1], -by[0][0]) if by else None)


def test_long_words(spark, monkeypatch):
    """Words beyond LONG letters by fingerprints: all edits, also between words of LONG letters and of one more."""
    monkeypatch.setattr(spelling, "LONG", 9)
    rng = random.Random(8)
    pool = {"".join(rng.choice("ab") for _ in range(rng.randrange(7, 13))) for _ in range(400)} | {"ab" * 400, "ab" * 400 + "a", "ab" * 399 + "aa"}
    words = [(w, rng.randrange(1, 5)) for w in sorted(pool)]
    got = {r.word: (r.n_near, r.near, r.near_n) for r in neighbours(spark.createDataFrame(words, "word string, n long").repartition(5)).collect()}
    for w, _ in words:
        by = sorted((-n, v) for v, n in words if near(w, v))
        assert got.get(w) == ((len(by), by[0][1], -by[0][0]) if by else None)


def test_roots_of_long_chains(spark):
    chain = [f"w{i:02}" for i in range(20)]
    pairs = list(zip(chain, chain[1:], strict=False)) + [("a", "b"), ("c", "b")]
    got = dict(tuple(r) for r in roots(spark.createDataFrame(pairs, "word string, form string")).collect())
    assert got == {w: "w19" for w in chain[:-1]} | {"a": "b", "c": "b"}
    assert roots(spark.createDataFrame([], "word string, form string")).collect() == []


def test_forms_follow_counts(spark):
    """A slip of a slip leads to the root; of two forms of one size the first in order counts."""
    text = " ".join(["wordings"] * 300 + ["wordingz"] * 25 + ["wordingzz"] * 2 + ["abcdefgh", "abcdefgi"] * 20 + ["abcdefg"] * 2)
    got = {r.word: (r.form, r.root) for r in variants(table(spark, [(1, text)])).collect()}
    assert got["wordingzz"] == ("wordingz", "wordings") and got["wordingz"] == ("wordings", "wordings") and got["wordings"] == (None, "wordings")
    assert got["abcdefg"] == ("abcdefgh", "abcdefgh")


def test_long_texts_and_empty_tables(spark):
    assert variants(table(spark, [])).collect() == []
    assert variants(table(spark, [(1, None), (None, "")])).collect() == []
    long = "Abcdefgh " * 300_000 + "y" * 100_000
    got = {r.word: r.n for r in word_counts(table(spark, [(1, long), (1, long)])).collect()}
    assert got == {"abcdefgh": 600_000, "y" * 100_000: 2}
    assert sorted(r.n_near for r in variants(table(spark, [(1, long), (1, long), (2, "y" * 99_999), (2, "y" * 99_999)])).collect()) == [0, 1, 1]
