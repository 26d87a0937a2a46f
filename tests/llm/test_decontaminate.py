import random

from brute import contamination
from fluence.llm import decontaminate as de


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")


def cases(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 10, 11, 30])))) for i in range(12)] + [(50, None), (51, ""), (52, "W1, w2! W3")]
    docs = []
    for i in range(120):
        w = [rng.choice([*words, "other", "é"]) for _ in range(rng.randrange(50))]
        if rng.random() < 0.6:
            at = rng.randrange(len(w) + 1)
            it = de.item_words(rng.choice(items)[1])
            w[at:at] = [x.decode() for x in it][rng.randrange(3) :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    return docs + [(900, None), (901, ""), (902, "?!")], items


def check(spark, docs, items):
    want = contamination(docs, items)
    a, b = frames(spark, docs, items)
    for r in de.matches(a, b).collect():
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, set(r["items"])) == (n, len(hit), found)
        assert {i for s in r.spans for i in range(s["first"], s["last"])} == hit


def test_against_brute_force(spark):
    check(spark, *cases())


def test_several_automata(spark, monkeypatch):
    monkeypatch.setattr(de, "AUTOMATON_BYTES", 150)
    check(spark, *cases(5))


def test_only_long_items(spark):
    docs, items = cases(7)
    check(spark, docs, [x for x in items if x[1] and len(x[1].split()) >= 10])


def test_clean_cuts_spans_and_drops_what_is_mostly_benchmark(spark):
    passage = " ".join(f"b{i}" for i in range(12))
    own = " ".join(f"o{i}" for i in range(30))
    a, b = frames(spark, [(1, f"Ä {own} {passage.upper()} end"), (2, passage), (3, own), (4, None)], [(1, passage)])
    got = {r.doc_id: r for r in de.clean(a, b).collect()}
    assert set(got) == {1, 3, 4} and got[1].text == f"Ä {own}  end" and got[3].text == own and got[4].text is None and got[1]["items"] == "x"


def test_clean_is_the_same_with_several_automata(spark, monkeypatch):
    docs, items = cases(5)
    parts = [[f"{p}{i}" for i in range(15)] for p in "abcdef"]
    items += [(60 + k, " ".join(x)) for k, x in enumerate(parts)]
    own = [f"o{i}" for i in range(40)]
    # 60 of 100 words from two items at a time: each alone, and what is left after the other, is under half
    docs += [(1000 + k, " ".join(own + x + x + y + y)) for k, (x, y) in enumerate((x, y) for x in parts for y in parts if x < y)]
    # windows of an item that overlap another item's span
    long = [f"m{i}" for i in range(40)]
    items += [(70 + k, " ".join(long[5 * k : 5 * k + 10])) for k in range(7)]
    docs += [(2000, " ".join(own + long)), (2001, " ".join(own + long[:15]))]
    a, b = frames(spark, docs, items)
    want = sorted(tuple(r) for r in de.clean(a, b).collect())
    hits = contamination(docs, items)
    assert {r[0] for r in want} == {d for d, (n, hit, _) in hits.items() if len(hit) <= 0.5 * n}
    monkeypatch.setattr(de, "AUTOMATON_BYTES", 150)
    assert len(list(de._shards(b, "item_id", "text"))) > 3
    assert sorted(tuple(r) for r in de.clean(a, b).collect()) == want


def test_an_automaton_is_small():
    """A megabyte of items, a third of them with a common beginning: under 60 MB, so 8 MB of items stay far below 500."""
    import tracemalloc

    rng = random.Random(1)
    vocabulary = [f"w{rng.randrange(10**6)}".encode() for _ in range(20_000)]
    common, items = [rng.choice(vocabulary) for _ in range(60)], []
    for i in range(1200):
        items.append((str(i), (common if i % 3 == 0 else []) + [vocabulary[int(20_000 * rng.random() ** 3)] for _ in range(120)]))
    tracemalloc.start()
    automaton = de.SuffixAutomaton(items)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 60e6, peak
    hit, found = automaton.scan(common)
    assert hit.all() and found == {str(i) for i in range(0, 1200, 3)}


def test_a_very_long_text(spark):
    passage = " ".join(f"b{i}" for i in range(12))
    a, b = frames(spark, [(1, "other words " * 200_000 + passage), (2, None)], [(1, passage)])
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in de.matches(a, b).collect()) == [(1, 400_012, 12), (2, 0, 0)]


def test_empty_tables(spark):
    a, b = frames(spark, [], [])
    assert de.matches(a, b).collect() == []
    a, b = frames(spark, [(1, "a b")], [])
    assert [(r.n_words, r.n_hit) for r in de.matches(a, b).collect()] == [(2, 0)]
