"""Each stage on its own input against a plain version."""

import re

import corpus_pipeline as cp
from brute import contamination, near_duplicates, secrets as brute_secrets
from fluence.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = docs.collect()
    kept = [r.asDict() for r in cp.reject_low_quality(spark, docs, SF).collect()]
    scores = {r.doc_id: r._score for r in quality.scores(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet")), name="_score").collect()}
    assert {r["doc_id"] for r in kept} == {d for d, s in scores.items() if s >= 0.5} and 0 < len(kept) < len(seen)

    one = spark.createDataFrame(kept, docs.schema)
    after = [r.asDict() for r in cp.drop_near_duplicates(spark, one, SF).collect()]
    want = {d for d, _, c in near_duplicates([(r["doc_id"], r["text"]) for r in kept]) if d == c}
    assert {r["doc_id"] for r in after} == want and len(after) == len(want)

    two = spark.createDataFrame(after, docs.schema)
    cleaned = {r.doc_id: r for r in cp.remove_benchmark(spark, two, SF).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = contamination([(r["doc_id"], r["text"]) for r in after], items)
    for r in after:
        n, hit, _ = hits[r["doc_id"]]
        if len(hit) > 0.5 * n:
            assert r["doc_id"] not in cleaned
        elif not hit:
            assert cleaned[r["doc_id"]].text == r["text"] and cleaned[r["doc_id"]].n_chars == r["n_chars"]
        else:
            assert len(cleaned[r["doc_id"]].text) < len(r["text"])

    three = spark.createDataFrame(list(cleaned.values()), docs.schema)
    redacted = {r.doc_id: r for r in cp.redact_secrets(spark, three, SF).collect()}
    assert set(redacted) == set(cleaned)
    for d, r in redacted.items():
        assert not brute_secrets(r.text)
        if not brute_secrets(cleaned[d].text) and "[SECRET]" not in r.text:
            assert r.text == cleaned[d].text

    four = spark.createDataFrame(list(redacted.values()), docs.schema)
    mixed = cp.mix_sources(spark, four, SF)
    assert set(columns) < set(mixed.columns) and 0 < mixed.count() < len(redacted)
    assert re.fullmatch(r"\d+", str(mixed.first().mix_copies))


def test_repeated_ids_leave_one_row(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x"), (None, "y"), (3, "A b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in cp.drop_near_duplicates(spark, docs, SF).collect()) == [0, 1, 2]


def test_of_a_repeated_id_the_smallest_text_stays(spark):
    rows = [(1, "zz top", 5), (1, "b a", 7), (1, "b a", 6), (2, "other", 1), (2, None, 2), (None, "q", 1), (None, "q", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    for parts in (1, 5):
        got = cp.drop_near_duplicates(spark, docs.repartition(parts), SF).collect()
        assert sorted((r.doc_id or 0, r.text or "", r.n) for r in got) == [(0, "q", 1), (0, "q", 1), (1, "b a", 6), (2, "", 2)]


EDGES = [
    (1, None, "en", None, 3, "a", 0.1, 1),
    (2, "", None, "web", None, None, None, None),
    (None, "a text without an id " * 9, "en", "web", 9, "b", 0.2, 2),
    (3, "long words stand here " * 60_000, "en", "web", 9, "c", 0.3, 3),
    (4, "token = 0123456789abcdef00 and a line of ordinary words", "en", "web", 9, "d", 0.4, 4),
    (4, "token = 0123456789abcdef00 and a line of ordinary words", "en", "web", 9, "d", 0.4, 4),
]
CLASHES = "doc_id long, text string, lang string, source string, n_chars long, row string, _score double, mix_copies int"


def test_edge_rows_clashing_columns_and_empty_tables_pass_every_stage(spark):
    for rows in (EDGES, []):
        for k, (name, stage) in enumerate(cp.STAGES):
            docs = spark.createDataFrame(rows, CLASHES)
            out = stage(spark, docs, SF)
            got = out.collect()
            assert len(got) <= len(rows)
            if k < len(cp.STAGES) - 1:
                assert out.columns == docs.columns, name
            else:
                assert out.columns == [c for c in docs.columns if c != "mix_copies"] + ["mix_copies", "mix_probability"]
            if name == "secret scan":
                assert len(got) == len(rows) and all("0123456789abcdef" not in (r.text or "") for r in got)
