"""Quality and toxicity: held-out accuracy, edge cases, and what the parts must do."""

import random
import re
import zlib

import numpy as np
import pytest
from fluence.llm import quality, toxicity
from fluence.llm.shared import word_hashes

SF = "/root/testdata/sf0.1"


def accuracy(spark, out, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    right = {v: np.mean([r.predicted == v for r in rows if r[label] == v]) for v in (0, 1)}
    assert len(rows) > 500 and min(right.values()) > least, right


def test_quality_on_held_out_labels(spark):
    accuracy(spark, quality.op10_quality(spark, SF), "quality", 0.95)


def test_toxicity_on_held_out_labels(spark):
    accuracy(spark, toxicity.op7_toxicity(spark, SF), "toxic", 0.9)  # some labelled texts hold no sign of it


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(0)
    bags, y = [], []
    for i in range(300):
        x = rng.normal(size=(rng.integers(2, 8), quality.WIDTH)).astype(np.float32)
        y.append(i % 2)
        if i % 2:
            x[rng.integers(len(x)), 3] += 6
        bags.append(x)
    begin = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    model = quality.fit(np.concatenate(bags), begin, np.array(y, np.float32))
    p, kept = quality.forward(np.concatenate(bags), begin, model)
    assert np.mean((p > 0.5) == np.array(y)) > 0.95


def test_gradients():
    rng = np.random.default_rng(1)
    x, begin, y = rng.normal(size=(9, quality.WIDTH)).astype(np.float64), np.array([0, 4, 9]), np.array([1.0, 0.0])
    model = quality.fit(x.astype(np.float32), begin, np.array([1.0, 1.0], np.float32))
    model["c"] = rng.normal(size=quality.HIDDEN)
    loss = lambda m: -np.mean(y * np.log(quality.forward(x, begin, m)[0]) + (1 - y) * np.log(1 - quality.forward(x, begin, m)[0]))
    p, kept = quality.forward(x, begin, model)
    g = quality._gradients(begin, model, p, y, np.ones(2), kept)
    for name, at in (("w", (2, 3)), ("v", (1, 2)), ("u", (3, 1)), ("a", (2,)), ("c", (4,)), ("b", (5,))):
        up, down = {**model, name: model[name].astype(float).copy()}, {**model, name: model[name].astype(float).copy()}
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        assert (loss(up) - loss(down)) / 2e-4 == pytest.approx(g[name][at], abs=2e-4)


def test_encoding_does_not_depend_on_neighbours():
    texts = [b"", b"one two", "é".encode() * 70, b"A b! " * 100, b"  \n", b"x"]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together, begin = quality.encode(np.frombuffer(b"".join(texts), np.uint8), off)
    for k, t in enumerate(texts):
        alone, _ = quality.encode(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.array_equal(together[begin[k] : begin[k + 1]], alone)


def plain_passages(text):
    """What encode gives, a passage at a time with plain Python."""
    raw = text.encode()
    spots = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    words = [raw[a:b].lower() for a, b in spots]
    out = []
    for first in range(0, max(1, len(words)), quality.PASSAGE_WORDS):
        mine = range(first, min(first + quality.PASSAGE_WORDS, len(words)))
        begin = spots[first][0] if first else 0
        end = spots[first + quality.PASSAGE_WORDS][0] if first + quality.PASSAGE_WORDS < len(words) else len(raw)
        x = np.zeros(quality.WIDTH)
        for b in raw[begin:end]:
            kind = next((k for k, m in enumerate(quality.CLASSES) if chr(b) in m), len(quality.CLASSES)) if b < 128 else len(quality.CLASSES) + 1
            x[kind] += 1 / (end - begin)
        for i in mine:
            h = int(word_hashes(np.frombuffer(words[i], np.uint8), np.array([0]), np.array([len(words[i])]))[0])
            x[quality.N_CLASSES + h % quality.BUCKETS] += 1 / len(mine)
            x[-3] += (words[i] in words[max(0, i - 8) : i]) / len(mine)
            x[-2] += min(len(words[i]), 40) / len(mine) / 10
        x[-1] = len(mine) / quality.PASSAGE_WORDS
        out.append(x)
    return np.array(out)


TEXTS = ["", None, "one two one", "é " * 200, "A b! c\n" * 90, "  \n", "x", "one two one", "word " * 61 + "end", "tab\tsep | $5 <a>"]


def test_quality_against_plain_passages(spark):
    """Encoding, attention and score of each text alone, by formulas; and texts in one batch or in many."""
    rng = np.random.default_rng(3)
    shapes = {"w": (quality.WIDTH, quality.HIDDEN), "b": (quality.HIDDEN,), "v": (quality.HIDDEN, quality.GATE), "u": (quality.HIDDEN, quality.GATE), "a": (quality.GATE,), "c": (quality.HIDDEN,), "d": (), "mean": (quality.WIDTH,)}
    p = {k: rng.normal(size=s) / 3 for k, s in shapes.items()} | {"dev": np.full(quality.WIDTH, 0.3)}
    want = []
    for t in TEXTS:
        e, hidden = [], []
        for x in plain_passages(t or ""):
            h = np.tanh((x - p["mean"]) / p["dev"] @ p["w"] + p["b"])
            e.append(np.exp(np.tanh(h @ p["v"]) / (1 + np.exp(-h @ p["u"])) @ p["a"]))
            hidden.append(h)
        z = sum(a * h for a, h in zip(e, hidden, strict=True)) / sum(e)
        want.append(1 / (1 + np.exp(-(z @ p["c"] + p["d"]))))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for parts in (1, 7):
        got = {r.doc_id: r.score for r in quality.scores(docs.repartition(parts), p).collect()}
        assert np.allclose([got[i] for i in range(len(TEXTS))], want, atol=1e-5) and got[2] == got[7]


def test_scores_depend_on_the_text_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.train(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    one = {r.doc_id: (r.text, r.score) for r in quality.scores(docs.repartition(1).sort("text"), model).collect()}
    two = {r.doc_id: r.score for r in quality.scores(docs.repartition(13), model).collect()}
    assert {d: s for d, (_, s) in one.items()} == two
    by_text = {}
    for t, s in one.values():
        assert by_text.setdefault(t, s) == s


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c")]])
def test_edges(spark, rows):
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    for out in (quality.scores(docs, quality.train(docs, labels)), toxicity.scores(docs, toxicity.train(docs, labels))):
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def test_automaton_against_plain_edit_distance():
    import random

    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abc") for _ in range(n))
    words, stems = {make(rng.randrange(4, 8)): rng.randrange(3) for _ in range(20)}, {make(rng.randrange(4, 7)): rng.randrange(2) for _ in range(8)}
    auto = toxicity.LexiconAutomaton(words, stems)
    for _ in range(3000):
        w = make(rng.randrange(0, 10))
        whole = min([d for t, k in words.items() if (d := plain_distance(t, w)[-1]) <= k], default=9)
        head = min([d for t, k in stems.items() if w and (d := min(plain_distance(t, w[:-1]))) <= k], default=9)
        assert auto.match(w) == (whole, head)


def test_quotation_counts_less_than_abuse():
    f = toxicity.Finder(toxicity.SEED_TERMS, [], set())
    direct, quoted = f.features(b"you are an idiot and you know it"), f.features(b'the report said the word "idiot" was quoted there')
    assert direct[0] > quoted[0] and quoted[4] > direct[4]
    assert f.features(b"such an idoit, such an idiott")[2] > 0 and not f.features(b"nothing here").any()


def near(term, word, edits, stem):
    """Edits from term to word, or for a stem to a beginning of it that is shorter than it; 9 if above `edits`."""
    row = plain_distance(term, word[:-1] if stem else word)
    d = min(row) if stem else row[-1]
    return d if d <= edits and (word or not stem) else 9


def plain_toxicity(docs, labels):
    """op7's scores by plain loops: term tests over all labelled documents, distances to every term, features, weights."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    find = lambda t: list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)))
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    train = [(d, t, labels[d]) for d, t in docs if d in labels and not held(d)]
    terms = {}
    for d, t, y in train:
        for w in {m[0] for m in find(t)}:
            for x in {w + "$", *(w[:k] for k in range(3, 9) if k < len(w))}:
                terms.setdefault(x, ({}, {}))[y][d] = 1
    n_toxic = sum(y for *_, y in train)
    rate, least, good = n_toxic / len(train), np.log(len(terms)) + 2, []
    for x, (clean, toxic) in terms.items():
        a, b = len(toxic), len(clean)
        if a >= 3 and a >= 0.5 * (a + b):
            gain = a * np.log(a / (a + b) / rate) + (b * np.log(b / (a + b) / (1 - rate)) if b else 0)
            if gain >= least:
                good.append((-gain, -len(x), x))
    chosen = []
    for *_, x in sorted(good):
        if not any(x.startswith(c) or c.startswith(x) for c in chosen):
            chosen.append(x)
    words = {x[:-1] for x in chosen if x.endswith("$")} | set(toxicity.SEED_TERMS)
    stems = {x for x in chosen if not x.endswith("$")}

    def edits(w):
        return min((near(t, w, int(len(t) >= 5), False) for t in words), default=9), min((near(t, w, int(len(t) >= 6), True) for t in stems), default=9)

    every = {m[0] for _, t in docs for m in find(t)}
    known = {w: edits(w) for w in every}
    clean_words = {x[:-1] for x, (c, t) in terms.items() if x.endswith("$") and len(c) > len(t) and min(known[x[:-1]]) == 1}

    def features(t):
        t, x, total, spots = t or "", np.zeros(10), 0, find(t)
        for i, m in enumerate(spots):
            a, b = known[m[0]]
            k = 1 if a == 0 else 2 if b == 0 else 0 if m[0] in clean_words else 3 if a == 1 else 4 if b == 1 else 0
            if k:
                around = [o[0] for o in spots[max(0, i - 6) : i] + spots[i + 1 : i + 7]]
                marks = (m.start() > 0 and t[m.start() - 1] in toxicity.QUOTES) + (m.end() < len(t) and t[m.end()] in toxicity.QUOTES)
                q = min(1, marks / 2 + sum(w in toxicity.QUOTING for w in around) / 4) * (0.5 if set(around) & toxicity.ADDRESS else 1)
                x[k - 1] += 1 - q
                x[4 if k <= 2 else 5] += q
                total += 1
        if total:
            x[6], x[9] = np.log1p(100 * total / len(spots)), np.log1p(100 * x[1] / len(spots))
            x[7], x[8] = x[0] + x[1] + x[4] > 0, x[2] + x[3] + x[5] > 0
            x[:6] = np.log1p(x[:6])
        return x

    rows = sorted(((d, list(features(t)), y) for d, t, y in train), key=lambda r: r[:2])
    w = toxicity.fit(np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float))
    return {d: 1 / (1 + np.exp(-(np.r_[features(t), 1.0] @ w))) for d, t in docs}


def test_toxicity_against_plain_loops(spark):
    rng = random.Random(2)
    neutral = [f"{a}{b}ing" for a in ("walk", "talk", "sing", "read", "grow", "plant") for b in ("", "er", "s", "ab", "ol")]
    bad = ["grumblar", "snorkite", "vilething", "blargo", "idiot"]
    docs, labels = [], {}
    for d in range(240):
        w, y = [rng.choice(neutral) for _ in range(rng.randrange(5, 40))], int(rng.random() < 0.35)
        for _ in range(rng.randrange(1, 4) if y else 0):
            term = rng.choice(bad)
            i = rng.randrange(len(term))
            w.insert(rng.randrange(len(w)), rng.choice([term, term.title() + "s", f'"{term}" said', "you " + term, term[:i] + "x" + term[i + 1 :]]))
        docs.append((d, " ".join(w) + rng.choice([".", "", " é!"])))
        if d % 5:
            labels[d] = y
    docs += [(900, ""), (901, None), (902, docs[3][1])]
    a = spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, score double").repartition(5)
    b = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.scores(a, toxicity.train(a, b)).collect()}
    want = plain_toxicity(docs, labels)
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-6
    assert got[902] == got[3]
    right = [(got[d] >= 0.7) == labels[d] for d in labels]
    assert np.mean(right) > 0.9


def test_a_lexicon_beyond_its_bytes_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LEXICON_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        toxicity._held(spark.createDataFrame([("abcdef",), ("ghijkl",)], "term string"))


def test_very_long_texts_and_clashing_columns(spark):
    long = "plain words stand here " * 100_000 + "you idiot"
    docs = spark.createDataFrame([(1, long, 7, 0), (1, long, 7, 0), (2, "", 7, 1)], "doc_id long, text string, predicted int, y int")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    q = quality.scores(docs, quality.train(docs, labels)).collect()
    t = toxicity.scores(docs, toxicity.train(docs, labels)).collect()
    assert len(q) == len(t) == 3 and len({r.score for r in q if r.doc_id == 1}) == len({r.score for r in t if r.doc_id == 1}) == 1
