import random

from brute import phrases
from fluence.llm import licenses


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, notices string")
    return {r.doc_id: r for r in licenses.scan(df).collect()}


def test_phrases_against_brute_force(spark):
    rng = random.Random(4)
    words = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "é", "x", "\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(150)] + [None, "", "cc by cc by", "ccby", "cc\tby."]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        n, want = phrases(t, licenses.PHRASES)
        assert got[i].n_words == n and [(p["word"], p["label"]) for p in got[i].phrases] == want


def test_misspelled_notices_are_found_with_their_edits(spark):
    texts = ["x Licensed under the Apache License, Version 2.0. y", "Licenced under the Apatche License Version 2.0", "Released  under the MIT Licnse!", "nothing of the kind stands here", "LICENSED!! UNDER!! CC!! BY-NC!! 4.0", "gnu genral public license, version 3"]
    got = run(spark, texts)
    labels = [{(x["label"], x["edits"]) for x in got[i].notices} for i in range(len(texts))]
    assert ("apache-2.0", 0) in labels[0] and ("apache-2.0", 2) in labels[1] and ("mit", 1) in labels[2] and not labels[3] and ("cc-by-nc-4.0", 0) in labels[4] and ("gpl-3.0", 1) in labels[5]
    span = got[0].notices[0]
    assert (span["first"], span["last"]) == (1, 9)


def test_pieces_cover_a_notice():
    for n, _ in licenses.NOTICES:
        assert "".join(p for p, _ in licenses.parts(n)) == licenses.plain(n)
        assert "".join(p.decode() for _, p in licenses.pieces(n)) == licenses.plain(n) and len(licenses.pieces(n)) == licenses.edits_allowed(n) + 1


def distances(part, text):
    """Edits from part to every beginning of text."""
    row = list(range(len(text) + 1))
    for i, x in enumerate(part, 1):
        row, last = [i], row
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row


def brute_notice(words, notice):
    """Fewest edits of the notice in any stretch of whole words, by plain edit distances of its parts; None if it has too many."""
    best, size = None, len(licenses.plain(notice).split())
    for a in range(len(words)):
        for b in range(max(a + 1, a + size - 3), min(len(words), a + size + 3) + 1):
            t, at = " ".join(words[a:b]), {0: 0}
            for p, k in licenses.parts(notice):
                marked, after = p.strip() == p and k <= 1, {}
                for begin, e in at.items():
                    if marked and begin and t[begin - 1] != " ":
                        continue
                    for n, d in enumerate(distances(p, t[begin : begin + len(p) + 5])):
                        end = begin + n
                        if d <= k and not (p[-1] != " " and end < len(t) and t[end] != " "):
                            after[end] = min(after.get(end, 99), e + d)
                at = after
            e = at.get(len(t), 99)
            if e <= licenses.edits_allowed(notice) and (best is None or e < best):
                best = e
    return best


def test_fuzzy_notices_against_brute_force():
    """All notices over mutated notices: the same are found, with as few edits."""
    rng, hits = random.Random(8), 0
    for notice, label in licenses.NOTICES:
        scanner = licenses.Scanner([(notice, label)], {})
        for other, _ in [(notice, label)] * 6 + rng.sample(licenses.NOTICES, 4):
            chars = list("pre " + licenses.plain(other) + " post")
            for _ in range(rng.randrange(6)):
                i = rng.randrange(len(chars))
                chars[i : i + rng.randrange(2)] = rng.choice(["", "x", " ", "e", "2"])
            words = "".join(chars).split()
            raw = " ".join(words).encode()
            found = scanner.texts(raw, [0, len(raw)])[2][0]
            want = brute_notice(words, notice)
            assert (min(x[3] for x in found) if found else None) == want, (notice, raw)
            hits += want is not None
    assert hits > 60


def test_other_licences_are_told_apart():
    wrong = {
        "released under the BSD license": "mit",
        "released under the GPL license": "mit",
        "released under the summit license": "mit",
        "licensed under the Apache License version 1 1": "apache-2.0",
        "licensed under cc by sa 4 0": "cc-by-nc-4.0",
        "cc by sa 4 0": "cc-by-nc-4.0",
        "cc by nd 4.0": "cc-by-nc-4.0",
        "GNU General Public License version 2": "gpl-3.0",
        "GNU General Public License version 9": "gpl-2.0",
        "Mozilla Public License version 1 1": "mpl-2.0",
    }
    scanner = licenses.Scanner()
    for text, label in wrong.items():
        raw = text.encode()
        assert label not in {x[2] for x in scanner.texts(raw, [0, len(raw)])[2][0]}


def test_overlapping_places_leave_the_nearest():
    assert licenses.nearest([(0, 5, "a", 2, 20), (3, 8, "b", 1, 20), (8, 9, "c", 0, 20), (8, 9, "d", 0, 21)]) == [(3, 8, "b", 1, 20), (8, 9, "d", 0, 21)]


def test_long_text_nulls_and_repeats(spark):
    long = "filler words and more " * 60_000 + "Released under the MIT Licnse! " * 2000
    df = spark.createDataFrame([(1, long), (1, long), (None, None), (2, "")], "doc_id long, text string")
    got = licenses.scan(df).collect()
    assert sorted((r.doc_id or 0, len(r.notices)) for r in got) == [(0, 0), (1, 2000), (1, 2000), (2, 0)]


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_nearest_of_many_places_against_all_pairs():
    """Random places against comparing each with all kept ones, and 20,000 places in a second or two."""
    rng = random.Random(14)
    for _ in range(300):
        found = [(a, a + rng.randrange(1, 9), rng.choice("ab"), rng.randrange(4), rng.randrange(10, 14)) for a in (rng.randrange(60) for _ in range(rng.randrange(30)))]
        kept = []
        for x in sorted(found, key=lambda x: (x[3] / x[4], -x[4], x)):
            if all(x[1] <= y[0] or y[1] <= x[0] for y in kept):
                kept.append(x)
        assert licenses.nearest(found) == sorted(kept)
    many = [(7 * i, 7 * i + 9, "a", i % 3, 20) for i in range(20_000)]
    out = licenses.nearest(many)
    assert all(x[1] <= y[0] for x, y in zip(out, out[1:], strict=False)) and len(out) > 6000
