"""Toxicity: Levenshtein automata run in step with a lexicon trie, and context windows.

The lexicon - whole words and word beginnings - is learned from all labelled documents outside the held-out fold; only the
weights of the score are fitted on a bounded sample of them. An automaton that is built lazily over
(trie node, edits) finds terms in any word, misspelled ones too. The words around a term, and the marks next to it, tell
quotation from abuse; a logistic model over exact, misspelled, quoted and direct finds gives the score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import bounded, training_rows
from .shared import TO_WORDS, crc_mod, settle, slices

# Toxic terms that are known without labels (whole words), and words that point to quoting or to address.
SEED_TERMS = ["idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown"]
QUOTING = {"said", "says", "wrote", "writes", "quote", "quoted", "called", "according", "reported", "term", "word", "phrase"}
ADDRESS = {"you", "your", "youre", "ihr", "du", "dein", "tu", "vous", "ton", "usted"}
QUOTES = "\"'`“”‘’«»„"

#: Labelled documents on which the score's weights are fitted, and their bytes, at most (about; a hash of the id picks them).
TRAIN_DOCS, TRAIN_BYTES = 16_000, 48_000_000
#: Lexicon: lengths of word beginnings, least share of toxic documents among those with the term, least support.
STEMS = range(3, 9)
PRECISION = 0.5
SUPPORT_LEAST = 3
#: Bytes of terms, and of their clean look-alikes, that the driver and every worker may hold; more is an error, not a cut.
LEXICON_BYTES = 16_000_000
#: Nats by which a term must beat the best of all terms if none marked the label.
MARGIN = 2.0
#: A term from this length on may hold one edit.
EDIT_WORD, EDIT_STEM = 5, 6
CONTEXT = 6
#: Words whose state a worker remembers.
MEMORY = 400_000
FLUSH = 250_000


class LexiconAutomaton:
    """Deterministic automaton, built as words need it, for: word within its edits of a whole term, or beginning within its edits of a stem."""

    WORD, STEM = 1, 2

    def __init__(self, words: dict[str, int], stems: dict[str, int]):
        self.child: list[dict] = [{}]
        self.end: list[dict] = [{}]
        for kind, terms in ((self.WORD, words), (self.STEM, stems)):
            for term, edits in terms.items():
                node = 0
                for ch in term:
                    if ch not in self.child[node]:
                        self.child[node][ch] = len(self.child)
                        self.child.append({})
                        self.end.append({})
                    node = self.child[node][ch]
                self.end[node][kind] = edits
        self.room = [0] * len(self.child)  # most edits of any term below
        for node in range(len(self.child) - 1, -1, -1):
            self.room[node] = max([*self.end[node].values(), *(self.room[c] for c in self.child[node].values())], default=0)
        self.ids: dict = {}
        self.states: list = []
        self.moves: list[dict] = []
        self.accept: list[tuple] = []
        self.start = self._state(self._closed({(0, 0)}), (9, 9))

    def _closed(self, nfa: set) -> frozenset:
        """With the term's characters that the word leaves out."""
        todo = list(nfa)
        while todo:
            node, e = todo.pop()
            for c in self.child[node].values():
                if e + 1 <= self.room[c] and (c, e + 1) not in nfa:
                    nfa.add((c, e + 1))
                    todo.append((c, e + 1))
        return frozenset(nfa)

    def _state(self, nfa: frozenset, before: tuple) -> int:
        """Accepted edits so far: of a stem that has ended in the word (kept), of a whole word that ends here."""
        stem, word = before[1], 9
        for node, e in nfa:
            ends = self.end[node]
            if e <= ends.get(self.STEM, -1):
                stem = min(stem, e)
            if e <= ends.get(self.WORD, -1):
                word = min(word, e)
        key = (nfa, word, stem)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(nfa)
            self.moves.append({})
            self.accept.append((word, stem))
        return self.ids[key]

    def _move(self, state: int, ch: str) -> int:
        nfa = set()
        for node, e in self.states[state]:
            if ch in self.child[node]:
                nfa.add((self.child[node][ch], e))
            if e + 1 <= self.room[node]:
                nfa.add((node, e + 1))
                nfa.update((c, e + 1) for c in self.child[node].values() if e + 1 <= self.room[c])
        return self._state(self._closed(nfa), self.accept[state])

    def match(self, word: str) -> tuple[int, int]:
        """Edits to the nearest whole term, and to the nearest stem that the word goes on after (9: none)."""
        state, stem = self.start, 9
        for i, ch in enumerate(word):
            stem = self.accept[state][1]
            nxt = self.moves[state].get(ch)
            if nxt is None:
                nxt = self.moves[state][ch] = self._move(state, ch)
            state = nxt
            if not self.states[state]:
                return 9, self.accept[state][1] if i + 1 < len(word) else stem
        return self.accept[state][0], stem


def terms_of(words: set[bytes]) -> set[str]:
    """Each word, marked with a final $, and its beginnings that are shorter than it."""
    out = set()
    for w in words:
        s = w.decode(errors="replace")
        out.add(s + "$")
        out.update(s[:k] for k in STEMS if k < len(s))
    return out


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, toxic, clean): how many documents of each label have the term; partial sums leave a task in bounded lots."""

    def run(batches):
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def lot():
            every = list(seen[0].keys() | seen[1].keys())
            b = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([seen[1][t] for t in every], pa.int64()), pa.array([seen[0][t] for t in every], pa.int64())], names=["term", "toxic", "clean"])
            seen[0].clear()
            seen[1].clear()
            return b

        for piece, data, off in slices(batches):
            raw, cuts, y = data.tobytes(), off.tolist(), piece.column(2).to_pylist()
            for a, b, label in zip(cuts, cuts[1:], y, strict=False):
                seen[1 if label else 0].update(terms_of(set(raw[a:b].translate(TO_WORDS).split())))
                if len(seen[0]) + len(seen[1]) > FLUSH:
                    yield lot()
        yield lot()

    return rows.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _held(terms: DataFrame) -> list[str]:
    """The only column of terms, in order; an error where it has more than LEXICON_BYTES."""
    out, size = [], 0
    for (t,) in terms.toLocalIterator():
        out.append(t)
        size += len(t)
        if size > LEXICON_BYTES:
            raise ValueError(f"the lexicon has more than {LEXICON_BYTES} bytes; raise PRECISION, MARGIN or LEXICON_BYTES")
    return out


def learn_lexicon(counts: DataFrame, toxic: int, clean: int) -> tuple[list[str], list[str]]:
    """Whole words and stems that mark the toxic label.

    A term qualifies by the log-likelihood ratio of its documents against the overall rate, which must exceed what the best of
    so many random terms would reach, and by PRECISION. The strongest terms come first, of equal ones the longest, and a term
    that begins another, or begins with it, is left out afterwards. All others are kept."""
    if not toxic or not clean:
        return [], []
    n, rate = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
    gain = F.col("toxic") * F.log(F.col("toxic") / n / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - rate))).otherwise(0.0)
    least = float(np.log(max(counts.count(), 2))) + MARGIN
    good = counts.filter((F.col("toxic") >= SUPPORT_LEAST) & (F.col("toxic") >= PRECISION * n)).withColumn("gain", gain).filter(F.col("gain") >= least)
    chosen: list[str] = []
    taken: set[str] = set()
    begun: set[str] = set()
    for t in _held(good.orderBy(F.desc("gain"), F.desc(F.length("term")), "term").select("term")):
        heads = [t[:k] for k in range(1, len(t) + 1)]
        if t not in begun and not taken.intersection(heads):
            chosen.append(t)
            taken.add(t)
            begun.update(heads)
    return [t[:-1] for t in chosen if t.endswith("$")], [t for t in chosen if not t.endswith("$")]


def automaton_of(words: list[str], stems: list[str]) -> LexiconAutomaton:
    return LexiconAutomaton({w: int(len(w) >= EDIT_WORD) for w in words}, {s: int(len(s) >= EDIT_STEM) for s in stems})


def look_alikes(counts: DataFrame, words: list[str], stems: list[str]) -> set[str]:
    """Words of clean training documents within one edit of a term; they are no misspelling of it."""

    def run(batches):
        auto = automaton_of(words, stems)
        for b in batches:
            keep = []
            for term in b.column(0).to_pylist():
                w, s = auto.match(term[:-1])
                keep.append(min(w, s) == 1)
            yield b.filter(pa.array(keep))

    whole = counts.filter(F.endswith("term", F.lit("$")) & (F.col("clean") > F.col("toxic"))).select("term", "clean")
    return {t[:-1] for t in _held(whole.mapInArrow(run, whole.schema).select("term"))}


_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
N_FEATURES = 10


class Finder:
    """Features of texts: exact and misspelled finds of words and stems, quoted and direct, and their density."""

    def __init__(self, words: list[str], stems: list[str], clean: set[str]):
        self.auto, self.clean, self.known = automaton_of(words, stems), clean, {}

    def kind(self, word: bytes) -> int:
        """0 none, 1 exact word, 2 exact stem, 3 misspelled word, 4 misspelled stem."""
        k = self.known.get(word)
        if k is None:
            s = word.decode(errors="replace")
            w, t = self.auto.match(s)
            k = 1 if w == 0 else 2 if t == 0 else 0 if s in self.clean else 3 if w == 1 else 4 if t == 1 else 0
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = k
        return k

    def features(self, doc: bytes) -> np.ndarray:
        x = np.zeros(N_FEATURES)
        words = doc.translate(TO_WORDS).split()
        known, kind = self.known, self.kind
        bad = [w for w in set(words) if (known[w] if w in known else kind(w))]
        if not bad:
            return x
        text = doc.decode(errors="replace")
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        spots = list(_TOKEN.finditer(low))
        tokens = [m[0] for m in spots]
        terms = {w.decode(errors="replace"): kind(w) for w in bad}
        total = 0.0
        for i, w in enumerate(tokens):
            k = terms.get(w)
            if not k:
                continue
            near = tokens[max(0, i - CONTEXT) : i] + tokens[i + 1 : i + 1 + CONTEXT]
            a, b = spots[i].span()
            marks = (text[a - 1 : a] in QUOTES and a > 0) + (text[b : b + 1] in QUOTES and b < len(text))
            quoted = min(1.0, 0.5 * marks + 0.25 * sum(t in QUOTING for t in near)) * (0.5 if any(t in ADDRESS for t in near) else 1.0)
            x[k - 1] += 1 - quoted
            x[4] += quoted * (k <= 2)
            x[5] += quoted * (k > 2)
            total += 1
        x[6] = np.log1p(100 * total / max(1, len(tokens)))
        x[9] = np.log1p(100 * x[1] / max(1, len(tokens)))
        x[7] = float(x[0] + x[1] + x[4] > 0)
        x[8] = float(x[2] + x[3] + x[5] > 0)
        x[:6] = np.log1p(x[:6])
        return x


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Logistic weights (the last is the constant) with a small ridge. Without both classes: a lexicon find decides."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([1.0, 1.0, 0.3, 0.3, 0.2, 0.1, 0.0, 3.0, 0.5, 0.0, -2.5])
    xs = np.c_[x, np.ones(len(x))]
    w = np.zeros(xs.shape[1])
    ridge = np.r_[np.full(x.shape[1], 1e-3), 0.0] * len(y)
    for _ in range(min(rounds, 40)):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        g = xs.T @ (p - y) + ridge * w
        hess = (xs * (p * (1 - p) + 1e-6)[:, None]).T @ xs + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hess, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _featured(rows: DataFrame, words, stems, clean, weights=None) -> DataFrame:
    """doc_id, y and features; or doc_id and score where weights are given."""
    shared = rows.sparkSession.sparkContext.broadcast((words, stems, clean))

    def run(batches):
        finder = Finder(*shared.value)
        for piece, data, off in slices(batches):
            raw, cuts = data.tobytes(), off.tolist()
            x = np.array([finder.features(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
            if weights is None:
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])
            else:
                z = np.c_[x, np.ones(len(x))] @ weights
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, y int, x array<double>" if weights is None else "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> dict:
    """Lexicon and look-alikes from all labelled documents outside the held-out fold, and the weights of the score from a
    bounded number of them (`most` documents, `most_bytes` of text)."""
    rows = training_rows(docs, labels, "toxic", None)
    counts = settle(term_counts(rows))
    total = rows.select("y").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).first()
    words, stems = learn_lexicon(counts, total.toxic or 0, total.n - (total.toxic or 0))
    words = sorted(set(words) | set(SEED_TERMS))
    clean = look_alikes(counts, words, stems)
    sample = bounded(settle(training_rows(docs, labels, "toxic", most)), most_bytes)
    got = sorted(_featured(sample, words, stems, clean).collect(), key=lambda r: (r.doc_id, r.x))
    weights = fit(np.array([r.x for r in got]).reshape(-1, N_FEATURES), np.array([r.y for r in got], float))
    return {"words": words, "stems": stems, "clean": clean, "weights": weights}


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id and score, 0 to 1, of the whole text. Null texts are empty; empty texts get the score of a text
    without finds; texts of any length are read whole. Repeated rows repeat; further columns are ignored; an empty table gives
    no rows. Equal texts have equal scores."""
    return _featured(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model["words"], model["stems"], model["clean"], model["weights"])


def op7_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scores(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
