"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings (the values that the fixed patterns find), one on ordinary identifiers and words
(shorter runs of the same characters); a long run that the first explains better by a margin is reported.

The ordinary model takes an identifier for words, numbers and separators in a row: it first goes on in a class of characters or
changes it (camel case, a separator, a number), then picks a character of that class, a letter by the one before without regard
to case. Its shares are mixed with flat ones by fixed weights, so what the samples lack costs little. The random model is mixed
with one that draws evenly from the alphabet the run itself shows (hexadecimal, letters of one case, digits and so on).
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, word_spans

KINDS = ("assign", "access", "hex", "markov")
# The patterns, the least length of what must be long, and words that a match cannot do without.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
ASSIGN_VALUE, ACCESS_ALL, HEX_ALL = 12, 18, 16
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Characters of the models; a run of them is a candidate from RUN on.
SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = 16
ORDINARY_RUN = 6
#: Nats a character by which the random model must be better.
MARGIN = 0.5
#: Fewer different characters than this are a rule or a filler, no secret.
DISTINCT = 6
#: Pseudo-count of a character, and weight of the single characters' shares among those that follow another in random strings.
PRIOR, BACK_OFF = 0.5, 30.0
#: Ordinary text: weights of a letter's share after another letter, of its share alone, and of an even share.
LETTER_WEIGHTS = (0.8, 0.15, 0.05)
#: Ordinary text: a class of characters goes on with this share (marks: any class follows alike), and what is seen of it counts
#: this much.
GOES_ON, SEEN_WEIGHT = 0.7, 0.5

_CODE = np.full(256, -1, np.int64)
_CODE[list(SYMBOLS)] = np.arange(len(SYMBOLS))
_SYMBOL = _CODE >= 0
LOWER, UPPER, DIGIT, MARK = range(4)
_CLASS = np.array([UPPER if chr(b).isupper() else LOWER if chr(b).islower() else DIGIT if chr(b).isdigit() else MARK for b in SYMBOLS])
_LETTER = np.array([(b | 32) - 97 if chr(b).isalpha() else -1 for b in SYMBOLS])
#: code of a symbol's small letter, or the symbol itself
_SMALL = _CODE[[b | 32 if chr(b).isalpha() else b for b in SYMBOLS]]
_HEX_LETTER = (_LETTER >= 0) & (_LETTER < 6)
_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_RUN_MAP = bytes(120 if _SYMBOL[b] else 0 for b in range(256))


def fixed(doc: bytes) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) in bytes, of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    low = doc.lower()
    if any(k in low for k in KEYWORDS):
        out += [(0, m.start(), m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(doc) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if b"AKIA" in doc:
        out += [(1, m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(doc) if m.end() - m.start() >= ACCESS_ALL]
    marks = doc.translate(_HEX_MAP)
    at = marks.find(b"h" * HEX_ALL)
    while at >= 0:
        end = HEX.match(doc, at).end()
        out.append((2, at, end, at, end))
        at = marks.find(b"h" * HEX_ALL, end)
    return out


def pair_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each pair of characters stands in random strings (label 1) and in ordinary runs (label 0), over all rows."""
    n = len(SYMBOLS)

    def run(batches):
        total = np.zeros((2, n * n), np.int64)
        for _, data, off in slices(batches):
            pairs = _CODE[data[:-1]] * n + _CODE[data[1:]] if len(data) > 1 else np.zeros(0, np.int64)
            raw, cuts = data.tobytes(), off.tolist()
            random = np.zeros(len(data), bool)
            for a, b in zip(cuts, cuts[1:], strict=False):
                for _, _, _, x, y in fixed(raw[a:b]):
                    random[a + x : a + y] = True
            start, end, _ = word_spans(data, off, _SYMBOL)
            step = np.zeros(len(data) + 1, np.int8)
            # a run that is long enough to be a candidate is no sample of ordinary text
            for label, pick in ((0, (end - start >= ORDINARY_RUN) & (end - start < RUN)), (1, end - start >= ORDINARY_RUN)):
                step[:] = 0
                step[start[pick]] += 1
                step[end[pick] - 1] -= 1  # the last character begins no pair
                inside = np.cumsum(step[:-1], dtype=np.int8)[: len(pairs)] > 0
                ok = inside & (random[:-1] == bool(label)) & (random[1:] == bool(label))
                total[label] += np.bincount(pairs[ok], minlength=n * n)
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[label, pair])], names=["label", "pair", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))


def ordinary(seen: np.ndarray) -> np.ndarray:
    """Share of each symbol after each symbol in ordinary runs, from counts of pairs (a square)."""
    classes = np.eye(4)[_CLASS]
    moves = classes.T @ seen @ classes
    steady = np.where(np.eye(4) > 0, GOES_ON, (1 - GOES_ON) / 3)
    steady[MARK] = 1 / 4
    total = moves.sum(axis=1, keepdims=True)
    moves = np.where(total > 0, SEEN_WEIGHT * moves / np.maximum(total, 1) + (1 - SEEN_WEIGHT) * steady, steady)

    is_letter = _LETTER >= 0
    fold = np.eye(27)[_LETTER][:, :26]  # what is no letter has number -1, the last column
    pairs = fold.T @ seen @ fold
    alone = (pairs.sum(axis=0) + PRIOR) / (pairs.sum() + PRIOR * 26)
    after = (pairs + BACK_OFF * alone) / (pairs.sum(axis=1, keepdims=True) + BACK_OFF)
    pair_weight, alone_weight, even_weight = LETTER_WEIGHTS
    within = pair_weight * after + alone_weight * alone + even_weight / 26
    first = (pair_weight + alone_weight) * alone + even_weight / 26

    n = len(SYMBOLS)
    pick = np.empty((n, n))
    pick[:, is_letter] = first[_LETTER[is_letter]]
    joined = np.ix_(is_letter, is_letter)
    camel = (_CLASS[:, None] == LOWER) & (_CLASS == UPPER)
    pick[joined] = np.where(camel[joined], pick[joined], within[np.ix_(_LETTER[is_letter], _LETTER[is_letter])])
    pick[:, _CLASS == DIGIT] = 0.1
    marks = _CLASS == MARK
    pick[:, marks] = 1 / marks.sum()
    pick[np.ix_(marks, marks)] = np.where(np.eye(marks.sum()) > 0, GOES_ON, (1 - GOES_ON) / (marks.sum() - 1))
    return moves[_CLASS][:, _CLASS] * pick


def train(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Two rows with a number for each pair: its share in random strings (0 without any), and the logarithm of its share in
    ordinary runs. At most 2 * 67**2 sums come to the driver; without samples both models are flat."""
    n = len(SYMBOLS)
    seen = np.zeros((2, n * n))
    for r in pair_counts(docs, text_col).collect():
        seen[r.label, r.pair] += r.n
    plain, random = seen.reshape(2, n, n)
    alone = (random.sum(axis=0) + PRIOR) / (random.sum() + PRIOR * n)
    share = (random + BACK_OFF * alone) / (random.sum(axis=1, keepdims=True) + BACK_OFF)
    return np.stack([share.ravel() if random.any() else np.zeros(n * n), np.log(ordinary(plain)).ravel()])


def alphabet(codes: np.ndarray) -> int:
    """Size of the smallest usual alphabet that holds all symbols of a run: letters of a case count 6 (a to f) or 26."""
    size = 0
    for c, whole in ((LOWER, 26), (UPPER, 26), (DIGIT, 10), (MARK, 5)):
        of = codes[_CLASS[codes] == c]
        size += 0 if not len(of) else 6 if whole == 26 and _HEX_LETTER[of].all() else whole
    return size


def ratios(codes: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio (nats) of each pair of a run. A run without small letters is read as if in small letters."""
    n = len(SYMBOLS)
    plain = codes if (_CLASS[codes] == LOWER).any() else _SMALL[codes]
    random = (model[0, codes[:-1] * n + codes[1:]] + 1 / alphabet(codes)) / 2
    return np.log(random) - model[1, plain[:-1] * n + plain[1:]]


def _uncovered(begin: int, end: int, spans: list[tuple]) -> list[tuple[int, int]]:
    """What spans leave of begin to end."""
    out, at = [], begin
    for a, b, _ in sorted(spans):
        if a >= end:
            break
        if b > at:
            if a > at:
                out.append((at, a))
            at = b
    return out + [(at, end)] if at < end else out


def found(doc: bytes, model: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, sorted: the fixed patterns' matches, and runs that the models call random.

    A run that fixed matches cover in part is tested as a whole, with what they leave of it, and reported as a whole. A run of
    fewer than DISTINCT different characters is none."""
    base = [(a, b, k) for k, a, b, _, _ in fixed(doc)]
    spans, marks, base_at = list(base), doc.translate(_RUN_MAP), sorted(base)
    ends = np.maximum.accumulate([b for _, b, _ in base_at]) if base else np.zeros(0, np.int64)
    starts = [a for a, _, _ in base_at]
    at = marks.find(b"x" * RUN)
    while at >= 0:
        end = marks.find(b"\0", at)
        end = len(doc) if end < 0 else end
        near = base_at[int(np.searchsorted(ends, at, "right")) : bisect_left(starts, end)]
        free = _uncovered(at, end, near)
        if free:
            codes = _CODE[np.frombuffer(doc[at:end], np.uint8)]
            each = ratios(codes, model)
            rest = np.concatenate([each[max(0, a - at - 1) : b - at] for a, b in free])  # pairs with a character that is left
            if each.mean() > MARGIN and rest.mean() > MARGIN and len(np.unique(codes)) >= DISTINCT:
                spans.append((at, end, 3))
        at = marks.find(b"x" * RUN, end)
    return sorted(spans)


def points(doc: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if not spans or doc.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(doc, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), int(before[b]), k) for a, b, k in spans]


def scan(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, spans (kind, start, end; code points, end exclusive; by start, then kind).

    Null texts are empty and have none. Texts of any length are searched whole, in time that grows with their length and
    number of spans. Repeated rows repeat; further columns are ignored; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for piece, data, off in slices(batches):
            raw, cuts = data.tobytes(), off.tolist()
            out = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted(points(d, found(d, model)), key=lambda x: (x[0], x[2]))] for d in (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, model: np.ndarray, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by a mark (overlapping spans by one); all rows and columns stay, null texts null.

    Repeated rows repeat; an empty table gives an empty table of the same columns."""
    schema = docs.schema
    at = schema.fieldNames().index(text_col)

    def run(batches):
        for piece, data, off in slices(batches, text_col):
            raw, cuts, texts = data.tobytes(), off.tolist(), None
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                spans = found(raw[a:b], model)
                if spans:
                    texts = piece.column(at).to_pylist() if texts is None else texts
                    out, last = [], 0
                    for s, e, _ in spans:
                        if s >= last:
                            out += [raw[a + last : a + s], mark.encode()]
                        last = max(last, e)
                    texts[i] = b"".join([*out, raw[a + last : b]]).decode()
            if texts is not None:
                columns = list(piece.columns)
                columns[at] = pa.array(texts, piece.schema.field(at).type)
                piece = pa.RecordBatch.from_arrays(columns, schema=piece.schema)
            yield piece

    return docs.mapInArrow(run, schema)


def op8_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spans = scan(docs, train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "markov"), line), ",")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))
