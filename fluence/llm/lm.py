"""Language-model scores by logistic context mixing.

Text is spelled as its lower-cased words, one space between them and a newline at the end, and coded bit by bit. Seven
predictors - after the last 0 to 5 bytes, and after the word so far (its last five letters) - give the log odds of the bits
that followed in training. A gate (bit number, longest context that has been seen, place in the word, word so far seen)
selects the weights that mix them; the weights are learned online, shard after shard of the contexts. A last stage refines the
mixed probability by what it has meant so far. The bits sum to the text's probability, so score is a log10 probability of the
same token sequence that the unigram base scores.

What is gathered grows with the input and stays distributed: a row for each distinct string (a byte with the five before it)
of all texts, with how often it occurs. Strings that share the last two bytes of context are packed together, so every count
of orders 2 to 5 and of the word so far is exact and local; only the 65,536 sums of orders 0 and 1 go everywhere. Each distinct
string is scored once, on the cluster. Texts are then read once more: the most frequent strings and words are looked up in a
broadcast of bounded size, all others are joined.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, NOT_SPACE, U64, arrow_rows, crc_mod, discard, settle, slices, word_hashes, word_spans

ORDER = 5
PREDICTORS = ORDER + 2
#: Inputs of the mixer: a predictor's log odds, and a constant.
INPUTS = PREDICTORS + 1
PRIOR = 0.4
GATES = 8 * (ORDER + 1) ** 2 * 2
BUCKETS = 25
STRETCH = 10.0
#: The contexts are dealt over so many shards; the weights take a step after each, and go over all shards so many times.
SHARDS, ROUNDS = 4, 1
RIDGE = 3.0
FIRST_WEIGHTS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.3, 0.0)
#: Distinct strings that are packed together on average (the strings after one pair of bytes are never split).
PACK = 60_000
#: Distinct words, and strings, whose values are broadcast, at most; the others are joined.
FREQUENT_WORDS, FREQUENT_STRINGS = 300_000, 1_000_000
#: Distinct strings or words that a task holds before it hands them on.
HOLD = 200_000
#: Bytes of text that are turned into arrays at once, texts of an Arrow batch, and strings of a pack whose bits are mixed at once:
#: the tasks of an executor hold these side by side. Packed rows come one in a batch.
SLICE = 500_000
BATCH_ROWS = 1000
AT_ONCE = 1 << 15
END = 0x5EED5EED

_PAD = b"\n" * ORDER
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True


def _windows(flat: np.ndarray) -> np.ndarray:
    """At every byte the last six, the byte itself in the low eight bits."""
    window = np.zeros(len(flat), U64)
    for j in range(ORDER + 1):
        window[j:] |= flat[: len(flat) - j].astype(U64) << U64(8 * j)
    return window


def strings_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The window of every coded byte, and the text it belongs to."""
    raw, cuts = LOWER[data].tobytes(), off.tolist()
    texts = [b" ".join(raw[a:b].split()) + b"\n" for a, b in zip(cuts, cuts[1:], strict=False)]
    flat = np.frombuffer(_PAD + _PAD.join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    at = np.arange(int(size.sum())) + np.repeat(np.arange(1, len(size) + 1) * ORDER, size)
    return _windows(flat)[at], np.repeat(np.arange(len(size)), size)


def tokens_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every token of the texts - words, then an end - and the offset of each text's first token."""
    start, end, first = word_spans(data, off, NOT_SPACE)
    h = word_hashes(LOWER[data], start, end)
    n = len(off) - 1
    out = np.full(len(h) + n, END, U64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))] = h
    return out, first + np.arange(n + 1)


def _runs(v: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)


class _Tally:
    """How often each key came, in lots."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, key, n=None):
        if n is None:
            v = np.sort(key)
            first = _runs(v)
            n = np.diff(np.append(first, len(v)))
        else:
            order = np.argsort(key, kind="stable")
            v = key[order]
            first = _runs(v)
            n = np.add.reduceat(n[order], first) if len(v) else n
        self.parts.append((v[first], n))
        self.held += len(first)

    def lot(self, most: int = 0):
        """All that is held, merged; or None if that is at most `most` keys, which stay."""
        if len(self.parts) > 1:
            merged = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
            self.parts, self.held = [], 0
            self.add(*merged)
        if not self.parts or self.held <= most:
            return None
        part, self.parts, self.held = self.parts[0], [], 0
        return part


STRING, WORD = 0, 1


def counted(rows: DataFrame) -> DataFrame:
    """(kind, key, n, m) over all texts of rows (text, held_out): strings by their windows, and tokens by a 64-bit hash; n and
    m say how often they occur in training texts and in all. Tasks sum up first, in bounded lots."""

    def batch(kind, train, key, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n * train), pa.array(n)], names=["kind", "key", "n", "m"])

    def run(batches):
        held = {(kind, train): _Tally() for kind in (STRING, WORD) for train in (True, False)}
        for piece, data, off in slices(batches, most=SLICE):
            train = ~np.array(piece.column(1).to_pylist(), bool)
            window, of = strings_of(data, off)
            token, first = tokens_of(data, off)
            for which in (True, False):
                held[STRING, which].add(window[(train == which)[of]])
                held[WORD, which].add(token[np.repeat(train == which, np.diff(first))])
            for (kind, which), t in held.items():
                part = t.lot(HOLD) if t.held > 2 * HOLD else None
                if part:
                    yield batch(kind, which, *part)
        for (kind, which), t in held.items():
            part = t.lot()
            if part:
                yield batch(kind, which, *part)

    return rows.select("text", "held_out").mapInArrow(run, "kind int, key long, n long, m long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def packed(strings: DataFrame) -> DataFrame:
    """strings (key, n, m) with all that share the last two bytes of context in one row: part, shard, strings (all keys,
    ascending, then all n, then all m, as longs)."""
    parts = max(SHARDS, -(-strings.count() // PACK))

    def run(batches):
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not held:
            return
        part, *columns = (c.to_numpy() for c in pa.concat_tables(held).columns)
        order = np.lexsort((columns[0], part))
        whole = np.stack([c[order] for c in columns])
        ids, first = np.unique(part[order], return_index=True)
        for p, piece in zip(ids.tolist(), np.split(whole, first[1:], axis=1), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([p % SHARDS], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["part", "shard", "strings"])

    context = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF))
    dealt = strings.select(F.pmod(F.xxhash64(context), F.lit(parts)).cast("int").alias("part"), "key", "n", "m")
    return dealt.repartition(parts, "part").mapInArrow(run, "part int, shard int, strings binary")


def first_orders(strings: DataFrame) -> np.ndarray:
    """Training counts of every byte after every byte (65,536 sums at most)."""
    out = np.zeros((256, 256))
    pair = F.col("key").bitwiseAND(F.lit(0xFFFF))
    for r in strings.filter("n > 0").groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).collect():
        out[r.pair >> 8, r.pair & 255] = r.n
    return out


def _place(key: np.ndarray) -> np.ndarray:
    """Bytes of the word so far, at most ORDER."""
    out, open_ = np.zeros(len(key), np.int64), np.ones(len(key), bool)
    for j in range(1, ORDER + 1):
        open_ &= ~_BREAK[((key >> U64(8 * j)) & U64(255)).astype(np.int64)]
        out[open_] += 1
    return out


class Counts:
    """Training counts of 0 and 1 bits after every context of packed strings, a bit number at a time."""

    def __init__(self, window: np.ndarray, n: np.ndarray, nodes: list):
        self.n, self.byte = n.astype(float), (window & U64(255)).astype(np.int64)
        self.past = ((window >> U64(8)) & U64(255)).astype(np.int64)
        self.place = _place(window)
        self.nodes = nodes
        # the bytes of the word so far and the coded one; a single letter with the break before it, which is in its pack too
        bytes_ = np.minimum(self.place + 1 + (self.place == 1), ORDER + 1).astype(U64)
        word = (window & ((U64(1) << (U64(8) * bytes_)) - U64(1))) | (self.place.astype(U64) << U64(56))
        values = [window & U64((1 << 8 * (k + 1)) - 1) for k in range(2, ORDER + 1)] + [word]
        self.sorted = []
        for v in values:
            order = np.argsort(v, kind="stable").astype(np.int32)
            self.sorted.append((order, v[order]))

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of 0 and of 1 (predictors x strings) of bit i after the context and the bits before it."""
        zero, one = np.empty((2, PREDICTORS, len(self.n)))
        for k in (0, 1):
            got = self.nodes[i][k][self.past, self.byte >> (8 - i)]
            zero[k], one[k] = got[:, 0], got[:, 1]
        for k, (order, v) in enumerate(self.sorted, 2):
            n, group = self.n[order], v >> U64(8 - i)
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            ones = np.add.reduceat(n * ((v >> U64(7 - i)) & U64(1)).astype(float), first)
            size = np.diff(np.append(first, len(v)))
            one[k][order] = np.repeat(ones, size)
            zero[k][order] = np.repeat(np.add.reduceat(n, first) - ones, size)
        start = np.flatnonzero(self.place == 0)  # a word's beginning has no letters yet: what follows the break, whatever stands before
        zero[-1][start], one[-1][start] = zero[1][start], one[1][start]
        return zero, one

    def inputs(self, i: int, leave_one: bool):
        """Of bit i, for AT_ONCE strings at a time: which strings they are, the mixer's inputs, gate and bit. leave_one: without one
        occurrence of the string itself."""
        every = self.of(i)
        for a in range(0, len(self.n), AT_ONCE):
            part = slice(a, a + AT_ONCE)
            zero, one = (t[:, part] for t in every)
            bit = (self.byte[part] >> (7 - i)) & 1
            if leave_one:
                zero -= bit == 0
                one -= bit == 1
                np.maximum(zero, 0, out=zero)
                np.maximum(one, 0, out=one)
            x = np.empty((INPUTS, len(bit)))
            np.log((one + PRIOR) / (zero + PRIOR), out=x[:PREDICTORS])
            x[PREDICTORS] = 1.0
            seen = zero + one > 0.5
            longest = np.zeros(len(bit), np.int64)
            for k in range(1, ORDER + 1):
                longest[seen[k]] = k
            gate = (((longest * (ORDER + 1) + self.place[part]) * 2 + seen[ORDER + 1]) * 8) + i
            yield part, x, gate, bit


def node_sums(pairs: np.ndarray) -> list:
    """For each bit the counts of 0 and 1 of orders 0 and 1: sums over the bytes that begin with the bits so far."""
    alone = np.broadcast_to(pairs.sum(axis=0), pairs.shape)
    return [[table.reshape(256, 1 << i, 2, -1).sum(axis=3) for table in (alone, pairs)] for i in range(8)]


def unpacked(batches, pairs: np.ndarray, training: bool):
    """The keys, counts in all and Counts of each packed row; of training: only strings of training texts."""
    nodes = node_sums(pairs)
    for b in batches:
        for blob in b.column(b.schema.get_field_index("strings")):
            key, n, m = np.frombuffer(blob.as_buffer(), np.int64).reshape(3, -1)
            if training:
                key, n = key[n > 0], n[n > 0]
            if len(key):
                yield key, m, Counts(key.view(U64), n, nodes)


def _mixed(x, gate, weights):
    return np.clip(np.einsum("kj,kj->j", x, weights.T[:, gate]), -STRETCH, STRETCH)


def _logistic(z):
    return 1 / (1 + np.exp(-z))


def _bucket(z):
    x = (z + STRETCH) * ((BUCKETS - 1) / (2 * STRETCH))
    low = np.minimum(x.astype(np.int64), BUCKETS - 2)
    return low, x - low


def _sums(total: np.ndarray):
    """The cells of a table of sums that are not 0, as rows."""
    flat = total.ravel()
    at = np.flatnonzero(flat)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "v"])


def _summed(rows: DataFrame, run, shape: tuple) -> np.ndarray:
    """The tables that run gives for every task, summed on the executors."""
    out = np.zeros(int(np.prod(shape)))
    for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out.reshape(shape)


def _slopes(batches, pairs, weights):
    """For each gate the gradient of the log likelihood, and its curvature, over packed strings."""
    total = np.zeros((GATES, INPUTS, INPUTS + 1))
    for _, _, counts in unpacked(batches, pairs.value, True):
        for part, x, gate, bit in (y for i in range(8) for y in counts.inputs(i, True)):
            n, p = counts.n[part], _logistic(_mixed(x, gate, weights))
            order = np.argsort(gate, kind="stable")
            x, gate = x[:, order], gate[order]
            error, bend = (n * (bit - p))[order], (n * p * (1 - p))[order]
            first = np.flatnonzero(np.concatenate(([True], gate[1:] != gate[:-1])))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(gate)], strict=True):
                total[gate[a], :, 0] += x[:, a:b] @ error[a:b]
                total[gate[a], :, 1:] += (x[:, a:b] * bend[a:b]) @ x[:, a:b].T
    yield _sums(total)


def _meanings(batches, pairs, weights):
    """For each gate and bucket of mixed probability how often the bit was 0 and 1."""
    total = np.zeros((2, GATES * BUCKETS))
    for _, _, counts in unpacked(batches, pairs.value, True):
        for part, x, gate, bit in (y for i in range(8) for y in counts.inputs(i, True)):
            low, share = _bucket(_mixed(x, gate, weights))
            for v in (0, 1):
                m = np.where(bit == v, counts.n[part], 0)
                for step, near in ((0, 1 - share), (1, share)):
                    total[v] += np.bincount(gate * BUCKETS + low + step, weights=m * near, minlength=GATES * BUCKETS)
    yield _sums(total)


def learn(packs: DataFrame, pairs) -> tuple[np.ndarray, np.ndarray]:
    """Gated weights and the refinement. After each shard every gate takes a second-order step by that shard's gradient and
    the curvature of all shards so far, so that later shards move the weights less. Shards are shards of contexts, and their
    sums are made on the executors: partitions do not matter. `pairs` is a broadcast of first_orders."""
    weights = np.tile(np.array(FIRST_WEIGHTS), (GATES, 1))
    bend = np.tile(RIDGE * np.eye(INPUTS), (GATES, 1, 1))
    for _ in range(ROUNDS):
        for shard in range(SHARDS):
            total = _summed(packs.filter(F.col("shard") == shard), partial(_slopes, pairs=pairs, weights=weights), (GATES, INPUTS, INPUTS + 1))
            bend = bend + total[:, :, 1:]
            weights = weights + np.clip(np.linalg.solve(bend, total[:, :, :1])[:, :, 0], -1, 1)
    zero, one = _summed(packs, partial(_meanings, pairs=pairs, weights=weights), (2, GATES, BUCKETS))
    middle = _logistic(np.linspace(-STRETCH, STRETCH, BUCKETS))
    return weights, (one + 20 * middle) / (zero + one + 20)


def log10_probability(counts: Counts, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """Of each string's coded byte after its contexts."""
    out = np.zeros(len(counts.n))
    for part, x, gate, bit in (y for i in range(8) for y in counts.inputs(i, False)):
        z = _mixed(x, gate, weights)
        low, share = _bucket(z)
        p = 0.5 * _logistic(z) + 0.5 * (refined[gate, low] * (1 - share) + refined[gate, low + 1] * share)
        out[part] += np.log10(np.where(bit == 1, p, 1 - p))
    return out


def scored(packs: DataFrame, pairs, weights: np.ndarray, refined: np.ndarray) -> DataFrame:
    """(key, m, value): log10 probability of every distinct string, and how often it occurs in all texts."""

    def run(batches):
        for key, m, counts in unpacked(batches, pairs.value, False):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(m), pa.array(log10_probability(counts, weights, refined))], names=["key", "m", "value"])

    return packs.mapInArrow(run, "key long, m long, value double")


def _least(table: DataFrame, column: str, room: int) -> int:
    """A count from which at most `room` rows of table have it in column (rows are taken by eighths of powers of two)."""
    step = F.floor(F.log2(F.col(column)) * 8).alias("step")
    least = 1 << 62
    for r in sorted(table.groupBy(step).agg(F.count("*").alias("rows"), F.min(column).alias("low")).collect(), key=lambda r: -r.step):
        room -= r.rows
        if room < 0:
            break
        least = r.low
    return least


class _Lookup:
    """Places of keys: a hash of a key names a slot that holds one key's place; others are searched."""

    last: tuple = (None, None)

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.keys, self.values = np.append(keys, U64(2**64 - 1)), [np.append(v, 0.0) for v in values]
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.slot = np.full(1 << self.bits, len(keys), np.int32)
        self.slot[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    @classmethod
    def of(cls, name: str, broadcast):
        """One in a Python process, for the broadcast of that name."""
        if cls.last[0] != name:
            cls.last = (name, [cls(*x) for x in broadcast.value])
        return cls.last[1]

    def _slot(self, key):
        return ((key * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, list]:
        """Which keys are here, and their values (0 where they are not)."""
        at = self.slot[self._slot(key)]
        lost = np.flatnonzero(self.keys[at] != key)
        if len(lost):
            place = np.searchsorted(self.keys[:-1], key[lost])
            at[lost] = np.where(self.keys[place] == key[lost], place, len(self.keys) - 1)
        return at < len(self.keys) - 1, [v[at] for v in self.values]


def _frequent(table: DataFrame, values: list[str]) -> list[np.ndarray]:
    """Keys, ascending, and values (doubles) of table; they come to the driver as bytes, not as rows."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), pa.array([np.stack([c.to_numpy() for c in b.columns[1:]]).tobytes()], pa.binary())], names=["k", "v"])

    lots = [(r.k, r.v) for r in table.select("key", *(F.col(v).cast("double") for v in values)).mapInArrow(run, "k binary, v binary").toLocalIterator()]
    keys = np.concatenate([np.frombuffer(k, U64) for k, _ in lots] or [np.zeros(0, U64)])
    columns = np.concatenate([np.frombuffer(v).reshape(len(values), -1) for _, v in lots] or [np.zeros((len(values), 0))], axis=1)
    order = np.argsort(keys)
    return [keys[order], *(c[order] for c in columns)]


def _lists(values: np.ndarray, doc: np.ndarray, n: int):
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 5) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learned from rows whose crc32(id as text) modulo `fold` is not 1 (a null id counts as 0). Null texts are empty: one end
    token. Tokens are told apart by a 64-bit hash. Texts of any length are scored whole. Repeated rows repeat and count as often; equal texts have equal scores; an empty table gives no rows; with
    no training rows every bit has about even odds. Further columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (crc_mod(F.col(id_col).cast("long"), fold) == 1).alias("held_out"))
    with arrow_rows(spark, BATCH_ROWS):
        found = settle(counted(rows))
    strings, words = found.filter(F.col("kind") == STRING).drop("kind"), found.filter(F.col("kind") == WORD).drop("kind")
    pairs = spark.sparkContext.broadcast(first_orders(strings))
    packs = settle(packed(strings))
    with arrow_rows(spark, 1):
        weights, refined = learn(packs, pairs)
        values = settle(scored(packs, pairs, weights, refined))
    discard(packs)

    sums = words.filter("n > 0").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).first()
    total, below = sums.total or 0, (sums.total or 0) + 0.5 * (sums.distinct + 1)
    words = words.select("key", "m", F.log10((F.col("n") + 0.5) / F.lit(float(below))).alias("base"), (F.col("n") > 0).cast("double").alias("seen"))
    word_least, string_least = _least(words, "m", FREQUENT_WORDS), _least(values, "m", FREQUENT_STRINGS)
    here = _frequent(words.filter(F.col("m") >= word_least), ["base", "seen"]), _frequent(values.filter(F.col("m") >= string_least), ["value"])
    name, known = uuid.uuid4().hex, spark.sparkContext.broadcast(here)
    del here

    def run(batches):
        in_words, in_strings = _Lookup.of(name, known)
        for piece, data, off in slices(batches, most=SLICE):
            n = len(off) - 1
            window, of = strings_of(data, off)
            near, (fit,) = in_strings(window)
            token, first = tokens_of(data, off)
            doc = np.repeat(np.arange(n), np.diff(first))
            there, (base, seen) = in_words(token)
            total = lambda at, v: np.bincount(at, weights=v, minlength=n)
            columns = [piece.column(0), piece.column(2), pa.array(np.diff(first)), pa.array(total(doc, seen).astype(np.int64)), pa.array(total(doc, base))]
            columns += [pa.array(total(of, fit)), pa.array(np.bincount(of, minlength=n)), _lists(token[~there], doc[~there], n), _lists(window[~near], of[~near], n)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "bytes", "words", "strings"])

    result = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, bytes long, words array<long>, strings array<long>"
    with arrow_rows(spark, BATCH_ROWS):
        part = settle(rows.mapInArrow(run, result).withColumn("row", F.monotonically_increasing_id()))
    rare = words.filter(F.col("m") < word_least).select("key", "base", "seen")
    more_words = part.select("row", F.explode("words").alias("key")).join(rare, "key").groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("seen").alias("more_known"))
    rare = values.filter(F.col("m") < string_least).select("key", "value")
    more_strings = part.select("row", F.explode("strings").alias("key")).join(rare, "key").groupBy("row").agg(F.sum("value").alias("more_score"))
    whole = part.join(more_words, "row", "left").join(more_strings, "row", "left").fillna(0.0, ["more_base", "more_known", "more_score"])
    mine = F.col("score") + F.col("more_score")
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("more_known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more_base")).alias("base_score"),
        F.round(mine, 7).alias("score"),
        (-mine / F.log10(F.lit(2.0)) / F.col("bytes")).alias("bits_per_byte"),
    )


def op2_lm_score(spark, sf_dir):
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
