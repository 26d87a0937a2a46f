"""Near-duplicates by HyperMinHash.

Every document's distinct five-word shingles are hashed; the top bits choose one of 256 registers, and a register keeps
the smallest remainder as its count of leading zeros and ten mantissa bits. Bands of five compressed registers find
candidates, the collision-corrected register estimate drops the hopeless ones before any text moves, and every link is
confirmed on the two full shingle sets. With 51 bands a pair at similarity 0.75 is missed with probability
(1 - 0.75**5)**51 = 1e-6; the estimate drops a pair where it is SIGMAS of its own deviations below the threshold.

Work is kept near linear in a group's size: equal token sequences are one node; in a bucket every node is compared with the
bucket's smallest id only, and links make components. Of the nodes that shared a bucket, pairs of different components are
then compared where they share one of their rarest shingles: a linked pair must (exact prefix bound), a group's common text
does not lead to pairs. No key holds a group in one task: buckets and shingles are counted with partial sums and joined back,
and the members of a leader are dealt out by a hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, NOT_SPACE, U64, arrow_rows, discard, mix, settle, slices, small, span_hashes, word_hashes, word_spans

WORDS = 5
REGISTERS = 256
MANTISSA = 10
BAND_ROWS = 5
BANDS = REGISTERS // BAND_ROWS
#: Members that a task compares with one leader; a leader with more is dealt to several tasks.
SALT_ROWS = 2000
#: Deviations by which a register estimate must miss the threshold before a pair is dropped.
SIGMAS = 6.0
#: Edges whose components one task works on.
EDGES_AT_ONCE = 250_000
#: Shingles that a task sums up before it hands them on.
HOLD_SHINGLES = 200_000
#: Rows of an Arrow batch, and bytes of text that are turned into arrays at once: two tasks of an executor hold both.
BATCH_ROWS = 1000
BATCH_BYTES = 500_000
#: Bits (of hashes) of the filter by which shingles that are in one component only stay out of the shuffle.
FILTER_BITS = 26

_COEF = mix(np.arange(11, 11 + WORDS, dtype=U64)) | U64(1)
_DONORS = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=U64) + U64(77)).reshape(REGISTERS, REGISTERS), axis=1, kind="stable").astype(np.int64)


def shingle_hashes(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each text its sorted distinct shingle hashes; and two hashes of its whole word sequence."""
    data = LOWER[data]
    start, end, first = word_spans(data, off, NOT_SPACE)
    words = word_hashes(data, start, end)
    key1 = span_hashes(mix(words + U64(1)), first[:-1], first[1:], 5)
    key2 = span_hashes(mix(words ^ U64(0xABCDEF0123456789)), first[:-1], first[1:], 9)
    n = len(words) - WORDS + 1
    rolled = np.zeros(max(n, 0), U64)
    for j in range(WORDS if n > 0 else 0):
        rolled += words[j : j + n] * _COEF[j]
    rolled = mix(rolled)
    sets = []
    for a, b, k in zip(first[:-1].tolist(), first[1:].tolist(), key1, strict=True):
        if b - a >= WORDS:
            s = np.sort(rolled[a : b - WORDS + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            sets.append(np.array([k] if b > a else [], U64))
    return sets, key1, key2


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (uint16) of each non-empty set; an empty register copies that of a fixed random order of donors."""
    width = U64(REGISTERS)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    cell = np.repeat(np.arange(len(sets), dtype=U64), sizes) * width + (flat >> U64(56))
    lead = np.concatenate(([True], cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, bool)
    at, low = cell[lead].astype(np.int64), (flat[lead] << U64(8)) | U64(1)
    zeros = (64 - np.frexp(low.astype(np.float64))[1]).clip(0, 63).astype(U64)
    code = (zeros << U64(MANTISSA)) | ((low << zeros << U64(1)) >> U64(64 - MANTISSA))
    out, full = np.zeros(len(sets) * REGISTERS, np.uint16), np.zeros(len(sets) * REGISTERS, bool)
    out[at], full[at] = code.astype(np.uint16), True
    known = out.copy()
    todo = np.flatnonzero(~full & np.repeat(sizes > 0, REGISTERS))
    for k in range(REGISTERS):
        if not len(todo):
            break
        donor = todo // REGISTERS * REGISTERS + _DONORS[todo % REGISTERS, k]
        ok = full[donor]
        out[todo[ok]] = known[donor[ok]]
        todo = todo[~ok]
    return out.reshape(-1, REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    r = regs[:, : BANDS * BAND_ROWS].reshape(len(regs), BANDS, BAND_ROWS).astype(U64)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64), r.shape[:2]).copy()
    for j in range(BAND_ROWS):
        key = mix(key * U64(0x100000001B3) + r[:, :, j] + U64(1))
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from the share of equal registers, less the share expected to be equal by chance."""
    same = float(np.mean(a == b))
    chance = sum(2.0 ** (-2 * (z + 1)) for z in range(20)) / (1 << MANTISSA)
    return max(0.0, (same - chance) / (1 - chance))


def may_link(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, least: int) -> bool:
    """False where sizes, or the estimate by SIGMAS of its deviations, leave no room for least percent of similarity.

    Registers of sets smaller than they are many repeat one another, so a set counts as one register a shingle at most."""
    if 100 * min(n_a, n_b) < least * max(n_a, n_b):
        return False
    p = least / 100
    return estimate(a, b) >= p - SIGMAS * (p * (1 - p) / min(REGISTERS, n_a, n_b)) ** 0.5


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, n_shingles, two hashes of the word sequence, registers (null for no words)."""

    def run(batches):
        for piece, data, off in slices(batches, most=BATCH_BYTES):
            sets, k1, k2 = shingle_hashes(data, off)
            regs = registers(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([r.tobytes() if n else None for r, n in zip(regs, sizes, strict=True)], pa.binary())],
                names=["doc_id", "n_shingles", "key1", "key2", "regs"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, regs binary")


def _banded(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                p = b.slice(i, 2000)
                regs = np.frombuffer(b"".join(p.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                keys = band_keys(regs)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(p.column(0).to_numpy(), BANDS)), pa.array(np.repeat(p.column(1).to_numpy().astype(np.int32), BANDS))], names=["bucket", "node", "n"])

    return nodes.select("node", "n_shingles", "regs").mapInArrow(run, "bucket long, node long, n int")


def _judged(pairs: DataFrame, payload: DataFrame, column: str, judge, heads_of: DataFrame | None = None) -> DataFrame:
    """The pairs (leader, member) that judge lets through, by each one's payload (node, column); leaders' in heads_of, if given.

    Rows of a leader are sorted behind the leader's own and streamed, so a group of any size takes the memory of two
    payloads. Members of a leader that has many are dealt out by a hash, so that none fills a task."""
    many = pairs.groupBy("leader").count().filter(F.col("count") > SALT_ROWS).select("leader", F.ceil(F.col("count") / SALT_ROWS).cast("int").alias("salts"))
    salted = pairs.join(small(many), "leader", "left").select("leader", "member", F.pmod(F.xxhash64("member"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    members = salted.join(payload, F.col("member") == F.col("node")).select("leader", "salt", F.lit(1).alias("kind"), "member", column)
    heads = salted.select("leader", "salt").distinct().join(payload if heads_of is None else heads_of, F.col("leader") == F.col("node")).select("leader", "salt", F.lit(0).alias("kind"), F.col("leader").alias("member"), column)

    def run(batches):
        at, heads = None, []
        for leaders, salts, kinds, members, values in judge.pieces(batches):
            out = []
            for leader, salt, kind, member, value in zip(leaders, salts, kinds, members, values, strict=True):
                if (leader, salt) != at:
                    at, heads = (leader, salt), []
                if kind == 0:
                    heads.append(value)
                elif any(judge.links(h, value) for h in heads):
                    out.append((leader, member))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["leader", "member"])

    rows = members.unionByName(heads).repartition("leader", "salt").sortWithinPartitions("leader", "salt", "kind")
    return rows.mapInArrow(run, "leader long, member long").distinct()


class _ByRegisters:
    """Judges pairs by their sizes and the corrected estimate; values are sizes and registers."""

    def __init__(self, least: int):
        self.least = least

    def pieces(self, batches):
        for b in batches:
            values = [(r["n"], np.frombuffer(r["regs"], np.uint16)) for r in b.column(4).to_pylist()]
            yield (*(b.column(i).to_pylist() for i in range(4)), values)

    def links(self, a, b) -> bool:
        return may_link(a[1], b[1], a[0], b[0], self.least)


class _ByTexts:
    """Judges pairs by 100 * intersection >= least * union of their full shingle sets; values are texts."""

    def __init__(self, least: int):
        self.least = least

    def pieces(self, batches):
        for piece, data, off in slices(batches, most=BATCH_BYTES):
            yield (*(piece.column(i).to_pylist() for i in range(4)), shingle_hashes(data, off)[0])

    def links(self, a, b) -> bool:
        n = len(a) + len(b)
        if 100 * min(len(a), len(b)) < self.least * max(len(a), len(b)):
            return False
        both = np.intersect1d(a, b, assume_unique=True).size
        return 100 * both >= self.least * (n - both)


def components(edges: DataFrame, a: str = "leader", b: str = "member") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node that can be reached.

    In each round a node takes the smallest label among its neighbours', and so does the node that its own label names (a
    root is hooked below what its tree's nodes meet); then each takes that label's own label (pointer jumping). Labels only
    fall and each is a node of the component, so when their sum stays, every edge has one label on both sides and that is
    the smallest node. Rounds go on until then. Labels stay distributed; they are broadcast only while they are few."""
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    both = settle(edges.union(edges.select("v", "u")).union(edges.select("u", "u")).union(edges.select("v", "v")).distinct())
    parts = max(4, both.count() // EDGES_AT_ONCE)
    label, total = settle(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).coalesce(parts)), None
    while True:
        known = small(label)
        met = both.join(known.select(F.col("node").alias("v"), "component"), "v").groupBy("u").agg(F.min("component").alias("low"), F.min(F.when(F.col("u") == F.col("v"), F.col("component"))).alias("own"))
        low = met.select(F.explode(F.array(F.struct(F.col("u").alias("node"), "low"), F.struct(F.col("own").alias("node"), "low"))).alias("x")).groupBy(F.col("x.node").alias("node")).agg(F.min("x.low").alias("low"))
        above = low.join(known.select(F.col("node").alias("low"), "component"), "low")
        older, label = label, settle(above.select("node", F.least("low", "component").alias("component")).coalesce(parts))
        discard(older)
        before, total = total, label.agg(F.sum(F.col("component").cast("decimal(28,0)"))).first()[0]
        if before == total:
            discard(both)
            return label


def _shingle_sums(labelled: DataFrame) -> DataFrame:
    """(shingle, times, low, high): in how many texts of labelled (node, component, text) it is, and the range of their
    components. Tasks sum their own texts up first, so a shingle of all texts leaves a task a few times."""

    def run(batches):
        parts, held = [], 0

        def lot():
            s, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(s, kind="stable")
            s, c = s[order], c[order]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            sums = s[first].view(np.int64), np.diff(np.append(first, len(s))), np.minimum.reduceat(c, first), np.maximum.reduceat(c, first)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in sums], names=["shingle", "times", "low", "high"])

        for piece, data, off in slices(batches, most=BATCH_BYTES):
            sets, _, _ = shingle_hashes(data, off)
            size = [len(x) for x in sets]
            if sum(size):
                parts.append((np.concatenate(sets), np.repeat(piece.column(1).to_numpy(), size)))
                held += sum(size)
            if held > HOLD_SHINGLES:
                yield lot()
                parts, held = [], 0
        if parts:
            yield lot()

    sums = labelled.mapInArrow(run, "shingle long, times long, low long, high long")
    return sums.groupBy("shingle").agg(F.sum("times").alias("times"), F.min("low").alias("low"), F.max("high").alias("high"))


def _filter_of(shared: DataFrame) -> bytes:
    """A bitmap of fixed size in which every shingle of `shared` has its bit; others mostly none."""
    size = 1 << (FILTER_BITS - 3)

    def run(batches):
        bits = np.zeros(size, np.uint8)
        for b in batches:
            h = b.column(0).to_numpy().view(U64) >> U64(64 - FILTER_BITS)
            np.bitwise_or.at(bits, (h >> U64(3)).astype(np.int64), (1 << (h & U64(7))).astype(np.uint8))
        for a in range(0, size, size // 64):
            if bits[a : a + size // 64].any():
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([zlib.compress(bits[a : a + size // 64].tobytes(), 1)], pa.binary())], names=["at", "bits"])

    def unite(frame):
        total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in frame["bits"]])
        return frame.iloc[:1].assign(bits=[zlib.compress(total.tobytes(), 1)])

    out = bytearray(size)
    for r in shared.select("shingle").mapInArrow(run, "at long, bits binary").groupBy("at").applyInPandas(unite, "at long, bits binary").toLocalIterator():
        part = zlib.decompress(r.bits)
        out[r["at"] : r["at"] + len(part)] = part
    return bytes(out)


def _rare(labelled: DataFrame, least: int) -> DataFrame:
    """(shingle, node, component, n, rank): the shingles that can prove a link, rarest first (rank from 0).

    A link leaves out so few of a node's n shingles that one of its rarest must be shared; only ranks up to n - least % of n
    can count, and of those only shingles that another component has too. How often a shingle occurs is summed over all
    texts given here, in two steps; only shingles of several components are joined back to their nodes."""
    shared = settle(_shingle_sums(labelled).filter("low < high").select("shingle", "times"))
    bits = labelled.sparkSession.sparkContext.broadcast(_filter_of(shared))

    def cut(batches):
        known = np.frombuffer(bits.value, np.uint8)
        for piece, data, off in slices(batches, most=BATCH_BYTES):
            sets, key, _ = shingle_hashes(data, off)
            size = np.array([len(x) for x in sets])
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
            h = flat >> U64(64 - FILTER_BITS)
            keep = np.flatnonzero((known[(h >> U64(3)).astype(np.int64)] >> (h & U64(7)).astype(np.uint8)) & 1)
            of = np.repeat(np.arange(len(sets)), size)[keep]
            columns = flat[keep].view(np.int64), piece.column(0).to_numpy()[of], piece.column(1).to_numpy()[of], size[of], key[of].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shingle", "node", "component", "n", "key"])

    def rank(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node, component, n = (b.column(i).to_numpy() for i in range(3))
            size = np.diff(b.column(3).offsets.to_numpy())
            times, shingle = (x.to_numpy() for x in b.column(3).flatten().flatten())
            of = np.repeat(np.arange(len(node)), size)
            shingle = shingle[np.lexsort((shingle, times, of))]  # shingles of one component only come before all of a text's others
            ranks = (n - np.cumsum(size))[of] + np.arange(len(of))
            keep = ranks <= (n - -(-least * n // 100))[of]
            columns = (x[keep] for x in (shingle, node[of], component[of], n[of], ranks))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["shingle", "node", "component", "n", "rank"])

    rows = labelled.mapInArrow(cut, "shingle long, node long, component long, n long, key long").join(small(shared), "shingle")
    of_text = rows.groupBy("node", "component", "n", "key").agg(F.collect_list(F.struct("times", "shingle")).alias("found")).drop("key")
    return of_text.mapInArrow(rank, "shingle long, node long, component long, n long, rank long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Links: 100 * intersection >= least_percent * union of distinct five-word shingles (whole sequence for fewer words).
    Null and empty texts, and texts without words, have no shingles and link with nothing. Repeated rows and equal texts
    share a component. Rows that share an id are one document. A null id gets a null component and is kept. An empty table
    gives no rows; further columns are ignored; texts of any length are read whole.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _near_duplicates(docs, id_col, text_col, least_percent)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, least_percent: int) -> DataFrame:
    sk = settle(sketches(docs, id_col, text_col))
    worded = sk.filter("n_shingles > 0 and doc_id is not null")
    classes = settle(worded.groupBy("key1", "key2").agg(F.min("doc_id").alias("node")))
    chosen = classes.select("node").distinct()
    nodes = settle(worded.join(small(chosen), F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "regs").dropDuplicates(["node", "regs"]))

    heads = settle(_banded(nodes).groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("many")).filter("many > 1").select("bucket", "leader"))
    met = settle(_banded(nodes).select("bucket", "node").join(small(heads), "bucket").select("leader", "node"))
    stars = settle(met.filter("leader <> node").groupBy("leader", F.col("node").alias("member")).agg(F.count("*").alias("shared")))
    wanted = settle(met.select("node").distinct())
    few = small(wanted)
    regs = nodes.join(few, "node", "left_semi").select("node", F.struct(F.col("n_shingles").alias("n"), "regs").alias("regs"))
    texts = settle(docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(few, "node", "left_semi"))
    found: list[DataFrame] = []

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = settle(_judged(pairs, regs, "regs", _ByRegisters(least_percent)))
        found.extend((likely, settle(_judged(likely, texts, "text", _ByTexts(least_percent)))))
        return found[-1]

    best = stars.withColumn("r", F.row_number().over(Window.partitionBy("member").orderBy(F.desc("shared"), "leader")))
    links = confirmed(best.filter("r = 1").select("leader", "member"))
    label = components(links)
    rest = best.filter("r > 1").select("leader", "member").join(label.select(F.col("node").alias("leader"), F.col("component").alias("c1")), "leader", "left").join(label.select(F.col("node").alias("member"), F.col("component").alias("c2")), "member", "left").filter(F.coalesce("c1", "leader") != F.coalesce("c2", "member")).select("leader", "member")
    links = links.unionByName(confirmed(rest))
    label = components(links)

    labelled = texts.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "text")
    rare = settle(_rare(labelled, least_percent))
    x, y = rare.alias("x"), rare.alias("y")
    shared = F.expr(f"({least_percent} * (x.n + y.n) + {least_percent + 99}) div {least_percent + 100}")  # a link's least intersection
    close: Column = (F.col("x.rank") <= F.col("x.n") - shared) & (F.col("y.rank") <= F.col("y.n") - shared)
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") < F.col("y.component")) & close).select(F.least("x.node", "y.node").alias("leader"), F.greatest("x.node", "y.node").alias("member")).distinct()
    last = confirmed(pairs.join(stars, ["leader", "member"], "left_anti"))
    if not last.isEmpty():
        label = components(links.unionByName(last))
    discard(nodes, heads, met, stars, wanted, texts, rare, *found)

    named = classes.join(label, "node", "left").select("key1", "key2", F.coalesce("component", "node").alias("found"))
    hit = sk.select("doc_id", "n_shingles", "key1", "key2").join(named, ["key1", "key2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    return hit.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
