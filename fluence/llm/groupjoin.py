"""A Jaccard self-join on word shingles by a token-group matrix.

1. Similar documents are put into groups: the smallest shingle hash of each of BINS hash ranges leads a document to a leader, a
   document is compared with two leaders that most and at least half of its ranges name, and linked documents make components. Blocks of a component of about
   GROUP_DOCS documents are the groups; a document that has no link yet is a group of its own.
2. The matrix has a row for each group and token of its union, as far as a link between two groups needs it: a document with n
   shingles can be linked only with one that has one of its first n - ceil(0.8 n) + 1 tokens in any fixed order, and sizes
   near each other ask for more than one. Frequent tokens come last in the
   order; which they are is read off a count of all documents' tokens by SLOTS slots (it decides the order only).
3. Groups of two components that share enough of these tokens are candidates: each query (a document of one group) is held
   against the stored token union of the other, both as signatures of 16 bits a token, which only make the overlap look larger.
   Where |query and union| cannot reach 80 % of the query, the group stays closed.
4. Groups that stay are opened: their documents are compared with the query on full sets until one links, which joins the two
   components (all documents of a group are in one).

Every link is found: what is left out in steps 2 and 3 is proved to have none. Rows of a token are one for each group, not for
each document, so that copies do not fill a task; members of a group that many queries ask for are dealt out by a hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .neardup import _judged, components, shingle_hashes
from .shared import U64, discard, settle, slices, small

#: Ranges of the hashes whose smallest values lead documents to groups.
BINS = 16
#: Documents of a group, about.
GROUP_DOCS = 64
#: Slots of the token counts, as a power of two: a slot for each 16 tokens within these bounds.
SLOT_BITS = (12, 24)
#: Slots that are sent on together.
CHUNK = 1 << 16
#: Tokens of a set up to which its signature has 16 bits a token (32 beyond).
NARROW = 8192
#: Rows of one token that are paired at once.
PAIR_ROWS = 1024


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, mins) of rows (doc_id, text): set size, two hashes of the word sequence, and the smallest
    shingle hash of each of BINS ranges that has one."""
    edges = np.arange(BINS, dtype=U64) << U64(60)

    def run(batches):
        for piece, data, off in slices(batches):
            sets, k1, k2 = shingle_hashes(data, off)
            mins = []
            for s in sets:
                at = np.searchsorted(s, edges)
                at = np.unique(at[at < len(s)])
                mins.append(s[at].view(np.int64))
            ends = np.cumsum([0] + [len(m) for m in mins]).astype(np.int32)
            flat = np.concatenate(mins) if mins else np.zeros(0, np.int64)
            columns = [piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "key1", "key2", "mins"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, mins array<long>")


def token_sets(texts: DataFrame) -> DataFrame:
    """(node, tokens) of rows (node, text): the sorted shingle hashes end to end."""

    def run(batches):
        for piece, data, off in slices(batches):
            sets, _, _ = shingle_hashes(data, off)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])

    return texts.select("node", "text").mapInArrow(run, "node long, tokens binary")


def signature(s: np.ndarray) -> np.ndarray:
    """The low bits of a set's tokens, as many as there are tokens."""
    return s.astype(np.uint16 if len(s) <= NARROW else np.uint32)


def _signature_of(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if width == 2 else np.uint32)


def signatures(texts: DataFrame) -> DataFrame:
    """(node, tokens: struct of width and bits) of rows (node, text)."""

    def run(batches):
        for piece, data, off in slices(batches):
            found = [signature(s) for s in shingle_hashes(data, off)[0]]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([s.itemsize for s in found], pa.int32()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "width", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, width int, bits binary").select("node", F.struct("width", "bits").alias("tokens"))


def unions(signed: DataFrame) -> DataFrame:
    """(node: the group, tokens) of rows (grp, tokens): the union of its documents' signatures, read one by one."""

    def run(batches):
        at, union = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([union.itemsize], pa.int32()), pa.array([union.tobytes()], pa.binary())], names=["node", "width", "bits"])

        for b in batches:
            for group, width, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = _signature_of(raw, width)
                if group != at:
                    if at is not None:
                        yield row()
                    at, union = group, np.unique(own)
                elif own.itemsize == 2 or union.itemsize == 2:
                    union = np.union1d(union.astype(np.uint16), own.astype(np.uint16))
                else:
                    union = np.union1d(union, own)
        if at is not None:
            yield row()

    rows = signed.select("grp", "tokens.width", "tokens.bits").repartition("grp").sortWithinPartitions("grp")
    return rows.mapInArrow(run, "node long, width int, bits binary").select("node", F.struct("width", "bits").alias("tokens"))


class _Bound:
    """Opens a group for a query if enough of the query's tokens may be in the group's union; values are signatures."""

    def __init__(self, least: int):
        self.least = least

    def pieces(self, batches):
        for b in batches:
            yield (*(b.column(i).to_pylist() for i in range(4)), [_signature_of(x["bits"], x["width"]) for x in b.column(4).to_pylist()])

    def links(self, union, query) -> bool:
        kind = min(union.dtype, query.dtype, key=lambda d: d.itemsize)
        return 100 * int(np.isin(query.astype(kind), union.astype(kind)).sum()) >= self.least * len(query)


class _Sets:
    """Links two documents by their full sets."""

    def __init__(self, least: int):
        self.least = least

    def pieces(self, batches):
        for b in batches:
            yield (*(b.column(i).to_pylist() for i in range(4)), [np.frombuffer(x, U64) for x in b.column(4).to_pylist()])

    def links(self, a, b) -> bool:
        if 100 * min(len(a), len(b)) < self.least * max(len(a), len(b)):
            return False
        both = np.intersect1d(a, b, assume_unique=True).size
        return 100 * both >= self.least * (len(a) + len(b) - both)


def _squeezed(counts: np.ndarray) -> bytes:
    """Counts (a multiple of 8 of them), compressed bit place by bit place: the upper places are almost all 0 and take no room."""
    return zlib.compress(np.packbits(np.unpackbits(counts.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).T).tobytes(), 1)


def _spread(raw: bytes) -> np.ndarray:
    places = np.unpackbits(np.frombuffer(zlib.decompress(raw), np.uint8)).reshape(64, -1)
    return np.packbits(places.T).view("<u8")


def frequent_slots(texts: DataFrame, tokens: int) -> np.ndarray:
    """Which slots (low bits of a token's hash) hold far more of all texts' tokens than the mean. Tasks add up their own texts;
    their counts are summed in two steps, and one bit for each slot comes to the driver (2 MB at most)."""
    bits = min(max(int(tokens // 16).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])
    size = 1 << bits
    mean = tokens / size
    most = mean + 8 * mean**0.5 + 48

    def count(batches):
        total = np.zeros(size, np.uint32)
        for _, data, off in slices(batches):
            for s in shingle_hashes(data, off)[0]:
                total[(s & U64(size - 1)).astype(np.int64)] += np.uint32(1)
        for a in range(0, size, CHUNK):
            part = total[a : a + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([_squeezed(part)], pa.binary())], names=["chunk", "counts"])

    def add(batches, last=False):
        at, total = None, None

        def row():
            out = zlib.compress(np.packbits(total > most).tobytes(), 1) if last else _squeezed(total)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out], pa.binary())], names=["chunk", "counts"])

        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if chunk != at:
                    if at is not None:
                        yield row()
                    at, total = chunk, np.zeros(min(CHUNK, size), "<u8")
                total += _spread(counts)
        if at is not None:
            yield row()

    kind = "chunk long, counts binary"
    parts = texts.select("text").mapInArrow(count, kind)
    dealt = parts.withColumn("salt", F.spark_partition_id() % 16).repartition("chunk", "salt").sortWithinPartitions("chunk", "salt").select("chunk", "counts")
    once = dealt.mapInArrow(add, kind)
    found = np.zeros(size, bool)
    for r in once.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lambda b: add(b, True), kind).toLocalIterator():
        part = np.unpackbits(np.frombuffer(zlib.decompress(r.counts), np.uint8))
        found[r.chunk : r.chunk + min(CHUNK, size)] = part[: min(CHUNK, size)].astype(bool)
    return found


def prefix(s: np.ndarray, frequent: np.ndarray, least: int) -> np.ndarray:
    """The first tokens of a sorted set, frequent ones last, of which a linked document must have one."""
    late = frequent[(s & U64(len(frequent) - 1)).astype(np.int64)]
    n = len(s)
    return np.concatenate((s[~late], s[late]))[: n - -(-least * n // 100) + 1]


def matrix(grouped: DataFrame, frequent: np.ndarray, least: int) -> DataFrame:
    """The token-group matrix (token, grp, component, low, high, many) of rows (node, component, grp, many, text), a group's rows being
    next to each other: for each group the tokens that links need, with the range of its documents' sizes."""
    sent = grouped.sparkSession.sparkContext.broadcast(np.packbits(frequent))
    size = len(frequent)

    def run(batches):
        late = np.unpackbits(sent.value)[:size].astype(bool)
        at, held, low, high = None, [], 0, 0

        def lot():
            tokens = np.unique(np.concatenate(held)) if at[2] else held[0]
            return tokens, *(np.full(len(tokens), v, kind) for v, kind in ((at[1], np.int64), (at[0], np.int64), (low, np.int32), (high, np.int32), (at[2], bool)))

        def batch(out):
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), *(pa.array(x) for x in columns[1:])], names=["token", "grp", "component", "low", "high", "many"])

        for piece, data, off in slices(batches):
            sets, out = shingle_hashes(data, off)[0], []
            for component, group, many, s in zip(*(piece.column(i).to_pylist() for i in (1, 2, 3)), sets, strict=True):
                if not len(s):
                    continue
                if at != (component, group, many) or not many:
                    if held:
                        out.append(lot())
                    at, held, low, high = (component, group, many), [], len(s), len(s)
                held.append(prefix(s, late, least))
                low, high = min(low, len(s)), max(high, len(s))
            if out:
                yield batch(out)
        if held:
            yield batch([lot()])

    return grouped.select("node", "component", "grp", "many", "text").mapInArrow(run, "token long, grp long, component long, low int, high int, many boolean")


def _pairs_of(columns: list[np.ndarray], least: int):
    """Index pairs of the rows (token, grp, component, low, high, many; sorted by token) that share a token, in different components and
    of fitting sizes, in bounded lots."""
    token, _, component, low, high, _ = columns
    start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.append(start, len(token)))
    mixed = np.minimum.reduceat(component, start) != np.maximum.reduceat(component, start)

    def fitting(i, j):
        ok = (component[i] != component[j]) & (100 * high[i].astype(np.int64) >= least * low[j]) & (100 * high[j].astype(np.int64) >= least * low[i])
        return i[ok], j[ok]

    few = mixed & (size <= PAIR_ROWS)
    end = np.repeat(start[few] + size[few], size[few])
    i = np.arange(size[few].sum()) + np.repeat(start[few] - (np.cumsum(size[few]) - size[few]), size[few])
    for d in range(1, PAIR_ROWS):
        keep = i + d < end
        i, end = i[keep], end[keep]
        if not len(i):
            break
        yield fitting(i, i + d)
    for a, n in zip(start[mixed & ~few].tolist(), size[mixed & ~few].tolist(), strict=True):
        for k in range(0, n, PAIR_ROWS):
            own = np.arange(a + k, a + min(n, k + PAIR_ROWS))
            for m in range(k, n, PAIR_ROWS):
                other = np.arange(a + m, a + min(n, m + PAIR_ROWS))
                i, j = np.repeat(own, len(other)), np.tile(other, len(own))
                yield fitting(i[i < j], j[i < j])


def candidates(rows: DataFrame, least: int) -> DataFrame:
    """(a, b), a < b: groups of different components that may hold a link.

    Two documents with n and m shingles share s = ceil(0.8 (n + m) / 1.8) at least. Of the two, look at the one whose matrix tokens
    end first in the order: all but n - s of them at most are shared, and stand among the other's matrix tokens too, as these
    reach further. Which one ends first is not kept, so the smaller of both numbers is asked for; fewer prove that there is no
    link. A group of several documents asks for one."""

    def run(batches):
        held = None
        for b in batches:
            columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns, strict=True)]
            new = np.flatnonzero(held[0][1:] != held[0][:-1])
            cut = int(new[-1]) + 1 if len(new) else 0
            if cut:
                yield from found([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield from found(held)

    def found(columns):
        _, group, _, low, _, many = columns
        n = low.astype(np.int64)
        kept = 1 - -(-least * n // 100)  # tokens in the matrix, less the set's size
        for i, j in _pairs_of(columns, least):
            if not len(i):
                continue
            shared = -(-least * (n[i] + n[j]) // (100 + least))
            need = np.where(many[i] | many[j], 1, np.maximum(1, shared + np.minimum(kept[i], kept[j])))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(group[i], group[j])), pa.array(np.maximum(group[i], group[j])), pa.array(need)], names=["a", "b", "need"])

    met = rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, "a long, b long, need long")
    return met.groupBy("a", "b").agg(F.count("*").alias("met"), F.max("need").alias("need")).filter("met >= need").select("a", "b")


def _groups(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """(node, component, grp, many): linked documents in blocks of their component, named by a block's smallest document."""
    blocks = label.groupBy("component").agg(F.ceil(F.count("*") / GROUP_DOCS).alias("blocks"))
    cut = label.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    names = cut.groupBy("component", "block").agg(F.min("node").alias("grp"))
    cut = cut.join(names, ["component", "block"]).select("node", "component", "grp")
    own = lambda c: F.coalesce(c, "node").alias(c)
    return nodes.join(cut, "node", "left").select("node", own("component"), own("grp"), F.col("grp").isNotNull().alias("many"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links).

    Links: 100 * intersection >= least_percent * union of distinct five-word shingles (whole sequence for fewer words). Null and
    empty texts, and texts without words, have no shingles and link with nothing. Repeated rows and equal texts share a
    component. Rows that share an id are one document. A null id gets a null component. An empty table gives no rows; further
    columns are ignored; texts of any length are read whole."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sk = settle(sketches(docs))
    worded = sk.filter("n_shingles > 0 and doc_id is not null")
    classes = settle(worded.groupBy("key1", "key2").agg(F.min("doc_id").alias("node")))
    nodes = settle(classes.select("node").distinct())
    few = small(nodes)
    texts = docs.withColumnRenamed("doc_id", "node").join(few, "node", "left_semi")

    # similar documents, by leaders
    mins = worded.withColumnRenamed("doc_id", "node").join(few, "node", "left_semi").select("node", F.size("mins").alias("bins"), F.explode("mins").alias("bucket")).distinct()
    heads = mins.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("docs")).filter("docs > 1")
    stars = mins.join(heads, "bucket").filter("leader <> node").groupBy("leader", F.col("node").alias("member"), "bins").agg(F.count("*").alias("shared"))
    best = stars.filter("2 * shared >= bins").withColumn("r", F.row_number().over(Window.partitionBy("member").orderBy(F.desc("shared"), "leader")))
    near = settle(best.filter("r <= 2").select("leader", "member"))
    asked = settle(near.select(F.explode(F.array("leader", "member")).alias("node")).distinct())
    first = settle(token_sets(texts.join(small(asked), "node", "left_semi")))
    links = settle(_judged(near, first, "tokens", _Sets(least_percent)))
    label = components(links)

    # groups, their tokens, and groups that may hold links
    members = settle(_groups(nodes, label))
    known = docs.withColumnRenamed("doc_id", "node").join(small(members), "node")
    tokens = sk.agg(F.sum("n_shingles")).first()[0] or 0
    frequent = frequent_slots(docs, tokens)
    alone, together = known.filter("not many"), known.filter("many").repartition("grp").sortWithinPartitions("component", "grp")
    rows = matrix(alone.select("node", "component", "grp", "many", "text").union(together.select("node", "component", "grp", "many", "text")), frequent, least_percent)
    likely = settle(candidates(rows, least_percent))

    # groups are opened for the queries whose tokens their unions hold
    asks = settle(likely.join(members.select("node", F.col("grp").alias("b")), "b").select(F.col("a").alias("leader"), F.col("node").alias("member")).distinct())
    wanted = settle(likely.select(F.explode(F.array("a", "b")).alias("grp")).distinct())
    inside = settle(members.join(small(wanted), "grp", "left_semi").select("node", "grp"))
    signed = settle(signatures(texts.join(small(inside.select("node").distinct()), "node", "left_semi")))
    held = unions(signed.join(inside, "node").join(likely.select(F.col("a").alias("grp")).distinct(), "grp", "left_semi"))
    opened = settle(_judged(asks, signed, "tokens", _Bound(least_percent), held))
    # a query is held against the group's documents until one links: a group is in one component, so its name stands for it
    own = settle(inside.join(small(opened.select(F.col("leader").alias("grp")).distinct()), "grp", "left_semi"))
    needed = settle(own.select("node").union(opened.select("member")).distinct())
    sets = settle(token_sets(texts.join(small(needed), "node", "left_semi")))
    documents = sets.join(own, "node").select(F.col("grp").alias("node"), "tokens")
    last = settle(_judged(opened, sets, "tokens", _Sets(least_percent), documents))
    if not last.isEmpty():
        label = components(links.unionByName(last))
    discard(near, asked, first, links, members, likely, asks, wanted, inside, signed, own, needed, sets, opened, last, nodes)

    named = classes.join(label, "node", "left").select("key1", "key2", F.coalesce("component", "node").alias("found"))
    hit = sk.select("doc_id", "n_shingles", "key1", "key2").join(named, ["key1", "key2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    return hit.select("doc_id", "n_shingles", own.alias("component_id"))


def op13_group_jaccard_join(spark, sf_dir):
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# Another way: every pair that shares a shingle is counted; components by smallest labels.
OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [hash(array_to_string(w, ' '))] ELSE [] END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS doc_id, v AS other FROM ways UNION SELECT reach.doc_id, ways.v FROM reach JOIN ways ON ways.u = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) r USING (doc_id)
"""
