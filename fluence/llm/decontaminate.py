"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

Training words stream through the automaton, which keeps the longest suffix that occurs in any item; where that is at
least a window long, the window's words are hit. Only runs of benchmark words that are long enough enter the automaton.
"""

from __future__ import annotations

import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .shared import ALNUM, LOWER, TO_WORDS, slices, word_hashes, word_spans

WINDOW = 10
#: Benchmark bytes in one automaton; a larger benchmark is dealt over several, whose hits are united.
AUTOMATON_BYTES = 8_000_000


class SuffixAutomaton:
    """Over sequences of words; tells for each state the sequences in which it occurs.

    Nearly all states have one way on, so that is kept in two flat arrays, further ones in a dictionary; the items of a state
    are those whose prefixes end below it in the tree of suffix links, and are gathered when a text first meets it."""

    def __init__(self, items: list[tuple[str, list]], window: int = WINDOW):
        self.window = window
        self.ids = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}  # 0 is no word
        self.word, self.to, self.more = array("i", [0]), array("i", [0]), {}  # type: ignore[var-annotated]
        self.link, self.len = array("i", [-1]), array("i", [0])
        coded = [(name, [self.ids[w] for w in words]) for name, words in items]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.names = [name for name, _ in coded]
        self.whole: dict[int, list] = {}
        state_of, item_of = array("i"), array("i")
        for k, (name, words) in enumerate(coded):
            state = 0
            for w in words:
                state = self._next(state, w)
                state_of.append(state)
                item_of.append(k)
            if 0 < len(words) < window:
                self.whole.setdefault(state, []).append((len(words), name))
        self.least = min([window, *(len(w) for _, w in items if w)])
        order = np.argsort(np.array(state_of, np.int32), kind="stable")
        self.prefix, self.item = np.array(state_of, np.int32)[order], np.array(item_of, np.int32)[order]
        links = np.array(self.link, np.int32)
        self.below = np.argsort(links, kind="stable").astype(np.int32)
        self.links = links[self.below]
        self.known: dict[int, frozenset] = {}

    def _next(self, state: int, w: int) -> int:
        """The state after w, or -1."""
        if self.word[state] == w:
            return self.to[state]
        more = self.more.get(state)
        return more.get(w, -1) if more else -1

    def _put(self, state: int, w: int, target: int) -> None:
        if self.word[state] in (0, w):
            self.word[state], self.to[state] = w, target
        else:
            self.more.setdefault(state, {})[w] = target

    def _new(self, size: int, link: int) -> int:
        for a, v in ((self.word, 0), (self.to, 0), (self.link, link), (self.len, size)):
            a.append(v)
        return len(self.len) - 1

    def _extend(self, last: int, w: int) -> int:
        q = self._next(last, w)
        if q >= 0:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur, p = self._new(self.len[last] + 1, 0), last
        while p >= 0 and (q := self._next(p, w)) < 0:
            self._put(p, w, cur)
            p = self.link[p]
        if p >= 0:
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._new(self.len[p] + 1, self.link[q])
        self.word[c], self.to[c] = self.word[q], self.to[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[q] = c
        while p >= 0 and self._next(p, w) == q:
            self._put(p, w, c)
            p = self.link[p]
        return c

    def _holders(self, state: int) -> frozenset:
        """The items that hold the last `window` words of a state."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        if state not in self.known:
            found, todo = set(), [state]
            while todo:
                s = todo.pop()
                a, b = np.searchsorted(self.prefix, [s, s + 1])
                found.update(self.item[a:b].tolist())
                a, b = np.searchsorted(self.links, [s, s + 1])
                todo += self.below[a:b].tolist()
            self.known[state] = frozenset(self.names[k] for k in found)
        return self.known[state]

    def scan(self, words: list) -> tuple[np.ndarray, set]:
        """Which words stand in an occurrence of a window, and the items whose windows occur."""
        hit, found, state, length = np.zeros(len(words), bool), set(), 0, 0
        ids, word, to, more, link, size, window = self.ids, self.word, self.to, self.more, self.link, self.len, self.window
        for i, text in enumerate(words):
            w = ids.get(text, -1)
            while True:
                if word[state] == w:
                    state = to[state]
                    length += 1
                    break
                after = more[state].get(w, -1) if state in more else -1
                if after >= 0:
                    state = after
                    length += 1
                    break
                if not state:
                    length = 0
                    break
                state = link[state]
                length = size[state]
            if length >= window:
                hit[i - window + 1 : i + 1] = True
                found |= self._holders(state)
            if self.whole and state:
                up, reach = state, length
                while up > 0:
                    for n, name in self.whole.get(up, ()):
                        if n <= reach:
                            hit[i - n + 1 : i + 1] = True
                            found.add(name)
                    up = link[up]
                    reach = size[up]
        return hit, found


def item_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


_built: dict[str, tuple] = {}


def _automaton(shared) -> tuple[SuffixAutomaton, np.ndarray]:
    """Built once in a Python process."""
    if shared.id not in _built:
        items = [(name, item_words(text)) for name, text in shared.value[0]]
        _built.clear()
        automaton = SuffixAutomaton(items, shared.value[1])
        vocabulary = list(automaton.ids)
        flat = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary], dtype=np.int64) if vocabulary else np.zeros(0, np.int64)
        _built[shared.id] = automaton, np.sort(word_hashes(flat, ends - np.array([len(w) for w in vocabulary], np.int64), ends))
    return _built[shared.id]


class _Shared:
    """A broadcast with a name, by which a process knows what it has built from it."""

    def __init__(self, spark, value):
        self.id, self._b = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._b.value


def _runs(piece, data, off, shared):
    """For each text of a piece: words, hit words, items, spans."""
    automaton, vocabulary = _automaton(shared)
    data = LOWER[data]
    start, end, first = word_spans(data, off, ALNUM)
    n = len(off) - 1
    words_of = np.diff(first)
    spans: list[list] = [[] for _ in range(n)]
    items: list[set] = [set() for _ in range(n)]
    hits = np.zeros(n, np.int64)
    if len(start) and len(vocabulary):
        h = word_hashes(data, start, end)
        at = np.searchsorted(vocabulary, h)
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == h
        edge = np.zeros(len(known) + 1, bool)
        edge[first] = True
        before = np.concatenate(([False], known[:-1])) & ~edge[:-1]
        after = np.concatenate((known[1:], [False])) & ~edge[1:]
        lo, hi = np.flatnonzero(known & ~before), np.flatnonzero(known & ~after) + 1
        keep = hi - lo >= automaton.least
        raw = data.tobytes()
        for a, b in zip(lo[keep].tolist(), hi[keep].tolist(), strict=True):
            hit, found = automaton.scan([raw[s:e] for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)])
            if found:
                doc = int(np.searchsorted(first, a, "right")) - 1
                items[doc] |= found
                hits[doc] += int(hit.sum())
                step = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                for x, y in zip(step[::2].tolist(), step[1::2].tolist(), strict=True):
                    spans[doc].append((a + x - int(first[doc]), a + y - int(first[doc]), int(start[a + x] - off[doc]), int(end[a + y - 1] - off[doc])))
    return words_of, hits, items, spans


def _shards(bench: DataFrame, id_col: str, text_col: str):
    """The benchmark's items in lists of bounded size, one after another."""
    b = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null and text is not null")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // AUTOMATON_BYTES) or 1
    for k in range(n):
        yield [(r.item, r.text) for r in b.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator()]


def matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, items (their ids as strings, sorted), spans (word numbers first
    to last, bytes start to end of the text; ends exclusive).

    A window is `window` consecutive words of an item, or a shorter item whole. Null and empty texts have no words; an
    empty benchmark hits nothing; items with a null id or text are passed over; items that share an id count once.
    Repeated document rows give repeated result rows. Further columns are ignored. A benchmark beyond one automaton goes
    over the rows shard by shard, and each row unites its spans and items.
    """
    spark = docs.sparkSession
    span = pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")])
    state = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    result = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long,start:long,end:long>>"
    shards, k = _shards(bench, item_col, text_col), 0
    items = next(shards)
    while items is not None:
        shared, items = _Shared(spark, (items, window)), next(shards, None)

        def run(batches, shared=shared, first=not k, last=items is None):
            for piece, data, off in slices(batches):
                words, hits, found, spans = _runs(piece, data, off, shared)
                if not first:
                    earlier = {name: piece.column(piece.schema.get_field_index(name)).to_pylist() for name in ("items", "spans")}
                    found = [x | set(y) for x, y in zip(found, earlier["items"], strict=True)]
                    spans = [_united(x + [tuple(s.values()) for s in y]) for x, y in zip(spans, earlier["spans"], strict=True)]
                    hits = np.array([sum(x[1] - x[0] for x in y) for y in spans], np.int64)
                columns = [piece.column(0), pa.array(words), pa.array(hits), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                columns.append(pa.array([[dict(zip(("first", "last", "start", "end"), y, strict=True)) for y in x] for x in spans], pa.list_(span)))
                names = ["doc_id", "n_words", "n_hit", "items", "spans"]
                if not last:  # the next automaton reads the text too
                    columns.append(piece.column(piece.schema.get_field_index("text")))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        state = state.mapInArrow(run, result if items is None else result + ", text string")
        k += 1
    return state


def _united(spans: list[tuple]) -> list[tuple]:
    """Overlapping or touching spans of words as one."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2], s[3])
        else:
            out.append(s)
    return out


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """docs without the hit spans; documents whose hit words are more than `most_coverage` of all words go.

    All columns come back, the text with its hit spans cut out. Documents without hits are unchanged, null and empty texts
    included. A benchmark beyond one automaton goes over the untouched text shard by shard; the rows carry their united
    spans in a further column, and coverage is tested and text cut once, after the last shard.
    """
    spark, schema = docs.sparkSession, docs.schema
    at = schema.fieldNames().index(text_col)
    width, carried = len(schema), f"spans_{uuid.uuid4().hex}"
    state = StructType([*schema.fields, StructField(carried, ArrayType(ArrayType(LongType())))])
    shards = _shards(bench, item_col, text_col)
    items, k = next(shards), 0
    while items is not None:
        shared, items = _Shared(spark, (items, window)), next(shards, None)

        def run(batches, shared=shared, first=not k, last=items is None):
            for piece, data, off in slices(batches, text_col):
                words, hits, _, spans = _runs(piece, data, off, shared)
                if not first:
                    spans = [_united(x + [tuple(s) for s in y]) for x, y in zip(spans, piece.column(width).to_pylist(), strict=True)]
                    hits = np.array([sum(x[1] - x[0] for x in y) for y in spans], np.int64)
                columns = list(piece.columns)[:width]
                if not last:
                    columns.append(pa.array([[list(s) for s in x] for x in spans], pa.list_(pa.list_(pa.int64()))))
                    yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names[:width], carried])
                    continue
                keep = hits <= most_coverage * words
                if hits.any():
                    raw, texts = data.tobytes(), columns[at].to_pylist()
                    for i in np.flatnonzero(hits).tolist():
                        one, out, done = raw[off[i] : off[i + 1]], [], 0
                        for _, _, a, b in spans[i]:
                            out.append(one[done:a])
                            done = b
                        texts[i] = b"".join([*out, one[done:]]).decode()
                    columns[at] = pa.array(texts, piece.schema.field(at).type)
                piece = pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(piece.schema)[:width]))
                yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema if items is None else state)
        k += 1
    return docs


def op4_decontaminate(spark, sf_dir):
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
