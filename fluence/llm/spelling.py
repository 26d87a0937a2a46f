"""Spelling variants by permuterm rotations.

A word with a terminator behind it has as many rotations as letters, and one more. Words that differ in one replaced letter have
rotations that differ in their last letter only; a word with one letter more has a rotation that is a rotation of the shorter
word and one letter behind. So the sorted rotations, each once whole and once without its last letter, bring all words of one
edit next to each other: a group is a whole rotation (of one word at most) and the rotations that begin with it and have one
letter more (as many as there are letters). Groups are scanned as they pass; what a word has met is summed over its groups.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, U64, discard, mix, settle, slices, span_hashes

#: No letter, so that a rotation tells where its word begins.
END = "$"
#: Letters of the longest word whose rotations are spelled out.
LONG = 64
#: Distinct words whose counts a task holds before it hands them on.
HOLD_WORDS = 300_000
_LOWER = LOWER.tobytes()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, damage: int | None = None) -> DataFrame:
    """(word, n): maximal runs of letters (A-Z lower-cased, a-z, U+00C0 to U+00FF) of at least least_length, over all texts.

    With damage, a run whose crc32 of "<id>:<run>" it divides loses the letter at crc32 modulo its length (so that texts without
    slips have some); a null id counts as an empty one. Tasks sum what they read before it is shuffled."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def run(batches):
        held: Counter = Counter()

        def lot():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for piece, data, off in slices(batches):
            flat = data.tobytes().translate(_LOWER)
            for i, a, b in zip(piece.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                found = Counter(runs.findall(flat[a:b].decode("utf-8", "replace")))
                if damage:
                    begin = zlib.crc32(b":" if i is None else b"%d:" % i)
                    for word, n in found.items():
                        h = zlib.crc32(word.encode(), begin)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        held[word] += n
                else:
                    held.update(found)
                if len(held) > HOLD_WORDS:
                    yield lot()
                    held.clear()
        if held:
            yield lot()

    words = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """(key, short, lead, n, word): each word's rotations whole (short 0) and, where the last letter is not the terminator, without
    it (short 1). lead is false where the letter before the skipped one is the same, as skipping either gives the same word."""
    length = F.length("word")
    turned = lambda j, skip: F.concat(F.substr("word", j + 1 + skip), F.lit(END), F.substr("word", F.lit(1), j))
    whole = F.transform(F.sequence(F.lit(0), length), lambda j: F.struct(turned(j, 0).alias("key"), F.lit(1).alias("lead"), F.lit(0).alias("short")))
    first = lambda j: (j == 0) | (F.substr("word", j + 1, F.lit(1)) != F.substr("word", j, F.lit(1)))
    short = F.transform(F.sequence(F.lit(0), length - 1), lambda j: F.struct(turned(j, 1).alias("key"), first(j).cast("int").alias("lead"), F.lit(1).alias("short")))
    return words.filter(length > 0).select(F.explode(F.concat(whole, short)).alias("x"), "n", "word").select("x.key", "x.short", "x.lead", "n", "word")


def _met(b: pa.Table) -> pa.RecordBatch:
    """What the words of whole groups have met, rows being sorted by key, short, falling n and word."""
    keys, words = (b.column(i).combine_chunks() for i in (0, 4))
    short, lead, n = (b.column(i).combine_chunks().to_numpy() for i in (1, 2, 3))
    rows = len(keys)
    start = np.flatnonzero(np.r_[True, pc.not_equal(keys.slice(1), keys.slice(0, rows - 1)).to_numpy(zero_copy_only=False)]) if rows else np.zeros(0, np.int64)
    size = np.diff(np.append(start, rows))
    start, size = start[size > 1], size[size > 1]
    at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    whole = (short[start] == 0).astype(np.int64)
    head, has, top, others = np.repeat(start, size), np.repeat(whole, size), np.repeat(start + whole, size), np.repeat(size - whole, size) - 1
    member = short[at] == 1

    # a letter-skipping rotation meets the group's others, and the shorter word
    own = at[member]
    head, has, top, others = head[member], has[member] & lead[own], top[member], others[member]
    count = others + has
    best = np.where(own == top, top + 1, top)
    best = np.where(others > 0, best, head)
    pick = np.flatnonzero((has == 1) & (others > 0))
    a, c = best[pick], head[pick]
    sooner = pc.less(words.take(pa.array(c)), words.take(pa.array(a))).to_numpy(zero_copy_only=False)
    best[pick] = np.where((n[c] > n[a]) | ((n[c] == n[a]) & sooner), c, a)
    own, best, count = own[count > 0], best[count > 0], count[count > 0]

    # a whole rotation meets those with a letter more, the most frequent of which comes first
    if len(at):
        edges = np.cumsum(size) - size
        longer = member & (lead[at] == 1)
        met, first = np.add.reduceat(longer.astype(np.int64), edges), np.minimum.reduceat(np.where(longer, at, rows), edges)
        ok = (whole == 1) & (met > 0)
        own, best, count = np.r_[own, start[ok]], np.r_[best, first[ok]], np.r_[count, met[ok]]
    return pa.RecordBatch.from_arrays([words.take(pa.array(own)), pa.array(count), pa.array(n[best]), words.take(pa.array(best))], names=["word", "met", "near_n", "near"])


def _scanned(rows: DataFrame, kind: str) -> DataFrame:
    """(word, met, near_n, near) of rows (key, short, lead, n, word: of the SQL type kind) by one pass over the sorted keys."""

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            keys = t.column(0).combine_chunks()
            if len(keys):
                new = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False))
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield _met(t.slice(0, cut))
                held = t.slice(cut)
        if held is not None:
            yield _met(held)

    return rows.repartition("key").sortWithinPartitions("key", "short", F.desc("n"), "word").mapInArrow(run, f"word {kind}, met long, near_n long, near {kind}")


def fingerprints(word: str, skip: int) -> bytes:
    """16 bytes for each of the word's rotations (skip 0), or of those without their last letter (skip 1)."""
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(U64)
    j, out = np.arange(len(letters) + 1 - skip), []
    for salt in (1, 2):
        x = mix(letters + U64(salt << 40))
        out.append(mix(span_hashes(x, j + skip, np.full(len(j), len(x))) * U64(3) + span_hashes(x, np.zeros(len(j), np.int64), j, 7)))
    return np.stack(out, 1).tobytes()


def long_rotations(words: DataFrame) -> DataFrame:
    """rotations() of words (word, n, idx) as fingerprints, with idx for the word. Words of LONG letters are there as the shorter
    ones of a pair only."""

    def run(batches):
        for b in batches:
            for word, n, idx in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                keys, short, lead = fingerprints(word, 0), np.zeros(len(word) + 1, np.int32), np.ones(len(word) + 1, np.int32)
                if len(word) > LONG:
                    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                    keys += fingerprints(word, 1)
                    short, lead = np.r_[short, np.ones(len(word), np.int32)], np.r_[lead, 1, letters[1:] != letters[:-1]].astype(np.int32)
                rows = len(short)
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), rows, [None, pa.py_buffer(keys)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([key, pa.array(short), pa.array(lead), pa.array(np.full(rows, n)), pa.array(np.full(rows, idx))], names=["key", "short", "lead", "n", "word"])

    return words.select("word", "n", "idx").mapInArrow(run, "key binary, short int, lead int, n long, word long")


def in_order(words: DataFrame) -> DataFrame:
    """words with idx, their numbers in code-point order: rows are sorted by ranges, and numbered within each range."""
    parts = settle(words.orderBy("word").withColumn("part", F.spark_partition_id()))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = parts.groupBy("part").agg(F.count("*").alias("rows")).select("part", before.alias("first"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("part").orderBy("word")) - 1
    return settle(parts.join(F.broadcast(first), "part").select("word", "n", (F.col("first") + own).alias("idx")))


def neighbours(words: DataFrame) -> DataFrame:
    """For words (word, n), distinct: a row per word that has near words (one inserted, deleted or replaced letter): their number
    n_near, and the one of largest n, of these the first in code-point order (near, near_n). Null and empty words have none."""
    met = _scanned(rotations(words.filter(F.length("word") <= LONG)), "string")
    if not words.filter(F.length("word") > LONG).isEmpty():
        ids = in_order(words.filter(F.length("word") >= LONG).select("word", "n"))
        own, other = ids.select(F.col("idx").alias("word"), F.col("word").alias("text")), ids.select(F.col("idx").alias("near"), F.col("word").alias("other"))
        met = met.unionByName(_scanned(long_rotations(ids), "long").join(own, "word").join(other, "near").select(F.col("text").alias("word"), "met", "near_n", F.col("other").alias("near")))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    return met.groupBy("word").agg(F.sum("met").alias("n_near"), best.alias("x")).select("word", "n_near", F.col("x.near").alias("near"), (-F.col("x.n")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), without circles: where following the forms ends. Each round doubles how far a word looks."""
    at = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        older, at = at, settle(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(older)
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, ratio: int = 10, damage: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least least_length letters that occurs least_count times.

    form is the near word of largest n if that is at least ratio times the word's own, else null; root is where following forms
    ends (the word itself without one). Null and empty texts have no words; repeated rows count again; texts of any length are
    read whole; an empty table gives no rows; further columns are ignored."""
    words = settle(word_counts(docs, id_col, text_col, least_length, damage).filter(F.col("n") >= least_count))
    near = neighbours(words)
    ok = F.col("near_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left")
    formed = settle(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("near")).alias("form"), F.when(ok, F.col("near_n")).alias("form_n")))
    discard(words)
    ends = roots(formed.filter("form is not null"))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir):
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=31)


# Another way: checksums by a table of 256 entries, near words by patterns with a gap and by words with a letter left out.
OP12_SQL = r"""
WITH RECURSIVE step AS (SELECT i, i::BIGINT AS v, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM step WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
per AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
codes AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM per),
hashed AS (SELECT run, c, xor(list_reduce([4294967295::BIGINT] || b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM codes, crc),
slips AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM slips WHERE length(word) >= 7 GROUP BY 1 HAVING sum(c) >= 2),
gaps AS MATERIALIZED (SELECT word, n, left(word, i::INT) || '*' || substr(word, i::INT + 2) AS pattern, left(word, i::INT) || substr(word, i::INT + 2) AS less FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.pattern = b.pattern AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.less UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.less),
best AS (SELECT word, count(*) AS n_near, max(m) AS top, arg_min(other, (-m, other)) AS other FROM pairs GROUP BY 1),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN other END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS last, 0 AS k FROM formed UNION ALL SELECT walk.word, f.form, k + 1 FROM walk JOIN formed f ON f.word = walk.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(last, k) AS root FROM walk GROUP BY 1) r USING (word)
"""
