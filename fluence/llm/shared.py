"""What the operators share: a folder all executors see, and Arrow batches as flat byte arrays."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Broadcast side limit in rows; beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that a Python task turns into arrays at once (a single longer text is taken whole).
SLICE_BYTES = 1_500_000


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local one only where it is unset and all executors are this machine (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for a session's context, so that its tasks import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_fluence_sent", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="fluence-")) / "fluence_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._fluence_sent = True


def shipped(query):
    """query, which sends the package before it runs."""

    @functools.wraps(query)
    def run(spark, *args, **kwargs):
        ship(spark)
        return query(spark, *args, **kwargs)

    return run


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Python tasks of jobs that run within get Arrow batches of at most `rows` rows; Spark and Python both hold a batch whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete what settle wrote, once nothing that is still to run reads it."""
    for df in settled:
        if hasattr(df, "settled_at"):
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(df.settled_at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame) -> DataFrame:
    """df (settled, so that its partitions stay) with idx, its rows' numbers from 0 without gaps: rows are counted by partition,
    and only these counts come to the driver."""
    part = F.spark_partition_id()
    counts = sorted((r.part, r["count"]) for r in df.groupBy(part.alias("part")).count().collect())
    ends = np.cumsum([0] + [c for _, c in counts])
    first = df.sparkSession.createDataFrame([(p, int(a)) for (p, _), a in zip(counts, ends, strict=False)], "part int, first long")
    own = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return df.withColumn("part", part).withColumn("own", own).join(F.broadcast(first), "part").withColumn("idx", F.col("own") + F.col("first")).drop("part", "own", "first")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, narrow rows of fixed size, with a broadcast hint if it has at most `rows` rows (counted up to that many), else as
    it is. It runs df once more to count, so df should be settled or cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc_mod(doc_id, n: int):
    """crc32 of the id as text, modulo n; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n)), F.lit(0)).cast("int")


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and n + 1 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        kind = np.int32
    else:
        kind = np.int64
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if not (pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)) else b"")
    _, off, data = col.buffers()
    o = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches so that each piece has about `most` bytes in `column`; yields (piece, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            j = min(j, batch.num_rows)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def lut(members) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = lut(b for b in range(256) if not (b == 0x20 or 9 <= b <= 13))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
ALNUM = lut(b for b in range(256) if not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))
#: A-Z to a-z, the rest unchanged
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: bytes.translate table: lower-case, and every byte that is no ALNUM word byte to a space
TO_WORDS = bytes(LOWER[b] if ALNUM[LOWER[b]] else 32 for b in range(256))

_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_powers = np.ones(1, U64), np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n, kept per process."""
    global _powers
    if len(_powers[0]) < n:
        a, b = np.full(n, _P), np.full(n, _P_INV)
        a[0] = b[0] = U64(1)
        _powers = np.cumprod(a, dtype=U64), np.cumprod(b, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, position independent."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], dtype=U64, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + U64(salt) + (end - start).astype(U64))


def word_spans(data: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the offset of its first word (n + 1 of them)."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word[data]
    left, right = inside[:-2].copy(), inside[2:].copy()
    cut = off[1:-1]
    left[cut[cut < n]] = False
    right[cut[cut > 0] - 1] = False
    start = np.flatnonzero(inside[1:-1] & ~left)
    end = np.flatnonzero(inside[1:-1] & ~right) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE[data], start, end)
