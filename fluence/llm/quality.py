"""Quality by attention over passages (multiple-instance learning).

A text is a bag of passages of 60 words. Every passage is encoded as shares of byte classes and of hashed words; gated
attention weights, learned from document labels, sum the passages into one vector, and that is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, NOT_SPACE, U64, crc_mod, settle, slices, small, word_hashes, word_spans

PASSAGE_WORDS = 60
BUCKETS = 48
HIDDEN, GATE = 16, 8
#: A word repeats if it equals one of so many words before it in its text.
REPEAT_WITHIN = 8
#: Labelled documents that are used for training, and their bytes, at most (about; a hash of the id picks them).
TRAIN_DOCS, TRAIN_BYTES = 8000, 48_000_000
EPOCHS = 40

# Byte classes by their members; any other ASCII byte is the last but one, other bytes the last.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r", ".", ",", "|", "!", "?", "#", "$", "%", "&", "*", "<>{}[]\\/=_", "\"'`-:;()+@~^"]
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _members in enumerate(CLASSES):
    _CLASS[[ord(c) for c in _members]] = _k
_CLASS[128:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
WIDTH = N_CLASSES + BUCKETS + 3


def encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of the texts, and for each text the offset of its first passage. A text without words has one passage.

    The vectors of a text depend on nothing but its bytes."""
    start, end, first = word_spans(data, off, NOT_SPACE)
    n_words = np.diff(first)
    per = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    begin = np.concatenate(([0], np.cumsum(per)))
    rank = np.arange(len(start)) - np.repeat(first[:-1], n_words)
    of_word = np.repeat(begin[:-1], n_words) + rank // PASSAGE_WORDS
    # bytes belong to the passage of the last word that began; what stands before the first word, to the first passage
    mark = np.zeros(len(data) + 1, np.int64)
    heads = rank % PASSAGE_WORDS == 0
    later = heads & (rank > 0)
    mark[start[later]] = 1
    step = np.cumsum(mark[:-1]) - np.repeat(np.concatenate(([0], np.cumsum(mark)))[off[:-1]], np.diff(off))
    of_byte = np.repeat(begin[:-1], np.diff(off)) + step
    n = int(begin[-1])
    x = np.zeros((n, WIDTH), np.float32)
    size = np.maximum(np.bincount(of_byte, minlength=n), 1)[:, None]
    x[:, :N_CLASSES] = np.bincount(of_byte * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES) / size
    words = np.bincount(of_word, minlength=n)
    if len(start):
        h = word_hashes(LOWER[data], start, end)
        x[:, N_CLASSES : N_CLASSES + BUCKETS] = np.bincount(of_word * BUCKETS + (h % U64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS) / np.maximum(words, 1)[:, None]
        again = np.zeros(len(h), bool)
        for k in range(1, min(REPEAT_WITHIN + 1, len(h))):
            again[k:] |= (h[k:] == h[:-k]) & (rank[k:] >= k)  # words of the same text only
        x[:, -3] = np.bincount(of_word, weights=again.astype(float), minlength=n) / np.maximum(words, 1)
        x[:, -2] = np.bincount(of_word, weights=np.minimum(end - start, 40), minlength=n) / np.maximum(words, 1) / 10
    x[:, -1] = np.minimum(words, PASSAGE_WORDS) / PASSAGE_WORDS
    return x, begin


def _sigmoid(v):
    return 1 / (1 + np.exp(-np.clip(v, -30, 30)))


def forward(x: np.ndarray, begin: np.ndarray, p: dict):
    """Scores of the bags, and what backward needs."""
    xs = (x - p["mean"]) / p["dev"]  # in double precision where the model is (see scores)
    h = np.tanh(xs @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (t * s) @ p["a"]
    bag = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    e = np.exp(e - np.maximum.reduceat(e, begin[:-1])[bag])
    att = e / np.add.reduceat(e, begin[:-1])[bag]
    z = np.add.reduceat(att[:, None] * h, begin[:-1], axis=0)
    y = _sigmoid(z @ p["c"] + p["d"])
    return y, (xs, h, t, s, bag, att, z)


def _gradients(begin, p, y, target, weight, kept):
    xs, h, t, s, bag, att, z = kept
    dy = ((y - target) * weight / len(y)).astype(np.float32)
    dz = dy[:, None] * p["c"]
    dh = att[:, None] * dz[bag]
    datt = (h * dz[bag]).sum(axis=1)
    de = att * (datt - np.add.reduceat(att * datt, begin[:-1])[bag])
    dts = de[:, None] * p["a"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    dh += dt @ p["v"].T + ds @ p["u"].T
    dpre = dh * (1 - h * h)
    return {"w": xs.T @ dpre, "b": dpre.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ dy, "d": dy.sum()}


def fit(x: np.ndarray, begin: np.ndarray, target: np.ndarray, seed: int = 5) -> dict:
    """Gated attention learned with Adam on mini-batches of bags. One class, or no bag, gives a constant score."""
    rng = np.random.default_rng(seed)
    rate = float(target.mean()) if len(target) else 0.5
    draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
    p = {"mean": x.mean(axis=0) if len(x) else np.zeros(WIDTH, np.float32), "dev": (x.std(axis=0) if len(x) else np.zeros(WIDTH, np.float32)) + 1e-2, "w": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE), "c": np.zeros(HIDDEN, np.float32), "d": np.float32(np.log((rate + 0.01) / (1.01 - rate)))}
    if len(target) < 2 or rate in (0.0, 1.0):
        return p
    names = ("w", "b", "v", "u", "a", "c", "d")
    m, v = {k: 0 * p[k] for k in names}, {k: 0 * p[k] for k in names}
    count, size = 0, np.diff(begin)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(target))
        for i in range(0, len(order), 256):
            bags = np.sort(order[i : i + 256])
            rows = np.concatenate([np.arange(begin[k], begin[k + 1]) for k in bags])
            local = np.concatenate(([0], np.cumsum(size[bags])))
            y, kept = forward(x[rows], local, p)
            g = _gradients(local, p, y, target[bags], np.ones(len(bags)), kept)
            count += 1
            lr = 0.01 * (1 - 0.9 * epoch / EPOCHS)
            for k in names:
                g[k] = g[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**count)) / (np.sqrt(v[k] / (1 - 0.99**count)) + 1e-8)).astype(np.float32)
    return p


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int | None, fold: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, y) of labelled rows outside the held-out fold (crc32 of the id modulo `fold` is 1); all of them, or
    about `most` at most, picked by a hash of the id. Rows with a null label or id are left out, as are an id's further labels."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), fold) != 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    n = y.count() if most else 0
    if most and n > most:
        y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(small(y), "doc_id")


def bounded(rows: DataFrame, most_bytes: int) -> DataFrame:
    """rows (doc_id, text, ...), thinned by a hash of the id to about `most_bytes` bytes of whole texts at most."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows if size <= most_bytes else rows.filter(F.pmod(F.xxhash64(F.lit("bytes"), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * most_bytes / size))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> dict:
    """The model, from all passages of a bounded number of labelled documents (the bounds are `most` documents and
    `most_bytes` of text, which keep the passage vectors that come to the driver under 0.8 bytes a byte of text)."""

    def run(batches):
        for piece, data, off in slices(batches):
            x, begin = encode(data, off)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip(begin, begin[1:], strict=False)], pa.binary())], names=["doc_id", "y", "x"])

    sample = bounded(settle(training_rows(docs, labels, "quality", most)), most_bytes)
    rows = sorted(sample.mapInArrow(run, "doc_id long, y int, x binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows]
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32)
    return fit(x, np.concatenate(([0], np.cumsum([len(b) for b in bags]))).astype(np.int64), np.array([r.y for r in rows], np.float32))


def scores(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a further column: the score, 0 to 1, of the whole text. Null and empty texts have one empty passage, so they
    have a score too. All rows and columns stay; a column that has the new one's name is replaced. An empty table gives no
    rows. Equal texts have equal scores, whatever stands around them: passages see their own text only, and sums that may
    take another order in another batch are in double precision, of which nine decimals are kept."""
    docs = docs.drop(name)
    model = {k: np.asarray(v, np.float64) for k, v in model.items()}
    schema = docs.withColumn(name, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for piece, data, off in slices(batches, text_col):
            y, _ = forward(*encode(data, off), shared.value)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(np.round(y.astype(np.float64), 9))], names=[*piece.schema.names, name])

    return docs.mapInArrow(run, schema)


def op10_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).drop("text")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
