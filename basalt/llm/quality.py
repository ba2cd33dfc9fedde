"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Random indexing: each word has a sparse ternary index vector, drawn from its hash; a word's context
vector is the sum of its own and its neighbours' index vectors over *all* documents. Words share
``BUCKETS`` hashed rows, so the sums have a fixed size whatever the corpus; each task adds up its
own, and these are added in two levels. Word endings (the last three bytes, case kept) get context
vectors in the same way. A document is the mean of its words' and endings' vectors, the norms of
these means and of the mean index vector of its word pairs (which rise with repetition), and its
logarithmic length.

The network (one hidden layer, logistic output) is fitted on at most ``most_labelled`` labelled rows
whose crc32(doc_id as text) mod 3 is not 1; a fifth of them is held back to fit the temperature that
calibrates its probabilities. Labels, lang, source and doc_id are never inputs.

Defined results: null and empty texts are scored as documents without words; a null doc_id has no
label and counts as not held out; several labels of a doc_id are averaged and rounded, half up; null
labels are ignored. Without labels, or with one class only, every score is the labels' smoothed mean
(0.5 without any). Repeated rows get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import sums
from .scratch import plain

BUCKETS, DIM, NONZERO = 8192, 32, 2
WIDTH = 2 * DIM + 4


def _index(buckets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """NONZERO pairs (place, sign) of the index vectors of hashed words."""
    h = K.mix(buckets.astype(K.U), 5)
    return [((h >> K.U(8 * k)).astype(np.int64) & (DIM - 1), 1 - 2 * ((h >> K.U(40 + k)).astype(np.int64) & 1)) for k in range(NONZERO)]


def _buckets(w: K.Words, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words and, from BUCKETS on, of their endings."""
    code = np.zeros(len(w.starts), K.U)
    for k in (1, 2, 3):
        at = w.ends - k
        code = code * K.U(257) + np.where(at >= w.starts, buf[np.maximum(at, 0)].astype(np.int64) + 1, 0).astype(K.U)
    return (w.hashes & K.U(BUCKETS - 1)).astype(np.int64), (K.mix(code, 9) & K.U(BUCKETS - 1)).astype(np.int64) + BUCKETS


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * BUCKETS * DIM, np.int64)
    for batch in batches:
        for _, _, buf, offsets in K.text_chunks(batch.column(0)):
            w = K.words(buf, offsets)
            if not len(w.hashes):
                continue
            own, ending = _buckets(w, buf)
            doc = w.doc
            same = doc[1:] == doc[:-1]
            index = _index(own)
            for row in (own, ending):
                cells, signs = [], []
                for place, sign in index:
                    cells += [row * DIM + place, row[1:][same] * DIM + place[:-1][same], row[:-1][same] * DIM + place[1:][same]]
                    signs += [sign, sign[:-1][same], sign[1:][same]]
                cells, signs = np.concatenate(cells), np.concatenate(signs)
                total += np.bincount(cells[signs > 0], minlength=len(total)) - np.bincount(cells[signs < 0], minlength=len(total))
    yield sums.emit(total, TaskContext.get().partitionId())


def context_vectors(docs: DataFrame) -> np.ndarray:
    """The (2 * BUCKETS, DIM) table of unit context vectors: 2 MB, whatever the input."""
    parts = plain(docs, text="string").mapInArrow(_contexts, sums.SCHEMA)
    out = sums.total(parts, 2 * BUCKETS * DIM).astype(np.float32).reshape(-1, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def features(w: K.Words, buf: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The pooled vector of each document of a chunk."""
    n, size = len(w.first) - 1, np.diff(w.first)
    out = np.zeros((n, WIDTH), np.float32)
    full = np.flatnonzero(size)
    if len(full):
        for k, rows in enumerate(_buckets(w, buf)):
            mean = np.add.reduceat(vectors[rows], w.first[full], axis=0) / size[full, None]
            out[full, k * DIM : (k + 1) * DIM] = mean
            out[full, 2 * DIM + k] = np.linalg.norm(mean, axis=1)
        pairs = K.grams(w.hashes, 2)
        bits = np.unpackbits(np.append(pairs, K.U(0)).view(np.uint8).reshape(-1, 8), axis=1)
        bits[np.maximum(w.first[full + 1] - 1, 0)] = 0  # a pair across two documents
        signs = 2 * np.add.reduceat(bits, w.first[full], axis=0, dtype=np.int32) - (size[full, None] - 1)
        spread = np.sqrt(np.mean(np.square(signs, dtype=np.float64), axis=1) / np.maximum(size[full] - 1, 1))
        out[full, 2 * DIM + 2] = np.log(spread + 0.1)  # near 0 where all pairs differ, whatever the length
    out[:, -1] = np.log1p(size)
    return out


class Network:
    """A two-layer network in numpy with a temperature; deterministic for given rows."""

    def __init__(self, hidden: int = 32, epochs: int = 40, seed: int = 7):
        self.hidden, self.epochs, self.seed = hidden, epochs, seed
        self.constant: float | None = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        if len(y) < 10 or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
            return self
        self.constant = None
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        held = np.arange(len(y)) % 5 == 4
        rng = np.random.default_rng(self.seed)
        w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], self.hidden)), np.zeros(self.hidden), rng.normal(0, np.sqrt(1 / self.hidden), (self.hidden, 1)), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        xs, ys = x[~held], y[~held].astype(float)[:, None]
        steps = self.epochs * max(1, len(ys) // 128)
        for _ in range(steps):
            pick = rng.integers(0, len(ys), min(128, len(ys)))
            a = xs[pick]
            h = np.maximum(a @ w[0] + w[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
            d = (p - ys[pick]) / len(pick)
            back = (d @ w[2].T) * (h > 0)
            grads = [a.T @ back + 1e-3 * w[0], back.sum(0), h.T @ d + 1e-3 * w[2], d.sum(0)]
            t += 1
            rate = 3e-3 * (1 - t / (steps + 1))
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.w = w
        z, target = self._logit(x[held]), y[held]
        loss = lambda s: np.mean(np.logaddexp(0, z / s) - target * z / s)
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return (np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])[:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self._logit((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def remainder(doc_id, by: int):
    """crc32(doc_id as text) modulo ``by``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> tuple[np.ndarray, Network]:
    """The context vectors of all documents and a network fitted on labelled rows."""
    vectors = context_vectors(docs)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vectors)
    known = plain(labels, doc_id="long", quality="double").where("doc_id is not null and quality is not null")
    known = known.where(remainder(F.col("doc_id"), 3) != 1).groupBy("doc_id").agg(F.floor(F.avg("quality") + 0.5).alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in K.text_chunks(batch.column(1)):
                x = features(K.words(buf, offsets), buf, sent.value)
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), K.keys_to_arrow(x)], names=["doc_id", "quality", "x"])

    rows = plain(docs, doc_id="long", text="string").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")
    rows = rows.mapInArrow(pooled, "doc_id long, quality long, x binary").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most_labelled).collect()
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, WIDTH)
    return vectors, Network().fit(x.astype(np.float64), np.array([r["quality"] for r in rows]))


def _scores(model):
    def of(column: pa.Array) -> np.ndarray:
        vectors, network = model.value
        parts = [network.score(features(K.words(buf, offsets), buf, vectors).astype(np.float64)) for _, _, buf, offsets in K.text_chunks(column)]
        return np.concatenate(parts) if parts else np.zeros(0)

    return of


def score(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    of = _scores(docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most_labelled)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(of(batch.column(1)))], names=["doc_id", "score"])

    out = plain(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns as they were."""
    of = _scores(docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most_labelled)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater_equal(pa.array(of(batch.column(at))), least))

    return docs.mapInArrow(run, docs.schema)
