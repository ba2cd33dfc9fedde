"""Language-model scores from a hierarchical Pitman-Yor model of word pairs.

Each context, the word before, has a restaurant of its own, named by its 64-bit hash; all context
restaurants share one parent, whose base is uniform over the vocabulary and one unknown word. A dish is a
word in a context, its customers are the occurrences; each table of a context restaurant is a customer of
the parent. Contexts are dealt to as many buckets as the text needs, so a context's dishes, customers and
tables stay together; a context with more than a bucket's share of all tokens is dealt over several buckets
by word, and its tables are added up apart. Only what the parent must know travels: the tables of each word
in a bucket go to the word's home, which adds them up and seats the parent's customers.

Seating is sampled by Gibbs, with every customer of every dish taking part in every sweep: the tables of a
dish are drawn anew from their exact conditional, given those of the other dishes and the parent's
probabilities of the sweep before. A restaurant first draws a weight, Gamma(strength / discount + its tables);
given that weight its dishes are independent, and a dish of c customers has t tables with probability
proportional to (discount * weight * parent's probability)^t times the generalised Stirling number of (c, t),
so dishes are drawn side by side without holding any still (``draw_tables``). Table sizes do not enter the
predictions and are not kept. Seating begins at the expected numbers of tables, and the first sweep repeats
its draws until the numbers of tables settle. The parent's customers, which change with every sweep, are
seated likewise. Discounts follow from the numbers of counts one and two. Predictive probabilities are
averaged over ``SAMPLES`` sweeps after the first ``BURN``. The sampler is seeded by bucket and sweep, so
reruns agree.

Every bucket exchanges a message with the homes of its words in each sweep, so ``bucket_bytes`` should grow
with the memory of a task: a tenth of the buckets have a hundredth of the messages.

Scores come from the buckets: each run of documents asks for the pairs it has, by their 64-bit hash, and
gets back one sum a document.

Defined results: null and empty texts are one token, the end; a document with a null id counts as a
training document; repeated rows each count. Without training documents counts are zero and
probabilities uniform. An empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, plain

SAMPLES, BURN = 5, 2
FLUSH = 1_000_000
#: Dishes of up to so many customers are drawn from listed weights, larger ones by rejection: the same distribution.
LISTED, SLICE = 512, 1 << 18
START, END = K.U(0x5D1E5A5A0F0F1234), K.U(0x1B873593CC9E2D51)


def tokens(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, document) of each token: the words of each document and its end."""
    n, size = len(w.first) - 1, np.diff(w.first)
    last = np.cumsum(size + 1) - 1
    word = np.empty(len(w.hashes) + n, K.U)
    ends = np.zeros(len(word), bool)
    ends[last] = True
    word[ends], word[~ends] = END, w.hashes
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[last - size] = START
    return word, before, np.repeat(np.arange(n), size + 1)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(context, 3) + word * K.U(0xD6E8FEB86659FD93), 4)


class Deal:
    """Which bucket has a pair: that of its context, or one of several if the context holds more than a bucket's share."""

    def __init__(self, buckets: int, hot: np.ndarray, parts: np.ndarray):
        self.buckets, self.hot, self.parts = buckets, hot, parts

    def place(self, context: np.ndarray) -> np.ndarray:
        """The place of each context among the hot ones, -1 for others."""
        if not len(self.hot):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
        return np.where(self.hot[at] == context, at, -1)

    def bucket(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out, at = (K.mix(context, 8) % K.U(self.buckets)).astype(np.int64), self.place(context)
        hot = np.flatnonzero(at >= 0)
        out[hot] += (K.mix(word[hot], 9) % self.parts[at[hot]].astype(K.U)).astype(np.int64)
        return out % self.buckets

    def home(self, word: np.ndarray) -> np.ndarray:
        return (K.mix(word, 12) % K.U(self.buckets)).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte by byte in planes, which compress better."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return zlib.compress(np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(planes), 1)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(blob), 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(raw[:at], np.int64).tolist(), kinds, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw[at : at + n * size], np.uint8).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted values; cumsum undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))


def _common(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in K.text_chunks(batch.column(1)):
                context, count = np.unique(tokens(K.words(buf, offsets))[1], return_counts=True)
                keep = count * 2 * buckets >= count.sum()
                yield pa.record_batch([K.signed(context[keep]), pa.array(count[keep]), pa.nulls(int(keep.sum()), pa.int64())], names=["context", "n", "all"])
                yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([count.sum()])], names=["context", "n", "all"])

    return run


def deal(rows: DataFrame, buckets: int, scratch: Scratch) -> Deal:
    """The contexts with more than a bucket's share of all tokens, as far as chunks of text show it: fewer than buckets."""
    seen = rows.mapInArrow(_common(buckets), "context long, n long, all long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    seen = scratch.table(seen, "contexts")
    every = seen.where("context is null").agg(F.sum("all")).first()[0] or 0
    found = seen.where(F.col("context").isNotNull() & (F.col("n") > every / buckets)).select("context", F.least(F.ceil(F.col("n") * buckets / every), F.lit(buckets)).alias("parts")).collect() if every else []
    found = sorted((int(np.int64(r["context"]).view(K.U)), r["parts"]) for r in found)
    scratch.drop("contexts")
    return Deal(buckets, np.array([c for c, _ in found], K.U), np.array([p for _, p in found], np.int64))


def _gathered(batches: Iterator[pa.RecordBatch]):
    """Runs of (ids, held flags, word, context, document) of about FLUSH tokens at most, or one longer chunk."""
    held: list[tuple] = []
    size = docs = 0
    for batch in batches:
        out = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
        for i, j, buf, offsets in K.text_chunks(batch.column(1)):
            word, context, doc = tokens(K.words(buf, offsets))
            held.append((batch.column(0).slice(i, j - i).to_pylist(), out[i:j], word, context, doc + docs))
            size, docs = size + len(word), docs + j - i
            if size >= FLUSH:
                run, held, size, docs = _joined(held), [], 0, 0
                yield run
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple:
    return ([x for h in held for x in h[0]], *(np.concatenate([h[k] for h in held]) for k in range(1, 5)))


def _runs(order_of: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    edges = np.searchsorted(order_of, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, int(edges[b]), int(edges[b + 1])


def _counted(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each key, in order of keys, and the sum of n over equal ones."""
    order = np.argsort(key)
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return order[edge], np.add.reduceat(n[order], edge, dtype=np.uint32) if len(key) else np.zeros(0, np.uint32)


def _train(to: Deal):
    """Pairs of a run by bucket, with their counts in training documents: 0 for those of other documents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, out, word, context, doc in _gathered(batches):
            first, count = _counted(pair_key(context, word), ~out[doc])
            word, context = word[first], context[first]
            bucket = to.bucket(context, word)
            order = np.lexsort((context, bucket))
            blobs = []
            for b, x, y in _runs(bucket[order], to.buckets):
                o = order[x:y]
                own, n = np.unique(context[o], return_counts=True)
                blobs.append((b, _pack(_steps(own), n.astype(np.uint32), word[o], count[o])))
            yield pa.record_batch([pa.array([b for b, _ in blobs], pa.int32()), pa.array([z for _, z in blobs], pa.binary())], names=["bucket", "blob"])

    return run


MODEL = (K.U, np.uint32, K.U, np.uint32, np.uint32)


def _merge(key: tuple, rows: pa.Table) -> pa.Table:
    """The pairs of a bucket: contexts, pairs of each, words, and each pair's place among the words and count."""
    held: tuple[list, list, list] = ([], [], [])
    for z in rows["blob"]:
        own, n, *rest = _unpack(z.as_buffer(), K.U, np.uint32, K.U, np.uint32)
        for part, values in zip(held, (np.repeat(np.cumsum(own, dtype=K.U), n), *rest), strict=True):
            part.append(values)
    joined = []
    for part in held:
        joined.append(np.concatenate(part))
        part.clear()
    context, word, count = joined
    del joined, own, n, rest, values
    first, count = _counted(pair_key(context, word), count)
    context, word = context[first], word[first]
    del first
    words, at = np.unique(word, return_inverse=True)
    del word
    at = at.astype(np.uint32)
    order = np.lexsort((at, context))
    context, at, count = context[order], at[order], count[order]
    del order
    contexts, per = np.unique(context, return_counts=True)
    del context
    blob = _pack(_steps(contexts), per.astype(np.uint32), _steps(words), at, count)
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary())})


# --- seating -------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _listed(d: float) -> np.ndarray:
    """For c = 1.. LISTED and t = 1..c: the log of the chance of t tables among c customers of a Pitman-Yor
    restaurant of discount d and strength 0, less that of (t - 1)!. Up to a factor of each c it is the
    generalised Stirling number times discount^t."""
    t = np.arange(1, LISTED + 1)
    fact = np.concatenate([[0.0], np.cumsum(np.log(t[:-1]))])
    row = np.full(LISTED, -np.inf)
    row[0], out = 0.0, []
    for c in range(1, LISTED + 1):
        out.append(row[:c] - fact[:c])
        if c < LISTED:
            more = np.full(LISTED, -np.inf)
            more[1 : c + 1] = row[:c] + np.log(d * t[:c] / c)
            row[:c] += np.log1p(-d * t[:c] / c)
            row = np.logaddexp(row, more)
    return np.concatenate(out)


def _bisect(above, low: np.ndarray, high: float) -> np.ndarray:
    """Where a falling function of positive w is no longer above, by halving its logarithm."""
    low = np.log(low)
    high = np.full_like(low, np.log(high))
    for _ in range(50):
        mid = (low + high) / 2
        up = above(np.exp(mid))
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return np.exp(low)


def _pull(w: np.ndarray, d: float) -> np.ndarray:
    """d u^(d - 1) (1 - u) at u = 1 - exp(-w)."""
    return d * np.exp((d - 1) * np.log(-np.expm1(-w)) - w)


def log_chance(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The log of the chance of t tables among c customers (discount d, strength 0), for more than LISTED customers.

    It is c / (t d) times the coefficient of x^c in (1 - (1 - x)^d)^t, an integral of that power times
    exp(c w) over x = exp(-w): along a parabola around the cut through the saddle point, or along the
    circle through it where that is far from the cut. The sums of 64 points are good to 1e-5 and mostly to 1e-8.
    """
    c, t = c.astype(float), t.astype(float)
    rest = lambda w: -np.expm1(d * np.log1p(-np.exp(-w)))  # noqa: E731  1 - u^d
    w0 = _bisect(lambda w: t * _pull(w, d) > c * rest(w), 3 / c, 40.0)
    far = w0 > 0.5
    y = np.arange(64) / 63
    e = np.exp(-w0)
    slope = _pull(w0, d) / rest(w0)
    spread = np.sqrt(np.maximum(t * slope * ((1 - d) * e / -np.expm1(-w0) + 1 - slope), 1e-12))  # the saddle's second derivative
    reach = np.where(far, np.minimum(np.pi, 9 / spread), np.minimum(np.sqrt(18 / (c * w0 * (1 - d))), np.pi / 2 / w0))
    y = y[None, :] * reach[:, None]
    w = np.where(far[:, None], w0[:, None] + 1j * y, w0[:, None] * (1 + 1j * y) ** 2)
    step = np.where(far[:, None], 1.0, 2 * w0[:, None] * (1 + 1j * y))  # of w by y, over i
    log_u = np.where(far[:, None], np.log1p(-np.exp(-w)), np.log(-np.expm1(-w)))
    power = t[:, None] * np.log(-np.expm1(d * log_u))
    top = c * w0 + power[:, 0].real
    near = (power[:, 0].real > -1)[:, None]  # without the constant 1, which adds nothing, so that nothing cancels
    value = np.where(near, np.expm1(np.where(near, power, 0)), np.exp(power - power[:, :1].real))
    value *= np.exp(1j * c[:, None] * w.imag + c[:, None] * (w.real - w0[:, None])) * step
    value[:, [0, -1]] /= 2
    area = value.real.sum(axis=1) * reach / 63 / np.pi
    with np.errstate(invalid="ignore", divide="ignore"):
        found = np.log(c / (t * d)) + np.log(area) + np.where(near[:, 0], c * w0, top)
    return np.where(t == c, (c - 1) * np.log(d), found)


def _draw_listed(count: np.ndarray, mean: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    weight, out = _listed(d), np.empty(len(count), np.int64)
    ends, x = np.cumsum(count), 0
    log_mean = np.log(mean)
    while x < len(count):
        y = max(x + 1, int(np.searchsorted(ends, ends[x] + SLICE, "right")))
        c = count[x:y]
        first = np.cumsum(c) - c
        t = np.arange(int(c.sum())) - np.repeat(first, c)  # tables, less one
        w = weight[np.repeat(c * (c - 1) // 2, c) + t] + t * np.repeat(log_mean[x:y], c)
        w = np.cumsum(np.exp(w - np.repeat(np.maximum.reduceat(w, first), c)))
        before = np.where(first > 0, w[first - 1], 0)
        at = np.searchsorted(w, before + rng.random(len(c)) * (w[first + c - 1] - before), "right")
        out[x:y] = np.clip(at - first, 0, c - 1) + 1
        x = y
    return out


_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def _draw_large(count: np.ndarray, mean: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """By rejection: the chances of numbers of tables are log-concave, so a level about the likeliest and two geometric tails lie above them."""

    def f(rows: np.ndarray, t: np.ndarray) -> np.ndarray:
        return log_chance(count[rows], t, d) + (t - 1) * np.log(mean[rows]) - _log_gamma(t).astype(float)

    every = np.arange(len(count))
    w = _bisect(lambda w: mean * _pull(w, d) > count, np.full(len(count), 1e-300), 40.0)
    top = np.clip(np.rint(-mean * np.expm1(d * np.log(-np.expm1(-w)))), 2, count - 1).astype(np.int64)
    reach = np.ceil(np.sqrt(np.minimum(top, count - top))).astype(np.int64) + 1
    peak = f(every, top)
    low, high = np.zeros((2, len(count)), np.int64)
    at_low, at_high, up, down = np.zeros((4, len(count)))
    rows = every
    while len(rows):
        low[rows], high[rows] = np.maximum(top[rows] - reach[rows], 1), np.minimum(top[rows] + reach[rows], count[rows])
        at_low[rows], at_high[rows] = f(rows, low[rows]), f(rows, high[rows])
        up[rows] = np.where(low[rows] > 1, f(rows, low[rows] + 1) - at_low[rows], np.inf)
        down[rows] = np.where(high[rows] < count[rows], f(rows, high[rows] - 1) - at_high[rows], np.inf)
        rows = rows[(up[rows] < 1e-9) | (down[rows] < 1e-9)]
        reach[rows] *= 2
    rise, fall = peak - f(every, top - 1), peak - f(every, top + 1)
    level = peak + np.maximum(0, np.maximum(rise * (high - top), fall * (top - low)))
    most = np.maximum(level, np.maximum(at_low, at_high))
    shares = np.cumsum([np.exp(level - most) * (high - low - 1), np.exp(at_low - most) / -np.expm1(-up), np.exp(at_high - most) / -np.expm1(-down)], axis=0)
    out, rows = np.zeros(len(count), np.int64), every
    while len(rows):
        which = (rng.random(len(rows)) * shares[2, rows] >= shares[:2, rows]).sum(axis=0)
        more = lambda slope: np.minimum(-np.log1p(-rng.random(len(rows))) / slope[rows], 1e18).astype(np.int64)  # noqa: B023, E731
        left, right = more(up), more(down)
        inner = low[rows] + 1 + (rng.random(len(rows)) * (high[rows] - low[rows] - 1)).astype(np.int64)
        t = np.choose(which, [inner, low[rows] - left, high[rows] + right])
        bound = np.choose(which, [level[rows], at_low[rows] - left * np.where(left, up[rows], 0), at_high[rows] - right * np.where(right, down[rows], 0)])
        good = np.flatnonzero((t >= 1) & (t <= count[rows]))
        ok = good[np.log(1 - rng.random(len(good))) <= f(rows[good], t[good]) - bound[good]]
        out[rows[ok]] = t[ok]
        rows = rows[out[rows] == 0]
    return out


def draw_tables(count: np.ndarray, p: np.ndarray, weight: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes from their conditional: p, the parent's probability; weight, that of the restaurant (``draw_weight``)."""
    mean, out = p * weight, np.ones(len(count), np.int64)
    large = count > LISTED
    some = np.flatnonzero(~large & (count > 1))
    out[some] = _draw_listed(count[some], mean[some], d, rng)
    large = np.flatnonzero(large)
    for x in range(0, len(large), 256):
        some = large[x : x + 256]
        out[some] = _draw_large(count[some], mean[some], d, rng)
    return out


def draw_weight(tables: np.ndarray | int, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Given it, the dishes of a restaurant are independent: rising products of strength and discount as a mean over a gamma."""
    return rng.gamma(theta / d + tables)


class Tables:
    """Seating of dishes by size: how many tables of each size a dish has, sorted by dish and size.

    Sweeps take the expected seating from it (``begin``) and draw numbers of tables by ``draw_tables``;
    ``redraw`` is the same conditional one customer at a time.
    """

    def __init__(self, count: np.ndarray, dish: np.ndarray, size: np.ndarray, n: np.ndarray):
        self.count, self.dish, self.size, self.n = count.astype(np.int64), dish.astype(np.int64), size.astype(np.int64), n.astype(np.int64)

    @classmethod
    def begin(cls, count: np.ndarray, opens: np.ndarray, d: float, rng: np.random.Generator) -> Tables:
        """Expected numbers and sizes, as customers come in: opens is the weight of a new table."""
        count, m = count.astype(np.int64), len(count)
        t, grown, born, k = np.ones(m), np.zeros(m), [], 1
        rows = np.flatnonzero(count > 1)
        while len(rows):
            then = max(k + 1, int(k * 1.3))
            step = np.minimum(count[rows], then) - k
            rate = 1 / (opens[rows] + np.maximum(k + (step - 1) / 2 - d * t[rows], 1e-9))
            new = np.minimum(np.floor(opens[rows] * rate * step + rng.random(len(rows))), step).astype(np.int64)
            some = new > 0
            born.append((rows[some], new[some], grown[rows[some]] + (rate * step)[some] / 2))
            t[rows] += new
            grown[rows] += rate * step
            k, rows = then, rows[count[rows] > then]
        dish, n, at = (np.concatenate([b[c] for b in born]) if born else np.zeros(0, np.int64) for c in range(3))
        size = np.maximum(1, np.floor(d + (1 - d) * np.exp(np.minimum(grown[dish] - at, 40)) + 0.5)).astype(np.int64)
        over = np.bincount(dish, size * n, m) >= count
        size[over[dish]] = 1
        first = count - np.bincount(dish, size * n, m).astype(np.int64)
        out = cls(count, np.concatenate([dish, np.arange(m)]), np.concatenate([size, first]), np.concatenate([n, np.ones(m, np.int64)]))
        out.gather()
        return out

    def gather(self) -> None:
        key, at = np.unique(self.dish << 40 | self.size, return_inverse=True)
        n = np.bincount(at, self.n, len(key)).astype(np.int64)
        key, self.n = key[n > 0], n[n > 0]
        self.dish, self.size = key >> 40, key & ((1 << 40) - 1)

    def total(self) -> np.ndarray:
        return np.bincount(self.dish, self.n, len(self.count)).astype(np.int64)

    def redraw(self, p: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> None:
        """One customer of each dish leaves and sits down again; p: the parent's probability, others: tables of other dishes around."""
        m = len(self.count)
        if not m:
            return
        t, ends = self.total(), np.cumsum(self.size * self.n)
        base = np.cumsum(self.count) - self.count

        def table_of(dish: np.ndarray, customer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(entry, table in it) of a customer, customers being counted table by table."""
            at = base[dish] + customer
            e = np.searchsorted(ends, at, "right")
            return e, (at - ends[e]) // self.size[e]  # negative, but equal for equal tables only

        every = np.arange(m)
        gone = np.minimum((rng.random(m) * self.count).astype(np.int64), self.count - 1)
        entry, table = table_of(every, gone)
        left = self.size[entry]
        t = t - (left == 1)
        new_weight = (theta + d * (others + t)) * p
        new = rng.random(m) * (new_weight + self.count - 1 - d * t) < new_weight
        joined = np.zeros(m, np.int64)  # customers of the table before, 0 for a new one
        same = new & (left == 1)
        rows = np.flatnonzero(~new & (self.count > 1))
        same |= ~new & (self.count == 1)
        while len(rows):
            other = np.minimum((rng.random(len(rows)) * (self.count[rows] - 1)).astype(np.int64), self.count[rows] - 2)
            other += other >= gone[rows]
            e, k = table_of(rows, other)
            own = (e == entry[rows]) & (k == table[rows])
            now = self.size[e] - own
            ok = rng.random(len(rows)) * now < now - d
            joined[rows[ok]], same[rows[ok]] = now[ok], own[ok]
            rows = rows[~ok]
        moved = np.flatnonzero(~same)
        shrunk, grew = moved[left[moved] > 1], moved[joined[moved] > 0]
        dish = np.concatenate([moved, shrunk, grew, moved])
        size = np.concatenate([left[moved], left[shrunk] - 1, joined[grew], joined[moved] + 1])
        n = np.repeat([-1, 1, -1, 1], [len(moved), len(shrunk), len(grew), len(moved)])
        self.dish, self.size, self.n = (np.concatenate(z) for z in ((self.dish, dish), (self.size, size), (self.n, n)))
        self.gather()


class Bucket:
    """The pairs of one bucket and their seating."""

    def __init__(self, number: int, blob: bytes, to: Deal):
        contexts, per, words, self.at, count = _unpack(blob, *MODEL)
        self.number, self.contexts, self.words = number, np.cumsum(contexts, dtype=K.U), np.cumsum(words, dtype=K.U)
        self.of, self.count = np.repeat(np.arange(len(per), dtype=np.uint32), per), count.astype(np.int64)
        self.hot = to.place(self.contexts)
        self.by_home = np.argsort(to.home(self.words), kind="stable")
        self.cuts = [(h, self.by_home[x:y]) for h, x, y in _runs(to.home(self.words)[self.by_home], to.buckets)]
        self.many = np.flatnonzero(self.count > 1)
        self.customers = np.bincount(self.of, self.count, len(per)).astype(np.int64)

    def spread(self, replies: pd.DataFrame, kinds: int) -> list[np.ndarray]:
        """What the homes sent, by word."""
        by = dict(zip(replies["home"].tolist(), replies["blob"], strict=True))
        out = [np.zeros(len(self.words), np.int64) for _ in range(kinds)]
        for h, own in self.cuts:
            for o, v in zip(out, _unpack(by[h], *[np.int64] * kinds), strict=True):
                o[own] = v
        return out

    def send(self, values: np.ndarray, *more: np.ndarray) -> list[tuple[int, bytes]]:
        return [(h, _pack(values[own].astype(np.int64), *(m[own] for m in more))) for h, own in self.cuts]

    def tables(self, of_many: np.ndarray) -> np.ndarray:
        out = np.minimum(self.count, 1)
        out[self.many] = of_many
        return out

    def around(self, tables: np.ndarray) -> np.ndarray:
        """Tables of each context's restaurant, as far as they are in the bucket."""
        return np.bincount(self.of, tables, len(self.contexts)).astype(np.int64)

    def instead(self, known: np.ndarray, own: np.ndarray) -> np.ndarray:
        """By context: what is known of the hot ones, the bucket's own of others."""
        return np.where(self.hot >= 0, known[np.maximum(self.hot, 0)], own) if len(known) else own

    def of_hot(self, by_context: np.ndarray) -> bytes:
        """The places of the bucket's hot contexts and their values."""
        some = self.hot >= 0
        return _pack(self.hot[some].astype(np.int64), by_context[some].astype(np.int64))


def root_probability(customers: np.ndarray, tables: np.ndarray, known: dict) -> np.ndarray:
    return (np.maximum(customers - known["d0"] * tables, 0) + (known["theta0"] + known["d0"] * known["all0"]) * known["base"]) / (known["theta0"] + known["all"])


#: home: the word's home, -1 for a bucket's own seating, -2 for its tables of hot contexts.
SENT = "home int, bucket int, blob binary, ones long, twos long, n long"
REPLY = "bucket int, home int, sweep int, blob binary, a long, b long, ones long, twos long"


def _sent(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SENT.split(", ")])


def _open(to: Deal):
    """Words and their training counts to their homes; customers of hot contexts."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(int(key[0]), rows["blob"].iloc[0], to)
        of_word = np.bincount(b.at, b.count, len(b.words)).astype(np.int64)
        ones, twos = (int(np.count_nonzero(b.count == n)) for n in (1, 2))
        out = [(h, b.number, z, 0, 0, 0) for h, z in b.send(of_word, b.words)]
        return _sent([*out, (-2, b.number, b.of_hot(b.customers), ones, twos, int(b.count.sum()))])

    return run


def _homes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """At a home: the training count of each word for each bucket that has it; row -1 is the home's own: who sent which words."""
    parts = [_unpack(z, np.int64, K.U) for z in rows["blob"]]
    words, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    count = np.bincount(at, np.concatenate([p[0] for p in parts]), len(words)).astype(np.int64)
    cuts = np.split(at, np.cumsum([len(p[0]) for p in parts])[:-1])
    known, n = int(np.count_nonzero(count)), len(rows)
    return pd.DataFrame({
        "bucket": [*rows["bucket"], -1], "home": key[0], "sweep": 0, "blob": [*(_pack(count[c]) for c in cuts), _pack(rows["bucket"].to_numpy(np.int64), np.array([len(c) for c in cuts]), at.astype(np.uint32))],
        "a": [0] * n + [known], "b": [0] * n + [int(count.sum())], "ones": 0, "twos": 0,
    })


def _parent(s: int, known: dict | None, fixed: dict):
    """At a home: customers and tables of the parent's dishes after sweep s."""

    def run(key: tuple, own: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        buckets, sizes, at = _unpack(own["blob"].iloc[0], np.int64, np.int64, np.uint32)
        by = dict(zip(sent["bucket"].tolist(), sent["blob"], strict=True))
        cuts = np.split(at, np.cumsum(sizes)[:-1])
        customers = np.zeros(int(at.max()) + 1, np.int64)
        for b, cut in zip(buckets.tolist(), cuts, strict=True):
            customers[cut] += _unpack(by[b], np.int64)[0]  # a bucket names a word once
        rng = np.random.default_rng([s, int(key[0]), 31])
        many = np.flatnonzero(customers > 1)
        tables = np.minimum(customers, 1)
        base = np.full(len(many), fixed["base"])
        if known:
            tables[many] = draw_tables(customers[many], base, np.full(len(many), known["weight0"]), known["d0"], rng)
        else:
            d0, share = 0.5, fixed["vocabulary"] / max(1, np.count_nonzero(customers))  # the home's words stand for all
            tables[many] = Tables.begin(customers[many], (fixed["theta0"] + d0 * fixed["vocabulary"]) * base, d0, rng).total()
            for _ in _settling(lambda: int(tables.sum())):
                weight = draw_weight(share * tables.sum(), d0, fixed["theta0"], rng)
                tables[many] = draw_tables(customers[many], base, np.full(len(many), weight), d0, rng)
        ones, twos = (int(np.count_nonzero(customers == n)) for n in (1, 2))
        k = len(buckets)
        return pd.DataFrame({
            "bucket": buckets, "home": key[0], "sweep": s, "blob": [_pack(customers[c], tables[c]) for c in cuts],
            "a": [int(customers.sum())] + [0] * (k - 1), "b": [int(tables.sum())] + [0] * (k - 1), "ones": [ones] + [0] * (k - 1), "twos": [twos] + [0] * (k - 1),
        })

    return run


def _settling(total) -> Iterator[None]:
    """Draws until the total grows by less than a hundredth, 30 at most."""
    before = total()
    for _ in range(30):
        yield
        after = total()
        if abs(after - before) * 100 < before:
            return
        before = after


#: Tables of dishes with more than one customer, their sum over sampled sweeps; tables of contexts, sweep by sweep.
SEATS = (np.uint32, np.uint32, np.int64)


def _sweep(to: Deal, s: int, history: list[dict], fixed: dict, burn: int):
    """A bucket's seating after sweep s, its tables of each word, and those of hot contexts."""

    def run(key: tuple, model: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        b = Bucket(int(key[0]), model["blob"].iloc[0], to)
        rng = np.random.default_rng([s, b.number, 29])
        d, theta, count = fixed["d"], fixed["theta"], b.count[b.many]
        of = b.of[b.many]
        if s == 1:
            p = ((b.spread(rows, 1)[0] + 1) / (fixed["n"] + fixed["vocabulary"] + 1))[b.at[b.many]]
            parts = np.where(b.hot >= 0, np.append(to.parts, 1)[b.hot], 1)  # the bucket's words of a hot context stand for all
            around = b.around(b.tables(np.ones(len(b.many), np.int64))) * parts
            seated = Tables.begin(count, (theta + d * around[of]) * p, d, rng).total()
            summed, kept = np.zeros(len(b.many), np.int64), np.zeros(0, np.int64)
            for _ in _settling(lambda: int(seated.sum())):
                seated = draw_tables(count, p, draw_weight(b.around(b.tables(seated)) * parts, d, theta, rng)[of], d, rng)
        else:
            known = history[-1]
            p = root_probability(*b.spread(rows[rows["home"] >= 0], 2), known)[b.at[b.many]]
            seated, summed, kept = (x.astype(np.int64) for x in _unpack(rows.loc[rows["home"] < 0, "blob"].iloc[0], *SEATS))
            weight = b.instead(known["hot_weight"], draw_weight(b.around(b.tables(seated)), d, theta, rng))
            seated = draw_tables(count, p, weight[of], d, rng)
        tables = b.tables(seated)
        own = b.around(tables)
        if s > burn:
            summed, kept = summed + seated, np.concatenate([kept, own])
        out = [(h, b.number, z, 0, 0, 0) for h, z in b.send(np.bincount(b.at, tables, len(b.words)))]
        out.append((-1, b.number, _pack(seated.astype(np.uint32), summed.astype(np.uint32), kept), 0, 0, 0))
        return _sent([*out, (-2, b.number, b.of_hot(own), 0, 0, 0)])

    return run


def _added(h: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(h, np.int64)
        for z in rows["blob"]:
            place, value = _unpack(z, np.int64, np.int64)
            total[place] += value
        return pd.DataFrame({"part": [key[0]], "blob": [_pack(total)]})

    return run


def _hot_sums(sent: DataFrame, h: int) -> np.ndarray:
    """Sums over the buckets of what they have of the hot contexts, added up in 64 parts before the driver adds these."""
    total = np.zeros(h, np.int64)
    if h:
        parts = sent.where("home = -2").select((F.col("bucket") % 64).alias("part"), "blob").groupBy("part")
        for r in parts.applyInPandas(_added(h), "part int, blob binary").collect():
            total += _unpack(r["blob"], np.int64)[0]
    return total


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def sample(model: DataFrame, to: Deal, scratch: Scratch, samples: int, burn: int) -> tuple[dict, list[dict], DataFrame, DataFrame]:
    """What is known everywhere, after each sampled sweep; the homes' replies of these sweeps and the counts; the buckets' last seating."""
    h = len(to.hot)
    opened = scratch.table(model.groupBy("bucket").applyInPandas(_open(to), SENT), "opened")
    told = opened.where("home = -2").agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos"), F.sum("n").alias("n")).first()
    replies = scratch.table(opened.where("home >= 0").groupBy("home").applyInPandas(_homes, REPLY), "counts")
    sums = replies.where("bucket = -1").agg(F.sum("a").alias("words")).first()
    vocabulary = sums["words"] or 0
    fixed = {"d": _discount(told["ones"] or 0, told["twos"] or 0), "theta": 1.0, "theta0": 1.0, "base": 1 / (vocabulary + 1), "vocabulary": vocabulary, "n": told["n"] or 0, "hot_customers": _hot_sums(opened, h)}
    homes, counts = replies.where("bucket = -1"), replies.where("bucket >= 0")
    scratch.drop("opened")
    history: list[dict] = []
    last, seats, heard = counts, None, [counts]
    for s in range(1, burn + samples + 1):
        own = ["bucket", "home", "blob"]
        rows = last.select(*own) if seats is None else last.select(*own).unionByName(seats.select(*own))
        sent = scratch.table(model.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInPandas(_sweep(to, s, history[-1:], fixed, burn), SENT), f"sent{s}")
        replies = homes.groupBy("home").cogroup(sent.where("home >= 0").groupBy("home")).applyInPandas(_parent(s, history[-1] if history else None, fixed), REPLY)
        last = scratch.table(replies, f"replies{s}")
        seats = scratch.table(sent.where("home = -1"), f"seats{s}")
        t = last.agg(*[F.sum(c).alias(c) for c in ("a", "b", "ones", "twos")]).first()
        hot, all0, d0, rng = _hot_sums(sent, h), t["b"] or 0, _discount(t["ones"] or 0, t["twos"] or 0), np.random.default_rng([s, 37])
        weights = {"weight0": draw_weight(all0, d0, fixed["theta0"], rng), "hot_weight": draw_weight(hot, fixed["d"], fixed["theta"], rng)}
        history.append(fixed | weights | {"hot": hot, "all": t["a"] or 0, "all0": all0, "d0": d0})
        scratch.drop(f"sent{s}", *([f"seats{s - 1}"] if s > 1 else []), *([f"replies{s - 1}"] if 1 < s <= burn + 1 else []))
        if s > burn:
            heard.append(last)
    replies = heard[0]
    for x in heard[1:]:
        replies = replies.unionByName(x)
    return fixed, history[burn:], replies, seats


# --- scores --------------------------------------------------------------------------------------


PARTS = "chunk long, own boolean, blob binary"
OWN = (np.int64, np.uint8, np.uint8, np.int64)


def _ask(to: Deal):
    """The pairs of each run by bucket, with the documents they stand in; and the run's documents (own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 20
        for ids, out, word, context, doc in _gathered(batches):
            key = pair_key(context, word)
            bucket = to.bucket(context, word)
            order = np.lexsort((key, bucket))
            bucket, key, of = bucket[order], key[order], doc[order]
            blobs = []
            for b, x, y in _runs(bucket, to.buckets):
                edge = np.flatnonzero(np.concatenate([[True], key[x + 1 : y] != key[x : y - 1]]))
                blobs.append((b, False, _pack(_steps(key[x:y][edge]), np.diff(np.append(edge, y - x)).astype(np.uint32), of[x:y].astype(np.uint32))))
            named = np.array([x is not None for x in ids])
            own = _pack(np.array([x or 0 for x in ids], np.int64), named.view(np.uint8), out.view(np.uint8), np.bincount(doc, minlength=len(ids)))
            blobs.append(((chunk + (chunk >> 20)) % to.buckets, True, own))
            buckets, owns, blobs = zip(*blobs, strict=True)
            yield pa.record_batch([pa.array(buckets, pa.int32()), pa.array([chunk] * len(blobs)), pa.array(owns), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "own", "blob"])
            chunk += 1

    return run


def _answer(sent, samples: int):
    """Sums of a bucket's log-probabilities for each document of the runs that ask; the runs' documents go through."""

    def run(key: tuple, model: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        to, fixed, history = sent.value
        asked, rows = rest[rest["chunk"].notna()], rest[rest["chunk"].isna()]
        out = [(int(c), True, z) for c, own, z in zip(asked["chunk"], asked["own"], asked["blob"], strict=True) if own]
        if len(model):
            b = Bucket(int(key[0]), model["blob"].iloc[0], to)
            total = b.spread(rows[rows["sweep"] == 0], 1)[0]
            _, summed, kept = _unpack(rows.loc[rows["sweep"] == -1, "blob"].iloc[0], *SEATS)
            kept = kept.reshape(samples, -1)
            p = samples * np.minimum(b.count, 1).astype(np.float64)
            p[b.many] = summed
            p = np.maximum(samples * b.count - fixed["d"] * p, 0)
            sweeps = sorted(set(rows["sweep"].tolist()) - {0, -1})
            for k, (s, known) in enumerate(zip(sweeps, history, strict=True)):
                root = root_probability(*b.spread(rows[rows["sweep"] == s], 2), known)
                more = (fixed["theta"] + fixed["d"] * b.instead(known["hot"], kept[k]))[b.of]
                more *= root[b.at]
                p += more
            p /= (samples * (fixed["theta"] + b.instead(fixed["hot_customers"], b.customers)))[b.of]
            score, p, more = np.log10(p), None, None
            base = np.log10((total + 1) / (fixed["n"] + fixed["vocabulary"] + 1))
            keys = pair_key(b.contexts[b.of], b.words[b.at])
            order = np.argsort(keys)
            at = b.at[order]
            keys, values = keys[order], [base[at], score[order], (total > 0)[at]]
            del b, order, at, score, rest, rows
            for chunk, own, blob in zip(asked["chunk"], asked["own"], asked["blob"], strict=True):
                if not own:
                    pairs, count, doc = _unpack(blob, K.U, np.uint32, np.uint32)
                    at = np.repeat(np.searchsorted(keys, np.cumsum(pairs, dtype=K.U)), count)
                    docs, to_doc = np.unique(doc, return_inverse=True)
                    sums = [np.bincount(to_doc, v[at], len(docs)) for v in values]
                    out.append((int(chunk), False, _pack(_steps(docs), sums[0], sums[1], sums[2].astype(np.uint32))))
        return pd.DataFrame(out, columns=["chunk", "own", "blob"])

    return run


def _gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    ids, named, held, sizes = _unpack(rows.loc[rows["own"], "blob"].iloc[0], *OWN)
    n = len(ids)
    base, score, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for z in sorted(rows.loc[~rows["own"], "blob"]):
        doc, b, s, k = _unpack(z, np.uint32, np.float64, np.float64, np.uint32)
        doc = np.cumsum(doc.astype(np.int64))
        base[doc] += b
        score[doc] += s
        known[doc] += k
    ids = pd.arrays.IntegerArray(ids.copy(), named == 0)
    return pd.DataFrame({"doc_id": ids, "held_out": held > 0, "n_tokens": sizes, "n_known": known, "base_score": base, "score": score})


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, scratch: Scratch, bucket_bytes: int = 16 << 20, samples: int = SAMPLES, burn: int = BURN) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held")
    rows = plain(docs, doc_id="long", text="string").select("doc_id", "text", held)
    spark = docs.sparkSession
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity")
    columns = lambda n: ["doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", perplexity]
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)).first()[0]
    if not size:
        return spark.createDataFrame([], SCORES).select(*columns(0))
    buckets = max(6, -(-size // bucket_bytes))
    to = deal(rows, buckets, scratch)
    files, name = min(buckets, 16_384), f"basalt_model_{uuid.uuid4().hex}"
    pairs = rows.mapInArrow(_train(to), "bucket int, blob binary").repartition(files, "bucket")
    try:
        model = scratch.bucketed(pairs.groupBy("bucket").applyInArrow(_merge, "bucket int, blob binary"), "model", name, files, "bucket")
        fixed, history, replies, seats = sample(model, to, scratch, samples, burn)
        sent = spark.sparkContext.broadcast((to, fixed, history))
        known = replies.select("bucket", "home", "sweep", "blob").unionByName(seats.select("bucket", "home", F.lit(-1).alias("sweep"), "blob"))
        asked = rows.mapInArrow(_ask(to), f"bucket int, {PARTS}")
        rest = known.unionByName(asked, allowMissingColumns=True)
        parts = model.groupBy("bucket").cogroup(rest.groupBy("bucket")).applyInPandas(_answer(sent, samples), PARTS)
        out = scratch.table(parts.groupBy("chunk").applyInPandas(_gather, SCORES), "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    scratch.drop("model", "counts", f"seats{burn + samples}", *(f"replies{s}" for s in range(burn + 1, burn + samples + 1)))
    return out.select(*columns(fixed["n"]))
