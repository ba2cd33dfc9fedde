"""N-gram Jaccard join: MinHash bands propose pairs, Bayesian pruning drops them, exact sets verify.

Near duplicates are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Words are runs without ASCII blanks, with A-Z lowered. Documents with the same word sequence
are one *class*; classes are compared, copies never expanded.

1. One pass hashes each text to a 128-bit class key and, once a task and class, keeps the text and
   a signature of 128 MinHash values.
2. 32 bands of 4 values give buckets. A pair of similarity 0.8 misses all of them with probability
   5e-8. Buckets with the same members are kept once.
3. A bucket is one block. Only a bucket beyond ``BLOCK`` bytes (a member counts its text and ``EACH`` more)
   is cut into chunks of that size, and pairs of chunks are its blocks, so no task holds more than two
   chunks. In a block a pair is taken up only by the first band in which it agrees, so once.
4. In blocks of 16 MinHash values, a pair goes as soon as the posterior probability (uniform prior)
   that its similarity reaches the threshold is below ``tolerance``. The rest are verified exactly, by
   what they differ in from the shingles that most of the block has.
5. A block returns, for each linked class, the number of documents it is linked to and the least
   class it reaches there: never pairs. Components join these.

Defined results: a null text counts as empty; documents without words are copies of each other;
fewer than five words form one shingle. A null doc_id takes part and is returned, and never names a
class unless all its documents have a null id. Repeated rows each count as a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .scratch import Scratch, plain

BANDS, ROWS, STEP = 32, 4, 16
VALUES = BANDS * ROWS
BLOCK, EACH = 8 << 20, 2048


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return K.mix(np.arange(VALUES, dtype=K.U), 77) | K.U(1)


def signatures(w: K.Words, shingle: int) -> np.ndarray:
    """16 bits of the minimum of each of 128 hash orders, for each document; zeros without words."""
    n, out = len(w.first) - 1, np.zeros((len(w.first) - 1, VALUES), np.uint16)
    g, ok = K.grams(w.hashes, shingle), K.inside(w.first, shingle)
    g, at = g[ok], np.concatenate([[0], np.cumsum(np.maximum(np.diff(w.first) - shingle + 1, 0))])
    size = np.diff(w.first)
    long, short = np.flatnonzero(size >= shingle), np.flatnonzero((size > 0) & (size < shingle))
    if len(long):
        for j, m in enumerate(_multipliers()):
            out[long, j] = (K.mix(np.minimum.reduceat(g * m, at[long])) & K.U(0xFFFF)).astype(np.uint16)
    for d in short:
        one = K.grams(w.hashes[w.first[d] : w.first[d + 1]], int(size[d]))
        out[d] = (K.mix(one * _multipliers()) & K.U(0xFFFF)).astype(np.uint16)
    return out if n else out[:0]


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each STEP of values, the fewest matches with which a pair stays.

    With a uniform prior, P(similarity >= t | m of h match) = P(Binomial(h + 1, t) <= m).
    """
    out = []
    for h in range(STEP, VALUES + 1, STEP):
        total, n = 0.0, h + 1
        for m in range(n + 1):
            total += exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * log(threshold) + (n - m) * log(1 - threshold))
            if total >= tolerance:
                out.append(m)
                break
    return out


def _read(shingle: int):
    kept = "doc_id long, cls binary, task int, n long, size long, sig binary, z binary"
    names = ["doc_id", "cls", "task", "n", "size", "sig", "z"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), set()
        for batch in batches:
            ids = batch.column(0)
            for i, j, buf, offsets in K.text_chunks(batch.column(1)):
                w = K.words(buf, offsets)
                keys = K.sequence_keys(w)
                cls = K.keys_to_arrow(keys)
                raw = [keys[d].tobytes() for d in range(j - i)]
                new = []
                for d, key in enumerate(raw):
                    if key not in seen:
                        seen.add(key)
                        new.append(d)
                sig = signatures(w, shingle)
                empty = pa.nulls(j - i, pa.binary())
                yield pa.record_batch([ids.slice(i, j - i), cls, pa.nulls(j - i, pa.int32()), pa.nulls(j - i, pa.int64()), pa.nulls(j - i, pa.int64()), empty, empty], names=names)
                yield pa.record_batch(
                    [
                        pa.nulls(len(new), pa.int64()),
                        pa.array([raw[d] for d in new], pa.binary()),
                        pa.array([task] * len(new), pa.int32()),
                        pa.array([int(w.first[d + 1] - w.first[d]) for d in new], pa.int64()),
                        pa.array([int(offsets[d + 1] - offsets[d]) for d in new], pa.int64()),
                        pa.array([sig[d].tobytes() for d in new], pa.binary()),
                        pa.array([zlib.compress(buf[offsets[d] : offsets[d + 1]].tobytes(), 1) for d in new], pa.binary()),
                    ],
                    names=names,
                )

    return kept, scan


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cls, sig = batch.column(0), np.ascontiguousarray(K.binary_rows(batch.column(1), np.uint16, VALUES)).view(np.int64)
        for band in range(BANDS):
            yield pa.record_batch([pa.array(np.full(len(cls), band, np.int8)), pa.array(sig[:, band]), cls, batch.column(2)], names=["band", "key", "cls", "size"])


def _find(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


class Overlaps:
    """Intersections of one set with all others of a block, from what each has and lacks of the features that most sets have."""

    def __init__(self, sets: list[np.ndarray]):
        n, size = len(sets), np.array([len(s) for s in sets])
        features, at = np.unique(np.concatenate(sets), return_inverse=True)
        usual = np.bincount(at, minlength=len(features)) * 2 > n
        owner = np.repeat(np.arange(n), size)
        place = np.cumsum(usual) - 1
        lacks = np.ones((n, int(usual.sum())), bool)  # at most twice as many cells as the sets have members
        lacks[owner[usual[at]], place[at[usual[at]]]] = False
        self.lack = lacks.sum(1)
        who, what = np.nonzero(lacks)
        odd = ~usual[at]
        who, what = np.concatenate([who, owner[odd]]), np.concatenate([np.flatnonzero(usual)[what], at[odd]])
        order = np.lexsort((what, who))
        self.own, self.own_ends = what[order], np.concatenate([[0], np.cumsum(np.bincount(who, minlength=n))])
        order = np.lexsort((who, what))
        self.posted, self.ends = who[order], np.concatenate([[0], np.cumsum(np.bincount(what, minlength=len(features)))])
        self.n, self.usual = n, lacks.shape[1]

    def of(self, i: int) -> np.ndarray:
        f = self.own[self.own_ends[i] : self.own_ends[i + 1]]
        first, count = self.ends[f], self.ends[f + 1] - self.ends[f]
        at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return self.usual - self.lack[i] - self.lack + np.bincount(self.posted[at], minlength=self.n)


def compare(sig: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, band: int, threshold: float, least: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, linked j > i) in one block. side: with two chunks, only pairs across; None: all pairs."""
    n = len(sig)
    bands = np.ascontiguousarray(sig).view(np.uint64)
    size = np.array([len(s) for s in sets])
    overlaps = None
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        if side is not None:
            j = j[side[j] != side[i]]
        if band:
            j = j[~(bands[j, :band] == bands[i, :band]).any(1)]
        j = j[bands[j, band] == bands[i, band]]
        hits = np.zeros(len(j), np.int64)
        for step, need in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            hits = hits + (sig[j, part] == sig[i, part]).sum(1)
            stay = hits >= need
            j, hits = j[stay], hits[stay]
        if not len(j):
            continue
        if n > 2:
            overlaps = overlaps or Overlaps(sets)
            both = overlaps.of(i)[j]
        else:
            both = np.array([len(np.intersect1d(sets[i], sets[x], assume_unique=True)) for x in j])
        linked = j[both >= threshold * (size[i] + size[j] - both) - 1e-9]
        if len(linked):
            yield i, linked


def _blocks(shingle: int, threshold: float, tolerance: float):
    least = least_matches(threshold, tolerance)
    names = ["cls", "links", "root"]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        texts = [zlib.decompress(r[5]) for r in rows]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        sets = K.shingle_sets(K.words(buf, np.cumsum([0, *map(len, texts)])), shingle)
        found = ([], [], [])
        a = 0
        while a < len(rows):
            b = a + 1
            while b < len(rows) and rows[b][0] == rows[a][0]:
                b += 1
            if b - a > 1:
                block = rows[a:b]
                sig = np.frombuffer(b"".join(r[4] for r in block), np.uint16).reshape(b - a, VALUES)
                side = np.array([r[2] for r in block])
                count, up, linked_any = [0] * (b - a), list(range(b - a)), set()
                _, _, low, high = rows[a][0]
                for i, linked in compare(sig, sets[a:b], None if low == high else side, rows[a][0][0], threshold, least):
                    for x in linked.tolist():
                        count[i] += block[x][3]
                        count[x] += block[i][3]
                        up[_find(up, x)] = _find(up, i)
                        linked_any |= {i, x}
                best: dict[int, bytes] = {}
                for x in linked_any:
                    r = _find(up, x)
                    best[r] = min(best.get(r, block[x][1]), block[x][1])
                for x in linked_any:
                    found[0].append(block[x][1])
                    found[1].append(count[x])
                    found[2].append(best[_find(up, x)])
            a = b
        return pa.record_batch([pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # Python objects of a few rows at a time
                c = [x.to_pylist() for x in batch.slice(at, 256).columns]
                for band, key, low, high, part, cls, copies, sig, z in zip(*c, strict=True):
                    block = (band, key, low, high)
                    if size > 2 * K.CHUNK and held[-1][0] != block:
                        yield solve(held)
                        held, size = [], 0
                    held.append((block, cls, part, copies, sig, z))
                    size += len(z) * 3 + 400
        if held:
            yield solve(held)

    return "cls binary, links long, root binary", run


def jaccard_join(docs: DataFrame, scratch: Scratch, shingle: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_copies, cls, kept_cls, least_id.

    class_id: the least doc_id of all documents joined to this one by links or copies. n_links: other
    documents of similarity ``threshold`` or more, copies included. n_copies: those with the same
    words, itself included. cls: the key of its word sequence; kept_cls: that of the document that
    stands for all of them; least_id: the least doc_id with these words. The result is a table in ``scratch``; all larger ones are deleted before return.
    """
    kept, scan = _read(shingle)
    read = scratch.table(plain(docs, doc_id="long", text="string").mapInArrow(scan, kept), "read")
    rows = read.where("task is null").select("doc_id", "cls")
    classes = rows.groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"))
    classes = scratch.table(classes, "classes")
    source = read.where("task is not null").groupBy("cls").agg(F.min("task").alias("task"))

    texts = read.where("task is not null and n > 0").select("cls", "task", "size", "sig", "z")
    bands = source.join(texts.select("cls", "task", "size", "sig"), ["cls", "task"]).select("cls", "sig", "size")
    bands = scratch.table(bands.mapInArrow(_bands, "band byte, key long, cls binary, size long"), "bands")
    full = bands.groupBy("band", "key").agg(
        F.count("*").alias("n"), F.ceil(F.sum(F.col("size") + EACH) / BLOCK).cast("int").alias("chunks"), *[F.sum(F.xxhash64(F.lit(s), "cls").cast("decimal(20,0)")).alias(f"s{s}") for s in (1, 2)]
    ).where("n > 1")
    once = full.groupBy("n", "chunks", "s1", "s2").agg(F.min(F.struct("band", "key")).alias("b")).select("chunks", "b.band", "b.key")
    part = F.pmod(F.xxhash64(F.lit(3), "cls"), F.col("chunks").cast("long")).cast("int")
    members = bands.join(once, ["band", "key"]).withColumn("part", part)
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.select("band", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "cls")
    members = scratch.table(members, "members")
    scratch.drop("bands")
    asked = members.select("cls").distinct().join(source, "cls")
    texts = asked.join(texts, ["cls", "task"]).join(classes.select("cls", "copies"), "cls").select("cls", "copies", "sig", "z")
    block = ["band", "key", "low", "high"]
    full = members.join(texts, "cls").select(*block, "part", "cls", "copies", "sig", "z")
    schema, run = _blocks(shingle, threshold, tolerance)
    found = full.repartition(*block).sortWithinPartitions(*block).mapInArrow(run, schema)
    found = scratch.table(found, "found")
    scratch.drop("members")

    # Only linked classes have a first class other than themselves; what is joined is written first, so
    # that both sides of a join are shuffles: adaptive execution can split a class of very many.
    roots = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")), scratch).withColumnsRenamed({"node": "cls", "root": "first_cls"})
    roots = scratch.table(roots.join(classes.select("cls", "least_id"), "cls"), "roots")
    least = roots.groupBy("first_cls").agg(F.min("least_id").alias("class_id"), F.min_by("cls", F.struct(F.col("least_id").isNull(), "least_id", "cls")).alias("kept_cls"))
    first = scratch.table(roots.select("cls", "first_cls").join(scratch.table(least, "least").hint("merge"), "first_cls").select("cls", "class_id", "kept_cls", F.lit(True).alias("linked")), "first")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    known = classes.join(first, "cls", "left").join(links, "cls", "left")
    own = lambda c, other: F.when(F.col("linked"), F.col(c)).otherwise(F.col(other)).alias(c)
    known = known.select("cls", own("class_id", "least_id"), own("kept_cls", "cls"), "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))
    out = rows.join(scratch.table(known, "known"), "cls")
    out = scratch.table(out.select("doc_id", "class_id", "n_links", "n_copies", "cls", "kept_cls", "least_id"), "result")
    scratch.drop("read", "classes", "found", "known", "roots", "least", "first")
    return out


def keep_one(docs: DataFrame, scratch: Scratch, **settings) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the least doc_id stays.

    Where several rows share that id and words, one of them stays. All columns are returned as they were.
    """
    result = jaccard_join(docs, scratch, **settings)
    stay = result.where(F.col("cls") == F.col("kept_cls")).select(F.col("cls").alias("_cls"), F.col("least_id").alias("_id")).distinct()
    names = docs.columns
    at, own = names.index("text"), f"c{names.index('doc_id')}"
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # so that no column is named like those added here
    fields = [*docs.columns, "cls"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offsets in K.text_chunks(batch.column(at)):
                cls = K.keys_to_arrow(K.sequence_keys(K.words(buf, offsets)))
                yield pa.record_batch([*(c.slice(i, j - i) for c in batch.columns), cls], names=fields)

    marked = docs.mapInArrow(keyed, docs.withColumn("cls", F.lit(None).cast("binary")).schema)
    same = (marked["cls"] == stay["_cls"]) & marked[own].cast("long").eqNullSafe(stay["_id"])
    return marked.join(stay, same, "left_semi").dropDuplicates(["cls", own]).select(*docs.columns).toDF(*names)
