"""Repeated passages by a sparse suffix array over all documents.

Words are runs without ASCII blanks, A-Z lowered. Of every 25 consecutive 26-word runs of a document
the one with the least hash is a minimiser; a passage of 50 words is such a window of runs, so it has
one minimiser, and copies of it select the same run wherever they stand. Only the suffixes that start
there are kept: about one in thirteen, each with the 24 words before and after its run and the passages
it is the minimiser of. They are range-partitioned and sorted by their run (as one hash), then by the
words after and before.

Two passages of 50 words are equal if and only if their minimisers have the same run, stand n words
after the passage's start for the same n, and the n words before and the 24 - n words after the run
agree. So the suffixes of one run are grouped by these keys, one for each passage: all documents with
the run are compared, not only neighbours. A run met in one document only needs no keys.

A run that may go on in another partition, or has more suffixes than are held at once, is settled in
parts: the parts' keys, at most two documents a shared key, are brought together by a shuffle.

Words around are compared by sixteen-bit codes, 24 of them a passage beside the hash of its run.

Defined results: only repeats across documents count; rows with the same doc_id (null being one id)
are one document; null, empty and shorter texts have no spans; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, plain

RUN, SIDE = 26, 24
LEAST = RUN + SIDE
NONE = -(1 << 63)


def minimisers(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash) of the runs that are least in some window of 25 runs inside a document, and the first and last such window."""
    n = len(w.hashes) - RUN + 1
    if n < SIDE + 1:
        return np.zeros(0, np.int64), np.zeros(0, K.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    power, inverse = K._powers(len(w.hashes))
    part = np.zeros(len(w.hashes) + 1, K.U)
    np.cumsum(w.hashes * power[: len(w.hashes)], out=part[1:])
    g = K.mix((part[RUN:] - part[:-RUN]) * inverse[:n], 41)
    whole = K.inside(w.first, LEAST)
    least = np.lib.stride_tricks.sliding_window_view(g, SIDE + 1)
    window = np.flatnonzero(whole[: len(least)])
    at, first, count = np.unique(window + least.argmin(1)[window], return_index=True, return_counts=True)
    return at, g[at], window[first], window[first + count - 1]


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, buf, offsets in K.text_chunks(batch.column(1)):
            w = K.words(buf, offsets)
            at, run, lowest, highest = minimisers(w)
            if not len(at):
                continue
            doc = np.searchsorted(w.first, at, "right") - 1
            codes = np.zeros(len(w.hashes) + 2 * SIDE, np.uint16)
            codes[SIDE:-SIDE] = (w.hashes >> K.U(9)).astype(np.uint16)
            place = at - w.first[doc]
            left = np.minimum(place, SIDE)
            right = np.minimum(w.first[doc + 1] - at - RUN, SIDE)
            steps = np.arange(SIDE)
            after = codes[at[:, None] + RUN + SIDE + steps] * (steps < right[:, None])
            before = codes[at[:, None] + SIDE - 1 - steps] * (steps < left[:, None])
            around = np.concatenate([after, before, (at - highest)[:, None], (at - lowest)[:, None]], axis=1).astype(np.uint16)
            ids = batch.column(0).slice(i, j - i).take(pa.array(doc))
            yield pa.record_batch([K.signed(run), K.keys_to_arrow(around), ids, pa.array(place)], names=["run", "around", "doc_id", "place"])


SCHEMA = "kind string, key long, doc_id long, start long, stop long"


def _rows(kind: str, key: np.ndarray | None, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    keys = pa.nulls(n, pa.int64()) if key is None else K.signed(key)
    return pa.record_batch([pa.array([kind] * n, pa.string()), keys, pa.array(doc, mask=doc == NONE), pa.array(start), pa.array(stop)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _shared(batches: Iterator[pa.RecordBatch], held: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Over sorted suffixes: passages that other documents hold ("span"), and keys of runs that are not seen whole ("key")."""
    tail: tuple | None = None
    parted: set[int] = set()
    for batch in batches:
        now = (batch.column(0).to_numpy(), K.binary_rows(batch.column(1), np.uint16, 2 * SIDE + 2), batch.column(2).fill_null(NONE).to_numpy(), batch.column(3).to_numpy())
        if not len(now[0]):
            continue
        if tail is None:
            parted.add(int(now[0][0]))
        rows = now if tail is None else tuple(np.concatenate([t, x]) for t, x in zip(tail, now, strict=True))
        # The last run is kept until its end is seen, up to a bound.
        cut = int(np.searchsorted(rows[0], rows[0][-1]))
        if len(rows[0]) - cut > held:
            cut = len(rows[0])
            parted.add(int(rows[0][-1]))
        if cut:
            yield from _settle(tuple(x[:cut] for x in rows), parted)
        tail = tuple(x[cut:] for x in rows)
    if tail is not None and len(tail[0]):
        yield from _settle(tail, parted | {int(tail[0][-1])})


def _keys(run: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, words before the run) of every passage that the suffixes are minimisers of."""
    sides = []
    for k in (0, 1):
        codes = around[:, k * SIDE : (k + 1) * SIDE].astype(K.U) + (np.arange(1, SIDE + 1).astype(K.U) << K.U(16))
        sums = np.zeros((len(run), SIDE + 1), K.U)
        np.cumsum(K.mix(codes, 50 + k), axis=1, out=sums[:, 1:])
        sides.append(sums)
    key, row, before = [], [], []
    for n in range(SIDE + 1):
        ok = np.flatnonzero((around[:, 2 * SIDE] <= n) & (n <= around[:, 2 * SIDE + 1]))
        key.append(K.mix(K.mix(run[ok].view(K.U), 60 + n) ^ K.mix(sides[0][ok, SIDE - n] + sides[1][ok, n], 52), 53))
        row.append(ok)
        before.append(np.full(len(ok), n))
    return np.concatenate(key), np.concatenate(row), np.concatenate(before)


def _settle(rows: tuple, parted: set[int]) -> Iterator[pa.RecordBatch]:
    run, around, doc, place = rows
    edge = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.append(edge, len(run)))
    partly = np.isin(run, np.fromiter(parted, np.int64, len(parted)))
    use = np.flatnonzero(partly | np.repeat(np.minimum.reduceat(doc, edge) != np.maximum.reduceat(doc, edge), size))
    if not len(use):
        return
    key, row, before = _keys(run[use], around[use])
    row = use[row]
    order = np.lexsort((doc[row], key))
    key, row, before = key[order], row[order], before[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.cumsum(first) - 1
    last = np.concatenate([first[1:], [True]])
    own = doc[row]
    shared = (own[first] != own[last])[group]

    sent = partly[row] & (~shared | first | last)
    if sent.any():
        start = place[row[sent]] - before[sent]
        yield _rows("key", key[sent], own[sent], start, start + LEAST)
    if shared.any():
        # Passages of a suffix that start one after another make one span.
        row, before = row[shared], before[shared]
        order = np.lexsort((before, row))
        row, before = row[order], before[order]
        fresh = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (before[1:] != before[:-1] + 1)]))
        end = np.append(fresh[1:], len(row)) - 1
        at = place[row[fresh]]
        yield _rows("span", None, doc[row[fresh]], at - before[end], at - before[fresh] + LEAST)


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, start_word, n_words: the stretches of 50 words or more that other documents hold too, merged."""
    suffixes = plain(docs, doc_id="long", text="string").mapInArrow(_suffixes, "run long, around binary, doc_id long, place long")
    order = ["run", "around", "doc_id", "place"]
    found = suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shared, SCHEMA)
    found = scratch.table(found, "found")

    keys = found.where("kind = 'key'")
    ids = F.coalesce("doc_id", F.lit(NONE))
    shared = keys.groupBy("key").agg(F.min(ids).alias("low"), F.max(ids).alias("high")).where("low <> high").select("key")
    settled = keys.join(shared, "key").select("doc_id", "start", "stop")
    spans = found.where("kind = 'span'").select("doc_id", "start", "stop").unionByName(settled).distinct()

    by_doc = Window.partitionBy("doc_id").orderBy("start", "stop")
    before = F.max("stop").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("long"))
    islands = islands.withColumn("island", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), (F.max("stop") - F.min("start")).alias("n_words"))
    return merged.select("doc_id", "start_word", "n_words")
