"""Benchmark decontamination by spaced seeds.

Tokens are runs of ASCII letters and digits and of all non-ASCII characters, with A-Z lowered. Two
fixed masks of six positions hash every place of the benchmark and of the documents; whatever two
tokens of a 13-token window are substituted, one of the masks still hits it. Equal hashes give a
diagonal (document place minus item place), and the tokens around the hit are compared on it.

A document matches an item where 13 tokens in a row (the whole item, if shorter) agree with at least
80%: 11 of 13. Items under nine tokens, the span of the longer mask, match whole and unchanged. For items
of 9 to 12 tokens the two masks leave some of the substitutions allowed without a hit; each such length has
masks more, at fixed places of the whole item, that hit in these cases.

The benchmark is hashed in blocks of about ``block_bytes`` of text, items that are equal counted once, so
what is broadcast has a fixed bound; documents are scanned once a block, and are never shuffled. Hits are
listed in slices of ``SLICE`` and reduced to distinct diagonals as they come, so that texts and items of one
repeated word, whose places all meet, take no more memory than their diagonals.

Defined results: null texts and items count as empty and match nothing; null ids are returned as they
are; repeated documents or items each give rows; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import plain

MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 2, 4, 7, 8))
SPAN, WINDOW, SHARE = 9, 13, 0.8
SLICE = 1 << 18
SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_matches long, item_words long"


def _masked(hashes: np.ndarray, mask: tuple[int, ...], seed: int) -> np.ndarray:
    n = len(hashes) - mask[-1]
    out = np.zeros(max(0, n), K.U)
    for o in mask if n > 0 else ():
        out += hashes[o : o + n] * K.U((2 * o + 3) * 0xD6E8FEB86659FD93 & (2**64 - 1) | 1)
    return K.mix(out, seed)


def needed(n: int) -> int:
    """Equal tokens that a window of n must have."""
    return n if n < SPAN else int(np.ceil(SHARE * n - 1e-9))


@cache
def whole_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks over an item of n tokens, fewer than WINDOW, for the substitutions that MASKS miss."""
    if n < SPAN:
        return (tuple(range(n)),)
    slid = [{p + o for o in mask} for mask in MASKS for p in range(n - mask[-1])]
    missed = [set(bad) for bad in combinations(range(n), n - needed(n)) if all(m & set(bad) for m in slid)]
    out: list[tuple[int, ...]] = []
    while missed:
        out.append(max(combinations(range(n), len(MASKS[0])), key=lambda m: sum(not set(m) & bad for bad in missed)))
        missed = [bad for bad in missed if set(out[-1]) & bad]
    return tuple(out)


def _seeds(w: K.Words, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(hashes, places, whole-item length or 0) of every mask and of every mask of a short length."""
    for s, mask in enumerate(MASKS):
        h, ok = _masked(w.hashes, mask, 100 + s), K.inside(w.first, mask[-1] + 1)
        yield h[ok], np.flatnonzero(ok), 0
    for n in lengths:
        ok = K.inside(w.first, n)
        for s, mask in enumerate(whole_masks(n)):
            h = K.grams(w.hashes, n, 200) if n < SPAN else _masked(w.hashes, mask, 300 + 100 * n + s)[: len(ok)]
            yield h[ok], np.flatnonzero(ok), n


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])] if len(rows) else rows


class Seeds:
    """The hashed benchmark block: what the executors get."""

    def __init__(self, items: list[tuple[int | None, str | None, int]]):
        column = pa.array([t for _, t, _ in items], pa.large_string())
        parts = [K.words(buf, offsets, K.PUNCT) for _, _, buf, offsets in K.text_chunks(column, 1 << 40)]
        self.ids, self.times = [i for i, _, _ in items], [n for _, _, n in items]
        self.tokens = parts[0].hashes if parts else np.zeros(0, K.U)
        self.first = parts[0].first if parts else np.zeros(1, np.int64)
        size = np.diff(self.first)
        self.short = sorted({int(n) for n in size if 0 < n < WINDOW})
        hashes, places = [np.zeros(0, K.U)], [np.zeros(0, np.int64)]
        item = np.repeat(np.arange(len(size)), size)
        if len(self.tokens):
            for h, p, n in _seeds(K.Words(self.tokens, self.tokens, self.tokens, self.first), self.short):
                if n:
                    whole = size[item[p]] == n
                    h, p = h[whole], p[whole]
                hashes.append(h)
                places.append(p)
        h, p = np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        self.hashes, self.places, self.item = h[order], p[order], item
        self.bits = min(25, max(16, int(16 * len(h)).bit_length()))

    def table(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, bool)
        out[(self.hashes >> K.U(64 - self.bits)).astype(np.int64)] = True
        return out

    def hits(self, w: K.Words, table: np.ndarray) -> np.ndarray:
        """Rows (document, item, diagonal), each once, of the seeds shared with the chunk."""
        found, size = [np.zeros((0, 3), np.int64)], 0
        for h, p, _ in _seeds(w, self.short):
            maybe = np.flatnonzero(table[(h >> K.U(64 - self.bits)).astype(np.int64)])
            low = np.searchsorted(self.hashes, h[maybe], "left")
            count = np.searchsorted(self.hashes, h[maybe], "right") - low
            ends = np.cumsum(count)
            for x in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
                flat = np.arange(x, min(int(ends[-1]), x + SLICE))
                own = np.searchsorted(ends, flat, "right")
                q, place = self.places[low[own] + flat - ends[own] + count[own]], p[maybe[own]]
                found.append(_distinct(np.stack([np.searchsorted(w.first, place, "right") - 1, self.item[q], place - q], 1)))
                size += len(found[-1])
                if size > max(SLICE, 2 * len(found[0])):
                    found, size = [_distinct(np.concatenate(found))], 0
        return _distinct(np.concatenate(found))

    def verify(self, w: K.Words, doc: int, item: int, diagonal: int) -> tuple[int, int, int, int] | None:
        """(document word, item word, words, equal words) of what agrees on a diagonal, or None."""
        a, b = int(self.first[item]), int(self.first[item + 1])
        lo, hi = max(a, int(w.first[doc]) - diagonal), min(b, int(w.first[doc + 1]) - diagonal)
        n = min(WINDOW, b - a)
        if hi - lo < n:
            return None
        same = self.tokens[lo:hi] == w.hashes[lo + diagonal : hi + diagonal]
        sums = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(sums[n:] - sums[:-n] >= needed(n))
        if not len(good):
            return None
        covered = np.zeros(hi - lo, bool)
        for g in good.tolist():
            covered[g : g + n] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
        runs = [(int(sums[y] - sums[x]), -x, y) for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        matches, x, y = max(runs)
        x = -x
        return lo + x + diagonal - int(w.first[doc]), lo + x - a, y - x, matches


def _scan(block) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = block.value
        table = seeds.table()
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0)
            for i, _, buf, offsets in K.text_chunks(batch.column(1)):
                w = K.words(buf, offsets, K.PUNCT)
                best: dict[tuple[int, int], tuple] = {}
                for doc, item, diagonal in seeds.hits(w, table).tolist():
                    got = seeds.verify(w, doc, item, diagonal)
                    if got and (got[3], -got[0], -got[1]) > best.get((doc, item), (-1,))[0:3]:
                        best[doc, item] = (got[3], -got[0], -got[1], got[2])
                for (doc, item), (matches, start, at, n) in sorted(best.items()):
                    size = int(seeds.first[item + 1] - seeds.first[item])
                    rows += [(ids[i + doc].as_py(), seeds.ids[item], -start, -at, n, matches, size)] * seeds.times[item]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Seeds]:
    items = plain(benchmark, item_id="long", text="string").groupBy("item_id", "text").agg(F.count("*").alias("times"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-total // (block_bytes // 2)) if total > block_bytes else 1
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        rows = sorted(part.collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield Seeds([tuple(r) for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """Each document and item that match, with the longest stretch that agrees: SCHEMA's columns.

    doc_start and item_start count tokens from 0; n_words is the length of the stretch, n_matches the
    tokens in it that are equal.
    """
    rows = plain(docs, doc_id="long", text="string")
    sent = docs.sparkSession.sparkContext.broadcast
    return reduce(DataFrame.unionByName, [rows.mapInArrow(_scan(sent(s)), SCHEMA) for s in _blocks(benchmark, block_bytes)])


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns as they were."""
    at, sent = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast

    def scan(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds: Seeds = block.value
            table = seeds.table()
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for i, _, buf, offsets in K.text_chunks(batch.column(at)):
                    w = K.words(buf, offsets, K.PUNCT)
                    for doc, item, diagonal in seeds.hits(w, table).tolist():
                        if clean[i + doc] and seeds.verify(w, doc, item, diagonal):
                            clean[i + doc] = False
                yield batch.filter(pc.equal(pa.array(clean), True))

        return run

    for s in _blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(scan(sent(s)), docs.schema)
    return docs
