"""Mixing sources to target weights by subset-sum budget fitting.

A document's size is its number of words (runs without ASCII blanks). Sources by code point, null
last, weigh 3, 1, 2, repeating; they share ``share`` times all sizes by weight, none above ``most``
times its own size, what is cut being shared again by weight until none is above.

Documents are counted by source and exact size: these counts, bounded by the longest text, are all
that the fitting sees. A source takes every document ``floor(target / size of the source)`` times; the
rest of its budget must be a subset. Of a source of at most ``SMALL`` words a bounded-knapsack dynamic
program finds the largest sum that fits. Of a larger one, each size gives its proportional share of
documents (rounded down), the gap is filled greedily up to a window of ``SMALL`` words or eight of the
longest texts, to which some documents of the smallest sizes are given back, and the program closes this
window: exactly, or to the nearest sum below that its documents reach.

Which documents of a size are taken once more is decided by a seeded hash of their ids. Documents of a
(source, size) fall into 64 hash buckets, whose counts say which are taken whole; those of the one bucket
on the border fall into 1,024, and documents are ranked in the one of these on the border only. So no
group is counted, joined or ranked in one task.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is a source of
its own, weighed last; null ids are ranked by hash like others; rows repeated exactly are
interchangeable: as many as needed are taken. Sources without words have target 0. An empty table
gives no rows. There is one total a source on the driver, nothing of documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, plain

WEIGHTS = (3.0, 1.0, 2.0)
SMALL = 1 << 16
COARSE, FINE = 64, 1024
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Budget of each source, given the sizes in order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[i] for i in sorted(open_))
        above = {i for i in open_ if left * w[i] / total > most * sizes[i]}
        if not above:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in sorted(above):
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= above
    return out


def fit_subset(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to ``budget`` or just below.

    Sizes are distinct and positive, and the budget is at most their total.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    if total <= SMALL:
        return _knapsack(sizes, counts, budget)
    take = (counts.astype(object) * budget // total).astype(np.int64)
    left, rest, window = budget - int((take * sizes).sum()), counts - take, max(SMALL, 8 * int(sizes.max()))
    for i in np.argsort(-sizes, kind="stable"):  # down to the window
        n = max(0, min(int(rest[i]), (left - window) // int(sizes[i])))
        take[i], rest[i], left = take[i] + n, rest[i] - n, left - n * int(sizes[i])
    for i in np.argsort(sizes, kind="stable"):  # up to the window
        n = max(0, min(int(take[i]), (window - left) // int(sizes[i])))
        take[i], rest[i], left = take[i] - n, rest[i] + n, left + n * int(sizes[i])
    return take + _knapsack(sizes, rest, left)


def _knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack by bits: the largest reachable sum within ``budget``, and what makes it up."""
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    piece = np.full(budget + 1, -1, np.int32)
    pieces: list[tuple[int, int]] = []
    order = np.argsort(sizes, kind="stable")
    for i in order:
        s, n, k = int(sizes[i]), min(int(counts[i]), budget // max(1, int(sizes[i]))), 1
        while n > 0 and not reach[budget]:
            k = min(k, n)
            new = np.flatnonzero(reach[: budget + 1 - s * k] & ~reach[s * k :]) + s * k
            piece[new] = len(pieces)
            reach[new] = True
            pieces.append((int(i), k))
            n -= k
            k *= 2
        if reach[budget]:
            break
    out, at = np.zeros(len(sizes), np.int64), int(np.flatnonzero(reach)[-1])
    while at:
        i, k = pieces[piece[at]]
        out[i] += k
        at -= k * int(sizes[i])
    return out


def _plan(budgets: dict[str, float]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        total = int((sizes * counts).sum())
        whole, extra = divmod(int(np.floor(budgets[key[0]] + 1e-6)), max(total, 1))
        return pd.DataFrame({"src": key[0], "size": sizes, "n": counts, "whole": whole, "extra": fit_subset(sizes, counts, extra)})

    return run


def mix(docs: DataFrame, scratch: Scratch, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken."""
    rows = plain(docs, doc_id="long", text="string", source="string")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    src = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("src")
    h = F.xxhash64(F.lit(seed), "doc_id")
    hashed = [h.alias("h"), F.pmod(F.xxhash64(F.lit(1), h), F.lit(COARSE)).alias("bucket"), F.pmod(F.xxhash64(F.lit(2), h), F.lit(FINE)).alias("fine")]
    rows = scratch.table(rows.select("doc_id", src, size, *hashed), "sizes")
    counts = scratch.table(rows.groupBy("src", "size", "bucket").agg(F.count("*").alias("m")), "counts")
    of_size = counts.groupBy("src", "size").agg(F.sum("m").alias("n"))
    totals = {r["src"]: r["total"] for r in of_size.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()}
    order = sorted(totals, key=lambda s: (s == "n", s))  # Python compares by code point
    budgets = dict(zip(order, targets([totals[s] for s in order], weights, share, most), strict=True))
    plan = scratch.table(of_size.where("size > 0").groupBy("src").applyInPandas(_plan(budgets), "src string, size long, n long, whole long, extra long"), "plan")

    def quotas(counts: DataFrame, wanted: DataFrame, bucket: str, name: str) -> DataFrame:
        """How many of each bucket's ``m`` documents are taken once more, first buckets first."""
        before = F.expr(f"sum(m) over (partition by src, size order by {bucket} rows between unbounded preceding and 1 preceding)")
        quota = F.least(F.greatest(F.col("extra") - F.coalesce(before, F.lit(0)), F.lit(0)), "m").alias("quota")
        return scratch.table(counts.join(wanted.hint("merge"), ["src", "size"]).select("src", "size", bucket, "m", "whole", quota), name)

    border = F.expr("quota > 0 and quota < m")
    times = F.coalesce(F.col("whole") + (F.col("quota") > 0).cast("long"), F.lit(0)).alias("times")
    columns = ["doc_id", "src", "size"]
    coarse = quotas(counts, plan.select("src", "size", "whole", "extra"), "bucket", "coarse")
    known = rows.join(coarse.hint("merge"), ["src", "size", "bucket"], "left")
    held = scratch.table(known.where(border).select(*columns, "h", "fine", "quota"), "held")
    wanted = coarse.where(border).select("src", "size", "whole", F.col("quota").alias("extra"))
    fine = quotas(held.groupBy("src", "size", "fine").agg(F.count("*").alias("m")), wanted, "fine", "fine")
    held = held.drop("quota").join(fine.hint("merge"), ["src", "size", "fine"])
    rank = F.expr("row_number() over (partition by src, size, fine order by h, doc_id)")
    ranked = held.where(border).withColumn("times", F.col("whole") + (rank <= F.col("quota")).cast("long"))
    out = known.where(~F.coalesce(border, F.lit(False))).select(*columns, times)
    out = out.unionByName(held.where(~border).select(*columns, times)).unionByName(ranked.select(*columns, "times"))
    budget = [(s, int(totals[s]), float(budgets[s])) for s in order]
    out = out.join(docs.sparkSession.createDataFrame(budget, "src string, source_size long, target double"), "src")
    out = scratch.table(out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken")), "mix")
    scratch.drop("sizes", "counts", "plan", "coarse", "held", "fine")
    return out
