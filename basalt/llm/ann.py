"""Approximate nearest neighbours: robust-pruned directed graphs, one a shard, searched by beams.

Equal vectors form one class, which keeps its few smallest ids: no result can need more of them, so a
vector that is very common costs one node. Classes are dealt to shards by hash. In a shard each node
is inserted by a greedy search from the medoid; of what it meets, relaxed distance pruning keeps
diverse edges (a neighbour goes if a kept one is ``relax`` times nearer to it than the node is), and
reverse edges are pruned likewise. Queries, as distinct vectors, are searched in every shard by a beam;
the best of all shards are merged by exact cosine in double precision.

Shards hold about 1/64 of the classes, within 1,024 and 65,536, so a task's memory is bounded. A shard's
index lies in rows of at most ``CELL`` bytes in a bucketed table, which searches read in place. Queries
come in blocks of about ``block_bytes`` of vectors: a block is broadcast, so no vector is copied for each
shard in a shuffle; what the shards find is cut to the best by two levels of aggregation. Every vector is
indexed, and every query is searched in every shard: the number of searches is queries times shards.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without
an id, take no part; vectors of different lengths are never compared; rows equal in id and vector
count once; a row is never its own neighbour, nor is another with its id. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, plain

DEGREE, BEAM, WIDE, CLASSES = 24, 48, 64, 10
CELL = 8 << 20


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The best ``beam`` nodes a query, best first, with their similarities; -1 where there are fewer."""
    b, n = len(queries), len(x)
    ids = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -np.inf, np.float32)
    open_ = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    rows = np.arange(b)[:, None]
    ids[:, 0], sims[:, 0], open_[:, 0] = entry, queries @ x[entry], True
    seen[:, entry] = seen[:, n] = True
    while open_.any():
        best = np.argsort(np.where(open_, -sims, np.inf), axis=1, kind="stable")[:, :width]
        use = open_[rows, best]
        open_[rows, best] = False
        near = np.where(use[:, :, None], graph[np.where(use, ids[rows, best], 0)], -1).reshape(b, -1)
        near = np.sort(near, axis=1)
        fresh = (near >= 0) & ~seen[rows, np.where(near >= 0, near, n)]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(fresh)
        found = np.full(near.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("ij,ij->i", x[near[r, c]], queries[r])
        seen[r, near[r, c]] = True
        ids, sims, open_ = (np.concatenate(z, axis=1) for z in ((ids, np.where(fresh, near, -1)), (sims, found), (open_, fresh)))
        top = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims, open_ = ids[rows, top], sims[rows, top], open_[rows, top]
    return ids, sims


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, relax: float, degree: int) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node out of its row of ``pool`` (-1: none)."""
    pool = np.sort(pool, axis=1)
    alive = (pool >= 0) & (pool != nodes[:, None])
    alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]
    v = x[np.where(alive, pool, 0)]
    far = np.where(alive, 2 - 2 * np.einsum("bcd,bd->bc", v, x[nodes]), np.inf)
    between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    out, rows = np.full((len(nodes), degree), -1, np.int64), np.arange(len(nodes))
    for k in range(degree):
        pick = np.argmin(np.where(alive, far, np.inf), axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, k] = pool[rows, pick][some]
        alive &= relax * relax * between[rows, pick] > far
        alive[rows, pick] = False
    return out


def build(x: np.ndarray, relax: float = 1.2, degree: int = DEGREE, beam: int = BEAM, seed: int = 5, batch: int = 128) -> tuple[np.ndarray, int]:
    """The graph of unit vectors (neighbours a node, -1 at the end) and the medoid."""
    n, rng = len(x), np.random.default_rng(seed)
    graph = np.full((n, degree), -1, np.int64)
    if n > 1:
        start = rng.integers(0, n - 1, (n, min(degree // 2, n - 1)))
        graph[:, : start.shape[1]] = start + (start >= np.arange(n)[:, None])
    entry = int(np.argmax(x @ x.mean(0)))
    for alpha in (1.0, relax):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            nodes = order[at : at + batch]
            met, _ = beam_search(x, graph, entry, x[nodes], beam)
            chosen = robust_prune(x, nodes, np.concatenate([met, graph[nodes]], axis=1), alpha, degree)
            graph[nodes] = chosen
            source, target = np.repeat(nodes, degree), chosen.ravel()
            source, target = source[target >= 0], target[target >= 0]
            order_t = np.argsort(target, kind="stable")
            source, target = source[order_t], target[order_t]
            to, first, count = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(to), int(count.max(initial=0))), -1, np.int64)
            back[np.repeat(np.arange(len(to)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            pool = np.concatenate([graph[to], back], axis=1)
            fits = (pool >= 0).sum(1) <= degree
            packed = np.take_along_axis(pool, np.argsort(pool < 0, axis=1, kind="stable"), axis=1)[:, :degree]
            if (~fits).any():
                packed[~fits] = robust_prune(x, to[~fits], pool[~fits], alpha, degree)
            graph[to] = packed
    return graph, entry


def _unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def _classes(query_step: int, ids_kept: int):
    """Within a task: each vector once, with its smallest ids; and the query ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        for batch in batches:
            asked: tuple[list, list] = ([], [])
            ids = batch.column(0).to_pylist()
            column = batch.column(1)
            flat, ends = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float), np.asarray(column.value_lengths().fill_null(0))
            at = np.concatenate([[0], np.cumsum(ends)])
            for i, vec_id in enumerate(ids):
                v = flat[at[i] : at[i + 1]]
                if vec_id is None or not len(v) or not np.isfinite(v).all() or not 0 < np.linalg.norm(v) < np.inf:
                    continue
                raw = v.tobytes()
                own = seen.setdefault(raw, [])
                if vec_id not in own:
                    own.append(vec_id)
                    own.sort()
                    del own[ids_kept:]
                if vec_id % query_step == 0:
                    asked[0].append(raw)
                    asked[1].append(vec_id)
            yield pa.record_batch([pa.array(asked[0], pa.binary()), pa.array(asked[1], pa.int64()), pa.nulls(len(asked[0]), pa.list_(pa.int64()))], names=["vec", "query_id", "ids"])
        yield pa.record_batch([pa.array(list(seen), pa.binary()), pa.nulls(len(seen), pa.int64()), pa.array(list(seen.values()), pa.list_(pa.int64()))], names=["vec", "query_id", "ids"])

    return run


INDEX = "size int, shard int, part int, entry long, vectors binary, graph binary, ids binary, counts binary"


def _index(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec")
    vectors = np.frombuffer(b"".join(rows["vec"]), np.float64).reshape(len(rows), -1)
    graph, entry = build(_unit(vectors))
    ids, step = rows["ids"].tolist(), max(1, CELL // (vectors.itemsize * vectors.shape[1]))
    out = []
    for part, x in enumerate(range(0, len(rows), step)):
        own = ids[x : x + step]
        flat = np.array([int(i) for some in own for i in some], np.int64)
        out.append((key[0], key[1], part, entry, vectors[x : x + step].tobytes(), graph[x : x + step].astype(np.int32).tobytes(), flat.tobytes(), np.array([len(some) for some in own], np.int32).tobytes()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])


FOUND = "q long, part int, found array<struct<far: double, id: long>>"


def _search(sent):
    def run(key: tuple, index: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"q": [], "part": [], "found": []}
        for size, rows in index.groupby("size"):
            if size not in sent.value:
                continue
            rows = rows.sort_values("part")
            numbers, q = sent.value[size]
            joined = lambda c, kind: np.frombuffer(b"".join(rows[c]), kind)  # noqa: B023, E731
            vectors = joined("vectors", np.float64).reshape(-1, size // 8)
            graph, counts, ids = joined("graph", np.int32).reshape(len(vectors), -1).astype(np.int64), joined("counts", np.int32), joined("ids", np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)])
            unit, norm = _unit(vectors), np.linalg.norm(vectors, axis=1)
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                near, _ = beam_search(unit, graph, int(rows["entry"].iloc[0]), _unit(part), WIDE)
                for i, v in enumerate(part):
                    nodes = near[i][near[i] >= 0][: 2 * CLASSES]
                    exact = (vectors[nodes] @ v) / (norm[nodes] * np.linalg.norm(v))
                    best = np.lexsort((ids[ends[nodes]], -exact))[:CLASSES]
                    out["q"].append(int(numbers[at + i]))
                    out["part"].append(int(key[0]) % 64)
                    out["found"].append([{"far": float(-exact[b]), "id": int(c)} for b in best for c in ids[ends[nodes[b]] : ends[nodes[b] + 1]]])
        return pd.DataFrame({name: pd.Series(column, dtype=object) for name, column in out.items()})

    return run


def search(embeddings: DataFrame, scratch: Scratch, query_step: int = 50, k: int = 5, block_bytes: int = 32 << 20, least_shard: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose vec_id is divisible by ``query_step``."""
    spark = embeddings.sparkSession
    rows = plain(embeddings, vec_id="long", embedding="array<double>").where("vec_id is not null and size(embedding) > 0")
    read = scratch.table(rows.mapInArrow(_classes(query_step, k + 1), "vec binary, query_id long, ids array<long>"), "vectors")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    size = F.octet_length("vec").alias("size")
    classes = scratch.table(read.where("ids is not null").groupBy("vec").agg(ids).select("vec", "ids", size), "classes")
    n = max(1, classes.count())
    shards = -(-n // min(65_536, max(least_shard, n // 64)))
    files, name = min(shards, 16_384), f"basalt_index_{uuid.uuid4().hex}"
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    asked = read.where("query_id is not null").select("vec", "query_id").distinct()
    # Numbers are fixed once written.
    single = scratch.table(asked.select("vec").distinct().select("vec", size, F.monotonically_increasing_id().alias("q")), "queries")
    blocks = -(-(single.agg(F.sum("size")).first()[0] or 1) // block_bytes)
    keep = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, (k + 1) * CLASSES).alias("found")
    best = None
    try:
        index = scratch.bucketed(dealt.groupBy("size", "shard").applyInPandas(_index, INDEX).repartition(files, "shard"), "index", name, files, "shard")
        for b in range(blocks):
            block: dict[int, tuple[list, list]] = {}
            for r in single.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect():
                numbers, vectors = block.setdefault(r["size"], ([], []))
                numbers.append(r["q"])
                vectors.append(bytes(r["vec"]))
            sent = spark.sparkContext.broadcast({s: (np.array(q), np.frombuffer(b"".join(v), np.float64).reshape(len(q), -1)) for s, (q, v) in block.items()})
            found = index.groupBy("shard").applyInPandas(_search(sent), FOUND)
            best = scratch.append(found.groupBy("q", "part").agg(keep).groupBy("q").agg(keep), "best")
            sent.unpersist()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    near = asked.join(single.select("vec", "q"), "vec").select("query_id", "q").join(best, "q").select("query_id", F.posexplode(own).alias("at", "x"))
    out = scratch.table(near.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score")), "neighbours")
    scratch.drop("vectors", "classes", "index", "queries", "best")
    return out
