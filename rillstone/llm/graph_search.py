"""Nearest neighbours by inner product on robust-pruned directed graphs, one for each shard (operator 3).

Vectors get one more component that brings all to the same length, so that nearness by angle, by distance and by inner
product with a query are the same. A graph is built in batches: a greedy beam search on the graph so far proposes
neighbours of the new points, relaxed pruning keeps those that no kept one is ``ALPHA`` times nearer to, and the reverse
edges are pruned in the same way. Queries search every shard with a beam, in groups; the best of all shards are merged.

Equal vectors are one point with the ``k + 1`` smallest ids that hold it, which is all that ``k`` neighbours of a query can
need; equal queries are searched once. The score of a neighbour is computed anew in double precision, ties go to the
smaller id.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length is not
the most frequent one; a table without others gives no rows; a query with fewer candidates gets all that there are; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillstone.llm import shared

DEGREE = 32
BUILD_BEAM = 64
BEAM = 128
ALPHA = 1.2
SHARD_ROWS = 20_000
LEAST_SHARDS = 8
QUERY_BLOCK = 256
QUERY_GROUP = 16_384


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with one more component, all of the same length."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors.astype(np.float64) ** 2).sum(1), 0))
    return np.hstack([vectors, rest[:, None]]).astype(np.float32)


def beam_search(points: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """Ids of the points in the final beam of each query, nearest first, -1 where there are fewer."""
    b, rows = len(queries), np.arange(len(queries))
    ids = np.full((b, beam), -1, np.int64)
    near = np.full((b, beam), -np.inf, np.float32)
    wait = np.zeros((b, beam), bool)
    seen = np.zeros((b, len(points)), bool)
    ids[:, 0], near[:, 0], wait[:, 0], seen[:, entry] = entry, queries @ points[entry], True, True
    while True:
        ahead = np.where(wait, near, -np.inf)
        best = ahead.argmax(1)
        active = np.flatnonzero(wait[rows, best])
        if not len(active):
            order = np.argsort(-near, 1, kind="stable")
            return np.take_along_axis(ids, order, 1)
        best = best[active]
        wait[active, best] = False
        found = links[ids[active, best]]
        new = (found >= 0) & ~seen[active[:, None], found]
        seen[active[:, None], np.where(new, found, entry)] = True
        score = np.einsum("ard,ad->ar", points[found], queries[active], optimize=False)
        score[~new] = -np.inf
        all_near = np.hstack([near[active], score])
        top = np.argpartition(-all_near, beam - 1, 1)[:, :beam]
        near[active] = np.take_along_axis(all_near, top, 1)
        ids[active] = np.take_along_axis(np.hstack([ids[active], np.where(new, found, -1)]), top, 1)
        wait[active] = np.take_along_axis(np.hstack([wait[active], new]), top, 1)


def pruned(points: np.ndarray, which: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """``degree`` diverse neighbours of each of ``which`` from its row of ``pool`` (-1 is none)."""
    out = np.full((len(which), degree), -1, np.int64)
    size = max(1, 40_000 // max(pool.shape[1], 1))
    for at in range(0, len(which), size):
        own, near = which[at : at + size], pool[at : at + size]
        near = np.where(near == own[:, None], -1, near)
        near = -np.sort(-near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        around = points[near]
        away = ((around - points[own][:, None]) ** 2).sum(2)
        away[near < 0] = np.inf
        order = np.argsort(away, 1, kind="stable")
        near, away = np.take_along_axis(near, order, 1), np.take_along_axis(away, order, 1)
        around = np.take_along_axis(around, order[:, :, None], 1)
        alive, rows = near >= 0, np.arange(len(own))
        for k in range(degree):
            pick = alive.argmax(1)
            some = alive[rows, pick]
            if not some.any():
                break
            out[at + rows[some], k] = near[rows, pick][some]
            alive[rows, pick] = False
            between = ((around - around[rows, pick][:, None]) ** 2).sum(2)
            alive &= ~((alpha * alpha * between <= away) & some[:, None])
    return out


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph of ``points``: neighbours of each (-1 is none) and the point where searches begin."""
    n = len(points)
    order = np.random.Generator(np.random.PCG64(11)).permutation(n)
    middle = points.mean(0)
    entry = int(((points - middle) ** 2).sum(1).argmin())
    order = np.concatenate([[entry], order[order != entry]])
    links = np.full((n, degree), -1, np.int64)
    first = order[: min(n, 128)]
    links[first] = pruned(points, first, np.tile(first, (len(first), 1)), degree, alpha)
    done = len(first)
    while done < n:
        batch = order[done : done + min(512, done)]
        pool = beam_search(points, links, entry, points[batch], beam)
        links[batch] = pruned(points, batch, pool, degree, alpha)
        to, source = links[batch].ravel(), np.repeat(batch, degree)
        source, to = source[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        source, to = source[by], to[by]
        target, begin, count = np.unique(to, return_index=True, return_counts=True)
        incoming = np.full((len(target), count.max()), -1, np.int64)
        incoming[np.repeat(np.arange(len(target)), count), np.arange(len(to)) - np.repeat(begin, count)] = source
        links[target] = _with(points, target, np.hstack([links[target], incoming]), degree, alpha)
        done += len(batch)
    return links, entry


def _with(points: np.ndarray, which: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Pools that fit stay as they are; the others are pruned."""
    full = (pool >= 0).sum(1) > degree
    out = -np.sort(-pool, 1)[:, :degree]
    if full.any():
        out[full] = pruned(points, which[full], pool[full], degree, alpha)
    return out


def _packed(column: pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _graphs(width: int, longest: float):  # noqa: ANN202
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        vectors = _packed(rows["vector"], width)
        links, entry = build(lifted(vectors, longest))
        columns = {"shard": key[0], "entry": pa.scalar(entry, pa.int32())}
        blobs = {"ids": rows["point"].to_numpy().astype(np.int64), "vectors": vectors, "links": links.astype(np.int32)}
        arrays = {k: pa.array([v.as_py()], v.type) for k, v in columns.items()}
        return pa.table(arrays | {k: pa.array([v.tobytes()], pa.binary()) for k, v in blobs.items()})

    return run


def _search(width: int, longest: float, k: int, beam: int):  # noqa: ANN202
    def run(key: tuple, graph: pa.Table, queries: pa.Table) -> pa.Table:
        """A group of queries on one graph, in blocks; the search is in single precision, scores and their order in double."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        asked, wanted = queries["asked"].to_numpy(), _packed(queries["wanted"], width)
        for row in graph.to_pylist():
            ids = np.frombuffer(row["ids"], np.int64)
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
            links = np.frombuffer(row["links"], np.int32).reshape(len(ids), -1)
            points = lifted(vectors, longest)
            for at in range(0, len(asked), QUERY_BLOCK):
                own = wanted[at : at + QUERY_BLOCK]
                flat = np.hstack([own, np.zeros((len(own), 1))]).astype(np.float32)
                found = beam_search(points, links, row["entry"], flat, max(beam, k))
                exact = (vectors[found] * own[:, None]).sum(2)
                exact[found < 0] = -np.inf
                order = np.lexsort((np.where(found < 0, 0, ids[found]), -exact), 1)[:, :k]
                found, exact = np.take_along_axis(found, order, 1), np.take_along_axis(exact, order, 1)
                real = found >= 0
                query = np.repeat(asked[at : at + QUERY_BLOCK, None], found.shape[1], 1)
                parts.append((query[real], ids[found[real]], exact[real]))
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        return pa.table(dict(zip(("asked", "point", "score"), map(np.concatenate, zip(*(parts or none))))))

    return run


def neighbours(table: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of ``table`` for each of its rows named in ``queries``.

    ``table`` has ``vec_id, embedding``, ``queries`` has ``vec_id``. A query is never its own neighbour.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    finite = "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    rows = rows.filter(f"vec_id IS NOT NULL AND size(vector) > 0 AND {finite} AND exists(vector, x -> x <> 0)")
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    result = "query_id long, rank int, vec_id long, score double"
    if width is None:
        return table.sparkSession.createDataFrame([], result)
    width = width.width
    rows = rows.filter(F.size("vector") == width).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    rows = shared.written(rows.distinct())
    # The smallest ids of each vector: first of each part of its rows, then of what the parts have left.
    part = Window.partitionBy("vector", F.pmod("vec_id", F.lit(64))).orderBy("vec_id")
    few = rows.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k + 1)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("_r") <= k + 1)
    points = few.groupBy("vector").agg(F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("holders"))
    points = shared.written(points.select("point", "vector", "holders"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).first()
    shards = max(LEAST_SHARDS, -(-size.n // shard_rows))
    dealt = points.select("point", "vector", F.pmod(F.xxhash64("point"), F.lit(shards)).cast("int").alias("shard"))
    blobs = "shard int, entry int, ids binary, vectors binary, links binary"
    graphs = shared.written(dealt.groupBy("shard").applyInArrow(_graphs(width, size.longest), blobs))
    asking = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id")
    asking = shared.written(asking.join(points.select("vector", "point"), "vector").select("vec_id", "point"))
    wanted = points.join(asking.select("point").distinct(), "point", "left_semi").select("point", "vector")
    wanted = shared.written(wanted)
    # A graph travels once for each group of queries, and not for each block; a group of a graph is one task's work.
    groups = wanted.count() // QUERY_GROUP + 1
    group = F.pmod(F.xxhash64("point"), F.lit(groups)).cast("int").alias("group")
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = wanted.select(F.col("point").alias("asked"), F.col("vector").alias("wanted"), group, each_shard)
    graphs = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    found = graphs.groupBy("shard", "group").cogroup(asked.groupBy("shard", "group")).applyInArrow(
        _search(width, size.longest, k + 1, beam), "asked long, point long, score double"
    )
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "point")
    found = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1)
    each = found.join(points.select("point", "holders"), "point").select("asked", "score", F.explode("holders").alias("vec_id"))
    each = each.groupBy("asked").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("all"))
    each = shared.written(each.select("asked", F.slice(F.sort_array("all"), 1, k + 1).alias("all")))
    out = asking.withColumnRenamed("vec_id", "query_id").join(each, asking.point == each.asked)
    others = F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("at", "one"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.s")).alias("score"))
