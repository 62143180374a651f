"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are dealt to blocks around pivots, queries and data alike.  A block's vectors form a
cover tree, and so do the queries that visit it.  A node is a centre and a covering radius; the best
inner product of a node pair is at most <c, d> + r|d| + s|c| + rs.  A pair of nodes is
pruned when that is below the worst k-th score of the queries under the query node.

Every query first searches the block it lies in.  Its k-th score there prunes blocks the same way:
a query is sent only to those whose centre and radius allow a score that high, and prunes there from
the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import hash_sample
from faultline.session import materialise

#: Vectors of a block, about, and the sample that pivots are taken from, at most.
BLOCK_ROWS = 65_536
PIVOT_SAMPLE = 8192
MOST_PIVOTS = 1024
LEAF, FANOUT, SHRINK = 128, 16, 1.5
#: Queries from other blocks that a task holds, about: as many as vectors.  A block is copied once for each part.
QUERY_BLOCK = 65_536
#: Queries that are copied at once on their way to blocks, about.
SENT_ROWS = 16_384
NOTHING = -(2**62)


class CoverTree:
    """Node i covers the points ``order[first[i]:end[i]]`` within ``radius[i]`` of ``centre[i]``."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.centre, self.radius, self.first, self.end = [], [], [], []
        self.children: list[list[int]] = []
        if len(points):
            self._grow(0, len(points), 0)

    def _grow(self, first: int, end: int, depth: int) -> int:
        own = self.order[first:end]
        at = self.points[own]
        centre = at[0]
        far = np.sqrt(np.maximum(((at - centre) ** 2).sum(axis=1), 0))
        node = len(self.centre)
        self.centre.append(centre), self.radius.append(float(far.max())), self.first.append(first), self.end.append(end)
        self.children.append([])
        if end - first <= LEAF or far.max() == 0 or depth > 60:
            return node
        # A cover by balls of a smaller radius, each centre the point farthest from those before.
        nearest, ball = far.copy(), np.zeros(len(own), dtype=np.int64)
        for k in range(1, FANOUT):
            if nearest.max() <= self.radius[node] / SHRINK:
                break
            pick = at[int(nearest.argmax())]
            d = np.sqrt(((at - pick) ** 2).sum(axis=1))
            ball[d < nearest] = k
            nearest = np.minimum(nearest, d)
        # Centres come first in their balls.
        by_ball = np.lexsort((nearest, ball))
        self.order[first:end] = own[by_ball]
        cuts = np.flatnonzero(np.diff(ball[by_ball])) + 1
        edges = [0, *cuts.tolist(), end - first]
        if len(edges) > 2:
            for a, b in zip(edges, edges[1:]):
                self.children[node].append(self._grow(first + a, first + b, depth + 1))
        return node


class Best:
    """The k best (score, id) of every query, higher scores first, smaller ids on ties."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.scores = np.full((queries, k), NOTHING, dtype=np.int64)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.floor = floor

    def worst(self, rows: np.ndarray) -> int:
        """No query among ``rows`` takes a score below this."""
        return int(np.maximum(self.scores[rows, -1], self.floor[rows]).min())

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        limit = np.maximum(self.scores[rows, -1], self.floor[rows])
        k = self.scores.shape[1]
        for i in np.flatnonzero((scores >= limit[:, None]).any(axis=1)):
            row, good = rows[i], scores[i] >= limit[i]
            s, n = np.concatenate((self.scores[row], scores[i][good])), np.concatenate((self.ids[row], ids[good]))
            best = np.lexsort((n, -s))[:k]
            self.scores[row], self.ids[row] = s[best], n[best]


def dual_search(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """The k best of ``data`` for each query, both integer-valued; scores below ``floor`` may be left out."""
    best = Best(len(queries), k, floor)
    if not len(queries) or not len(data):
        return best
    q, d = queries.astype(np.float64), data.astype(np.float64)
    # Sums of products are exact in floats while they stay under 2**53.
    exact = np.sqrt((q**2).sum(axis=1).max() * (d**2).sum(axis=1).max()) < 2**52
    left, right = CoverTree(q), CoverTree(d)
    norms_l = [float(np.linalg.norm(c)) for c in left.centre]
    norms_r = [float(np.linalg.norm(c)) for c in right.centre]

    def bounds(i: int, js: list[int]) -> np.ndarray:
        r, s = left.radius[i], np.array([right.radius[j] for j in js])
        size = norms_l[i], np.array([norms_r[j] for j in js])
        most = np.array([right.centre[j] for j in js]) @ left.centre[i] + r * size[1] + s * size[0] + r * s
        return most + 1e-9 * (1 + (size[0] + r) * (size[1] + s))

    stack = [(float(bounds(0, [0])[0]), 0, 0)]
    while stack:
        bound, i, j = stack.pop()
        rows = left.order[left.first[i] : left.end[i]]
        if bound < best.worst(rows):
            continue
        if not left.children[i] and not right.children[j]:
            members = right.order[right.first[j] : right.end[j]]
            if exact:
                scores = np.rint(q[rows] @ d[members].T).astype(np.int64)
            else:
                scores = queries[rows] @ data[members].T
            best.offer(rows, scores, ids[members])
        elif left.children[i] and (not right.children[j] or left.radius[i] >= right.radius[j]):
            stack += sorted((float(bounds(c, [j])[0]), c, j) for c in left.children[i])
        else:
            near = right.children[j]
            stack += sorted(zip(bounds(i, near).tolist(), [i] * len(near), near))  # the most promising is on top
    return best


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component as a double; null if the vector or a component has no finite value."""
    x = F.transform(vector, lambda v: v.cast("double"))
    infinite = F.lit(float("inf"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < infinite))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.list_value_length(column))
    out = np.zeros((len(column), int(sizes.max()) if len(sizes) else 0), dtype=np.int64)
    flat = np.asarray(pc.list_flatten(column))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Points far from each other: the top of a cover tree over the sample."""
    at = sample.astype(np.float64)
    picked, nearest = [0], ((at - at[0]) ** 2).sum(axis=1)
    while len(picked) < count and nearest.max() > 0:
        picked.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((at - at[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def _dealer(pivots: np.ndarray):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, to = _same_width(_matrix(batch["vector"]), pivots)
            at, to = at.astype(np.float64), to.astype(np.float64)
            far = (to**2).sum(axis=1)[None, :] - 2 * at @ to.T
            cells = far.argmin(axis=1).astype(np.int32) if len(pivots) else np.zeros(len(at), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    return deal


COVER = "block int, centre array<bigint>, radius double"


def _cover(key: tuple, rows: pa.Table) -> pa.Table:
    """The mean of a block's vectors, in whole numbers, and the radius around it that covers them."""
    at = _matrix(rows["vector"]).astype(np.float64)
    centre = np.rint(at.mean(axis=0))
    radius = float(np.sqrt(((at - centre) ** 2).sum(axis=1).max()))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "centre": [centre.astype(np.int64)], "radius": [radius]})


def _visitor(covers: Broadcast):
    """A row for each query and block but its own whose bound reaches the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, centres, radii = covers.value
        for batch in batches:
            # Few queries at once, as each may go to all blocks.
            few = max(1, SENT_ROWS // max(1, len(blocks)))
            for some in (batch.slice(at, few) for at in range(0, batch.num_rows, few)):
                q, c = (m.astype(np.float64) for m in _same_width(_matrix(some["vector"]), centres))
                # A little more than the bound, for what is rounded.
                spare = radii + 1e-9 * np.sqrt((c**2).sum(axis=1)) + 1e-6
                bound = q @ c.T + np.sqrt((q**2).sum(axis=1))[:, None] * spare[None, :] + 1
                floor = some["floor"].fill_null(NOTHING).to_numpy()
                rows, columns = np.nonzero((bound >= floor[:, None]) & (blocks != some["_home"].to_numpy()[:, None]))
                sent = some.select(["query", "vector", "floor"]).take(pa.array(rows))
                block = pa.array(blocks[columns], pa.int32())
                yield pa.RecordBatch.from_arrays([*sent.columns, block], names=[*sent.schema.names, "block"])

    return run


def visits(home: DataFrame, floors: DataFrame, placed: DataFrame) -> DataFrame:
    """(query, vector, floor, block): the blocks, home aside, that may hold one of a query's best.

    ``home`` is (query, vector, block), ``floors`` (query, floor), ``placed`` the data with its
    block.  The covers, a centre for about BLOCK_ROWS vectors, are broadcast.
    """
    found = placed.select("block", "vector").groupBy("block").applyInArrow(_cover, COVER).orderBy("block").toArrow()
    centres = _matrix(found["centre"]) if found.num_rows else np.zeros((0, 0))
    covers = (found["block"].to_numpy(), centres, found["radius"].to_numpy())
    asked = home.withColumnRenamed("block", "_home").join(floors, "query", "left")
    held = home.sparkSession.sparkContext.broadcast(covers)
    return asked.select("query", "vector", "floor", "_home").mapInArrow(
        _visitor(held), "query long, vector array<bigint>, floor long, block int"
    )


FOUND_SCHEMA = "query long, vec_id long, score long"


def _found(best: Best, keys: np.ndarray) -> pa.Table:
    some = best.scores > NOTHING
    rows = np.repeat(np.arange(len(keys)), some.sum(axis=1))
    return pa.table({"query": keys[rows], "vec_id": best.ids[some], "score": best.scores[some]})


def _searcher(k: int):
    def search(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not data.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query", "vec_id", "score")})
        d, q = _same_width(_matrix(data["vector"]), _matrix(queries["vector"]))
        floor = queries["floor"].fill_null(NOTHING).to_numpy()
        return _found(dual_search(q, d, data["vec_id"].to_numpy(), k, floor), queries["query"].to_numpy())

    return search


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = BLOCK_ROWS, scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query with other rows.

    ``vectors`` has vec_id and embedding; components become floor(scale * x), so scores are integers.
    ``is_query`` picks the queries by vec_id; ties go to the smaller vec_id; a query with
    fewer than k other rows gets all of them.  Rows with a null vec_id, a null vector or a null or
    infinite component, or NaN, take no part.  Rows that repeat vec_id and vector count
    once.  A vec_id with several vectors is several queries, none of which finds the id itself.
    Shorter vectors count as filled up with zeros.  An empty table gives an empty one.

    Equal vectors score alike, so of a vector's rows the k + 1 with the smallest vec_ids can be
    among the best; the others are known not to be and leave before the search.
    """
    rows = vectors.select("vec_id", quantised(F.col("embedding"), scale).alias("vector"))
    rows = rows.filter("vec_id is not null and vector is not null")
    first = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    kept = materialise(
        rows.distinct().withColumn("_n", first).filter(F.col("_n") <= k + 1).select("vec_id", "vector")
    )
    asked = materialise(rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct())
    # One search for each distinct query vector; the numbers are fixed by the checkpoint.
    searched = materialise(
        asked.select("vector").distinct().select("vector", F.monotonically_increasing_id().alias("query"))
    )

    total = kept.count()
    blocks = max(1, -(-total // block_rows), min(-(-total // 2048), 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    sample = kept.filter(hash_sample(F.xxhash64("vec_id", "vector"), PIVOT_SAMPLE, total))
    points = _matrix(sample.orderBy("vec_id", "vector").select("vector").toArrow()["vector"])
    pivots = _pivots(points, min(MOST_PIVOTS, blocks)) if len(points) else points
    schema = "vec_id long, vector array<bigint>, cell int"
    dealt = materialise(kept.mapInArrow(_dealer(pivots), schema))
    # At most MOST_PIVOTS counts; a crowded cell is cut into parts.
    parts = {r["cell"]: -(-r["count"] // block_rows) for r in dealt.groupBy("cell").count().collect()}
    starts, blocks = {}, 0
    for cell, many in sorted(parts.items()):
        starts[cell], blocks = blocks, blocks + many
    placed = _in_blocks(dealt, "cell", starts, parts)
    home = _in_blocks(
        searched.select(F.col("query").alias("vec_id"), "vector").mapInArrow(_dealer(pivots), schema), "cell", starts, parts
    ).select(F.col("vec_id").alias("query"), "vector", "block")

    search = _searcher(k + 1)
    at_home = materialise(
        placed.groupBy("block")
        .cogroup(home.withColumn("floor", F.lit(None).cast("long")).groupBy("block"))
        .applyInArrow(search, FOUND_SCHEMA)
    )
    # A query's last score at home, if it found k + 1 there, is a floor for all other blocks.
    floors = at_home.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).alias("floor"))
    away = visits(home, floors, placed)
    many = max(1, -(-searched.count() // QUERY_BLOCK))
    away = away.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(many)).cast("int"))
    copies = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    elsewhere = (
        copies.groupBy("block", "part").cogroup(away.groupBy("block", "part")).applyInArrow(search, FOUND_SCHEMA)
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = (
        at_home.union(elsewhere).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n")
    )
    per_query = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(searched, "vector")
        .select("query_id", "query")
        .join(best, "query")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(per_query))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _in_blocks(df: DataFrame, cell: str, starts: dict[int, int], parts: dict[int, int]) -> DataFrame:
    """``df`` with ``block``: the first block of its cell, plus a part by the vector's hash."""
    if not starts:
        return df.withColumn("block", F.lit(0))
    size = max(starts) + 1
    first = F.array(*[F.lit(starts.get(c, 0)) for c in range(size)])
    many = F.array(*[F.lit(parts.get(c, 1)) for c in range(size)])
    at = F.col(cell)
    # Query and data rows with one vector get one block, so queries find their own neighbours first.
    return df.withColumn("block", (F.get(first, at) + F.pmod(F.xxhash64("vector"), F.get(many, at))).cast("int"))
