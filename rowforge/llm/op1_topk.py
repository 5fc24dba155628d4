"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors go into blocks by their norms.  A block keeps, for every dimension, its members in the order of that component.
A query reads all its dimensions' lists in step, from the end that its sign prefers; each vector met is
scored in full.  No vector that is still unseen can score more than the best one whose components lie no further than the
lists' values at the depth reached and whose norm is the block's greatest; once that is below the k-th best score, the
block has nothing more to give (at equality it goes on: ties go to the smaller id).  Blocks' best are merged.

The k-th best score is shared: each query first goes through the block of the greatest norms, and the k-th score there is
a bound that all other blocks start from; blocks whose norms cannot reach it are not visited.

Queries are cut into blocks as well, and each (vector block, query block) is one piece of work, so no task
holds more than one block of each.  Equal vectors share one list entry that holds only as
many of their smallest ids as can matter, so a hot vector costs no more than another.

On vectors without any structure in many dimensions the algorithm has to meet nearly every vector before its bound
falls (`scored_share` tells how many): that is in the nature of the method, and results are exact all the same.

Defined cases: components become floor(scale * x); a vector that is null, or holds null, NaN or an infinity,
takes no part; vectors of unlike length count as padded with zeros, so an empty one scores 0; a null id
takes no part; repeated ids are candidates of their own, but never of the query with the same id, and each
query id is answered once for each distinct vector it has; components and scores beyond a long's range are held
at its ends; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.sources.ranges import MOST_RANGES, key_ranges
from rowforge.sources.staging import stage

BLOCK_ROWS, QUERY_ROWS, FIRST_DEPTH = 4096, 2048, 32
LOW, HIGH = -(1 << 63), (1 << 63) - 1


class SortedLists:
    """A block's per-dimension lists and the threshold algorithm over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.k = k
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        plain, one, at = np.unique(vectors.astype(np.float64), axis=0, return_index=True, return_inverse=True)
        self.vectors, at = vectors[one], np.ravel(at)
        rows = np.argsort(at, kind="stable")  # of equal vectors, ids ascending
        first = np.searchsorted(at[rows], np.arange(len(self.vectors)))
        counts = np.diff(np.append(first, len(rows)))
        self.owners = [self._least(ids[rows[a : a + n]], k) for a, n in zip(first, counts, strict=True)]
        self.lone = np.array([o[0] if o[0] == o[-1] else -1 for o in self.owners], np.int64)  # the only id, if there is one
        self.alone = np.array([o[0] == o[-1] for o in self.owners], bool)
        self.lists = np.argsort(plain, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.lists, axis=0)
        plain = plain.astype(float)
        self.plain = self.vectors.dtype != object
        self.norm2 = float((plain * plain).sum(1).max(initial=0)) * (1 + 1e-9)

    @staticmethod
    def _least(ids: np.ndarray, k: int) -> np.ndarray:
        """Of ascending ids, those that can be among the k smallest once any one id is left out."""
        return ids[np.arange(len(ids)) - np.searchsorted(ids, ids) < k][: 2 * k]

    def _reach(self, q: np.ndarray, edge: np.ndarray) -> float:
        """No unseen vector scores more: its components lie no further along q than `edge`, its norm is the block's greatest at most."""
        plain = (q * edge).sum()
        if not self.plain:
            return plain
        far = q * edge > 0
        left = self.norm2 - float((edge[~far] ** 2).sum())  # of the squared norm, past those that must point the other way
        if left < 0:
            return -np.inf
        e, s = np.abs(edge[far]), np.abs(q[far])
        if float((e * e).sum()) <= left:
            return plain
        order = np.argsort(e / s)  # the first ones are held by their lists, the rest point along q
        e, s = e[order], s[order]
        held, rest = np.concatenate(([0.0], np.cumsum(e * e))), np.concatenate((np.cumsum((s * s)[::-1])[::-1], [0.0]))
        k = int(np.argmax(held + np.append(e / s, np.inf) ** 2 * np.maximum(rest, 1e-300) > left))
        along = np.sqrt(max(0.0, left - held[k]) * rest[k])
        return float((q * edge)[~far].sum() + (e * s)[:k].sum() + along) * (1 + 1e-9) + 1e-6

    def search(self, query: np.ndarray, own_id: int, floor: int | None = None) -> tuple[list[int], list[int], int]:
        """Ids and scores of the k best but the query's own row, and how many vectors were scored.

        floor: a score that the k-th best of all blocks is known to reach; what is below it may be left out."""
        n, k = len(self.vectors), self.k
        dims = np.flatnonzero(query)
        q, up = query[dims], query[dims] > 0
        seen, depth, step = np.zeros(n, bool), 0, FIRST_DEPTH
        best: list[tuple[int, int]] = []  # (-score, id)

        def dry(edge: np.ndarray) -> bool:
            bound = max([*([-best[-1][0]] if len(best) == k else []), *([] if floor is None else [floor])], default=None)
            return bound is not None and self._reach(q, edge) < bound

        if len(dims) and dry(np.where(up, self.values[-1, dims], self.values[0, dims])):
            return [], [], 0
        while depth < n and len(dims):
            past = min(n, depth + step)
            met = np.zeros(n, bool)
            met[self.lists[n - past : n - depth, dims[up]].ravel()] = True
            met[self.lists[depth:past, dims[~up]].ravel()] = True
            best = self._merge(best, np.flatnonzero(met & ~seen), query, own_id, floor)
            seen |= met
            depth, step = past, step * 2
            if seen.all() or dry(np.where(up, self.values[n - depth, dims], self.values[depth - 1, dims])):
                break
        if not len(dims):  # a zero query: every score is 0
            best, seen = self._merge(best, np.arange(n), query, own_id, floor), np.ones(n, bool)
        return [b[1] for b in best], [min(max(-b[0], LOW), HIGH) for b in best], int(seen.sum())

    def _merge(self, best: list[tuple[int, int]], found: np.ndarray, query: np.ndarray, own_id: int, floor: int | None) -> list[tuple[int, int]]:
        found = found[~(self.alone[found] & (self.lone[found] == own_id))]
        k, scores = self.k, self.vectors[found] @ query
        if floor is not None:
            found, scores = found[scores >= floor], scores[scores >= floor]
        if len(found) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            if len(best) == k:
                kth = max(kth, -best[-1][0])
            found, scores = found[scores >= kth], scores[scores >= kth]
        more = [(-int(s), int(i)) for v, s in zip(found, scores, strict=True) for i in self.owners[v] if i != own_id]
        return sorted(best + more)[:k]


def _exact(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """A matrix whose products are exact: doubles while sums stay under 2**53, else Python integers."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    if np.abs(out).max(initial=0) ** 2 * max(1, width) < 2**53:
        return out
    return np.array([[int(x) for x in row] for row in out], object).reshape(len(vectors), width)


def _work(k: int):
    """Pieces of work to (ask, query_id, vec_id, score); an ask without results has none.  A row (ask, null, null, n) tells how many were scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def answer() -> Iterator[pa.RecordBatch]:
            ids, asks, floors, vectors = [np.concatenate([h[c] for h in held]) for c in range(4)]
            matrix = _exact(list(vectors), max(map(len, vectors)))
            mine = asks >= 0
            if not mine.any() or mine.all():
                return
            lists, out = SortedLists(ids[~mine], matrix[~mine], k), []
            for own_id, ask, floor, query in zip(ids[mine].tolist(), asks[mine].tolist(), floors[mine].tolist(), matrix[mine], strict=True):
                found, scores, scored = lists.search(query, own_id, floor if LOW < floor < HIGH else None)
                out += [(ask, own_id, i, s) for i, s in zip(found, scores, strict=True)]
                out.append((ask, None, None, scored))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["ask", "query_id", "vec_id", "score"])

        for batch in batches:
            b, q = (np.asarray(batch.column(c)) for c in ("block", "query_block"))
            cut = [0, *(np.flatnonzero((np.diff(b) != 0) | (np.diff(q) != 0)) + 1).tolist(), len(b)]
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                if a == z:
                    continue
                if (b[a], q[a]) != key:
                    if held:
                        yield from answer()
                    key, held = (b[a], q[a]), []
                lists = batch.column("v").slice(a, z - a)
                flat, at = np.asarray(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
                vectors = np.empty(z - a, object)
                vectors[:] = [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                held.append((*(np.asarray(batch.column(c).slice(a, z - a)) for c in ("id", "ask", "floor")), vectors))
        if held:
            yield from answer()

    return run


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null if the vector takes no part."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & sound, whole)


def _answers(data: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """The work on blocks: data with block and query_block, id and v; asks with ask, floor as well."""
    data = data.select("block", "query_block", F.lit(-1).cast("long").alias("ask"), F.lit(LOW).alias("floor"), "id", "v")
    work = data.unionByName(asks.select("block", "query_block", "ask", "floor", "id", "v"))
    return work.repartition("block", "query_block").sortWithinPartitions("block", "query_block").mapInArrow(_work(k), "ask long, query_id long, vec_id long, score long")


def _searched(vectors: DataFrame, k: int, every: int, scale: int, id_col: str, vector_col: str, block_rows: int, query_rows: int) -> tuple[DataFrame, int, int]:
    """What _work says of all pieces; how many vectors and queries there are."""
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), quantised(vectors[vector_col], scale).alias("v")).where("id is not null and v is not null")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.withColumn("norm", F.ceil(F.least(F.sqrt(norm2) * 16, F.lit(2.0**62))))
    n = rows.count()
    asks = stage(rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]).withColumn("ask", F.monotonically_increasing_id()))
    queries = asks.count()
    query_blocks = max(1, -(-queries // query_rows))
    asks = asks.withColumn("query_block", F.pmod(F.xxhash64("v", "id"), F.lit(query_blocks)).cast("int"))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    wanted = max(1, -(-n // block_rows))
    ranges = key_ranges(rows, "norm", wanted)
    parts = max(1, -(-wanted // MOST_RANGES))  # past the most ranges, each is dealt out to several blocks
    spot = F.xxhash64("id", "v")
    placed = ranges.place(rows, "norm", "range", spot).withColumn("block", F.col("range") * parts + F.pmod(F.xxhash64(spot), F.lit(parts)))
    if ranges.count * parts == 1:
        return _answers(placed.withColumn("query_block", every_block), asks.withColumns({"block": F.lit(0), "floor": F.lit(LOW)}), k), n, queries

    tops = placed.groupBy("block").agg(F.max("norm").alias("norm")).orderBy(F.desc("norm"), "block").collect()  # a row a block
    lead = tops[0].block
    first = stage(_answers(placed.where(F.col("block") == lead).withColumn("query_block", every_block), asks.withColumns({"block": F.lit(lead), "floor": F.lit(LOW)}), k))
    kth = first.where("query_id is not null").groupBy("ask").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = [(t.block, t.norm) for t in tops[1:]]
    others = F.from_json(F.lit(json.dumps([{"block": b, "norm": x} for b, x in rest])), "array<struct<block: int, norm: bigint>>")
    told = asks.join(kth, "ask", "left").withColumn("floor", F.coalesce("floor", F.lit(LOW)))
    reach = F.filter(others, lambda o: (F.col("floor") <= LOW) | ((o["norm"].cast("double") / 16) * (F.col("norm").cast("double") / 16) * (1 + 1e-9) >= F.col("floor")))
    told = stage(told.withColumn("block", F.explode(reach["block"])))
    meet = told.select("block", "query_block").distinct()
    second = _answers(placed.join(meet, "block"), told, k)
    return first.unionByName(second), n, queries


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose id is divisible by `every`, against all rows."""
    found, _, _ = _searched(vectors, k, every, scale, id_col, vector_col, block_rows, query_rows)
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.where("query_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored_share(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> float:
    """The share of all distinct vectors that an average query scored before its bounds let it stop."""
    found, n, queries = _searched(vectors, k, every, scale, id_col, vector_col, block_rows, query_rows)
    return (found.where("query_id is null").agg(F.sum("score")).first()[0] or 0) / max(1, n * queries)
