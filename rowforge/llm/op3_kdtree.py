"""Shards by a k-d tree over documents' metadata, cut at weighted medians.

A node holds a number of shards.  It is cut along its widest dimension (extent over the whole table's extent) so
that bytes part in proportion to what the shards on either side still want, until every leaf holds one: then each has
the target bytes, within the tolerance of each cut.  Medians are found for all nodes of a level at once, from histograms:
each round counts bytes in a fixed number of bins of the interval in question, and goes into the bin with the
median until what that bin holds is small.  The driver sees bins and nodes, never rows; cuts reach the rows as a small
joined table.

Equal texts stay together.  A group of copies goes through the tree as one: with equal hashes and the coordinates of one of
them.  Groups of more than `share` of a shard's target (fewer than shards / share of them) are dealt out before, the largest
first, each whole to the shard that has least, and the tree fills what is left.  Only a group that is larger than
a whole shard's target cannot be kept: each of its rows goes through the tree by itself.  Among rows with one coordinate
the cut runs through a hash, so a hot value parts as well as any other.

Law: bytes (sizes near equal).  Slots number a shard's rows without gaps, in the order of (bin of a hash, doc_id).

Defined cases: a null text has size 1 and counts as empty among copies; nulls in a dimension lie below all values;
repeated rows are kept and numbered each; very long texts count with their bytes, and one that is longer than a shard's
target makes its shard larger; other columns are ignored, whatever their names; an empty table gives no rows; fewer rows
than shards leave shards empty.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.sources.staging import scope, stage

BINS, TOLERANCE, SHARE, MOST_ROUNDS = 512, 0.002, 0.05, 64
HASH_SPAN = 1 << 62


@dataclass
class Node:
    """A subtree, the shards it will be cut into, and the bytes that each of them still wants."""

    number: int  # of the rows in it
    first_shard: int
    wants: list[float]


def dimensions(docs: DataFrame) -> dict[str, Column]:
    """Metadata dimensions as numbers: length, place in the table's order, and source and language by their hash."""
    found = {}
    if "n_chars" in docs.columns:
        found["length"] = F.log1p(F.greatest(F.col("n_chars").cast("double"), F.lit(0.0)))
    found["id"] = F.col("doc_id").cast("double")
    for name in ("source", "lang"):
        if name in docs.columns:
            found[name] = F.pmod(F.xxhash64(name), F.lit(4096)).cast("double")
    return found


def keyed_rows(docs: DataFrame, shards: int, target_bytes: int | None, share: float) -> tuple[DataFrame, list[str], list[tuple[int, int]], list[float]]:
    """Staged rows of ids, sizes, coordinates x0, x1, ... and tie hash h, without texts; the coordinates' names; the
    groups of copies dealt out whole, as (copy, shard); and what each shard still wants."""
    dims = dimensions(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("copy"), *[F.coalesce(F.nanvl(c, F.lit(-1.0)), F.lit(-1.0)).alias(f"x{k}") for k, c in enumerate(dims.values())],
    ))
    names = [f"x{k}" for k in range(len(dims))]
    total = own.agg(F.sum("size")).first()[0] or 0
    if target_bytes is not None:
        shards = max(1, -(-total // target_bytes))
    target = total / shards
    groups = stage(own.groupBy("copy").agg(F.count("*").alias("n"), F.sum("size").alias("own"), F.min(F.struct("doc_id", *names)).alias("one")).where(F.col("n") > 1).where(F.col("own") <= target))
    dealt, heap = [], [(0, k) for k in range(shards)]
    for r in sorted(groups.where(F.col("own") > share * target).select("own", "copy").collect(), reverse=True):
        held, k = heapq.heappop(heap)
        if held + r.own > target:  # no shard has room for all of it
            heapq.heappush(heap, (held, k))
            continue
        dealt.append((r.copy, k))
        heapq.heappush(heap, (held + r.own, k))
    wants = [0.0] * shards
    for held, k in heap:
        wants[k] = target - held
    kept = groups.select("copy", "one")  # both sides of the join are dealt out anew, so that it can split a hot one
    rows = own.join(kept, "copy", "left")
    held = F.col("one").isNotNull()
    rows = stage(rows.select("doc_id", "size", "text_crc32", "copy", *[F.when(held, F.col(f"one.{x}")).otherwise(F.col(x)).alias(x) for x in names], F.shiftrightunsigned(F.when(held, F.xxhash64("copy", F.lit(7))).otherwise(F.xxhash64("doc_id", "copy")), 2).alias("h")))
    return rows, names, dealt, wants


def _table(spark, rows: list[dict], kind: str) -> DataFrame:
    """A small table from the driver, sent as one literal."""
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>"))))


def _axis(names: list[str]) -> Column:
    """The coordinate that `axis` names."""
    return F.element_at(F.array(*names), F.col("axis") + 1)


def _cut(rows: DataFrame, nodes: list[Node], names: list[str], extents: dict, target: float) -> dict[int, tuple[int, float, int]]:
    """For each node (dimension, value, hash): rows below (value, hash) in that order go left."""
    spark = rows.sparkSession
    asked = _table(spark, [{"node": n.number} for n in nodes], "node: int")
    spans = rows.join(asked, "node").groupBy("node").agg(F.sum("size").alias("size"), *[f(x).alias(f"{t}_{x}") for x in names for f, t in ((F.min, "a"), (F.max, "z"))]).collect()
    state, done, by_number = {}, {}, {n.number: n for n in nodes}
    for s in spans:
        wants = by_number[s.node].wants
        width = {x: (s[f"z_{x}"] - s[f"a_{x}"]) / max(extents[x], 1e-300) for x in names}
        axis = max(names, key=lambda x: width[x])
        left = sum(wants[: len(wants) // 2]) / max(sum(wants), 1e-300)
        state[s.node] = {"axis": axis, "low": s[f"a_{axis}"], "high": s[f"z_{axis}"], "hash": None, "before": 0, "goal": s.size * left}
    for _ in range(MOST_ROUNDS):
        if not state:
            return done
        given = _table(spark, [
            {"node": n, "axis": names.index(s["axis"]), "low": s["low"], "high": s["high"], "step": max((s["high"] - s["low"]) / BINS, 5e-324), "tied": s["hash"] is not None,
             "h0": s["hash"][0] if s["hash"] else 0, "h1": s["hash"][1] if s["hash"] else 1}
            for n, s in state.items()
        ], "node: int, axis: int, low: double, high: double, step: double, tied: boolean, h0: bigint, h1: bigint")
        x = F.col("x")
        inside = F.when(F.col("tied"), (x == F.col("low")) & (F.col("h") >= F.col("h0")) & (F.col("h") < F.col("h1"))).otherwise((x >= F.col("low")) & (x <= F.col("high")))
        spot = F.when(F.col("tied"), (F.col("h") - F.col("h0")).cast("double") / ((F.col("h1") - F.col("h0")).cast("double") / BINS)).otherwise((x - F.col("low")) / F.col("step"))
        found = rows.join(given, "node").withColumn("x", _axis(names)).where(inside).withColumn("cell", F.least(F.floor(spot), F.lit(BINS - 1)).cast("int"))
        counts: dict[int, list] = {}
        for c in found.groupBy("node", "cell").agg(F.sum("size").alias("size"), F.min("x").alias("a"), F.max("x").alias("z"), F.min("h").alias("first"), F.max("h").alias("last")).collect():
            counts.setdefault(c.node, []).append((c.cell, c.size, c.a, c.z, c.first, c.last))
        for number in list(state):
            s, bins = state[number], sorted(counts[number])
            total = s["before"]
            for k, (_c, size, a, z, first, last) in enumerate(bins):
                if total + size >= s["goal"] or k == len(bins) - 1:
                    break
                total += size
            nearer = s["goal"] - total < size / 2  # the cut goes before the bin rather than past it
            if s["hash"] is None:
                if size <= TOLERANCE * target:
                    done[number] = (names.index(s["axis"]), a if nearer else z, 0 if nearer else HASH_SPAN)
                elif a == z:  # one value: on through the hash
                    s |= {"low": a, "high": a, "hash": (0, HASH_SPAN), "before": total}
                    continue
                else:
                    s |= {"low": a, "high": z, "before": total}
                    continue
            elif size <= TOLERANCE * target or first == last:
                done[number] = (names.index(s["axis"]), s["low"], first if nearer else last + 1)
            else:
                s |= {"hash": (first, last + 1), "before": total}
                continue
            del state[number]
    raise RuntimeError("the cuts have not settled")


def shard_rows(docs: DataFrame, shards: int = 8, target_bytes: int | None = None, share: float = SHARE) -> DataFrame:
    """doc_id, size, text_crc32, shard and h of every row; staged.  target_bytes, if given, decides how many shards there are."""
    with scope():
        rows, names, dealt, wants = keyed_rows(docs, shards, target_bytes, share)
        spark, found = rows.sparkSession, ["doc_id", "size", "text_crc32", "shard", "h"]
        whole = rows.agg(F.sum("size").alias("size"), *[(F.max(x) - F.min(x)).alias(x) for x in names]).first()
        target = (whole.size or 0) / len(wants)
        out, free = None, rows
        if dealt:
            table = _table(spark, [{"copy": c, "shard": k} for c, k in dealt], "copy: bigint, shard: int")
            out, free = rows.join(table, "copy").select(*found), rows.join(table, "copy", "left_anti")
        now, level, used = free.withColumn("node", F.lit(0)), [Node(0, 0, wants)], 1
        while any(len(n.wants) > 1 for n in level):
            asked = [n for n in level if len(n.wants) > 1]
            cuts = _cut(now, asked, names, {x: whole[x] or 0 for x in names}, target)
            steps, below = [], [n for n in level if len(n.wants) == 1]
            for n in asked:
                axis, value, edge = cuts.get(n.number, (0, 0.0, 0))
                k = len(n.wants) // 2
                left, right = Node(used, n.first_shard, n.wants[:k]), Node(used + 1, n.first_shard + k, n.wants[k:])
                steps.append({"node": n.number, "axis": axis, "value": value, "edge": edge, "left": left.number, "right": right.number})
                below, used = [*below, left, right], used + 2
            given = now.join(_table(spark, steps, "node: int, axis: int, value: double, edge: bigint, left: int, right: int"), "node", "left").withColumn("x", F.coalesce(_axis(names), F.lit(0.0)))
            goes = (F.col("x") < F.col("value")) | ((F.col("x") == F.col("value")) & (F.col("h") < F.col("edge")))
            now, level = stage(given.withColumn("node", F.when(F.col("axis").isNull(), F.col("node")).when(goes, F.col("left")).otherwise(F.col("right")))
                               .select("doc_id", "size", "text_crc32", "copy", *names, "h", "node")), below
        leaves = _table(spark, [{"node": n.number, "shard": n.first_shard} for n in level], "node: int, shard: int")
        last = now.join(leaves, "node").select(*found)
        return stage(last if out is None else last.unionByName(out), keep=True)


def numbered(rows: DataFrame, bins: int) -> DataFrame:
    """rows (staged) with slot: 0, 1, ... in each shard, from the counts of its bins and a rank within each bin.

    Repeats of one row are alike, so where they stand in the staged table deals them to bins as well."""
    binned = stage(rows.withColumn("bin", F.pmod(F.xxhash64("doc_id", "h", F.monotonically_increasing_id()), F.lit(bins)).cast("int")))
    counts = binned.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size"))
    return binned.withColumn("rank", rank).join(starts, ["shard", "bin"]).withColumn("slot", F.col("start") + F.col("rank") - 1)


def kd_shards(docs: DataFrame, shards: int = 8, target_bytes: int | None = None, share: float = SHARE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    rows = shard_rows(docs, shards, target_bytes, share)
    bins = max(128, -(-rows.count() // 50_000))
    return numbered(rows, bins).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
