"""Order-preserving bucketing of a bigint key: ranges from quantiles, looked up in a small broadcast table.

The table has a row for each cell of the key's span (cells are equal in width, as many as a few for each range), with the
bounds that lie in it; a key finds its cell by an equi-join and its range by comparing with those bounds.  Ranges are at
most MOST_RANGES, so bounds on the driver and the table are some 20 MB at most, however long the data; quantiles are those
of SAMPLE_ROWS rows at most, as one task merges their sketches.  Ranges only deal out work: any bounds give the same results.

A key that holds more than one range by itself (several quantiles are equal to it) is cut further by a hash, so that a
hot or null key is no hot spot."""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_RANGES, HOT_ROWS, SAMPLE_ROWS = 1 << 16, 1000, 1 << 22
LEAST = -(1 << 63)


@dataclass
class Ranges:
    """bounds: ascending keys, each the last of its range; parts: how many pieces the rows of each bound itself are cut into
    (0: they stay with the keys below); starts: the number of the range that ends in each bound, and of what is past them all."""

    bounds: list[int]
    parts: list[int]
    starts: list[int]

    @property
    def count(self) -> int:
        return self.starts[-1] + 1

    @property
    def hot(self) -> bool:
        return any(self.parts)

    def place(self, df: DataFrame, key: str, name: str, tie: Column | None = None) -> DataFrame:
        """df with `name`: the range of its key (nulls lie below all); rows of a hot key part by the hash `tie`."""
        if not self.bounds:
            return df.withColumn(name, F.lit(0))
        low, high = self.bounds[0], self.bounds[-1]
        shift = max(0, (high - low).bit_length() - (4 * len(self.bounds) + 16).bit_length())
        k = F.coalesce(F.col(key).cast("bigint"), F.lit(LEAST))
        cell = F.shiftright(F.greatest(F.least(k, F.lit(high)), F.lit(low)), shift)
        found = df.withColumn("_cell", cell).join(F.broadcast(self._cells(df, shift)), "_cell", "left")
        run = F.size(F.filter("_heads", lambda b: b < k))
        inner = F.element_at("_runs", run + 1)
        at = F.element_at(F.transform(F.array(run * F.col("_step") + F.size(F.filter(inner, lambda b: b["b"] < k))), lambda n: F.struct(n.alias("n"), F.get(inner, n - run * F.col("_step")).alias("bound"))), 1)
        chosen = found.withColumn("_at", at)
        start = F.element_at("_starts", F.col("_at.n") + 1)
        if tie is not None and self.hot:
            part = F.least(F.floor((tie.cast("double") / 2.0**64 + 0.5) * F.col("_at.bound.p")), F.col("_at.bound.p") - 1)
            start = start + F.when((F.col("_at.bound.b") == k) & (F.col("_at.bound.p") > 0), part + 1).otherwise(0)
        return chosen.withColumn(name, start.cast("int")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)

    def _cells(self, df: DataFrame, shift: int) -> DataFrame:
        """_cell, _heads and _runs (its bounds b with parts p, in runs of _step), _starts (of the range each ends, and the next)."""
        held: dict[int, list[int]] = {c: [] for c in range(self.bounds[0] >> shift, (self.bounds[-1] >> shift) + 1)}
        for j, b in enumerate(self.bounds):
            held[b >> shift].append(j)
        rows, past = [], 0
        for c, own in held.items():
            past = own[-1] + 1 if own else past
            step = max(1, math.isqrt(len(own)))
            runs = [[{"b": self.bounds[j], "p": self.parts[j]} for j in own[a : a + step]] for a in range(0, len(own), step)] or [[]]
            rows.append({"_cell": c, "_step": step, "_heads": [r[-1]["b"] for r in runs[:-1]], "_runs": runs, "_starts": [self.starts[j] for j in own] + [self.starts[past]]})
        kind = "array<struct<_cell: bigint, _step: int, _heads: array<bigint>, _runs: array<array<struct<b: bigint, p: int>>>, _starts: array<int>>>"
        return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def key_ranges(df: DataFrame, key: str, ranges: int, hot_rows: int = HOT_ROWS) -> Ranges:
    """Near-equal ranges of a bigint key, `ranges` of them or fewer (and no more than MOST_RANGES), cut at values that occur.

    A key that at least `hot_rows` rows are known to have, and that fills whole ranges, is cut into as many pieces."""
    ranges = min(ranges, MOST_RANGES)
    if ranges < 2:
        return Ranges([], [], [0])
    cuts, n = [k / ranges for k in range(1, ranges)], df.count()
    some = df.select(F.coalesce(F.col(key).cast("bigint"), F.lit(LEAST)).alias("k"))
    if n > SAMPLE_ROWS:
        some = some.sample(SAMPLE_ROWS / n, seed=1)
    quantiles = some.agg(F.percentile_approx("k", cuts, 20 * ranges)).first()[0]
    seen = sorted(Counter(quantiles or []).items())
    parts = [m if m > 1 and (m - 1) * n >= hot_rows * ranges else 0 for _, m in seen]
    starts = [0]
    for p in parts:
        starts.append(starts[-1] + 1 + p)
    return Ranges([b for b, _ in seen], parts, starts)
