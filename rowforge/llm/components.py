"""Connected components by alternating large-star and small-star steps.

Each step joins an edge table with its own minima and is staged in the shared folder; only counts reach the driver.  Minima
are pre-aggregated before they are shuffled, so a hub is no hot spot.  Steps end when an anti-join finds no edge that the
table before did not have and both hold as many: then the two are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowforge.sources.staging import release, scope, stage

MOST_STEPS = 60


def anew(key: str) -> Column:
    """The same long by an expression that looks new: a join on it deals out both of its sides, and can split a hot key's rows."""
    return F.col(key).bitwiseXOR(F.lit(0).cast("bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (u, v) edges but the roots, which are their components' least nodes."""
    with scope():
        now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        n = now.count()
        for _ in range(MOST_STEPS):
            if not n:
                break
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select(anew("u").alias("u"), F.least("u", "m").alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            first = large.groupBy("u").agg(F.min("v").alias("m"))
            rest = large.join(first.select(anew("u").alias("u"), "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            new = stage(rest.unionByName(first.select("u", F.col("m").alias("v"))).distinct())
            before, after = n, new.count()
            done = before == after and new.join(now, ["u", "v"], "left_anti").isEmpty()
            release(now)
            now, n = new, after
            if done:
                break
        else:
            raise RuntimeError("the components have not settled")
        return stage(now.select(F.col("u").alias("node"), F.col("v").alias("root")), keep=True)
