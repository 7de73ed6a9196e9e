"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined map-side, so a hub with a third of all edges is no hot group) and a join
back, in which hubs are salted.  Edges are rewritten to point at ever smaller neighbours until
nothing changes; each round's edges are a table in the shared folder, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.runtime import Scratch


#: Fewer nodes than HUBS are hubs (their list is broadcast); a hub's rows are dealt to SALTS tasks; nodes of fewer than
#: LEAST_HUB rows are never hubs.
HUBS, SALTS, LEAST_HUB = 1024, 256, 1000


def _joined(rows: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """rows(u, v) with the m of their u in least(u, m, c): a join on u, and on a salt if there are hubs.

    ``count`` is a number of edges, not less than that of the present ones, so ``c`` adds up to twice that at most.
    """
    hub = F.col("c") > max(LEAST_HUB, 2 * count // HUBS)
    hubs = least.where(hub).select("u", F.lit(True).alias("hub"))
    if hubs.isEmpty():
        return rows.join(least.select("u", "m"), "u")
    spread = rows.join(F.broadcast(hubs), "u", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    copies = least.select("u", "m", F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return spread.join(copies, ["u", "salt"])


def _star(edges: DataFrame, large: bool, count: int, scratch: Scratch, name: str) -> DataFrame:
    """edges(u, v) with u > v.  Large: each node's larger neighbours join its smallest; small: its smaller ones do.

    The minima are written, so that the join back does not compute them again.  Neither step gives more edges than it
    takes.
    """
    swapped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    grouped = (edges.union(swapped) if large else edges).groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    least = scratch.keep(grouped.select("u", F.least("u", "m").alias("m"), "c"), f"{name}-least")
    joined = _joined(swapped if large else edges, least, count)
    if large:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = scratch.keep(out.where("u <> v").distinct(), name)
    scratch.drop(f"{name}-least")
    return out


def components(edges: DataFrame, scratch: Scratch, name: str, left: str = "a", right: str = "b", most_rounds: int = 60) -> DataFrame:
    """(v, root) for every node that has an edge; root is the smallest node of its component."""
    at = f"{name}-edges"
    now = scratch.keep(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct(), at)
    count, before = now.count(), None
    for n in range(most_rounds):
        half = _star(now, True, count, scratch, f"{name}{n}-large")
        scratch.drop(at)
        at = f"{name}{n}"
        now = _star(half, False, count, scratch, at)
        scratch.drop(f"{name}{n}-large")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not converge")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(roots.select("v", F.col("v").alias("root")))
