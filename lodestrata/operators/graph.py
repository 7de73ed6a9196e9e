"""Directed weighted graphs: their state after operations, degrees, neighbours, and search by frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.plans.folds import current
from lodestrata.plans.scratch import Tables


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree in one grouped pass over distinct edges."""
    e = edges.select("src", "dst").distinct()
    both = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def bfs(edges: DataFrame, start: int, max_depth: int | None = None, path: bool = False) -> DataFrame:
    """node, depth (and with ``path`` the smallest shortest path as text) of every node reached from ``start``.

    Each round joins the frontier with the edges and drops what was seen; rounds are written to the shared folder, so
    plans stay short and lost executors cost one round.
    """
    spark, tables = edges.sparkSession, Tables(edges.sparkSession, "bfs")
    e = tables.keep(edges.select("src", "dst").distinct(), "edges")
    seen = frontier = spark.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(str(start)).alias("path"))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node"), F.concat_ws(">", "path", F.col("dst").cast("string")).alias("path"))
        new = step.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")).select("node", F.lit(depth).cast("long").alias("depth"), "path")
        frontier = tables.keep(new, f"d{depth}")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen if path else seen.select("node", "depth")


def state(ops: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) after ops(src, dst, weight, op, seq): ``add`` puts an edge, ``weight`` sets the weight of
    a present one, ``remove`` deletes one, ``remove_node`` all edges of ``src`` (dst is null), ``clear`` everything.
    """
    edge = ops.where("op in ('add', 'remove')")
    kept = current(edge, ["src", "dst"], "seq", payload=["weight", "seq"]).withColumnRenamed("seq", "at")
    wiped = ops.where("op = 'clear'").agg(F.max("seq").alias("wiped"))  # one row
    kept = kept.join(F.broadcast(wiped)).where("wiped is null or wiped < at").drop("wiped")
    gone = ops.where("op = 'remove_node'").groupBy("src").agg(F.max("seq").alias("gone"))
    for side in ("src", "dst"):
        kept = kept.join(gone.select(F.col("src").alias(side), "gone"), side, "left").where("gone is null or gone < at").drop("gone")
    weights = ops.where("op = 'weight'").select("src", "dst", F.col("weight").alias("set"), F.col("seq").alias("set_at"))
    later = weights.join(kept.select("src", "dst", "at"), ["src", "dst"]).where("set_at > at").groupBy("src", "dst").agg(F.max_by(F.struct("set"), "set_at").alias("s"))
    out = kept.join(later, ["src", "dst"], "left")
    return out.select("src", "dst", F.when(F.col("s").isNotNull(), F.col("s.set")).otherwise(F.col("weight")).alias("weight"))


def without_node(edges: DataFrame, node: int) -> DataFrame:
    """What ``remove_node`` leaves; it removes its out-edges and in-edges (a loop counts as one of each)."""
    return edges.where((F.col("src") != node) & (F.col("dst") != node))
