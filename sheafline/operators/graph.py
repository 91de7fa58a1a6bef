"""Levels of an acyclic edge table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from sheafline.session import cut

#: Rounds whose ties are kept as a union before they are stored as one table.
FOLD = 16
#: Cycles, and nodes of each, that an error names.
NAMED = 3, 10


def _jump(pointers: DataFrame, nodes: int) -> tuple[DataFrame, bool]:
    """(id, up, dist) with every ``up`` moved to the nearest node above that has no pointer itself.

    Each round doubles the way a pointer spans. False if some pointers still lead to others when
    they span all nodes: these lead into a cycle.
    """
    for _ in range(math.ceil(math.log2(nodes + 1)) + 1):
        hanging = pointers.join(pointers.select(F.col("id").alias("up")), "up", "left_semi")
        if hanging.isEmpty():
            return pointers, True
        above = pointers.select(
            F.col("id").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_dist"), F.lit(True).alias("_hit")
        )
        pointers = cut(
            pointers.join(above, "up", "left").select(
                "id",
                F.when(F.col("_hit"), F.col("_up")).otherwise(F.col("up")).alias("up"),
                (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
            )
        )
    return pointers, False


def dependency_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, level): 0 without inputs, else one more than the highest input.

    A node above all stands before those without inputs. In a round every node with a single
    input left is tied to it, chains of such ties are contracted by pointer jumping, and the edges
    out of tied nodes start at the node their chain hangs on, as long as the chain; of edges
    between the same two nodes the longest stays. So a chain costs rounds by the logarithm of its
    length, and rounds follow how often branches that part meet again. Where no node has a single input
    and edges are left, or a chain has no upper end, there is a cycle, which is an error that
    names the nodes of some.
    """
    given = cut(edges.select("src", "dst").distinct())
    everyone = given.select(F.col("src").alias("id")).union(given.select("dst"))
    if nodes is not None:
        everyone = everyone.union(nodes.select("id"))
    everyone = cut(everyone.distinct())
    many = everyone.count()
    starts = everyone.join(given.select(F.col("dst").alias("id")), "id", "left_anti")
    top = F.lit(None).cast(given.schema["src"].dataType)
    left = cut(
        given.withColumn("dist", F.lit(1)).unionByName(
            starts.select(top.alias("src"), F.col("id").alias("dst"), F.lit(0).alias("dist"))
        )
    )
    tied, ended, rounds = None, True, 0
    while not left.isEmpty():
        inputs = left.groupBy("dst").agg(
            F.count(F.lit(1)).alias("n"), F.first("src").alias("up"), F.max("dist").alias("dist")
        )
        single = cut(inputs.filter("n = 1").select(F.col("dst").alias("id"), "up", "dist"))
        if single.isEmpty():
            ended = False
            break
        single, whole = _jump(single, many)
        if not whole:  # those that hang on a cycle keep their edges
            single = cut(single.join(single.select(F.col("id").alias("up")), "up", "left_anti"))
            if single.isEmpty():
                ended = False
                break
        tied = single if tied is None else tied.unionByName(single)
        rounds += 1
        if rounds % FOLD == 0:
            tied = cut(tied)
        hang = single.select(
            F.col("id").alias("src"), F.col("up").alias("_up"), F.col("dist").alias("_dist"), F.lit(True).alias("_hit")
        )
        left = cut(
            left.join(single.select(F.col("id").alias("dst")), "dst", "left_anti")
            .join(hang, "src", "left")
            .select(
                F.when(F.col("_hit"), F.col("_up")).otherwise(F.col("src")).alias("src"),
                "dst",
                (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
            )
            .groupBy("src", "dst")
            .agg(F.max("dist").alias("dist"))
        )
    placed = None
    if tied is not None:
        placed, _ = _jump(cut(tied), many)
        placed = placed.filter("up is null").select("id", F.col("dist").alias("level"))
    if not ended:
        raise ValueError(f"the edges hold a cycle: {_cycles(given, everyone, placed)}")
    return placed if placed is not None else everyone.withColumn("level", F.lit(0))


def _cycles(edges: DataFrame, everyone: DataFrame, placed: DataFrame | None) -> str:
    """The names of some nodes on cycles, by cycle.

    Every node without a level has an input without one. Following the least of these
    long enough ends on a cycle, so the ends of such walks are the nodes of cycles.
    """
    open_ = everyone if placed is None else everyone.join(placed, "id", "left_anti")
    open_ = cut(open_)
    walk = (
        edges.join(open_.select(F.col("id").alias("dst")), "dst", "left_semi")
        .join(open_.select(F.col("id").alias("src")), "src", "left_semi")
        .groupBy("dst")
        .agg(F.min("src").alias("up"))
        .select(F.col("dst").alias("id"), "up", F.least("dst", "up").alias("low"))
    )
    walk = cut(walk)
    for _ in range(math.ceil(math.log2(open_.count() + 1))):
        above = walk.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_low"))
        walk = cut(walk.join(above, "up").select("id", F.col("_up").alias("up"), F.least("low", "_low").alias("low")))
    on_cycles = walk.select(F.col("up").alias("id")).distinct().join(walk.select("id", "low"), "id")
    cycles, names = NAMED
    some = on_cycles.groupBy("low").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).orderBy("low").limit(cycles)
    out = []
    for c in some.collect():
        own = on_cycles.filter(F.col("low") == F.lit(c["low"])).orderBy("id").limit(names)
        listed = ", ".join(str(r["id"]) for r in own.collect())
        out.append(f"{listed}{' and more' if c['n'] > names else ''}")
    return "; ".join(out)
