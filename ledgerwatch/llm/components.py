"""Connected components of an edge table, by hooking roots and jumping pointers in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges(a, b)``: the smallest id reachable from it.

    Each round contracts the edges to roots, hooks every root that has a smaller neighbour to
    its smallest one, and follows the hooks to their end. At least every root but the local
    minima goes in a round, so the rounds grow with the logarithm of the number of ids. Every
    round is written to the shared folder; only counts come to the driver. Self loops and
    repeated edges change nothing; edges with a null end are left out.
    """
    links = written(
        edges.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    roots = None
    while True:
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        # A root that has no smaller neighbour stays a root.
        hooks = both.groupBy("a").agg(F.min("b").alias("low"))
        hooks = written(
            hooks.select(F.col("a").alias("id"), F.least("a", "low").alias("up")), "hooks"
        )
        if hooks.isEmpty():
            break
        hooks = _to_the_end(hooks)
        if roots is None:
            roots = hooks.select("id", F.col("up").alias("component"))
        else:
            step = hooks.withColumnRenamed("id", "component")
            roots = roots.join(step, "component", "left").select(
                "id", F.coalesce("up", "component").alias("component")
            )
        roots = written(roots, "roots")
        moved = links
        for end in ("a", "b"):
            moved = (
                moved.join(hooks.select(F.col("id").alias(end), "up"), end)
                .drop(end)
                .withColumnRenamed("up", end)
            )
        links = written(
            moved.where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct(),
            "edges",
        )
        if links.isEmpty():
            break
    if roots is None:
        ends = edges.select(F.col("a").alias("id")).limit(0)
        return ends.withColumn("component", F.col("id"))
    return roots


def _to_the_end(hooks: DataFrame) -> DataFrame:
    """Pointer jumping: every id points to the end of its chain. Hooks only go to smaller
    ids, so chains end, and each jump halves them."""
    while True:
        above = hooks.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jumped = hooks.join(above, "up", "left").select(
            "id",
            F.coalesce("top", "up").alias("up"),
            (F.coalesce("top", "up") < F.col("up")).alias("moved"),
        )
        jumped = written(jumped, "jumps")
        if jumped.where("moved").isEmpty():
            return jumped.select("id", "up")
        hooks = jumped.select("id", "up")
