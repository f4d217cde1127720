"""Mixing sources to target weights by entropy balancing.

Rates are the least change, in relative entropy over words, that meets every source's target:
the solution is exponentially tilted, exp of the sum of one dual value per constraint a
document takes part in. Documents with the same constraints have the same rate, so the duals
are solved on cells: one row per combination of constraint values, with the words it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.llm.common import ready, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
CLOSE = 1e-12
# Steps without a smaller gap after which targets are held to contradict each other.
PATIENCE = 30
# Parts of a source that are taken whole or not at all; only the part where the target lies
# is decided row by row.
PARTS = 1 << 16


def word_count(text: str = "text") -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return words.cast("long")


def ordinal(df: DataFrame, order: str) -> DataFrame:
    """``place``: number of rows before each in ascending order, nulls last. The rows are dealt
    by ranges and counted there; what is gathered is one count per range."""
    key = F.asc_nulls_last(order)
    dealt = written(
        df.repartitionByRange(key).withColumn("range_no", F.spark_partition_id()), "ordered"
    )
    counts = dealt.groupBy("range_no").agg(F.count("*").alias("own"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("range_no", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("n"))
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(key)) - 1
    return (
        dealt.withColumn("inside", inside)
        .join(counts, "range_no")
        .withColumn("place", (F.col("n") + F.col("inside")).cast("long"))
        .drop("range_no", "n", "inside")
    )


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST):
    """``target`` of each row of ``sources(source, words)``: ``share`` of all words, dealt by
    weights that repeat over the sources in code point order, null last. No target exceeds
    ``most`` times the source's words; what is over is dealt again by weight until none is.

    All weights grow by one factor until a source is full; a round finds the factor that the
    sources not yet full allow. Each round reads one row of sums.
    """
    rows = ordinal(sources, "source")
    weight = reduce(
        lambda rest, i: F.when(F.col("place") % len(weights) == i, weights[i]).otherwise(rest),
        range(len(weights)),
        F.lit(None),
    )
    rows = rows.withColumn("weight", weight.cast("double"))
    rows = written(rows.withColumn("most", F.col("words") * F.lit(most)).drop("place"), "weights")
    total = share * (rows.agg(F.sum("words")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("most") <= F.col("weight") * F.lit(level)
        row = rows.agg(
            F.sum(F.when(full, F.col("most"))).alias("filled"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if not row.open:
            break
        higher = (total - (row.filled or 0.0)) / row.open
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return rows.select(
        "source", "words", F.least("most", F.col("weight") * F.lit(level)).alias("target")
    )


def balance(cells: DataFrame, constraints: list[str]) -> DataFrame:
    """Adds ``rate`` to cells that hold ``words`` and, for each constraint column c, its value
    and ``target_c``, the words that all cells of that value must come to.

    Newton steps on the convex dual, one constraint column after the other (their blocks of
    the Hessian are diagonal). Each step is one aggregation over the cells; what the driver
    sees is the largest relative gap. Steps go on until it is closed; if it stops getting
    smaller, no rates meet all targets, and that is an error. Values without words, or with
    target 0, have rate 0.
    """
    rate = F.lit(1.0)
    for name in constraints:
        cells = cells.withColumn(f"dual_{name}", F.lit(0.0))
        rate = rate * F.exp(F.col(f"dual_{name}"))
    cells = written(cells, "duals")
    least, since = None, 0
    while True:
        gaps = []
        for name in constraints:
            same = Window.partitionBy(name)
            dual, target = F.col(f"dual_{name}"), F.col(f"target_{name}")
            have = F.sum(F.col("words") * rate).over(same)
            step = (target - have) / have
            gap = F.when(
                (F.col("words") > 0) & (target > 0), F.abs(have - target) / target
            ).otherwise(0.0)
            cells = cells.withColumn("gap", gap).withColumn(
                f"dual_{name}",
                dual + F.when(target > 0, F.greatest(F.lit(-2.0), F.least(step, F.lit(2.0)))).otherwise(0.0),
            )
            cells = cells.withColumn(f"gap_{name}", F.col("gap")).drop("gap")
            gaps.append(f"gap_{name}")
        cells = written(cells, "duals")
        worst = cells.agg(F.max(F.greatest(*gaps) if len(gaps) > 1 else F.col(gaps[0]))).first()[0]
        cells = cells.drop(*gaps)
        if worst is None or worst <= CLOSE:
            break
        since = 0 if least is None or worst < least else since + 1
        least = worst if least is None else min(least, worst)
        if since > PATIENCE:
            raise ValueError(f"no rates meet the targets: {least:.3g} of one is left over")
    blocked = reduce(lambda a, b: a | b, [F.col(f"target_{c}") <= 0 for c in constraints])
    cells = cells.withColumn("rate", F.when(blocked, 0.0).otherwise(rate))
    return cells.drop(*[f"dual_{c}" for c in constraints])


def round_to_copies(rows: DataFrame) -> DataFrame:
    """``copies`` of each of ``rows(source, size, rate, draw)``: the whole part of its rate,
    and one more for the documents first by ``draw`` until their words make up the source's
    fraction, so that a source misses its target by half a document at most.

    ``draw`` is a hexadecimal digest. Its first four digits cut a source into parts, and sums
    over parts tell the one in which the fraction is reached; only its rows are ordered.
    ``chunk`` cuts up rows that are equal in everything: they are first counted by chunk, the
    counts are ordered, and single rows are only numbered inside their chunk.
    """
    rows = rows.withColumn("part", F.conv(F.substring("draw", 1, 4), 16, 10).cast("int"))
    fraction = F.col("rate") - F.floor("rate")
    parts = rows.groupBy("source", "part").agg(
        F.sum("size").alias("own"), F.sum(F.col("size") * fraction).alias("want")
    )
    by_source = Window.partitionBy("source")
    upto = F.sum("own").over(by_source.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(
        "source",
        "part",
        "own",
        F.coalesce(upto, F.lit(0)).alias("before"),
        F.sum("want").over(by_source).alias("need"),
    )
    marked = rows.join(
        parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "own", "before", "need"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")),
    ).drop("s", "p")
    cut = (F.col("before") < F.col("need")) & (F.col("need") < F.col("before") + F.col("own"))
    decided = marked.where(cut)
    alike = ["draw", "doc_id", "size", "tie", "chunk"]
    groups = decided.groupBy("source", "part", *alike).agg(F.count("*").alias("rows"))
    order = Window.partitionBy("source", "part").orderBy(*alike)
    earlier = F.sum(F.col("size") * F.col("rows")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.withColumn("earlier", F.coalesce(earlier, F.lit(0))).drop("rows")
    keys = ["source", "part", *alike]
    same = [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in keys]
    groups = groups.select(*[F.col(c).alias(f"g_{c}") for c in keys], "earlier")
    decided = decided.join(groups, reduce(lambda a, b: a & b, same)).drop(*[f"g_{c}" for c in keys])
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("draw")) - 1
    at = F.col("before") + F.col("earlier") + nth * F.col("size")
    decided = decided.withColumn("more", at + F.col("size") / 2 <= F.col("need")).drop("earlier")
    whole = marked.where(~cut).withColumn("more", F.col("before") + F.col("own") <= F.col("need"))
    copies = F.floor("rate") + F.when(F.col("more") & (fraction > 0), 1).otherwise(0)
    return whole.unionByName(decided).withColumn("copies", copies.cast("long"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST):
    """(doc_id, source, size, source_size, target, rate, copies, taken) for every row of
    ``docs(doc_id, text, source)``, and ``tie``, a hash of the text.

    Null sources are one source. Null and empty texts have size 0 and count for nothing, but
    stay rows. Copies depend on ids and texts alone, so reruns agree; equal rows may differ in
    copies by one and are interchangeable. Further columns are ignored; an empty table gives
    an empty result.
    """
    ready(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        word_count().alias("size"),
        F.xxhash64("text").alias("tie"),
        F.spark_partition_id().alias("chunk"),
    )
    # Sizes are counted once: the texts are not read again.
    rows = written(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("words"))
    cells = targets(sources, weights, share, most).withColumnRenamed("target", "target_source")
    cells = balance(cells, ["source"])
    cells = cells.select(
        F.col("source").alias("s"),
        F.col("words").alias("source_size"),
        F.col("target_source").alias("target"),
        # A full source has exactly its whole rate, not one an ulp below.
        F.when(F.abs(F.col("rate") - F.rint("rate")) < 1e-9, F.rint("rate"))
        .otherwise(F.col("rate"))
        .alias("rate"),
    )
    rows = rows.join(cells, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    name = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("tie").cast("string"))
    rows = rows.withColumn("draw", F.md5(name.cast("binary")))
    copied = round_to_copies(rows)
    return copied.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "rate",
        "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
        "tie",
    )
