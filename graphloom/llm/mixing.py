"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm._shared import partitions, staged

#: Parts into which the shuffled order of each source is cut for its running sums. Fixed, so that a source of any size is summed by many tasks.
SLICES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Water filling. sizes: source, source_size. Adds weight and target.

    Sources by code point, null last, take the weights in turn. They share `share` of all sizes by weight; a target stops at
    `most` times its source's size, and the excess is shared again by weight until none is above. In order of
    most * size / weight, sources fill up one after another, so the level at which the rest stands comes from running sums.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    out = (
        out.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(all_rows))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    )
    # the level of the first source that isn't capped holds for all after it
    rest = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(all_rows)
    return out.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), rest["level"] * F.col("weight")))).select("source", "source_size", "weight", "target")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken and virtual_finish.

    Each source's documents stand in a shuffled order, repeated `most` times. A copy's virtual finish time is the words of its
    source up to its end, divided by its source's target, so sources advance in step with their targets. Copies in order of
    virtual finish time make the mix; it ends where the total budget is used up, which is virtual time 1 for every source, and
    a copy on that line is cut there. taken: the words that the mix takes of a document, repeats counted. virtual_finish: of
    its first copy. The result is sorted by it across partitions.

    Running sums come from a fixed number of slices for each source, so that a source with any share of all rows is summed by
    many tasks. Null or empty texts have size 0 and are taken 0 times; null is a source of its own; rows that repeat are
    documents of their own; ties in the shuffled order go by doc_id, then text; no rows give no rows.
    """
    spark = docs.sparkSession
    lean = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("_order")), "mix-sizes")
    lean = lean.withColumn("_slice", F.pmod(F.shiftright("_order", 20), F.lit(SLICES)).cast("int"))
    parts = lean.groupBy("source", "_slice").agg(F.sum("size").alias("words"))
    sums = parts.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sums, weights, share, most)
    by_slice = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.withColumn("_before", F.coalesce(F.sum("words").over(by_slice), F.lit(0))).select("source", "_slice", "_before")
    begins = begins.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.*", "source_size", "target")
    within = Window.partitionBy("source", "_slice").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = lean.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("r")
    run = run.join(begins.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r._slice") == F.col("b._slice"))).select("r.doc_id", "r.source", "r.size", "r._order", (F.col("_before") + F.col("_in")).alias("_start"), "source_size", "target")
    taken = F.lit(0)
    for turn in range(most):
        at = F.col("_start") + F.lit(turn) * F.col("source_size")
        taken = taken + F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - at))
    finish = F.when(F.col("target") > 0, (F.col("_start") + F.col("size")) / F.col("target")).otherwise(F.lit(1.0))
    out = run.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), finish.alias("virtual_finish"))
    return out.repartitionByRange(partitions(spark), "virtual_finish", "doc_id").sortWithinPartitions("virtual_finish", "doc_id")
