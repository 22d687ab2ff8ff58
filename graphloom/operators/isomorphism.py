"""Isomorphism classes of a collection of small labelled graphs, and the shares of unique and of new graphs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import canonical
from graphloom.sources.staging import staged

#: Tasks that the forms of one invariant are dealt to in a round of tests.
SALTS = 16


def _forms(frames):
    for f in frames:
        graphs = [([int(x) for x in labels], [(int(e["u"]), int(e["v"]), int(e["label"])) for e in edges]) for labels, edges in zip(f.labels, f.edges, strict=True)]
        yield pd.DataFrame({"key": [canonical.invariant(g) for g in graphs], "form": [json.dumps(canonical.form(g)) for g in graphs], "gen": f.gen, "ref": f.ref})


def _tested(frames):
    for f in frames:
        yield f.assign(same=[canonical.isomorphic(json.loads(a), json.loads(b)) for a, b in zip(f.form, f.rep, strict=True)])


def isomorphism_classes(graphs: DataFrame, sides: tuple[str, str] = ("gen", "ref")) -> DataFrame:
    """graphs: side, labels (array of int), edges (array of struct u, v, label; places in labels, u < v, each once).
    (key, rep, gen, ref): a row a class, with its number of graphs on either side; rep is one of its graphs as JSON.

    Graphs that are alike as they stand are counted first, so a frequent shape is one row from there on. The hash of the refined
    colouring is the join key; within it graphs fall together by their form. What is left, different forms of one hash, is tested
    exactly against the hash's least form, in rounds: those that fail are the next round's. A round deals a hash's forms to SALTS
    tasks. A graph has to fit a row.
    """
    gen, ref = (F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(n) for s, n in zip(sides, ("gen", "ref"), strict=True))
    shapes = graphs.select("side", "labels", F.array_sort(F.transform("edges", lambda e: F.struct(e["u"].cast("int").alias("u"), e["v"].cast("int").alias("v"), e["label"].cast("int").alias("label")))).alias("edges"))
    shapes = shapes.groupBy("labels", "edges").agg(gen, ref)
    forms = shapes.mapInPandas(_forms, "key string, form string, gen long, ref long")
    open_ = staged(forms.groupBy("key", "form").agg(F.sum("gen").alias("gen"), F.sum("ref").alias("ref")), "forms")
    found = None
    while not open_.isEmpty():
        reps = open_.groupBy("key").agg(F.min("form").alias("rep"))
        dealt = reps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = open_.withColumn("salt", F.pmod(F.xxhash64("form"), F.lit(SALTS)).cast("int")).join(dealt, ["key", "salt"]).select("key", "form", "rep", "gen", "ref")
        alike = met.where("form = rep").withColumn("same", F.lit(True))
        tested = met.where("form <> rep").mapInPandas(_tested, "key string, form string, rep string, gen long, ref long, same boolean")
        told = staged(alike.unionByName(tested), "tested")
        done = told.where("same").select("key", "rep", "gen", "ref")
        found = done if found is None else found.unionByName(done)
        open_ = staged(told.where("NOT same").select("key", "form", "gen", "ref"), "forms")
    if found is None:
        return open_.select("key", F.col("form").alias("rep"), "gen", "ref")
    return found.groupBy("key", "rep").agg(F.sum("gen").alias("gen"), F.sum("ref").alias("ref"))


def uniqueness_novelty(graphs: DataFrame) -> DataFrame:
    """(graphs, classes, uniqueness, novelty): classes among generated graphs over graphs, and the share of those classes that no
    reference graph is in. Graphs without nodes don't count; without graphs both are 0."""
    c = isomorphism_classes(graphs.where("size(labels) > 0"))
    total, kinds = F.coalesce(F.sum("gen"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("gen") > 0, 1)), F.lit(0))
    new = F.coalesce(F.sum(F.when((F.col("gen") > 0) & (F.col("ref") == 0), 1)), F.lit(0))
    return c.agg(total.alias("graphs"), kinds.alias("classes"), (kinds / F.greatest(total, F.lit(1))).alias("uniqueness"), (new / F.greatest(kinds, F.lit(1))).alias("novelty"))
