"""Histograms of graph collections and distances between two sides of them, as functions of DataFrames.

graphs: side, nodes (array of labels), edges (array of struct u, v with u < v, each once). counts: side, key, n."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.distances import emd, gaussian, gaussian_tv

#: What a mean over pairs counts as where a side is empty.
EMPTY = 1e6


def sequence_graphs(rows: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """A graph for each value of keys: its nodes are the labels, its edges the distinct pairs that follow one another in order. One
    shuffle: rows meet by keys, the rest is array functions."""
    held = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(label).alias("label")))), lambda x: x["label"]).alias("seq"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    steps = F.zip_with(F.slice("seq", F.lit(1), F.size("seq") - 1), F.slice("seq", F.lit(2), F.size("seq") - 1), pair)
    return held.select(*keys, F.array_distinct("seq").alias("nodes"), F.array_distinct(F.filter(steps, lambda e: e["u"] != e["v"])).alias("edges"))


def degrees(nodes: Column, edges: Column) -> Column:
    """Degrees of the nodes, in their order."""
    return F.transform(nodes, lambda v: F.size(F.filter(edges, lambda e: (e["u"] == v) | (e["v"] == v))))


def degree_histogram(graphs: DataFrame) -> DataFrame:
    """(side, degree, nodes)."""
    each = graphs.select("side", F.explode(degrees(F.col("nodes"), F.col("edges"))).alias("d"))
    return each.groupBy("side", F.col("d").cast("long").alias("degree")).agg(F.count("*").alias("nodes"))


def graph_sizes(graphs: DataFrame) -> DataFrame:
    """(side, n_nodes, graphs)."""
    return graphs.groupBy("side", F.size("nodes").cast("long").alias("n_nodes")).agg(F.count("*").alias("graphs"))


def graph_shapes(graphs: DataFrame) -> DataFrame:
    """(side, nodes, edges, c): nodes and edges by their places in the graph, and how many graphs of the side are written alike."""
    place = lambda x: (F.array_position("nodes", x) - 1).cast("int")
    edge = lambda e: F.struct(F.least(place(e["u"]), place(e["v"])).alias("u"), F.greatest(place(e["u"]), place(e["v"])).alias("v"))
    told = graphs.select("side", F.transform("nodes", lambda _, i: i).alias("places"), F.array_sort(F.transform("edges", edge)).alias("links"))
    return told.groupBy("side", F.col("places").alias("nodes"), F.col("links").alias("edges")).agg(F.count("*").cast("double").alias("c"))


def degree_shapes(graphs: DataFrame, weight: str | None = None) -> DataFrame:
    """(side, hist, c): different degree histograms, places 0 to the collection's largest degree, and how many graphs have each. A row
    may stand for as many graphs as its column `weight` tells."""
    held = graphs.select("side", degrees(F.col("nodes"), F.col("edges")).alias("d"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    most = held.agg(F.max(F.array_max("d")).alias("most"))
    place = lambda d: F.transform(F.sequence(F.lit(0), F.col("most")), lambda k: F.size(F.filter(d, lambda x: x == k)).cast("double"))
    return held.join(F.broadcast(most)).select("side", "w", place(F.col("d")).alias("hist")).groupBy("side", "hist").agg(F.sum("w").alias("c"))


KERNELS: dict[str, Callable[[Column, Column], Column]] = {
    "tv": gaussian_tv,
    "gaussian": gaussian,
    # the last cumulated difference is that of the totals
    "emd": lambda a, b: F.exp(-F.pow(emd(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(b, F.lit(1), F.size(b) - 1)), 2) / 2),
}


def mmd(shapes: DataFrame, kernel: str = "tv", sides: tuple[str, str] = ("gen", "ref")) -> DataFrame:
    """mmd2: squared maximum mean discrepancy of two sides' histograms (side, hist, c), each normalised by its sum and 1e-6. Only
    different histograms meet, with how often they occur, so the pairs follow the number of shapes, not of graphs."""
    total = F.aggregate("hist", F.lit(0.0), lambda s, x: s + x) + F.lit(1e-6)
    norm = shapes.select("side", "c", F.transform("hist", lambda x: x / total).alias("p"))
    x, y = norm.select(*[F.col(c).alias(f"{c}_x") for c in norm.columns]), norm.select(*[F.col(c).alias(f"{c}_y") for c in norm.columns])
    means = x.crossJoin(y).groupBy("side_x", "side_y").agg((F.sum(F.col("c_x") * F.col("c_y") * KERNELS[kernel](F.col("p_x"), F.col("p_y"))) / F.sum(F.col("c_x") * F.col("c_y"))).alias("k"))
    of = lambda a, b: F.coalesce(F.max(F.when((F.col("side_x") == a) & (F.col("side_y") == b), F.col("k"))), F.lit(EMPTY))
    g, r = sides
    return means.agg((of(g, g) + of(r, r) - 2 * of(g, r)).alias("mmd2"))


# ---------------------------------------------------------------- two distributions over keys


def two_sided(counts: DataFrame, sides: tuple[str, str] = ("gen", "ref")) -> DataFrame:
    """(key, g, r, p, q, p1, q1): counts of both sides, their shares r first, and the shares after one is added to every key."""
    pick = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).cast("double")
    held = counts.groupBy("key").agg(pick(sides[0]).alias("g"), pick(sides[1]).alias("r"))
    all_ = held.agg(F.sum("g").alias("tg"), F.sum("r").alias("tr"), F.count("*").cast("double").alias("keys"))
    share = lambda x, t: F.coalesce(F.col(x) / F.nullif(F.col(t), F.lit(0.0)), F.lit(0.0))
    out = held.crossJoin(F.broadcast(all_))
    return out.select("key", "g", "r", share("r", "tr").alias("p"), share("g", "tg").alias("q"), ((F.col("r") + 1) / (F.col("tr") + F.col("keys"))).alias("p1"), ((F.col("g") + 1) / (F.col("tg") + F.col("keys"))).alias("q1"))


def total_variation() -> Column:
    return F.coalesce(0.5 * F.sum(F.abs(F.col("p") - F.col("q"))), F.lit(0.0))


def kl_smoothed(eps: float = 1e-10) -> Column:
    """KL of p against q, eps added to both, not normalised again; 0 without keys."""
    p, q = F.col("p") + F.lit(eps), F.col("q") + F.lit(eps)
    return F.coalesce(F.sum(p * F.log(p / q)), F.lit(0.0))


def kl_add_one() -> Column:
    return F.sum(F.col("q1") * F.log(F.col("q1") / F.col("p1")))


def count_cosine() -> Column:
    root = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))) + F.lit(1e-10)
    return F.sum(F.col("r") * F.col("g")) / (root("r") * root("g"))


def share_l2() -> Column:
    return F.sqrt(F.sum(F.pow(F.col("p") - F.col("q"), 2)))


# ---------------------------------------------------------------- features of graphs


def clipped_histogram(features: DataFrame, most: int = 10) -> DataFrame:
    """features: side, motif, n (count in one graph). (side, motif, bin, graphs), the last bin open."""
    return features.groupBy("side", "motif", F.least("n", F.lit(most)).cast("long").alias("bin")).agg(F.count("*").alias("graphs"))


def cooccurrence(presence: DataFrame) -> DataFrame:
    """presence: side, graph (any key), motifs (array of distinct). (side, i, j, p): the share of graphs with i that have j."""
    held = presence.select("side", F.explode("motifs").alias("i"), "motifs").select("side", "i", F.explode("motifs").alias("j"))
    pairs = held.groupBy("side", "i", "j").agg(F.count("*").alias("n"))
    own = pairs.where("i = j").select("side", "i", F.col("n").cast("double").alias("all"))
    return pairs.join(own, ["side", "i"]).select("side", "i", "j", (F.col("n") / F.col("all")).alias("p"))


def cooccurrence_distance(co: DataFrame, sides: tuple[str, str] = ("gen", "ref")) -> DataFrame:
    """frobenius and mean_abs of the difference of two sides' tables, cells that aren't there 0."""
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("p")).otherwise(0.0))
    d = co.groupBy("i", "j").agg((pick(sides[0]) - pick(sides[1])).alias("d"))
    keys = co.agg(F.count_distinct("i").cast("double").alias("n"))
    return d.crossJoin(F.broadcast(keys)).agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("frobenius"), (F.sum(F.abs("d")) / F.max(F.col("n") * F.col("n"))).alias("mean_abs"))


def modularity(edges: DataFrame) -> DataFrame:
    """edges: graph_id, u, v and their communities cu, cv. (graph_id, q): sum of e/m - (d/2m)^2 over communities. One shuffle."""
    one = F.lit(1.0)
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("cu").alias("c"), F.when(F.col("cu") == F.col("cv"), one).otherwise(0.0).alias("e")), F.struct(F.col("cv").alias("c"), F.lit(0.0).alias("e")))).alias("x"))
    by = ends.groupBy("graph_id", "x.c").agg(F.sum("x.e").alias("e"), F.count("*").cast("double").alias("d"))
    m = F.sum("d").over(Window.partitionBy("graph_id")) / 2
    return by.withColumn("m", m).groupBy("graph_id").agg(F.sum(F.col("e") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))


def length_stats(lengths: DataFrame) -> DataFrame:
    """lengths: n. Mean, least, largest, standard deviation, and the 95th and 99th of a hundred by rank. Ranks come from how often
    each length occurs, so no task holds all rows."""
    often = lengths.groupBy("n").agg(F.count("*").alias("c"))
    upto = often.withColumn("upto", F.sum("c").over(Window.orderBy("n")))
    rows = lengths.agg(F.count("*").alias("rows"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("rows") * q).cast("long"), F.col("rows") - 1), F.col("n")))
    out = upto.crossJoin(F.broadcast(rows))
    return out.agg(F.round(F.max("mean"), 6).alias("mean_len"), F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.round(F.max("std"), 6).alias("std_len"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def share_of_new(rows: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """novelty: the share of rows whose text known doesn't hold. Texts meet by their SHA-256, so none is shuffled."""
    key = F.sha2(F.col(text), 256)
    held = known.select(key.alias("h")).where("h IS NOT NULL").distinct().withColumn("known", F.lit(1))
    own = rows.select(key.alias("h")).groupBy("h").agg(F.count("*").alias("n")).join(held, "h", "left")
    return own.agg((F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).cast("double") / F.sum("n")).alias("novelty"))


def filled_and_distinct(rows: DataFrame, text: str) -> DataFrame:
    """validity: the share of rows with a text; uniqueness: different texts among those that aren't null, by their SHA-256."""
    key = rows.select(F.sha2(F.col(text), 256).alias("h"), (F.col(text) != "").alias("full")).groupBy("h").agg(F.count("*").alias("n"), F.sum(F.when(F.col("full"), 1).otherwise(0)).alias("full"))
    return key.agg((F.sum("full").cast("double") / F.sum("n")).alias("validity"), (F.count("h").cast("double") / F.sum(F.when(F.col("h").isNotNull(), F.col("n")).otherwise(0))).alias("uniqueness"))
