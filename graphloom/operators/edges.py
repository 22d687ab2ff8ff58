"""Patterns and communities over edge tables: graph_id, u, v with u < v, each once, and w, how often. Nodes are any labels that sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(rows: DataFrame, graph: str, inside: list[Column], order: list[str], label: str) -> DataFrame:
    """Edges between different labels that follow one another in rows with one value of graph and of `inside`."""
    after = F.lead(label).over(Window.partitionBy(graph, *inside).orderBy(*order))
    steps = rows.select(F.col(graph).alias("graph_id"), F.col(label).alias("a"), after.alias("b")).where("b IS NOT NULL AND a <> b")
    return steps.groupBy("graph_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("w"))


def ends(edges: DataFrame) -> DataFrame:
    """(graph_id, v, to, w): every edge from both ends."""
    return edges.select("graph_id", F.col("u").alias("v"), F.col("v").alias("to"), "w").unionByName(edges.select("graph_id", "v", F.col("u").alias("to"), "w"))


def degrees(edges: DataFrame) -> DataFrame:
    """(graph_id, v, deg)."""
    return ends(edges).groupBy("graph_id", "v").agg(F.count("*").alias("deg"))


def triangles(edges: DataFrame) -> DataFrame:
    """(graph_id, x, y, z), x < y < z. Each node has the set of its larger neighbours; an edge's two sets meet, so a task never holds more
    than two of them and pairs of neighbours are never listed."""
    above = edges.groupBy("graph_id", "u").agg(F.collect_set("v").alias("above"))
    left = edges.select("graph_id", "u", "v").join(above, ["graph_id", "u"])
    both = left.join(above.select("graph_id", F.col("u").alias("v"), F.col("above").alias("more")), ["graph_id", "v"])
    return both.select("graph_id", F.col("u").alias("x"), F.col("v").alias("y"), F.explode(F.array_intersect("above", "more")).alias("z"))


def clustering(edges: DataFrame) -> DataFrame:
    """(graph_id, v, c): of all pairs of a node's neighbours, the share that are joined; 0 with fewer than two."""
    t = triangles(edges).select("graph_id", F.explode(F.array("x", "y", "z")).alias("v")).groupBy("graph_id", "v").agg(F.count("*").alias("t"))
    d = degrees(edges).join(t, ["graph_id", "v"], "left")
    pairs = (F.col("deg") * (F.col("deg") - 1)).cast("double")
    return d.select("graph_id", "v", F.when(F.col("deg") < 2, 0.0).otherwise(2.0 * F.coalesce("t", F.lit(0)).cast("double") / pairs).alias("c"))


def bins(values: DataFrame, column: str, n: int) -> DataFrame:
    """(bin, nodes): values of 0 to 1 in n equal bins, 1 in the last."""
    return values.groupBy(F.least(F.floor(F.col(column) * n + 1e-9), F.lit(n - 1)).cast("long").alias("bin")).agg(F.count("*").alias("nodes"))


def stars(edges: DataFrame, arms: int) -> DataFrame:
    """(graph_id, matches): nodes with `arms` of their neighbours, all choices."""
    choices = F.col("deg").cast("double")
    for k in range(1, arms):
        choices = choices * (F.col("deg") - k) / (k + 1)
    return degrees(edges).groupBy("graph_id").agg(F.sum(F.round(choices)).cast("long").alias("matches"))


def together(found: DataFrame, places: list[str]) -> DataFrame:
    """(graph_id, i, j, together): in how many matches two nodes are, i before j."""
    pairs = F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for k, a in enumerate(places) for b in places[k + 1 :]])
    return found.select("graph_id", F.inline(pairs)).groupBy("graph_id", "i", "j").agg(F.count("*").alias("together"))


def cohesion(found: DataFrame, places: list[str], community) -> DataFrame:
    """(graph_id, cohesion): the share of matches that lie in one community. community: of a node's column."""
    first = community(F.col(places[0]))
    whole = F.lit(True)
    for p in places[1:]:
        whole = whole & (community(F.col(p)) == first)
    return found.groupBy("graph_id").agg(F.avg(F.when(whole, 1.0).otherwise(0.0)).alias("cohesion"))


def moments(edges: DataFrame) -> DataFrame:
    """(graph_id, trace1, trace2): sums of the eigenvalues of the normalised Laplacian and of their squares, without finding them: the
    nodes, and the nodes and the sum of 1 / (deg u * deg v) over ordered edges."""
    d = degrees(edges)
    e = edges.join(d.select("graph_id", F.col("v").alias("u"), F.col("deg").alias("du")), ["graph_id", "u"]).join(d.select("graph_id", "v", F.col("deg").alias("dv")), ["graph_id", "v"])
    s = e.groupBy("graph_id").agg(F.sum(2.0 / (F.col("du") * F.col("dv")).cast("double")).alias("s"))
    n = d.groupBy("graph_id").agg(F.count("*").cast("double").alias("n"))
    return n.join(s, "graph_id").select("graph_id", F.col("n").alias("trace1"), (F.col("n") + F.col("s")).alias("trace2"))


def back_edges(edges: DataFrame) -> DataFrame:
    """(graph_id, node, target, target_pos): edges to nodes that come earlier, by falling degree and then by label."""
    at = degrees(edges).withColumn("pos", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("deg"), "v"))).select("graph_id", "v", "pos")
    met = ends(edges).join(at, ["graph_id", "v"]).join(at.select("graph_id", F.col("v").alias("to"), F.col("pos").alias("to_pos")), ["graph_id", "to"])
    return met.where("to_pos < pos").select("graph_id", F.col("v").alias("node"), F.col("to").alias("target"), F.col("to_pos").cast("long").alias("target_pos"))


def histogram_gap(counts: DataFrame, clip: float = 1e-10) -> DataFrame:
    """counts: bin, g, r. (kl, w1): KL of g's shares against r's, clipped and normalised again, and the sum of the absolute differences
    of the cumulated shares. A row a bin."""
    total = counts.agg(F.sum("g").cast("double").alias("tg"), F.sum("r").cast("double").alias("tr"))
    p = counts.crossJoin(F.broadcast(total)).select("bin", (F.col("g") / F.col("tg")).alias("p"), (F.col("r") / F.col("tr")).alias("q"))
    kept = lambda c: F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(clip))
    sums = p.agg(F.sum(kept("p")).alias("sp"), F.sum(kept("q")).alias("sq"))
    cdf = p.crossJoin(F.broadcast(sums)).withColumn("cdf", F.sum(F.col("p") - F.col("q")).over(Window.orderBy("bin")))
    a, b = kept("p") / F.col("sp"), kept("q") / F.col("sq")
    return cdf.agg(F.sum(a * F.log(a / b)).alias("kl"), F.sum(F.abs("cdf")).alias("w1"))


def bigram_loss(rows: DataFrame, by: str, order: list[str], token: str) -> DataFrame:
    """(loss, perplexity) of each token given the one before, under the shares of all such pairs."""
    before = F.lag(token).over(Window.partitionBy(by).orderBy(*order))
    n = rows.select(F.col(token).alias("b"), before.alias("a")).where("a IS NOT NULL").groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    m = F.sum("n").over(Window.partitionBy("a"))
    loss = -F.sum(F.col("n") * F.log(F.col("n") / F.col("m"))) / F.sum("n")
    return n.withColumn("m", m).agg(loss.alias("loss"), F.exp(loss).alias("perplexity"))
