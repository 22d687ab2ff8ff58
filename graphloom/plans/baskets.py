"""Labelled graphs from the sales tables, one a customer: nodes are the parts bought, labelled by their kind; parts of one order are
all joined, and the least part of an order with that of the customer's next. An edge's label is the most urgent priority of the
orders that make it. And the user-day graphs of events as unlabelled shapes. Queries over both, each with a text of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import codecs, isomorphism, levels
from graphloom.operators import metrics as m
from graphloom.operators.levels import EDGES
from graphloom.sources.staging import staged


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, ids, labels, edges, as graphloom.operators.levels takes them."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("graph_id"), "o_orderdate", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"))
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    held = orders.join(lines, "o_orderkey")
    before = F.lag(F.element_at("parts", 1)).over(Window.partitionBy("graph_id").orderBy("o_orderdate", "o_orderkey"))
    edge = lambda a, b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.col("label"))
    inside = F.flatten(F.transform("parts", lambda a: F.transform(F.filter("parts", lambda b: b > a), lambda b: edge(a, b))))
    chain = F.filter(F.array(edge(F.col("before"), F.element_at("parts", 1))), lambda e: e["src"] < e["dst"])
    told = held.withColumn("before", before).select("graph_id", "parts", F.concat(inside, F.coalesce(chain, F.array())).alias("told"))
    whole = told.groupBy("graph_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("ids"), F.flatten(F.collect_list("told")).alias("told"))
    kinds = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type")
    numbered = kinds.join(F.broadcast(kinds.agg(F.sort_array(F.collect_set("p_type")).alias("types")))).select("id", (F.array_position("types", F.col("p_type")) - 1).cast("int").alias("kind"))
    named = whole.select("graph_id", F.explode("ids").alias("id")).join(numbered, "id", "left").groupBy("graph_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("kind", F.lit(9)).alias("kind")))), lambda x: x["kind"]).alias("labels"))
    place = lambda x: (F.array_position("ids", x) - 1).cast("int")
    every = F.sort_array(F.transform("told", lambda e: F.struct(place(e["src"]).alias("u"), place(e["dst"]).alias("v"), e["label"].alias("label"))))
    first = lambda e, i: (i == 0) | (F.get("every", i - 1)["u"] != e["u"]) | (F.get("every", i - 1)["v"] != e["v"])
    return whole.join(named, "graph_id").select("graph_id", "ids", "labels", every.alias("every")).select("graph_id", "ids", "labels", F.filter("every", first).cast(EDGES).alias("edges"))


def day_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """side, labels (all 0), edges: the transitions between event types of a user's day, whatever the types are."""
    day = F.to_date("ts")
    events = _read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", day.alias("d"), F.when(day < F.lit("2024-01-16").cast("date"), "ref").otherwise("gen").alias("side"))
    g = m.sequence_graphs(events, ["user_id", "d", "side"], ["ts", "event_id"], "event_type")
    place = lambda x: (F.array_position("nodes", x) - 1).cast("int")
    edge = lambda e: F.struct(F.least(place(e["u"]), place(e["v"])).alias("u"), F.greatest(place(e["u"]), place(e["v"])).alias("v"), F.lit(0).alias("label"))
    return g.select("side", F.transform("nodes", lambda _: F.lit(0)).alias("labels"), F.transform("edges", edge).alias("edges"))


def iso_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = isomorphism.isomorphism_classes(day_shapes(spark, sf_dir))
    sizes = F.from_json("rep", "array<string>")
    nodes, edges = F.size(F.from_json(sizes[0], "array<int>")), F.size(F.from_json(sizes[1], "array<array<int>>"))
    return c.select(nodes.cast("long").alias("n_nodes"), edges.cast("long").alias("n_edges"), "gen", "ref")


def iso_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = isomorphism.uniqueness_novelty(day_shapes(spark, sf_dir))
    return out.select("graphs", "classes", F.round("uniqueness", 9).alias("uniqueness"), F.round("novelty", 9).alias("novelty"))


def _edges_back(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        graphs = staged(basket_graphs(spark, sf_dir), "baskets")
        return levels.named(levels.reconstruct(levels.hierarchy(graphs, method)), graphs)

    return run


def hier_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's leaves, and how deep its leaf is at least: 0 only in graphs that stay whole."""
    graphs = staged(basket_graphs(spark, sf_dir), "baskets")
    held = levels.leaves(levels.hierarchy(graphs, "affinity")).select("graph_id", F.explode("nodes").alias("x"))
    met = held.groupBy("graph_id", "x").agg(F.count("*").alias("leaves")).join(graphs.select("graph_id", "ids"), "graph_id")
    return met.select("graph_id", F.get("ids", "x").alias("node"), "leaves")


def _codec(scheme: str) -> Callable[[SparkSession, str], DataFrame]:
    """Labelled edges with the labels of their ends, as read from the tokens."""

    def run(spark, sf_dir):
        graphs = staged(basket_graphs(spark, sf_dir), "baskets")
        nodes = codecs.vocabulary(graphs)
        if scheme == "walk":
            read = codecs.decode_walks(staged(codecs.encode_walks(graphs, nodes), "walks"), nodes)
        else:
            read = codecs.decode(codecs.tokens_of(graphs, levels.hierarchy(graphs, "affinity"), scheme, nodes), scheme, nodes)
        # graphs are joined before their edges become rows
        met = read.join(graphs.select("graph_id", "ids"), "graph_id").select("graph_id", "ids", F.map_from_entries("labels").alias("kind"), F.inline("edges"))
        return met.select("graph_id", F.get("ids", "u").alias("src"), F.get("ids", "v").alias("dst"), "label", F.col("kind")[F.col("u")].alias("src_kind"), F.col("kind")[F.col("v")].alias("dst_kind"))

    return run


BASKET_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "iso_classes": iso_classes,
    "iso_uniqueness_novelty": iso_uniqueness,
    "hierarchy_spectral_edges": _edges_back("spectral"),
    "hierarchy_affinity_edges": _edges_back("affinity"),
    "hierarchy_cover": hier_cover,
    "codec_hsent_labelled": _codec("hsent"),
    "codec_hdt_labelled": _codec("hdt"),
    "codec_hdtc_labelled": _codec("hdtc"),
    "codec_walk_labelled": _codec("walk"),
}

_BASKETS = """l AS (SELECT DISTINCT o_custkey AS graph_id, o_orderkey, o_orderdate, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS label, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
  firsts AS (SELECT graph_id, o_orderkey, o_orderdate, label, min(p) AS p FROM l GROUP BY ALL),
  chain AS (SELECT graph_id, lag(p) OVER (PARTITION BY graph_id ORDER BY o_orderdate, o_orderkey) AS q, p, label FROM firsts),
  every AS (SELECT a.graph_id, a.p AS src, b.p AS dst, a.label FROM l a JOIN l b ON a.o_orderkey = b.o_orderkey AND a.p < b.p
    UNION ALL SELECT graph_id, least(p, q), greatest(p, q), label FROM chain WHERE p <> q),
  edges AS (SELECT graph_id, src, dst, min(label) AS label FROM every GROUP BY graph_id, src, dst),
  kinds AS (SELECT p_partkey AS id, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS kind FROM part)"""

#: The least of all ways to number a graph's nodes, as bits of pairs: graphs have at most five nodes, one an event type.
_SHAPES = """ev AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, event_id, ts FROM events),
  nodes AS (SELECT user_id, d, event_type AS v, CAST(row_number() OVER (PARTITION BY user_id, d ORDER BY event_type) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT user_id, d, event_type FROM ev)),
  steps AS (SELECT user_id, d, event_type AS a, lead(event_type) OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS b FROM ev),
  pairs AS (SELECT DISTINCT s.user_id, s.d, x.i AS u, y.i AS v FROM steps s JOIN nodes x ON x.user_id = s.user_id AND x.d = s.d AND x.v = s.a JOIN nodes y ON y.user_id = s.user_id AND y.d = s.d AND y.v = s.b WHERE x.i <> y.i),
  simple AS (SELECT DISTINCT user_id, d, least(u, v) AS u, greatest(u, v) AS v FROM pairs),
  graphs AS (SELECT user_id, d, max(i) + 1 AS n FROM nodes GROUP BY user_id, d),
  five AS (SELECT unnest(range(5)) AS x),
  perms AS (SELECT [a.x, b.x, c.x, e.x, f.x] AS p FROM five a, five b, five c, five e, five f WHERE len(list_distinct([a.x, b.x, c.x, e.x, f.x])) = 5),
  fit AS (SELECT n, p FROM (SELECT unnest(range(1, 6)) AS n), perms WHERE list_max(p[1:n]) < n),
  masks AS (SELECT g.user_id, g.d, g.n, f.p, sum(CASE WHEN s.u IS NULL THEN 0 ELSE 1 << (least(f.p[s.u + 1], f.p[s.v + 1]) * 5 + greatest(f.p[s.u + 1], f.p[s.v + 1])) END) AS mask, count(s.u) AS e
    FROM graphs g JOIN fit f ON f.n = g.n LEFT JOIN simple s ON s.user_id = g.user_id AND s.d = g.d GROUP BY g.user_id, g.d, g.n, f.p),
  form AS (SELECT user_id, d, n, max(e) AS e, min(mask) AS form FROM masks GROUP BY user_id, d, n),
  classes AS (SELECT n, e, form, CAST(sum(CASE WHEN d >= DATE '2024-01-16' THEN 1 ELSE 0 END) AS BIGINT) AS gen, CAST(sum(CASE WHEN d < DATE '2024-01-16' THEN 1 ELSE 0 END) AS BIGINT) AS ref FROM form GROUP BY n, e, form)"""

_EDGES = f"WITH {_BASKETS} SELECT graph_id, src, dst, label FROM edges"
_LABELLED = f"WITH {_BASKETS} SELECT e.graph_id, e.src, e.dst, e.label, x.kind AS src_kind, y.kind AS dst_kind FROM edges e JOIN kinds x ON x.id = e.src JOIN kinds y ON y.id = e.dst"

BASKET_ORACLES: dict[str, str] = {
    "iso_classes": f"WITH {_SHAPES} SELECT CAST(n AS BIGINT) AS n_nodes, CAST(e AS BIGINT) AS n_edges, gen, ref FROM classes",
    "iso_uniqueness_novelty": f"""WITH {_SHAPES} SELECT CAST(sum(gen) AS BIGINT) AS graphs, count(*) FILTER (gen > 0) AS classes, round(count(*) FILTER (gen > 0) / CAST(sum(gen) AS DOUBLE), 9) AS uniqueness,
      round(count(*) FILTER (gen > 0 AND ref = 0) / CAST(greatest(count(*) FILTER (gen > 0), 1) AS DOUBLE), 9) AS novelty FROM classes""",
    "hierarchy_spectral_edges": _EDGES,
    "hierarchy_affinity_edges": _EDGES,
    "hierarchy_cover": f"WITH {_BASKETS} SELECT DISTINCT graph_id, p AS node, CAST(1 AS BIGINT) AS leaves FROM l",
    "codec_hsent_labelled": _LABELLED,
    "codec_hdt_labelled": _LABELLED,
    "codec_hdtc_labelled": _LABELLED,
    "codec_walk_labelled": _LABELLED,
}
