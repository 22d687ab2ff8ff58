"""Moments, pair sums and fragments over the tables: vectors of `embeddings`, user-day graphs, chains of graphloom.plans.derived."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import kernels, molmetrics, pairs
from graphloom.operators import metrics as mt
from graphloom.operators import molecules as m
from graphloom.plans.baskets import _read
from graphloom.plans.collections import _graphs
from graphloom.plans.derived import _CHAINS, _chain, chains, on_chains, sides
from graphloom.plans.fixtures import QUERIES as KNOWN
from graphloom.sources.staging import staged

Query = Callable[[SparkSession, str], DataFrame]


def _halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    x = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return [x.where(f"vec_id % 2 = {k}").select("v") for k in (0, 1)]


def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for side, half in enumerate(_halves(spark, sf_dir)):
        _, _, cov = pairs.moments(half, block=24)
        rows += [(side, i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(rows, "side long, i long, j long, cov double").withColumn("cov", F.round("cov", 9))


def frechet(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return spark.createDataFrame([(pairs.frechet_distance(a, b),)], "frechet double")


def _sign_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of the components as bits, 32 a word."""
    bits = lambda lo: F.aggregate(F.transform(F.slice("embedding", lo, 32), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("long")), F.expr("0L"), lambda s, x: s + x)
    return _read(spark, sf_dir, "embeddings").select(F.array(bits(1), bits(33)).alias("words"))


def embedding_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    both = a.withColumn("side", F.lit("gen")).unionByName(b.withColumn("side", F.lit("ref")))
    return pairs.mmd(both, "gaussian").select(F.round("mmd2", 9).alias("mmd2"))


# ---------------------------------------------------------------- user-day graphs


def clustering_shapes(graphs: DataFrame, *more: str) -> DataFrame:
    """(side, v, *more): how many nodes of a graph have a clustering coefficient in each hundredth; 1 is in the last."""
    near = lambda v: F.transform(F.filter("edges", lambda e: (e["u"] == v) | (e["v"] == v)), lambda e: F.when(e["u"] == v, e["v"]).otherwise(e["u"]))
    closed = lambda held: F.size(F.filter("edges", lambda e: F.array_contains(held, e["u"]) & F.array_contains(held, e["v"])))
    ratio = lambda held: F.when(F.size(held) < 2, 0.0).otherwise(2.0 * closed(held) / (F.size(held) * (F.size(held) - 1)))
    bins = F.transform(F.transform("nodes", near), lambda held: F.least(F.floor(ratio(held) * 100 + 1e-9), F.lit(99)))
    # the bins are an array's only element, so that they aren't worked out for every hundredth
    counts = F.transform(F.array(bins), lambda held: F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.size(F.filter(held, lambda b: b == k)).cast("double")))
    return graphs.select("side", F.get(counts, F.lit(0)).alias("v"), *more)


def spectral_shapes(graphs: DataFrame, bins: int = 200, weight: str | None = None) -> DataFrame:
    """(side, c, v, sum1, sum2): the spectrum's histogram, already as shares, and the sums of the eigenvalues and of their squares; c
    is the column `weight`, 1 without."""
    place = lambda x: (F.array_position("nodes", x) - 1).cast("int")
    lean = graphs.select("side", (F.col(weight) if weight else F.lit(1.0)).alias("c"), F.size("nodes").alias("n"), F.transform("edges", lambda e: F.array(place(e["u"]), place(e["v"]))).alias("edges"))

    def run(batches):
        for batch in batches:
            sides, ns, edges = (batch.column(c).to_pylist() for c in ("side", "n", "edges"))
            told = [kernels.laplacian_spectrum(n, {(min(e), max(e)) for e in held}) for n, held in zip(ns, edges, strict=True)]
            hists = [kernels.spectral_shares(x, bins) for x in told]
            yield pa.RecordBatch.from_arrays([pa.array(sides, pa.string()), batch.column("c"), pa.array(hists, pa.list_(pa.float64())), pa.array([float(x.sum()) for x in told]), pa.array([float((x * x).sum()) for x in told])], names=["side", "c", "v", "sum1", "sum2"])

    return lean.mapInArrow(run, "side string, c double, v array<double>, sum1 double, sum2 double")


def clustering_mmd(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = staged(mt.graph_shapes(_graphs(spark, sf_dir)), "shapes")
    return pairs.mmd(clustering_shapes(shapes, "c"), "tv", sigma=0.1, is_hist=True, weight="c").select(F.round("mmd2", 9).alias("mmd2"))


def spectral_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By side: graphs, and sums of their eigenvalues and of the squares."""
    return spectral_shapes(_graphs(spark, sf_dir)).groupBy("side").agg(F.count("*").alias("graphs"), F.round(F.sum("sum1"), 6).alias("sum1"), F.round(F.sum("sum2"), 6).alias("sum2"), F.round(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)), 2).alias("mass"))


def graph_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle: squared discrepancies of degrees, spectra and clustering between the two sides."""
    graphs = staged(mt.graph_shapes(_graphs(spark, sf_dir).where("size(nodes) > 0")), "shapes")
    degree = pairs.mmd(mt.degree_shapes(graphs, "c").select("side", F.col("hist").alias("v"), "c"), "tv", is_hist=True, weight="c")
    spectral = pairs.mmd(spectral_shapes(graphs, weight="c").select("side", "c", F.transform("v", lambda x: F.round(x, 12)).alias("v")), "tv", is_hist=True, weight="c")
    clustering = pairs.mmd(clustering_shapes(graphs, "c"), "tv", sigma=0.1, is_hist=True, weight="c")
    return degree.select(F.col("mmd2").alias("degree")).crossJoin(spectral.select(F.col("mmd2").alias("spectral"))).crossJoin(clustering.select(F.col("mmd2").alias("clustering"))).select(*[F.round(c, 9).alias(c) for c in ("degree", "spectral", "clustering")])


_DAYS = """ev AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, event_id, ts FROM events),
  nodes AS (SELECT DISTINCT user_id, d, event_type AS v FROM ev),
  steps AS (SELECT user_id, d, event_type AS a, lead(event_type) OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS b FROM ev),
  edges AS (SELECT DISTINCT user_id, d, least(a, b) AS u, greatest(a, b) AS v FROM steps WHERE b IS NOT NULL AND a <> b),
  ends AS (SELECT user_id, d, u AS x, v AS y FROM edges UNION ALL SELECT user_id, d, v, u FROM edges),
  deg AS (SELECT n.user_id, n.d, n.v, count(e.x) AS deg FROM nodes n LEFT JOIN ends e ON e.user_id = n.user_id AND e.d = n.d AND e.x = n.v GROUP BY ALL)"""

_FRAGMENTS = f"""{_CHAINS}, u AS (SELECT mol_id, status, w, n, unnest(range(1, n + 1)) AS i FROM mol),
  a AS (SELECT *, w[i:i] AS c, CASE WHEN i > 1 THEN w[i - 1:i - 1] ELSE '' END AS l, CASE WHEN i < n THEN w[i + 1:i + 1] ELSE '' END AS r, i > 1 AND i < n AS inside FROM u),
  e AS (SELECT *, c = 'K' AND inside AS e1, c = 'O' AND inside AND (l IN ('C', 'K', 'P') OR r IN ('C', 'K', 'P')) AS e3, c = 'C' AND inside AND (l IN ('C', 'K', 'P') OR r IN ('C', 'K', 'P')) AS e4,
    c = 'N' AND inside AND l NOT IN ('N', 'O') AND r NOT IN ('N', 'O') AS e5, c = 'C' AND inside AS e8, c = 'P' AS e16 FROM a),
  x2 AS (SELECT *, lead(e1, 1, false) OVER m AS f1, lead(e3, 1, false) OVER m AS f3, lead(e4, 1, false) OVER m AS f4, lead(e5, 1, false) OVER m AS f5, lead(e8, 1, false) OVER m AS f8, lead(e16, 1, false) OVER m AS f16 FROM e WINDOW m AS (PARTITION BY mol_id ORDER BY i)),
  cut AS (SELECT mol_id, status, i, c, CASE WHEN e1 AND f3 THEN [1, 3] WHEN e3 AND f1 THEN [3, 1] WHEN e1 AND f5 THEN [1, 5] WHEN e5 AND f1 THEN [5, 1] WHEN e3 AND f4 THEN [3, 4] WHEN e4 AND f3 THEN [4, 3]
    WHEN e3 AND f16 THEN [3, 16] WHEN e16 AND f3 THEN [16, 3] WHEN e4 AND f5 THEN [4, 5] WHEN e5 AND f4 THEN [5, 4] WHEN e5 AND f16 THEN [5, 16] WHEN e16 AND f5 THEN [16, 5]
    WHEN e1 AND f16 THEN [6, 16] WHEN e16 AND f1 THEN [16, 6] WHEN e8 AND f16 THEN [8, 16] WHEN e16 AND f8 THEN [16, 8] END AS t FROM x2),
  grp AS (SELECT *, lag(t) OVER m AS before, sum(CASE WHEN t IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY mol_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM cut WINDOW m AS (PARTITION BY mol_id ORDER BY i)),
  piece AS (SELECT mol_id, status, coalesce(g, 0) AS g, string_agg(c, '' ORDER BY i) AS s, coalesce(arg_min(before[2], i)::VARCHAR, '') AS lt, coalesce(arg_max(t[1], i)::VARCHAR, '') AS rt FROM grp GROUP BY mol_id, status, coalesce(g, 0)),
  frag AS (SELECT mol_id, status, least(lt || ':' || s || ':' || rt, rt || ':' || reverse(s) || ':' || lt) AS f FROM piece)"""

#: Adjacent letters as (letter, next, the letter before, the one after), both ways along the chain.
_PAIRS = "list_concat(list_transform(range(1, n), lambda i: struct_pack(a := w[i:i], b := w[i + 1:i + 1], x := CASE WHEN i > 1 THEN w[i - 1:i - 1] ELSE '' END, y := CASE WHEN i + 1 < n THEN w[i + 2:i + 2] ELSE '' END)), list_transform(range(1, n), lambda i: struct_pack(a := w[i + 1:i + 1], b := w[i:i], x := CASE WHEN i + 1 < n THEN w[i + 2:i + 2] ELSE '' END, y := CASE WHEN i > 1 THEN w[i - 1:i - 1] ELSE '' END)))"
_IS_C = "IN ('C', 'K', 'P')"
_EVAL = f"""{_CHAINS}, t AS (SELECT *, {_PAIRS} AS q FROM mol),
  v AS (SELECT mol_id, p AS benzene, k AS carbonyl, len(list_filter(q, lambda z: z.a = 'O' AND z.x = '')) AS hydroxyl, len(list_filter(q, lambda z: z.a = 'O' AND z.b {_IS_C} AND z.x {_IS_C})) // 2 AS ether,
    len(list_filter(q, lambda z: z.a = 'K' AND z.b = 'O' AND z.x {_IS_C} AND z.y {_IS_C})) AS ester, len(list_filter(q, lambda z: z.a = 'K' AND z.b = 'N' AND z.x {_IS_C})) AS amide, len(list_filter(q, lambda z: z.a = 'K' AND z.b = 'O' AND z.y = '')) AS carboxyl,
    len(list_filter(q, lambda z: z.a = 'K' AND z.x = '' AND z.b {_IS_C})) AS aldehyde, len(list_filter(q, lambda z: z.a = 'N' AND z.x = '' AND z.b <> 'K')) AS amine_primary, len(list_filter(q, lambda z: z.a = 'N' AND z.x NOT IN ('', 'K') AND z.b <> 'K')) // 2 AS amine_secondary, 0 AS halogen FROM t)"""
_EVALUATED = ("benzene", "carbonyl", "hydroxyl", "ether", "ester", "amide", "carboxyl", "aldehyde", "amine_primary", "amine_secondary", "halogen")


def motif_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted(m.patterns.EVALUATION)
    v = molmetrics.motif_vectors(chains(spark, sf_dir))
    return v.select("mol_id", *[F.get("v", F.lit(names.index(n))).cast("long").alias(n) for n in _EVALUATED])


_HALVES = "h AS (SELECT vec_id % 2 AS side, embedding::DOUBLE[] AS v FROM embeddings)"

MOMENTS: dict[str, tuple[Query, str | None]] = {
    "frechet_moments": KNOWN["frechet_moments"],
    "covariance": (
        covariance,
        f"""WITH {_HALVES}, r AS (SELECT *, row_number() OVER () AS k FROM h), x AS (SELECT k, side, generate_subscripts(v, 1) - 1 AS i, unnest(v) AS x FROM r)
          SELECT a.side, a.i::BIGINT AS i, b.i::BIGINT AS j, round(covar_samp(a.x, b.x), 9) AS cov FROM x a JOIN x b ON a.k = b.k AND a.i <= b.i GROUP BY ALL""",
    ),
    "frechet_distance": (frechet, None),
    "embedding_diversity": (
        lambda s, d: pairs.internal_diversity(_sign_words(s, d)).select("rows", F.round("diversity", 9).alias("diversity")),
        """WITH b AS (SELECT row_number() OVER () AS k, list_transform(embedding, lambda x: x > 0) AS v FROM embeddings),
          w AS (SELECT k, list_sum(list_transform(range(1, 33), lambda i: v[i]::BIGINT << (i - 1)))::BIGINT AS a, list_sum(list_transform(range(1, 33), lambda i: v[i + 32]::BIGINT << (i - 1)))::BIGINT AS b FROM b)
          SELECT (SELECT count(*) FROM w) AS rows, round(1 - avg(coalesce((bit_count(x.a & y.a) + bit_count(x.b & y.b)) / nullif(bit_count(x.a | y.a) + bit_count(x.b | y.b), 0)::DOUBLE, 0)), 9) AS diversity FROM w x JOIN w y ON x.k < y.k""",
    ),
    "embedding_mmd": (
        embedding_mmd,
        f"""WITH {_HALVES}, k AS (SELECT a.side AS s, b.side AS t, avg(exp(-(list_distance(a.v, b.v) ** 2) / 2)) AS k FROM h a, h b GROUP BY ALL)
          SELECT round(sum(CASE WHEN s = t THEN k ELSE -k END), 9) AS mmd2 FROM k""",
    ),
    "clustering_mmd": (
        clustering_mmd,
        f"""WITH {_DAYS}, tri AS (SELECT a.user_id, a.d, a.x AS v, count(*) AS t FROM ends a JOIN ends b ON b.user_id = a.user_id AND b.d = a.d AND b.x = a.x AND a.y < b.y JOIN edges c ON c.user_id = a.user_id AND c.d = a.d AND c.u = a.y AND c.v = b.y GROUP BY ALL),
          bins AS (SELECT g.user_id, g.d, least(floor(CASE WHEN deg < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (deg * (deg - 1)) END * 100 + 1e-9), 99)::BIGINT AS b FROM deg g LEFT JOIN tri ON tri.user_id = g.user_id AND tri.d = g.d AND tri.v = g.v),
          h AS (SELECT user_id, d, list_transform(range(100), lambda k: len(list_filter(list(b), lambda x: x = k)) / (count(*) + 1e-6)) AS p FROM bins GROUP BY user_id, d),
          s AS (SELECT CASE WHEN d < DATE '2024-01-16' THEN 'ref' ELSE 'gen' END AS side, p, count(*)::DOUBLE AS c FROM h GROUP BY ALL),
          k AS (SELECT a.side AS s, b.side AS t, sum(a.c * b.c * exp(-((list_sum(list_transform(range(1, 101), lambda i: abs(a.p[i] - b.p[i]))) / 2) ** 2) / 0.02)) / sum(a.c * b.c) AS k FROM s a, s b GROUP BY ALL)
          SELECT round(sum(CASE WHEN s = t THEN k ELSE -k END), 9) AS mmd2 FROM k""",
    ),
    "spectral_sums": (
        spectral_sums,
        f"""WITH {_DAYS}, one AS (SELECT user_id, d, count(*) AS n, sum(CASE WHEN deg > 0 THEN 1 ELSE 0 END)::DOUBLE AS t FROM deg GROUP BY user_id, d),
          two AS (SELECT e.user_id, e.d, sum(1.0 / (x.deg * y.deg)) AS q FROM ends e JOIN deg x ON x.user_id = e.user_id AND x.d = e.d AND x.v = e.x JOIN deg y ON y.user_id = e.user_id AND y.d = e.d AND y.v = e.y GROUP BY ALL)
          SELECT CASE WHEN o.d < DATE '2024-01-16' THEN 'ref' ELSE 'gen' END AS side, count(*) AS graphs, round(sum(t), 6) AS sum1, round(sum(t + coalesce(q, 0)), 6) AS sum2, round(sum(n / (n + 1e-6)), 2) AS mass FROM one o LEFT JOIN two ON two.user_id = o.user_id AND two.d = o.d GROUP BY ALL""",
    ),
    "graph_metric_bundle": (graph_metrics, None),
    "mol_fragments": (
        on_chains(lambda x: molmetrics.fragments(x).groupBy("mol_id").agg(F.sum("n").cast("long").alias("pieces"), F.count("*").alias("kinds"))),
        f"WITH {_FRAGMENTS} SELECT mol_id, count(*) AS pieces, count(DISTINCT f) AS kinds FROM frag GROUP BY mol_id",
    ),
    "fragment_counts": (
        lambda s, d: molmetrics.fragment_counts(chains(s, d)).select("mols"),
        f"WITH {_FRAGMENTS} SELECT count(DISTINCT mol_id) AS mols FROM frag GROUP BY f",
    ),
    "fragment_cosine": (
        lambda s, d: molmetrics.fragment_cosine(chains(s, d, "O"), chains(s, d, "F")).select(F.round("cosine", 9).alias("cosine")),
        f"""WITH {_FRAGMENTS}, c AS (SELECT f, count(DISTINCT CASE WHEN status = 'O' THEN mol_id END)::DOUBLE AS a, count(DISTINCT CASE WHEN status = 'F' THEN mol_id END)::DOUBLE AS b FROM frag GROUP BY f)
          SELECT round(sum(a * b) / ((sqrt(sum(a * a)) + 1e-10) * (sqrt(sum(b * b)) + 1e-10)), 9) AS cosine FROM c""",
    ),
    "mol_ring_values": (
        lambda s, d: molmetrics.ring_vectors(chains(s, d)).select("mol_id", *[F.get("v", F.lit(i)).cast("long").alias(n) for i, n in enumerate(molmetrics.RING_NAMES)]),
        _chain("""SELECT mol_id, p AS num_rings, p AS num_aromatic_rings, 0::BIGINT AS num_aliphatic_rings, 0::BIGINT AS num_saturated_rings, 0::BIGINT AS num_heterocycles, 0::BIGINT AS num_aromatic_heterocycles, 0::BIGINT AS num_spiro_atoms, 0::BIGINT AS num_bridgehead_atoms,
          0::BIGINT AS ring_size_3, 0::BIGINT AS ring_size_4, 0::BIGINT AS ring_size_5, p AS ring_size_6, 0::BIGINT AS ring_size_7, 0::BIGINT AS ring_size_8 FROM mol"""),
    ),
    "mol_motif_evaluation": (motif_evaluation, f"WITH {_EVAL} SELECT mol_id, {', '.join(f'{n}::BIGINT AS {n}' for n in _EVALUATED)} FROM v"),
    "motif_bundle": (lambda s, d: molmetrics.motif_bundle(*sides(s, d, "O", "F")), None),
    "motif_summary": (lambda s, d: molmetrics.motif_summary(chains(s, d)), None),
}

MOMENT_QUERIES: dict[str, Query] = {k: q for k, (q, _) in MOMENTS.items()}
MOMENT_ORACLES: dict[str, str] = {k: o for k, (_, o) in MOMENTS.items() if o is not None}
