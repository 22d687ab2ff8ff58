"""Queries over graph collections derived from the relational tables: the operators are in graphloom.plans.collections, the texts here
are what DuckDB holds them against.

The collection `user-day` has one graph per user and day: nodes are the event types of that day, edges the distinct pairs of
types that follow one another. Days before 2024-01-16 are the reference side, later ones the generated side. Pairwise
kernels run over DISTINCT histograms with multiplicities, so their cost depends on the number of different graph shapes and not on
the number of graphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.collections import COLLECTIONS

GRAPHS = """
ev AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type, event_id, ts FROM events),
side AS (SELECT DISTINCT user_id, d, CASE WHEN d < DATE '2024-01-16' THEN 'ref' ELSE 'gen' END AS side FROM ev),
nodes AS (SELECT DISTINCT user_id, d, event_type AS v FROM ev),
steps AS (SELECT user_id, d, event_type AS a, LEAD(event_type) OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS b FROM ev),
edges AS (SELECT DISTINCT user_id, d, least(a, b) AS u, greatest(a, b) AS v FROM steps WHERE b IS NOT NULL AND a <> b),
ends AS (SELECT user_id, d, u AS v FROM edges UNION ALL SELECT user_id, d, v FROM edges),
deg AS (SELECT n.user_id, n.d, n.v, count(e.v) AS deg FROM nodes n LEFT JOIN ends e ON n.user_id = e.user_id AND n.d = e.d AND n.v = e.v GROUP BY n.user_id, n.d, n.v),
hist AS (SELECT user_id, d, CAST(sum(CASE WHEN deg = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS h0, CAST(sum(CASE WHEN deg = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS h1,
  CAST(sum(CASE WHEN deg = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS h2, CAST(sum(CASE WHEN deg = 3 THEN 1 ELSE 0 END) AS DOUBLE) AS h3, CAST(sum(CASE WHEN deg >= 4 THEN 1 ELSE 0 END) AS DOUBLE) AS h4 FROM deg GROUP BY user_id, d),
shapes AS (SELECT side, h0, h1, h2, h3, h4, CAST(count(*) AS DOUBLE) AS c FROM hist JOIN side USING (user_id, d) GROUP BY side, h0, h1, h2, h3, h4),
norm AS (SELECT side, c, h0/t AS p0, h1/t AS p1, h2/t AS p2, h3/t AS p3, h4/t AS p4 FROM (SELECT *, h0+h1+h2+h3+h4+CAST(1e-6 AS DOUBLE) AS t FROM shapes) s),
counts AS (SELECT user_id, d, event_type AS k, count(*) AS c FROM ev GROUP BY user_id, d, event_type)
"""

USER = """
step AS (SELECT user_id, event_type AS a, LEAD(event_type) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS b FROM events),
e AS (SELECT user_id, least(a, b) AS u, greatest(a, b) AS v, count(*) AS w FROM step WHERE b IS NOT NULL AND a <> b GROUP BY user_id, least(a, b), greatest(a, b)),
both_ways AS (SELECT user_id, u, v, w FROM e UNION ALL SELECT user_id, v AS u, u AS v, w FROM e),
tri AS (SELECT a.user_id, a.u AS x, a.v AS y, b.v AS z FROM e a JOIN e b ON a.user_id = b.user_id AND a.v = b.u JOIN e c ON c.user_id = a.user_id AND c.u = a.u AND c.v = b.v),
udeg AS (SELECT user_id, u AS v, count(*) AS deg FROM both_ways GROUP BY user_id, u)
"""


def _mmd(kernel: str) -> str:
    return f"""WITH {GRAPHS},
n AS (SELECT side, sum(c) AS n FROM norm GROUP BY side),
k AS (SELECT a.side AS s, b.side AS t, sum(a.c * b.c * {kernel}) AS total FROM norm a CROSS JOIN norm b GROUP BY a.side, b.side)
SELECT round(sum(CASE WHEN s = t THEN 1 ELSE -1 END * total / (x.n * y.n)), 9) AS mmd2 FROM k JOIN n x ON x.side = s JOIN n y ON y.side = t"""


_L1 = "(" + " + ".join(f"abs(a.p{i} - b.p{i})" for i in range(5)) + ")"
_L2 = "(" + " + ".join(f"(a.p{i} - b.p{i})*(a.p{i} - b.p{i})" for i in range(5)) + ")"
_CDF = "(" + " + ".join("abs(" + " + ".join(f"a.p{j} - b.p{j}" for j in range(i + 1)) + ")" for i in range(4)) + ")"

_SIDES = """sides AS (SELECT event_type AS k, CAST(sum(CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 0 END) AS DOUBLE) AS r,
  CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 0 END) AS DOUBLE) AS g FROM events GROUP BY event_type),
tot AS (SELECT sum(r) AS tr, sum(g) AS tg, CAST(count(*) AS DOUBLE) AS n FROM sides),
pq AS (SELECT k, r / tr AS p, g / tg AS q, (r + 1) / (tr + n) AS p1, (g + 1) / (tg + n) AS q1, r, g FROM sides CROSS JOIN tot)"""

_PRES = "pres AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'ref' ELSE 'gen' END AS side, event_type AS m FROM events)"
_CO = f"""{_PRES}, one AS (SELECT side, m, count(*) AS n FROM pres GROUP BY side, m),
co AS (SELECT a.side, a.m AS i, b.m AS j, CAST(count(*) AS DOUBLE) / max(o.n) AS p FROM pres a JOIN pres b ON a.user_id = b.user_id AND a.d = b.d AND a.side = b.side JOIN one o ON o.side = a.side AND o.m = a.m GROUP BY a.side, a.m, b.m)"""
_CLIP = "greatest(least({}, CAST(1 AS DOUBLE)), CAST(1e-10 AS DOUBLE))"

SQL: dict[str, str] = {
    "degree_mmd": _mmd(f"exp(-(0.5 * {_L1}) * (0.5 * {_L1}) / 2)"),
    "gaussian_mmd": _mmd(f"exp(-{_L2} / 2)"),
    "emd_mmd": _mmd(f"exp(-{_CDF} * {_CDF} / 2)"),
    "degree_histogram": f"WITH {GRAPHS} SELECT side, CAST(deg AS BIGINT) AS degree, count(*) AS nodes FROM deg JOIN side USING (user_id, d) GROUP BY side, deg",
    "graph_sizes": f"WITH {GRAPHS} SELECT side, n_nodes, count(*) AS graphs FROM (SELECT user_id, d, count(*) AS n_nodes FROM nodes GROUP BY user_id, d) x JOIN side USING (user_id, d) GROUP BY side, n_nodes",
    "clustering_histogram": f"""WITH {USER}, corner AS (SELECT user_id, x AS v FROM tri UNION ALL SELECT user_id, y FROM tri UNION ALL SELECT user_id, z FROM tri),
      t AS (SELECT user_id, v, count(*) AS t FROM corner GROUP BY user_id, v),
      c AS (SELECT d.user_id, d.v, CASE WHEN d.deg < 2 THEN CAST(0 AS DOUBLE) ELSE 2.0 * CAST(coalesce(t.t, 0) AS DOUBLE) / CAST(d.deg * (d.deg - 1) AS DOUBLE) END AS c FROM udeg d LEFT JOIN t ON t.user_id = d.user_id AND t.v = d.v)
      SELECT CAST(least(floor(c * 100 + 1e-9), 99) AS BIGINT) AS bin, count(*) AS nodes FROM c GROUP BY 1""",
    "pattern_edge": f"WITH {USER} SELECT user_id, count(*) AS matches, CAST(sum(w) AS BIGINT) AS weight FROM e GROUP BY user_id",
    "pattern_path2": f"WITH {USER} SELECT user_id, CAST(sum(deg * (deg - 1) / 2) AS BIGINT) AS matches FROM udeg GROUP BY user_id",
    "pattern_star3": f"WITH {USER} SELECT user_id, CAST(sum(deg * (deg - 1) * (deg - 2) / 6) AS BIGINT) AS matches FROM udeg GROUP BY user_id",
    "pattern_triangle": f"WITH {USER} SELECT user_id, count(*) AS matches FROM tri GROUP BY user_id",
    "motif_containment": f"WITH {USER} SELECT u.user_id FROM (SELECT DISTINCT user_id FROM e) u WHERE EXISTS (SELECT 1 FROM tri WHERE tri.user_id = u.user_id)",
    "affinity_matrix": f"""WITH {USER}, c AS (SELECT user_id, x AS i, y AS j FROM tri UNION ALL SELECT user_id, x, z FROM tri UNION ALL SELECT user_id, y, z FROM tri)
      SELECT user_id, i, j, count(*) AS together FROM c GROUP BY user_id, i, j""",
    "motif_cohesion": f"""WITH {USER} SELECT user_id, round(avg(CASE WHEN length(x) % 3 = length(y) % 3 AND length(y) % 3 = length(z) % 3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS cohesion FROM tri GROUP BY user_id""",
    "induced_edges": f"WITH {USER} SELECT user_id, length(u) % 3 AS community, count(*) AS edges FROM e WHERE length(u) % 3 = length(v) % 3 GROUP BY user_id, length(u) % 3",
    "super_edges": f"WITH {USER} SELECT DISTINCT user_id, least(length(u) % 3, length(v) % 3) AS c1, greatest(length(u) % 3, length(v) % 3) AS c2 FROM e WHERE length(u) % 3 <> length(v) % 3",
    "bipartite_edges": f"WITH {USER} SELECT user_id, length(u) % 3 AS ci, length(v) % 3 AS cj, u, v FROM both_ways WHERE length(u) % 3 < length(v) % 3",
    "weighted_adjacency": f"WITH {USER} SELECT user_id, u, v, CASE w % 5 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) WHEN 2 THEN CAST(3 AS DOUBLE) WHEN 3 THEN CAST(1.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS weight FROM e",
    "modularity": f"""WITH {USER}, m AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS m FROM e GROUP BY user_id),
      dc AS (SELECT user_id, length(v) % 3 AS c, CAST(sum(deg) AS DOUBLE) AS d FROM udeg GROUP BY user_id, length(v) % 3),
      ec AS (SELECT user_id, length(u) % 3 AS c, CAST(count(*) AS DOUBLE) AS e FROM e WHERE length(u) % 3 = length(v) % 3 GROUP BY user_id, length(u) % 3)
      SELECT dc.user_id, round(sum(coalesce(ec.e, 0) / m.m - (dc.d / (2 * m.m)) * (dc.d / (2 * m.m))), 9) AS q FROM dc JOIN m ON m.user_id = dc.user_id LEFT JOIN ec ON ec.user_id = dc.user_id AND ec.c = dc.c GROUP BY dc.user_id""",
    "spectral_moments": f"""WITH {USER}, s AS (SELECT b.user_id, sum(1.0 / CAST(x.deg * y.deg AS DOUBLE)) AS s FROM both_ways b JOIN udeg x ON x.user_id = b.user_id AND x.v = b.u JOIN udeg y ON y.user_id = b.user_id AND y.v = b.v GROUP BY b.user_id),
      n AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n FROM udeg GROUP BY user_id) SELECT n.user_id, n.n AS trace1, round(n.n + s.s, 9) AS trace2 FROM n JOIN s ON s.user_id = n.user_id""",
    "back_edges": f"""WITH {USER}, o AS (SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY deg DESC, v) AS pos FROM udeg)
      SELECT a.user_id, a.v AS node, b.v AS target, CAST(b.pos AS BIGINT) AS target_pos FROM both_ways e JOIN o a ON a.user_id = e.user_id AND a.v = e.u JOIN o b ON b.user_id = e.user_id AND b.v = e.v WHERE b.pos < a.pos""",
    "valence_rollup": f"""WITH {USER} SELECT v AS node, CASE WHEN deg > 6 THEN 'over' ELSE 'ok' END AS role, count(*) AS n FROM udeg GROUP BY GROUPING SETS ((v, CASE WHEN deg > 6 THEN 'over' ELSE 'ok' END), (CASE WHEN deg > 6 THEN 'over' ELSE 'ok' END), ())""",
    "compare_tv_kl": f"WITH {_SIDES} SELECT round(0.5 * sum(abs(p - q)), 9) AS tv, round(sum((p + CAST(1e-10 AS DOUBLE)) * ln((p + CAST(1e-10 AS DOUBLE)) / (q + CAST(1e-10 AS DOUBLE)))), 9) AS kl FROM pq",
    "addone_kl": f"WITH {_SIDES} SELECT round(sum(q1 * ln(q1 / p1)), 9) AS kl FROM pq",
    "freq_cosine": f"WITH {_SIDES} SELECT round(sum(r * g) / ((sqrt(sum(r * r)) + CAST(1e-10 AS DOUBLE)) * (sqrt(sum(g * g)) + CAST(1e-10 AS DOUBLE))), 9) AS cosine FROM pq",
    "freq_l2": f"WITH {_SIDES} SELECT round(sqrt(sum((p - q) * (p - q))), 9) AS l2 FROM pq",
    "motif_histogram": f"WITH {GRAPHS} SELECT side, k AS motif, CAST(least(c, 10) AS BIGINT) AS bin, count(*) AS graphs FROM counts JOIN side USING (user_id, d) GROUP BY side, k, least(c, 10)",
    "hist_kl_w1": f"""WITH {GRAPHS}, h AS (SELECT least(c, 10) AS b, CAST(sum(CASE WHEN side = 'gen' THEN 1 ELSE 0 END) AS DOUBLE) AS g, CAST(sum(CASE WHEN side = 'ref' THEN 1 ELSE 0 END) AS DOUBLE) AS r FROM counts JOIN side USING (user_id, d) GROUP BY least(c, 10)),
      t AS (SELECT sum(g) AS tg, sum(r) AS tr FROM h), p AS (SELECT b, g / tg AS p, r / tr AS q FROM h CROSS JOIN t),
      s AS (SELECT sum({_CLIP.format("p")}) AS sp, sum({_CLIP.format("q")}) AS sq FROM p),
      w AS (SELECT b, p, q, {_CLIP.format("p")} / sp AS cp, {_CLIP.format("q")} / sq AS cq, sum(p - q) OVER (ORDER BY b) AS cdf FROM p CROSS JOIN s)
      SELECT round(sum(cp * ln(cp / cq)), 9) AS kl, round(sum(abs(cdf)), 9) AS w1 FROM w""",
    "motif_summary_topk": "SELECT event_type AS motif, count(*) AS total FROM events GROUP BY event_type ORDER BY total DESC, motif LIMIT 20",
    "cooccurrence": f"WITH {_CO} SELECT side, i, j, round(p, 9) AS p FROM co",
    "cooccur_distance": f"""WITH {_CO}, d AS (SELECT coalesce(g.p, 0) - coalesce(r.p, 0) AS d FROM (SELECT * FROM co WHERE side = 'gen') g FULL OUTER JOIN (SELECT * FROM co WHERE side = 'ref') r ON g.i = r.i AND g.j = r.j),
      n AS (SELECT CAST(count(DISTINCT m) AS DOUBLE) AS n FROM pres) SELECT round(sqrt(sum(d * d)), 9) AS frobenius, round(sum(abs(d)) / max(n * n), 9) AS mean_abs FROM d CROSS JOIN n""",
    "cooccur_topk": f"WITH {_CO} SELECT i, j, round(p, 9) AS p FROM co WHERE side = 'ref' AND i <> j AND p > 0 ORDER BY p DESC, i, j LIMIT 10",
    "validity_uniqueness": "SELECT round(avg(CASE WHEN text IS NOT NULL AND text <> '' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS validity, round(CAST(count(DISTINCT text) AS DOUBLE) / count(text), 9) AS uniqueness FROM documents",
    "novelty": "SELECT round(CAST(sum(CASE WHEN r.t IS NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS novelty FROM documents d LEFT JOIN (SELECT DISTINCT text AS t FROM documents WHERE lang = 'en') r ON r.t = d.text WHERE d.lang <> 'en' OR d.lang IS NULL",
    "token_length_stats": """WITH t AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n FROM conversations), r AS (SELECT n, row_number() OVER (ORDER BY n, conv_id, turn) AS i, count(*) OVER () AS c FROM t)
      SELECT round(avg(n), 6) AS mean_len, min(n) AS min_len, max(n) AS max_len, round(stddev_pop(n), 6) AS std_len, max(CASE WHEN i = least(CAST(floor(c * 0.95) AS BIGINT), c - 1) + 1 THEN n END) AS p95, max(CASE WHEN i = least(CAST(floor(c * 0.99) AS BIGINT), c - 1) + 1 THEN n END) AS p99 FROM r""",
    "split_80_10_10": "SELECT CASE WHEN (o_orderkey * 2654435761) % 10 < 8 THEN 'train' WHEN (o_orderkey * 2654435761) % 10 = 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1",
    "best_run": """SELECT l_suppkey, l_returnflag, l_partkey, price FROM (SELECT l_suppkey, l_returnflag, l_partkey, l_extendedprice AS price, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice NULLS LAST, l_orderkey, l_linenumber) AS r FROM lineitem) x WHERE r = 1""",
    "rank_ties": """WITH a AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag)
      SELECT l_returnflag, l_suppkey, n, CAST(dense_rank() OVER (PARTITION BY l_returnflag ORDER BY n DESC) AS BIGINT) AS place, count(*) OVER (PARTITION BY l_returnflag, n) AS tied FROM a""",
    "order_cliques": "SELECT a.l_orderkey, count(*) AS pairs FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY a.l_orderkey",
    "token_loss_perplexity": """WITH t AS (SELECT event_type AS b, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a FROM events),
      c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b), m AS (SELECT a, sum(n) AS m FROM c GROUP BY a)
      SELECT round(-sum(n * ln(n / m)) / sum(n), 9) AS loss, round(exp(-sum(n * ln(n / m)) / sum(n)), 9) AS perplexity FROM c JOIN m USING (a)""",
}

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return COLLECTIONS["degree_mmd"](spark, sf_dir)


def relational_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: COLLECTIONS[name] for name in SQL}


def relational_oracles() -> dict[str, str]:
    """The texts above; Spark doesn't run them."""
    return dict(SQL)
