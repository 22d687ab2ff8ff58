import re

import pytest
from pyspark.sql import functions as F
from oracle import compare

from graphloom.operators import runs
from graphloom.plans.derived import DERIVED

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(DERIVED))
def test_against_duckdb(spark, name):
    query, oracle = DERIVED[name]
    compare(query(spark, SF), oracle, SF)


def test_long_and_circular_lineage(spark):
    kind = "run_id int, parent int, settings map<string,string>"
    rows = [(i, i - 1 if i else None, {"k": str(i)} if i % 50 == 0 else ({"only": "first"} if i == 1 else None)) for i in range(200)]
    out = {r.run_id: r.settings for r in runs.lineage(spark.createDataFrame(rows, kind)).collect()}
    assert len(out) == 200 and out[199] == {"k": "150", "only": "first"} and out[0] == {"k": "0"} and out[49] == {"k": "0", "only": "first"}
    gone = runs.lineage(spark.createDataFrame([(1, 99, {"a": "b"})], kind)).collect()
    assert [(r.run_id, r.settings) for r in gone] == [(1, {"a": "b"})]
    with pytest.raises(ValueError, match="circle"):
        runs.lineage(spark.createDataFrame([(1, 2, {}), (2, 3, {}), (3, 1, {})], kind))
    assert runs.lineage(spark.createDataFrame([], kind)).collect() == []


def test_runs_that_are_done_dont_meet_in_one_task(spark, monkeypatch):
    """Of 4,000 runs all but a few have no parent: a round's rows are dealt over its tasks all the same."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    largest, write = [], runs.staged

    def watched(df, tag):
        largest.append(max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()))
        return write(df, tag)

    monkeypatch.setattr(runs, "staged", watched)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = [(i, i - 1 if i % 100 == 1 else None, {"k": str(i)} if i % 2 == 0 else None) for i in range(4000)]
        out = {r.run_id: r.settings for r in runs.lineage(spark.createDataFrame(rows, "run_id int, parent int, settings map<string,string>")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(out) == 4000 and out[101] == {"k": "100"} and out[3] == {}
    assert len(largest) > 1 and max(largest[1:]) < 2000


@pytest.mark.parametrize("name", ["part_reconstruct", "singleton_merge", "part_bipartites"])
def test_edges_meet_parts_in_a_row_a_graph(spark, name):
    """A graph's edges are shuffled as one row; none goes by its ends, and no row an edge is made distinct."""
    plan = DERIVED[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(graph_id#\w+, (src|dst|node|community|u|v|part_id#\w+, src_local|left_part)", plan)
