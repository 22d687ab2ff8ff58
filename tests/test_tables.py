import datetime as dt

import pytest
from oracle import compare, rows
from pyspark.sql import functions as F

from graphloom.functions import tables
from graphloom.operators import classifier
from graphloom.operators import metrics as m
from graphloom.plans.collections import COLLECTIONS
from graphloom.plans.tables import TABLES
from graphloom.streaming.graphs import day_graphs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(k for k, (_, o) in TABLES.items() if o))
def test_against_duckdb(spark, name):
    query, oracle = TABLES[name]
    compare(query(spark, SF), oracle, SF)


def test_table_functions_on_odd_input(spark):
    tables.register(spark)
    found = spark.sql("SELECT smiles, m.* FROM VALUES ('Cc1ccccc1'), ('x'), (NULL), ('') t(smiles), LATERAL motif_matches(smiles, 'c1ccccc1') m").collect()
    assert [tuple(r) for r in found] == [("Cc1ccccc1", 0, [1, 2, 3, 4, 5, 6])]
    assert spark.sql("SELECT m.* FROM VALUES ('CC') t(s), LATERAL motif_matches(s, 'C(') m").collect() == []
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, None), (1, 4, "a"), (None, 1, "z"), (None, 2, "y")], "id long, t long, s string")
    got = spark.sql("SELECT * FROM transitions(TABLE(SELECT id, s, t FROM {df}) PARTITION BY id ORDER BY t)", df=df).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a", "b", 1), (None, "y", "z", 1)]


def test_discrepancy_of_same_and_disjoint_sides(spark):
    kind = "side string, key long, v array<double>"
    one = [("gen", i, [float(i % 3), 1.0]) for i in range(60)]
    same = [("ref", i + 100, [float(i % 3), 1.0]) for i in range(90)]
    apart = [("ref", i + 100, [float(i % 3), 5.0]) for i in range(30)]
    told = lambda *x: classifier.discrepancy(spark.createDataFrame([r for p in x for r in p], kind))
    assert told(one, same) < 0.2 and told(one, apart) > 0.95 and told(one) == classifier.FAILED
    half = [("ref", i + 100, [float(i % 3), 1.0 if i % 2 else 5.0]) for i in range(200)]
    # half of one side can be told: the exact distance is the root of 0.311
    assert 0.4 < told(one, half) <= 0.56


def test_days_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """Out of order within an hour, over three batches, then rows that come too late: the histogram is the batch query's."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    for i in range(3):
        lo, hi = (dt.datetime(2024, 1, 1) + dt.timedelta(days=10 * k, minutes=30 * (k > 0)) for k in (i, i + 1))
        part = events.where((F.col("ts") >= lo) & ((F.col("ts") < hi) | F.lit(i == 2)))
        part.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    end = spark.createDataFrame([(-1, dt.datetime(2030, 1, 1), -1, "end")], events.schema)
    end.write.parquet(f"{tmp_path}/in/7")
    late = spark.createDataFrame([(0, dt.datetime(2024, 1, 5, 3), -2, "late")], events.schema)
    late.write.parquet(f"{tmp_path}/in/8")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = day_graphs(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out").withColumn("side", F.when(F.col("d") < F.lit("2024-01-16").cast("date"), "ref").otherwise("gen"))
    assert out.where("array_contains(nodes, 'late') OR array_contains(nodes, 'end')").count() == 0
    got, want = m.degree_histogram(out), COLLECTIONS["degree_histogram"](spark, SF)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, map(tuple, want.collect()))


def test_day_discrepancy(spark):
    out = {r.family: r.bound for r in TABLES["graph_discrepancy"][0](spark, SF).collect()}
    assert set(out) == {"degree", "sizes", "clustering", "spectral", "pgd"} and out["pgd"] == max(out.values()) and all(0 <= v < 0.5 for v in out.values())
