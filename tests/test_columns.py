from pyspark.sql import functions as F

from graphloom.functions import distances as d
from graphloom.sources import molecules
from graphloom.streaming.histograms import window_histogram


def test_distances(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0], [15], [7], [0, 6, 7, 8, 9, 4, 1])], "a array<double>, b array<double>, x array<long>, y array<long>, t array<int>")
    got = row.select(d.gaussian(F.col("a"), F.col("b")), d.gaussian_tv(F.col("a"), F.col("a")), d.emd(F.col("a"), F.col("b")), d.tanimoto(F.col("x"), F.col("y")), d.pad_tokens(F.col("t"), 4, 5, 4), d.pad_tokens(F.col("t"), 8, 5, 4)).first()
    assert abs(got[0] - 0.36787944) < 1e-6 and got[1] == 1 and got[2] == 1 and got[3] == 0.75
    assert got[4] == [0, 6, 7, 4] and got[5] == [0, 6, 7, 8, 9, 4, 1, 5]


def test_overlaps(spark):
    g = spark.createDataFrame([([(30, 6, "ring", [0, 1, 2, 3, 4, 5]), (20, 2, "oh", [5, 6]), (10, 2, "c", [7, 8])],)], "g array<struct<priority:int,size:int,name:string,atoms:array<int>>>")
    assert [x.name for x in g.select(d.without_overlaps(F.col("g"))).first()[0]] == ["ring", "c"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.smi").write_text("# note\n\nCCO x\nC\n")
    (tmp_path / "a.csv").write_text("id,SMILES\n1,CCO\n2,CC\n")
    assert [r.smiles for r in molecules.read_smi(spark, str(tmp_path / "a.smi")).collect()] == ["CCO", "C"]
    assert molecules.read_smiles_csv(spark, str(tmp_path / "a.csv")).count() == 2
    assert molecules.cache_name("m", "train", "hdt", 5, {"a": 1}).startswith("m_train_hdt_5_")


def test_stream(spark):
    src = spark.createDataFrame([("2024-01-01 10:00:00", "a"), ("2024-01-01 11:00:00", "a"), ("2024-01-03 10:00:00", "b")], "ts string, event_type string")
    assert sorted(r.n for r in window_histogram(src).collect()) == [1, 2]
