import pytest

from graphloom.sources import datasets


def test_splits(spark, tmp_path):
    rows = spark.range(1000)
    got = datasets.qm9_splits(rows, "id")
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 800, "val": 100, "test": 100}
    few = datasets.coconut_splits(rows, "id", {"train": 1600, "val": 200, "test": 200})
    assert {r.split: r["count"] for r in few.groupBy("split").count().collect()} == {"train": 800, "val": 100, "test": 100}
    for name, n in (("train", 50), ("test", 40)):
        spark.createDataFrame([(f"{'C' * (i + 1)}", name) for i in range(n)], "SMILES string, SPLIT string").write.option("header", True).csv(f"{tmp_path}/m/{name}.csv")
    sets = datasets.splits(spark, "moses", f"{tmp_path}/m", {"train": 30, "val": 10, "test": 10})
    assert {k: v.count() for k, v in sets.items()} == {"train": 30, "val": 10, "test": 10}
    assert {r.smiles for r in sets["val"].collect()} != {r.smiles for r in sets["test"].collect()}
    with pytest.raises(ValueError, match="no dataset"):
        datasets.splits(spark, "other", "", {})


def test_caches(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", [1, 2, 9])], "graph_id string, tokens array<int>")

    for _ in range(2):
        assert datasets.cached_tokens(spark, str(tmp_path), "moses", "train", "hdt", 1, {"k": 1}, build).count() == 1
    assert len(built) == 1
    a = spark.createDataFrame([(2, [1]), (0, [2])], "global_index int, tokens array<int>")
    about = {"scheme": "hdt", "config": {"spectral_n_init": 10}, "vocab_size": 7, "max_num_nodes": 3}
    out, told = datasets.combine_chunks([a, datasets.chunk(a, "global_index", 2, 3)], [about, {**about, "config": {"n_init": 10}, "vocab_size": 9}])
    assert [r.global_index for r in out.collect()] == [0, 2, 2] and told["vocab_size"] == 9
    with pytest.raises(ValueError, match="different"):
        datasets.combine_chunks([a, a], [about, {**about, "scheme": "sent"}])
    datasets.export_smiles(spark.createDataFrame([("CO",), ("C",)], "smiles string"), spark.createDataFrame([("N",)], "smiles string"), f"{tmp_path}/x")
    assert [r.value for r in spark.read.text(f"{tmp_path}/x").collect()] == ["2", "C", "CO", "N"]
    assert datasets.smiles_column(spark.createDataFrame([(1, " CO "), (2, " ")], "id int, canonical_smiles string")).collect() == [("CO",)]
