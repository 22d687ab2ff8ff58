"""Molecules whose strings repeat: the work follows the different strings, the rows all molecules."""

from pyspark.sql import functions as F

from graphloom.operators import molecules as m
from graphloom.operators import molmetrics, pairs


def _mols(spark):
    told = ["CCO", "c1ccccc1C", "C1", None]
    return spark.createDataFrame([(k, told[k % 4]) for k in range(400)], "mol_id long, smiles string")


def test_each_string_is_worked_on_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def rows(mol):
        seen.add(1)
        return [(mol.n,)]

    sizes = m.once_a_string(lambda x: m._per_molecule(x, rows, "n int"))(_mols(spark)).collect()
    assert sorted((r.mol_id, r.n) for r in sizes) == [(k, {0: 3, 1: 7}[k % 4]) for k in range(400) if k % 4 < 2]
    assert seen.value == 2


def test_every_molecule_gets_its_rows(spark):
    mols = _mols(spark)
    assert m.atoms(mols).count() == 100 * 10
    assert m.strings(mols).count() == 3
    assert {(r.motif, r["count"]) for r in m.functional_groups(mols).groupBy("motif").count().collect()} >= {("benzene", 100), ("hydroxyl", 100)}
    assert sorted(r.mol_id for r in m.containing(mols, "[OX2H]").collect()) == list(range(0, 400, 4))
    assert m.functional_communities(mols, m.functional_groups(mols)).count() == m.functional_communities(mols).count()
    assert molmetrics.motif_vectors(mols).count() == 200
    assert [tuple(r) for r in m.quality(mols, mols.where("smiles = 'CCO'")).collect()] == [(0.5, 0.01, 0.5)]


def test_two_sets_are_compared_over_strings_read_once(spark):
    """Each side's strings are read in one pass that is staged with their numbers; no row a molecule is joined after it."""
    mols = _mols(spark)
    other = spark.createDataFrame([(0, "CCO"), (1, "CCN"), (2, "Cc1ccccc1"), (3, "Cc1ccccc1")], "mol_id long, smiles string")
    told = molmetrics.evaluation(mols, other, similarities=False)
    assert "MapIn" not in told._jdf.queryExecution().executedPlan().toString()
    once = {r.metric: r.value for r in told.collect()}
    assert (once["validity"], once["uniqueness"], once["novelty"]) == (0.5, 0.01, 0.0)
    a, b = molmetrics.fragments(mols), molmetrics.fragments(other)
    assert abs(once["fragment_cosine"] - m.cosine(a, b, "fragment").first()[0]) < 1e-12
    assert abs(once["scaffold_cosine"] - m.cosine(m.scaffolds(mols), m.scaffolds(other), "scaffold").first()[0]) < 1e-12
    bundle = molmetrics.motif_bundle(mols, other)
    assert "MapInPandas" not in bundle._jdf.queryExecution().executedPlan().toString()
    each = {k: pairs.mmd(v(mols).select(F.lit("gen").alias("side"), "v").unionByName(v(other).select(F.lit("ref").alias("side"), "v"))).first()[0] for k, v in (("smarts", molmetrics.motif_vectors), ("ring", molmetrics.ring_vectors))}
    assert all(abs(bundle.first()[f"motif_{k}_mmd"] - v) < 1e-12 for k, v in each.items())
