import math

import pytest
from oracle import compare

from graphloom.operators import reports
from graphloom.plans.reports import REPORTS

SF = "/root/testdata/sf0.001"
KIND = "graph_id string, ids array<long>, labels array<int>, edges array<struct<u: int, v: int, label: int>>"


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_against_duckdb(spark, name):
    query, oracle = REPORTS[name]
    compare(query(spark, SF), oracle, SF)


def mols(spark, *smiles):
    return spark.createDataFrame(list(enumerate(smiles)), "mol_id long, smiles string")


def test_categories_and_groups(spark):
    names = {"c1ccccc1": "unsubstituted", "Cc1ccccc1": "mono", "Cc1ccc(C)cc1": "di-para", "Cc1ccccc1C": "di-ortho", "Cc1cccc(C)c1": "di-meta", "Cc1cc(C)cc(C)c1": "tri", "Cc1cc(C)c(C)c(C)c1": "poly", "CCO": None, "x": None}
    got = {r.mol_id: r.category for r in reports.substitution_category(mols(spark, *names)).collect()}
    assert [got.get(i) for i in range(len(names))] == list(names.values())
    groups = {r.motif: r.mols for r in reports.substituent_presence(mols(spark, "Oc1ccccc1", "COc1ccccc1Cl", "CC(=O)Oc1ccccc1C(=O)O", "CCO", "N#Cc1ccccc1")).collect()}
    assert groups == {"Hydroxyl (-OH)": 3, "Ether (-OR)": 2, "Chloro (-Cl)": 1, "Carbonyl (C=O)": 1, "Carboxyl (-COOH)": 1, "Cyano (-CN)": 1}


def test_histogram_metric(spark):
    table = {"ring": "c1ccccc1", "oh": "[OX2H]"}
    a, b = mols(spark, "Oc1ccccc1", "CCO", "CC", "OCCO"), mols(spark, "Oc1ccccc1", "c1ccccc1")
    told = {r.metric: r.value for r in reports.histogram_metric(a, b, "wasserstein", table).collect()}
    assert told == {"motif_hist_ring": pytest.approx(0.75), "motif_hist_oh": pytest.approx(0.5), "motif_hist_mean": pytest.approx(0.625), "motif_hist_max": pytest.approx(0.75)}
    same = {r.metric: r.value for r in reports.histogram_metric(a, a).collect()}
    assert len(same) == 31 and all(abs(v) < 1e-12 for v in same.values())
    kl = {r.metric: r.value for r in reports.histogram_metric(a, b, "kl", table, most=2).collect()}
    assert kl["motif_hist_ring"] == pytest.approx(0.75 * math.log(0.75 / 1e-10) + 0.25 * math.log(0.25), rel=1e-6)
    assert {r.metric: r.value for r in reports.histogram_metric(mols(spark, "x"), b, "kl", table).collect()} == {"motif_hist_mean": math.inf, "motif_hist_max": math.inf}


def test_what_is_wrong_with_a_graph(spark):
    """Carbon with five bonds in a ring and beside it, a good molecule, nothing at all."""
    ring = [(0, 1, 1), (0, 2, 1), (1, 2, 0), (0, 3, 0)]
    rows = [("bad", [0, 1, 2, 3], [0, 0, 0, 0], ring), ("good", [0, 1, 2], [0, 0, 2], [(0, 1, 0), (1, 2, 0)]), ("none", [], [], []), ("tail", [0, 1, 2, 3, 4], [0, 0, 0, 2, 0], [(0, 1, 0), (1, 2, 0), (0, 2, 0), (0, 3, 1), (3, 4, 0)])]
    got = {r.graph_id: r for r in reports.analyse(spark.createDataFrame(rows, KIND)).collect()}
    assert (got["good"].valid, got["good"].violations) == (True, []) and (got["none"].decode_failure, got["none"].valid) == (True, False)
    assert [(v.idx, v.role, v.atom, v.used, v.allowed) for v in got["bad"].violations] == [(0, "ring_boundary", "C", 5.0, 4)]
    assert [(v.idx, v.role, v.atom) for v in got["tail"].violations] == [(3, "chain_boundary", "O")]
    one = reports.batch_report(reports.analyse(spark.createDataFrame(rows, KIND))).first()
    assert (one.total, one.num_valid, one.num_invalid, one.num_decode_failures, one.with_valence, one.other, one.ring_boundary, one.chain_boundary, one.boundary_ratio) == (4, 1, 2, 1, 2, 0, 1, 1, 1.0)
    by = {(r.role, r.atom): r.n for r in reports.violations_by_atom(reports.analyse(spark.createDataFrame(rows, KIND))).collect()}
    assert by == {("ring_boundary", "C"): 1, ("ring_boundary", None): 1, ("chain_boundary", "O"): 1, ("chain_boundary", None): 1, (None, None): 2}
    assert reports.batch_report(reports.analyse(spark.createDataFrame([], KIND))).first().total == 0


def test_molecules_are_counted_before_they_are_read(spark):
    """Any number of molecules of one string is one row to read, and no row a molecule is joined."""
    many = mols(spark, *["Oc1ccccc1"] * 50, "COc1ccccc1Cl", "CCO", "not a molecule")
    found = reports.substituent_presence(many)
    assert {r.motif: r.mols for r in found.collect()}["Hydroxyl (-OH)"] == 51
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert reports.substituents(many).count() == 50 + reports.substituents(mols(spark, "COc1ccccc1Cl")).count()

def test_graphs_are_judged_where_their_rows_are(spark):
    """No join, and no shuffle after the strings are counted: a row of a string comes from one pass over it."""
    rows = [("odd", [0, 1], [0, 2], [(0, 1, 0), (0, 1, 2), (1, 1, 0), (0, 7, 1)]), ("null", [0, 1], [None, 0], [(0, 1, None)])]
    judged = reports.analyse(spark.createDataFrame(rows, KIND))
    assert not any(x in judged._jdf.queryExecution().executedPlan().toString() for x in ("Join", "Exchange"))
    got = {r.graph_id: (r.valid, [(v.idx, v.used, v.allowed) for v in r.violations]) for r in judged.collect()}
    assert got == {"odd": (False, [(0, 6.0, 4), (1, 6.0, 2)]), "null": (True, [])}
    assert "Join" not in REPORTS["molecule_report"][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    mixed = spark.createDataFrame([("good", [0, 1], [0, 2], [(0, 1, 0)]), ("bad", [0, 1], [0, 2], [(0, 1, 2)])], KIND)
    weighed = reports.analyse(mixed).selectExpr("*", "IF(graph_id = 'bad', 3, 2) AS n")
    assert tuple(reports.batch_report(weighed, "n").first())[:3] == (5, 2, 3)
