import math

import numpy as np
import pytest
from oracle import compare

from graphloom.functions import chem, fragments, patterns
from graphloom.operators import molmetrics, pairs
from graphloom.operators import molecules as m
from graphloom.plans.collections import COLLECTIONS
from graphloom.plans.moments import MOMENTS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(k for k, (_, o) in MOMENTS.items() if o))
def test_against_duckdb(spark, name):
    query, oracle = MOMENTS[name]
    compare(query(spark, SF), oracle, SF)


@pytest.mark.parametrize("kernel", sorted(pairs.KERNELS))
@pytest.mark.parametrize("tile", [5, 1024])
def test_pair_sums_against_all_pairs(spark, kernel, tile):
    rng = np.random.default_rng(3)
    words = kernel == "tanimoto"
    make = lambda n: (rng.integers(-(2**62), 2**62, (n, 3)) if words else rng.random((n, 4)) * 2)
    x = {"gen": make(23), "ref": make(17)}
    x["gen"][5] = x["gen"][6] = x["ref"][2]
    if words:
        x["ref"][0] = 0
    kind = "side string, v array<long>" if words else "side string, v array<double>"
    df = spark.createDataFrame([(s, v.tolist()) for s, rows in x.items() for v in rows], kind).repartition(4)

    def k(a, b):
        if words:
            ones = lambda z: sum(bin(int(w) & (2**64 - 1)).count("1") for w in z)
            return ones(a & b) / ones(a | b) if ones(a | b) else 0.0
        if kernel == "gaussian":
            return math.exp(-((a - b) ** 2).sum() / (2 * 0.7**2))
        d = np.abs(a - b).sum() / 2 if kernel == "tv" else np.abs(np.cumsum(a - b)[:-1]).sum()
        return math.exp(-(d**2) / (2 * 0.7**2))

    got = {(r.a, r.b): (r.total, r.pairs) for r in pairs.kernel_sums(df, kernel, 0.7, tile).collect()}
    for a in x:
        for b in x:
            assert got[a, b][0] == pytest.approx(sum(k(p, q) for p in x[a] for q in x[b]), rel=1e-9)
            assert got[a, b][1] == len(x[a]) * len(x[b])


def test_same_sides_have_no_discrepancy(spark):
    df = spark.createDataFrame([(s, [1.0, 2.0, 3.0]) for s in ("gen", "ref") for _ in range(5)], "side string, v array<double>")
    assert abs(pairs.mmd(df).first()[0]) < 1e-12
    apart = spark.createDataFrame([("gen", [1.0, 0.0]), ("ref", [0.0, 1.0])], "side string, v array<double>")
    assert pairs.mmd(apart).first()[0] == pytest.approx(2 - 2 * math.exp(-1))
    assert pairs.mmd(apart.where("side = 'ref'")).first()[0] == pytest.approx(1e6 + 1 - 2e6)


def test_frechet_distance(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) + 5, rng.normal(size=(200, 7)) * 2 + 1000
    df = lambda z: spark.createDataFrame([(v.tolist(),) for v in z] + [(None,)], "v array<double>").repartition(5)
    n, mean, cov = pairs.moments(df(y), block=3)
    assert n == 200 and np.allclose(mean, y.mean(axis=0), rtol=1e-12) and np.allclose(cov, np.cov(y, rowvar=False), rtol=1e-10)
    a, b = np.cov(x, rowvar=False), np.cov(y, rowvar=False)
    want = ((x.mean(axis=0) - y.mean(axis=0)) ** 2).sum() + np.trace(a + b) - 2 * np.sqrt(np.linalg.eigvals(a @ b).real).sum()
    assert pairs.frechet_distance(df(x), df(y)) == pytest.approx(want, rel=1e-9)
    assert pairs.frechet_distance(df(x), df(x)) == pytest.approx(0, abs=1e-8)
    assert math.isnan(pairs.frechet_distance(df(x), df(y[:1]))) and math.isnan(pairs.frechet_distance(df(x).limit(0), df(y)))


def test_diversity_of_few(spark):
    df = lambda *rows: spark.createDataFrame([(list(r),) for r in rows], "words array<long>")
    told = lambda *rows: tuple(pairs.internal_diversity(df(*rows)).first())
    assert told() == (0, 0.0) and told((3,)) == (1, 0.0) and told((3,), (3,)) == (2, 0.0) and told((1,), (2,)) == (2, 1.0)
    assert told((0,), (0,), (3,), (1,)) == (4, pytest.approx(1 - 0.5 / 6))


def test_fragments_of_known_molecules():
    """The first is the published example of the cleavage rules."""
    known = {
        "CCCOCc1cc(c2ncccc2)ccc1": ["CCC[4*]", "[4*]C[8*]", "[3*]O[3*]", "[16*]c1cccc([16*])c1", "[14*]c1ncccc1"],
        "CC(=O)Oc1ccccc1C(=O)O": ["CC(=O)[1*]", "[3*]O[3*]", "[16*]c1ccccc1[16*]", "OC(=O)[6*]"],
        "c1ccc(-c2ccccc2)cc1": ["[16*]c1ccccc1", "[16*]c1ccccc1"],
        "CC(=O)Nc1ccccc1": ["CC(=O)[1*]", "[5*]N[5*]", "[16*]c1ccccc1"],
        "CCO": ["CCO"],
        "C1CCCCC1": ["C1CCCCC1"],
    }
    size = lambda s: sorted((s.count("*"), sum(c.isalpha() for c in s)) for s in s)
    for smiles, want in known.items():
        mol = chem.read(smiles)
        got = fragments.pieces(mol)
        assert size(got) == size(want), (smiles, got)
        assert sorted(sorted(x for x in s.replace("]", "[").split("[") if x.endswith("*")) for s in got) == sorted(sorted(x for x in s.replace("]", "[").split("[") if x.endswith("*")) for s in want)
    assert fragments.pieces(chem.read("CCOc1ccccc1")) == fragments.pieces(chem.read("c1ccccc1OCC")) or sorted(fragments.pieces(chem.read("CCOc1ccccc1"))) == sorted(fragments.pieces(chem.read("c1ccccc1OCC")))


def test_ring_values():
    told = lambda s: {k: v for k, v in fragments.ring_values(chem.read(s)).items() if v}
    assert told("C1CCC2(CC1)CCCC2") == {"num_rings": 2, "num_aliphatic_rings": 2, "num_saturated_rings": 2, "num_spiro_atoms": 1, "ring_size_5": 1, "ring_size_6": 1}
    assert told("C1CC2CCC1CC2") == {"num_rings": 2, "num_aliphatic_rings": 2, "num_saturated_rings": 2, "num_bridgehead_atoms": 2, "ring_size_6": 2}
    assert told("c1ccc2[nH]ccc2c1") == {"num_rings": 2, "num_aromatic_rings": 2, "num_heterocycles": 1, "num_aromatic_heterocycles": 1, "ring_size_5": 1, "ring_size_6": 1}
    assert told("C1CC=CCC1") == {"num_rings": 1, "num_aliphatic_rings": 1, "ring_size_6": 1}
    assert told("CCO") == {} and len(fragments.ring_values(chem.read("CCO"))) == 14 == len(molmetrics.RING_NAMES)


def test_motif_table():
    assert len(patterns.EVALUATION) == 29
    count = lambda s: {n: len(chem.pattern(p).unique(chem.read(s))) for n, p in patterns.EVALUATION.items() if chem.pattern(p).unique(chem.read(s))}
    assert count("CC(=O)Oc1ccccc1C(=O)O") == {"benzene": 1, "hydroxyl": 1, "carboxyl": 1, "carbonyl": 2, "ester": 1, "ether": 1}
    assert count("CC(=O)NC") == {"carbonyl": 1, "amide": 1}
    assert count("NCCNCC(C)N(C)C") == {"amine_primary": 1, "amine_secondary": 1, "amine_tertiary": 1}
    assert count("O=[N+]([O-])c1ccccc1Cl") == {"benzene": 1, "amine_tertiary": 1, "nitro": 1, "halogen": 1, "chlorine": 1}
    assert count("CS(=O)(=O)N") == {"amine_primary": 1, "sulfonamide": 1} and count("N#CC=O") == {"carbonyl": 1, "aldehyde": 1, "nitrile": 1}


def test_bundles(spark):
    mols = lambda *s: spark.createDataFrame(list(enumerate(s)), "mol_id long, smiles string")
    some = mols("CCO", "c1ccccc1O", "CC(=O)Oc1ccccc1C(=O)O", "not one", None, "")
    assert all(abs(v) < 1e-9 for v in molmetrics.motif_bundle(some, some).first())
    assert all(v > 0 for v in molmetrics.motif_bundle(some, mols("C1CCCCC1", "CCNCC", "CCl")).first())
    assert list(molmetrics.motif_bundle(mols("x", None), some).first()) == [float("inf")] * 4
    top = {(r.family, r.name): r.total for r in molmetrics.motif_summary(some, 3).collect()}
    assert top["smarts_motifs", "benzene"] == 2 and top["ring_systems", "num_rings"] == 2 and top["ring_systems", "num_spiro_atoms"] == 0 and sum(f == "fragments" for f, _ in top) == 3
    assert molmetrics.internal_diversity(mols("CCO", "OCC")).first()["diversity"] == pytest.approx(0)
    assert m.cosine(molmetrics.fragments(some), molmetrics.fragments(some), "fragment").first()[0] == pytest.approx(1)
    assert molmetrics.fragment_cosine(mols("x"), some).first()[0] == 0.0


def test_graph_bundle(spark):
    one = MOMENTS["graph_metric_bundle"][0](spark, SF).first()
    assert one.degree == pytest.approx(COLLECTIONS["degree_mmd"](spark, SF).first()[0], abs=1e-9)
    assert one.clustering == pytest.approx(MOMENTS["clustering_mmd"][0](spark, SF).first()[0], abs=1e-9) and 0 <= one.spectral < 1


def test_rows_of_tiles_grow_with_the_table(spark, monkeypatch):
    """Each vector goes to as many pairs as there are tiles; up to MOST vectors a tile their number stays what keeps cores busy."""
    monkeypatch.setattr(pairs, "PAIRS", 1)
    x = np.random.default_rng(5).normal(size=(400, 3))
    df = spark.createDataFrame([("gen" if i % 2 else "ref", v.tolist()) for i, v in enumerate(x)], "side string, v array<double>")
    dealt = []
    repartition = type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *a: (dealt.append(self.count()), repartition(self, *a))[1])
    got = {(r.a, r.b): r.total for r in pairs.kernel_sums(df, "gaussian", 1.0, 2).collect()}
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    k = np.exp(-gap / 2)
    assert abs(got["gen", "ref"] - k[1::2, ::2].sum()) < 1e-9 and abs(got["gen", "gen"] - k[1::2, 1::2].sum()) < 1e-9
    assert dealt == [400 * (int(spark.sparkContext.defaultParallelism**0.5) + 1)]
    with pytest.raises(Exception, match="differ in length"):
        pairs.kernel_sums(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "side string, v array<double>"), "gaussian").collect()
