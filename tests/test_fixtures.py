import pytest
from oracle import compare

from graphloom.functions import chem
from graphloom.plans.fixtures import QUERIES, fixture_oracles, fixture_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_known_results(spark, name):
    compare(fixture_queries()[name](spark, SF), fixture_oracles()[name], SF)


@pytest.mark.parametrize(
    "group",
    [
        ["CCO", "OCC", "C(C)O"],
        ["c1ccccc1", "C1=CC=CC=C1"],
        ["CC(=O)OC1=CC=CC=C1C(=O)O", "OC(=O)c1ccccc1OC(C)=O"],
        ["CN1C=NC2=C1C(=O)N(C(=O)N2C)C", "Cn1cnc2c1c(=O)n(C)c(=O)n2C"],
        ["c1ccc2ccccc2c1", "C1=CC=C2C=CC=CC2=C1"],
        ["c1cc[nH]c1", "[nH]1cccc1", "C1=CNC=C1"],
        ["O=[N+]([O-])c1ccccc1", "c1ccccc1[N+]([O-])=O"],
        ["C1CC2CCC1CC2", "C1CC2CCC1CC2"],
    ],
)
def test_canonical(group):
    found = {chem.canonical(s) for s in group}
    assert len(found) == 1 and None not in found
    assert {chem.canonical(s) for s in found} == found


#: each breaks one rule: an aromatic chain, an element nobody knows, an open ring, a closed branch, five bonds, a loop, no letters
@pytest.mark.parametrize("text", ["ccc", "[Zq]C", "N1CCO", "O)C", "C(N)(N)(N)(N)N", "C11", "??", "", None])
def test_no_molecules(text):
    assert chem.read(text) is None


def test_patterns():
    m = chem.read("CC(=O)N(C)c1ccc(Cl)cc1")
    unique = lambda s: chem.pattern(s).unique(m)
    assert len(unique("[CX3](=O)[NX3]")) == 1 and len(unique("[#6]~[#7]")) == 3 and len(unique("[C,N;!R]")) == 4
    assert len(unique("[$([cR1]Cl)]")) == 1 and len(unique("c:c")) == 6 and len(unique("*!@c")) == 2 and unique("[OX2H]") == []
    for wrong in ("[Q]", "C(", "C1CC"):
        with pytest.raises((ValueError, IndexError)):
            chem.pattern(wrong)
