import pytest

from graphloom.functions import smiles


@pytest.mark.parametrize(("text", "atoms", "bonds"), [("CCO", 3, 2), ("c1ccccc1", 6, 6), ("CC(=O)OC1=CC=CC=C1C(=O)O", 13, 13), ("CN1C=NC2=C1C(=O)N(C(=O)N2C)C", 14, 15), ("c1ccc(-c2ccccc2)cc1", 12, 13), ("[NH4+]", 1, 0)])
def test_parse(text, atoms, bonds):
    symbols, _, got = smiles.parse(text)
    assert (len(symbols), len(got)) == (atoms, bonds)


#: each breaks one rule: no atom symbols, a branch or a ring left open, a bond without an end, too many bonds
@pytest.mark.parametrize("text", ["?", "N(C", "O1CC", "CC=", "F(C)C", "", None])
def test_invalid(text):
    assert smiles.parse(text) is None


def test_columns(spark):
    df = spark.createDataFrame([("c1ccc2cc3ccccc3cc2c1",), ("CCO",), ("bad!",)], "smiles string")
    got = [(r.valid, r.n_atoms, r.n_rings, r.n_scaffold) for r in smiles.molecules(df).collect()]
    assert got == [(True, 14, 3, 14), (True, 3, 0, 0), (False, None, None, None)]
    assert smiles.complex_enough(smiles.molecules(df), (10, 15), 2, 4).count() == 1
    assert smiles.ring_atoms(4, [(0, 1, 0), (1, 2, 0), (0, 2, 0), (2, 3, 0)]) == {0, 1, 2}
