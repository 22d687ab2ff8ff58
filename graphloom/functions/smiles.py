"""Molecule strings to labelled graphs, for the organic subset, brackets, branches and ring closures."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Atom labels by place, 9 for others; bond labels; default valences; bond orders by label.
ATOMS = ["C", "N", "O", "F", "P", "S", "Cl", "Br", "I"]
BONDS = {"-": 0, "=": 1, "#": 2, ":": 3}
VALENCE = {"C": 4, "N": 3, "O": 2, "F": 1, "P": 5, "S": 6, "Cl": 1, "Br": 1, "I": 1}
ORDER = [1.0, 2.0, 3.0, 1.5, 1.0]
_TOKEN = re.compile(r"\[([^\]]+)\]|(Br|Cl|[BCNOPSFI]|[bcnops])|(%\d\d|\d)|([-=#:/\\])|([().])")
_BRACKET = re.compile(r"\d*([A-Z][a-z]?|[a-z][a-z]?)(@{0,2})(H\d*)?([+-]+\d*|[+-]\d+)?(:\d+)?$")


def parse(smiles: str | None) -> tuple[list[str], list[bool], list[tuple[int, int, int]]] | None:
    """(symbols, aromatic flags, bonds (u, v, label) with u < v); None where the string is no molecule of the subset."""
    if not smiles:
        return None
    symbols, aromatic, bonds, stack, rings = [], [], [], [], {}
    last, bond, at, charged = None, None, 0, set()
    while at < len(smiles):
        m = _TOKEN.match(smiles, at)
        if not m:
            return None
        at = m.end()
        bracket, atom, ring, link, mark = m.groups()
        if bracket is not None or atom is not None:
            if bracket is not None:
                b = _BRACKET.match(bracket)
                if not b:
                    return None
                atom = b[1]
                charged.add(len(symbols))
            i = len(symbols)
            symbols.append(atom[0].upper() + atom[1:])
            aromatic.append(atom[0].islower())
            if last is not None:
                bonds.append((last, i, bond if bond is not None else 3 if aromatic[last] and aromatic[i] else 0))
            last, bond = i, None
        elif ring is not None:
            if last is None:
                return None
            if ring in rings:
                other, kind = rings.pop(ring)
                if other == last:
                    return None
                kind = bond if bond is not None else kind
                bonds.append((other, last, kind if kind is not None else 3 if aromatic[last] and aromatic[other] else 0))
            else:
                rings[ring] = (last, bond)
            bond = None
        elif link is not None:
            if last is None or bond is not None:
                return None
            bond = BONDS.get(link, 0)
        elif mark == "(":
            if last is None:
                return None
            stack.append(last)
        elif mark == ")":
            if not stack or bond is not None:
                return None
            last = stack.pop()
        else:
            last, bond = None, None
    if stack or rings or bond is not None or len({(min(u, v), max(u, v)) for u, v, _ in bonds}) < len(bonds):
        return None
    for i, s in enumerate(symbols):
        if i not in charged and s in VALENCE and sum(1.0 if k == 3 else ORDER[k] for u, v, k in bonds if i in (u, v)) > VALENCE[s]:
            return None
    return symbols, aromatic, sorted((min(u, v), max(u, v), k) for u, v, k in bonds)


def ring_atoms(n: int, bonds: list[tuple[int, int, int]]) -> set[int]:
    """Atoms on a cycle: what is left on edges that are no bridges."""
    near: dict[int, set[int]] = {i: set() for i in range(n)}
    for u, v, _ in bonds:
        near[u].add(v)
        near[v].add(u)
    out: set[int] = set()
    for u, v, _ in bonds:
        seen, open_ = {u}, [u]
        while open_:
            x = open_.pop()
            for y in near[x]:
                if y not in seen and {x, y} != {u, v}:
                    seen.add(y)
                    open_.append(y)
        if v in seen:
            out |= {u, v}
    return out


def scaffold_atoms(n: int, bonds: list[tuple[int, int, int]]) -> int:
    """Atoms that stay when ends of chains are taken off again and again; 0 without rings."""
    edges, kept = {(u, v) for u, v, _ in bonds}, set(range(n))
    while True:
        degree = {i: 0 for i in kept}
        for u, v in edges:
            degree[u] += 1
            degree[v] += 1
        ends = {i for i in kept if degree[i] < 2}
        if not ends:
            return len(kept)
        kept -= ends
        edges = {(u, v) for u, v in edges if u in kept and v in kept}


def molecules(df: DataFrame, column: str = "smiles") -> DataFrame:
    """Adds valid, labels, bonds (src, dst, label), n_atoms, n_rings, n_scaffold to df; what doesn't parse is not valid and null."""
    schema = "valid boolean, labels array<int>, bonds array<struct<src:int,dst:int,label:int>>, n_atoms int, n_rings int, n_scaffold int"

    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            got = parse(x)
            if got is None:
                rows.append((False, None, None, None, None, None))
                continue
            symbols, _, bonds = got
            n, parts = len(symbols), list(range(len(symbols)))
            for u, v, _ in bonds:
                a, b = parts[u], parts[v]
                parts = [a if p == b else p for p in parts]
            labels = [ATOMS.index(a) if a in ATOMS else 9 for a in symbols]
            rows.append((True, labels, [{"src": u, "dst": v, "label": k} for u, v, k in bonds], n, len(bonds) - n + len(set(parts)), scaffold_atoms(n, bonds)))
        return pd.DataFrame(rows, columns=["valid", "labels", "bonds", "n_atoms", "n_rings", "n_scaffold"])

    parsed = F.pandas_udf(run, schema)
    return df.withColumn("_m", parsed(F.col(column))).select(*df.columns, "_m.*")


def complex_enough(mols: DataFrame, atoms: tuple[int, int] = (30, 100), rings: int = 4, scaffold: int = 15) -> DataFrame:
    """Rows of `molecules` within the bounds."""
    return mols.where(F.col("n_atoms").between(*atoms) & (F.col("n_rings") >= rings) & (F.col("n_scaffold") >= scaffold))
