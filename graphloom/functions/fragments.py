"""Fragments of a molecule: bonds break between atoms of given environments, and each end keeps its environment's number."""

from __future__ import annotations

from functools import lru_cache

from graphloom.functions import chem

#: Environments by number, their first atom is the one at the bond; which of them a bond may join. Published cleavage rules, fixed
#: values. Double bonds break between two of 7, all others are single and outside rings.
ENVIRONMENTS = {
    1: "[C;D3]([#6,#7,#8])(=O)",
    3: "[O;D2]-;!@[#6]",
    4: "[C;!D1;!$(C=*)]-;!@[#6]",
    5: "[N;!D1;!$(N=*);!$(N-[!#6;!#16]);!$([N;R]@[C;R]=O)]",
    6: "[C;D3;!R](=O)-;!@[#6,#7,#8]",
    7: "[C;D2,D3]-[#6]",
    8: "[C;!R;!D1;!$(C!-*)]",
    9: "[n;+0;$(n(:[c,n,o,s]):[c,n,o,s])]",
    10: "[N;R;$(N(@C(=O))@[C,N,O,S])]",
    11: "[S;D2]-;!@[#6]",
    12: "[S;D4]([#6])(=O)(=O)",
    13: "[C;$(C(-;@[C,N,O,S])-;@[N,O,S])]",
    14: "[c;$(c(:[c,n,o,s]):[n,o,s])]",
    15: "[C;$(C(-;@C)-;@C)]",
    16: "[c;$(c(:c):c)]",
}
JOINED = {1: (3, 5, 10), 3: (4, 13, 14, 15, 16), 4: (5, 11), 5: (12, 13, 14, 15, 16), 6: (13, 14, 15, 16), 7: (7,), 8: (9, 10, 13, 14, 15, 16), 9: (13, 14, 15, 16), 10: (13, 14, 15, 16), 11: (13, 14, 15, 16), 13: (14, 15, 16), 14: (14, 15, 16), 15: (16,), 16: (16,)}
_RULES = [(a, b) for a, more in JOINED.items() for b in more]

for _k in ENVIRONMENTS:
    chem.NUMBER[f"{_k}*"] = 200 + _k


def cuts(mol: chem.Molecule) -> list[tuple[int, int, int, int]]:
    """(atom, its environment, atom, its environment) of every bond that breaks, by the first rule that fits."""
    rules = [(k, chem.pattern(s)) for k, s in ENVIRONMENTS.items()]
    held = [tuple(k for k, p in rules if p.atoms[0](mol, i) and next(p.matches(mol, i), None) is not None) for i in range(mol.n)]
    out = []
    for i in range(mol.n):
        for j, kind in mol.near[i].items():
            if j > i and held[i] and held[j] and frozenset((i, j)) not in mol.ring_bonds and (both := _rule(held[i], held[j], kind)):
                out.append((i, both[0], j, both[1]))
    return out


@lru_cache(maxsize=4096)
def _rule(left: tuple[int, ...], right: tuple[int, ...], kind: int) -> tuple[int, int] | None:
    """The environments of a bond's ends under the first rule that fits."""
    for a, b in _RULES:
        if kind == (1 if a == 7 else 0):
            if a in left and b in right:
                return a, b
            if a in right and b in left:
                return b, a
    return None


@lru_cache(maxsize=4096)
def _written(*atoms_and_bonds) -> str:
    """The canonical string of a piece. Molecules share most of theirs."""
    return chem.write(chem.Molecule(*atoms_and_bonds))


def pieces(mol: chem.Molecule) -> list[str]:
    """Canonical strings of what is left when all bonds break; [4*] stands where an atom of environment 4 was cut off."""
    broken = cuts(mol)
    gone = {frozenset((i, j)) for i, _, j, _ in broken}
    ends: dict[int, list[int]] = {}
    for i, a, j, b in broken:
        ends.setdefault(i, []).append(a)
        ends.setdefault(j, []).append(b)
    seen: set[int] = set()
    out = []
    for start in range(mol.n):
        if start in seen:
            continue
        held, open_ = [], [start]
        seen.add(start)
        while open_:
            x = open_.pop()
            held.append(x)
            for y in mol.near[x]:
                if y not in seen and frozenset((x, y)) not in gone:
                    seen.add(y)
                    open_.append(y)
        held.sort()
        place = {x: k for k, x in enumerate(held)}
        links = [(place[x], place[y], k) for x in held for y, k in mol.near[x].items() if x < y and frozenset((x, y)) not in gone]
        stubs = [(place[x], k) for x in held for k in ends.get(x, ())]
        links += [(at, len(held) + n, 0) for n, (at, _) in enumerate(stubs)]
        n = len(stubs)
        out.append(_written((*(mol.symbol[x] for x in held), *(f"{k}*" for _, k in stubs)), (*(mol.aromatic[x] for x in held), *[False] * n), (*(mol.charge[x] for x in held), *[0] * n), (*(mol.hydrogens[x] for x in held), *[0] * n), tuple(links)))
    return out


def ring_values(mol: chem.Molecule) -> dict[str, int]:
    """Fourteen numbers of a molecule's rings. Spiro atoms are all that two rings share; bridgeheads end a path of two bonds or more
    that two rings share."""
    rings = [frozenset(r) for r in mol.rings]
    bonds = [{frozenset((r[i - 1], r[i])) for i in range(len(r))} for r in mol.rings]
    flat = [all(mol.aromatic[i] for i in r) for r in rings]
    other = [any(mol.symbol[i] != "C" for i in r) for r in rings]
    single = [all(mol.near[a][b] == 0 for a, b in map(tuple, x)) for x in bonds]
    spiro, heads = set(), set()
    for i in range(len(rings)):
        for j in range(i):
            both, common = rings[i] & rings[j], bonds[i] & bonds[j]
            if len(both) == 1:
                spiro |= both
            if len(common) > 1:
                heads |= {x for x in both if sum(x in b for b in common) == 1}
    out = {
        "num_rings": len(rings), "num_aromatic_rings": sum(flat), "num_aliphatic_rings": len(rings) - sum(flat), "num_saturated_rings": sum(single), "num_heterocycles": sum(other),
        "num_aromatic_heterocycles": sum(a and b for a, b in zip(flat, other, strict=True)), "num_spiro_atoms": len(spiro), "num_bridgehead_atoms": len(heads),
    }
    return {**out, **{f"ring_size_{n}": sum(len(r) == n for r in rings) for n in range(3, 9)}}
