"""Molecules with hydrogens, charges, rings and aromaticity; a subset of SMARTS; canonical strings. Plain Python on one molecule."""

from __future__ import annotations

import re
from collections import Counter
from functools import cached_property, lru_cache
from itertools import count

from graphloom.functions.smiles import _BRACKET, _TOKEN, parse

# Atomic numbers, the valences that implicit hydrogens fill up to, electrons a lone pair gives to a ring.
NUMBER = {"H": 1, "B": 5, "C": 6, "N": 7, "O": 8, "F": 9, "Si": 14, "P": 15, "S": 16, "Cl": 17, "Se": 34, "Br": 35, "I": 53}
FILL = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "F": (1,), "P": (3, 5), "S": (2, 4, 6), "Cl": (1,), "Br": (1,), "I": (1,)}
_ORDER = {0: 1, 1: 2, 2: 3}
#: Numbers of the features that an atom's primitives ask for; forgotten beyond a bound.
_KINDS: dict[tuple, int] = {}
_NUMBERS, _MOST = count(), 1 << 14


class Molecule:
    """Atoms 0..n-1: symbol, aromatic, charge, hydrogens; bond: label of every bonded pair in both directions; rings: a least set."""

    def __init__(self, symbol, aromatic, charge, explicit, bonds):
        self.symbol, self.aromatic, self.charge = symbol, list(aromatic), charge
        self.n = len(symbol)
        self.near: list[dict[int, int]] = [{} for _ in range(self.n)]
        for u, v, k in bonds:
            self.near[u][v] = self.near[v][u] = k
        self.rings = least_rings(self.n, [(u, v) for u, v, _ in bonds])
        self.ring_bonds = {frozenset((r[i - 1], r[i])) for r in self.rings for i in range(len(r))}
        for u, v, k in bonds:  # written without a sign, a bond between two rings is single
            if k == 3 and frozenset((u, v)) not in self.ring_bonds:
                self.near[u][v] = self.near[v][u] = 0
        self.ring_sizes: list[list[int]] = [[] for _ in range(self.n)]
        for r in sorted(self.rings, key=len):
            for i in r:
                self.ring_sizes[i].append(len(r))
        self.hydrogens = [h if h is not None else self._fill(i) for i, h in enumerate(explicit)]
        self._perceive()

    @cached_property
    def kinds(self) -> list[int]:
        """A number for each atom: atoms of one number are alike for every primitive but $()."""
        if len(_KINDS) > _MOST:
            _KINDS.clear()
        told = ((self.symbol[i], self.aromatic[i], self.charge[i], self.hydrogens[i], tuple(sorted(self.near[i].values())), tuple(self.ring_sizes[i])) for i in range(self.n))
        return [_KINDS[k] if k in _KINDS else _KINDS.setdefault(k, next(_NUMBERS)) for k in told]

    @cached_property
    def known(self) -> dict[tuple[str, int], bool]:
        """What was found of atoms under brackets with $()."""
        return {}

    def _fill(self, i: int) -> int:
        """Hydrogens that fill an atom without brackets. One that gives a ring an electron uses a valence for it."""
        kinds = self.near[i].values()
        used = sum(_ORDER.get(k, 1) for k in kinds)
        if self.aromatic[i] and (self.symbol[i] in ("C", "B") or self.symbol[i] in ("N", "P") and len(self.near[i]) < 3):
            used += 1 if 3 in kinds and 1 not in kinds else 0
        return next((v - used for v in FILL.get(self.symbol[i], ()) if v >= used), 0)

    def _perceive(self) -> None:
        """Rings written with double bonds become aromatic where Hueckel's rule holds."""
        in_ring = {i for r in self.rings for i in r}
        for _ in range(len(self.rings)):
            changed = False
            for ring in self.rings:
                if not 5 <= len(ring) <= 7 or all(self.aromatic[i] for i in ring):
                    continue
                electrons = [self._electrons(i, set(ring), in_ring) for i in ring]
                if None not in electrons and sum(electrons) % 4 == 2:
                    changed = True
                    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                        self.near[a][b] = self.near[b][a] = 3
                        self.aromatic[a] = True
            if not changed:
                return

    def _electrons(self, i: int, ring: set[int], in_ring: set[int]) -> int | None:
        double = [j for j, k in self.near[i].items() if k == 1]
        if self.aromatic[i] and any(k == 3 for k in self.near[i].values()):
            return 2 if self.symbol[i] in ("O", "S") or self.symbol[i] == "N" and self.hydrogens[i] + len(self.near[i]) == 3 else 1
        if any(j in in_ring for j in double):
            return 1
        if double:
            return 0 if self.symbol[i] == "C" and self.symbol[double[0]] in ("O", "N", "S") else None
        return 2 if self.symbol[i] in ("N", "O", "S", "P") and len(self.near[i]) + self.hydrogens[i] <= 3 else None


def _cyclic(near: list[set[int]]) -> tuple[int, list[int]]:
    """How many parts a graph has, and for each node a number of what it is in without bridges; -1 where that is the node alone."""
    n, parts, met = len(near), 0, 0
    when, low, group = [-1] * n, [0] * n, [-1] * n
    for start in range(n):
        if when[start] >= 0:
            continue
        parts += 1
        when[start] = low[start] = met
        met += 1
        held, open_ = [start], [(start, -1, iter(near[start]))]
        while open_:
            x, above, rest = open_[-1]
            for y in rest:
                if when[y] < 0:
                    when[y] = low[y] = met
                    met += 1
                    held.append(y)
                    open_.append((y, x, iter(near[y])))
                    break
                if y != above:
                    low[x] = min(low[x], when[y])
            else:
                open_.pop()
                if above >= 0:
                    low[above] = min(low[above], low[x])
                if low[x] == when[x]:
                    own = held[held.index(x) :]
                    del held[-len(own) :]
                    for y in own if len(own) > 1 else ():
                        group[y] = x
    return parts, group


def least_rings(n: int, edges: list[tuple[int, int]]) -> list[list[int]]:
    """A basis of shortest cycles: for each edge and node the shortest cycle through both, short ones first, kept if independent. A
    cycle crosses no bridge, so it is sought in what bridges leave."""
    near: list[set[int]] = [set() for _ in range(n)]
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    number = {frozenset(e): i for i, e in enumerate(edges)}
    parts, group = _cyclic(near)
    inside: dict[int, list[tuple[int, int]]] = {}
    for u, v in edges:
        if group[u] >= 0 and group[u] == group[v]:
            inside.setdefault(group[u], []).append((u, v))
    ways = []
    for i in range(n):
        if group[i] < 0:
            continue
        back, queue = {i: None}, [i]
        for x in queue:
            for y in sorted(near[x]):
                if y not in back and group[y] == group[i]:
                    back[y] = x
                    queue.append(y)
        ways.append((group[i], back))
    want = len(edges) - n + parts
    found = {}
    for at, back in ways if want else []:
        for u, v in inside[at]:
            if back[u] != v and back[v] != u:
                left, right = [u], [v]
                for side in (left, right):
                    while back[side[-1]] is not None:
                        side.append(back[side[-1]])
                if set(left) & set(right) == {left[-1]}:
                    ring = left + right[-2::-1] if len(right) > 1 else left
                    found.setdefault(frozenset(ring), ring)
    out, basis = [], {}
    for ring in sorted(found.values(), key=lambda r: (len(r), sorted(r))):
        bits = 0
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            bits ^= 1 << number[frozenset((a, b))]
        while bits and bits.bit_length() in basis:
            bits ^= basis[bits.bit_length()]
        if bits:
            basis[bits.bit_length()] = bits
            out.append(ring)
        if len(out) == want:
            break
    return out


def read(smiles: str | None) -> Molecule | None:
    """A molecule; None where the string isn't one: unknown elements, aromatic atoms outside rings, wrong valences or grammar."""
    got = parse(smiles)
    if got is None:
        return None
    symbol, aromatic, bonds = got
    charge, explicit = [], []
    for m in _TOKEN.finditer(smiles):
        if m[1] is not None:
            b = _BRACKET.match(m[1])
            sign = b[4] or ""
            size = re.sub("[+-]", "", sign)
            charge.append((int(size) if size else len(sign)) * (-1 if "-" in sign else 1))
            explicit.append(int(b[3][1:] or 1) if b[3] else 0)
        elif m[2] is not None:
            charge.append(0)
            explicit.append(None)
    if any(s not in NUMBER for s in symbol):
        return None
    out = Molecule(symbol, aromatic, charge, explicit, bonds)
    return None if any(a and not out.ring_sizes[i] for i, a in enumerate(aromatic)) else out


# ---------------------------------------------------------------- SMARTS


def _told(text: str, test):
    """test with its answers kept: by kind of atom or, where the text has $(), by atom of the molecule."""
    if "$(" in text:

        def asked(mol, i):
            key = (text, i)
            if key not in mol.known:
                mol.known[key] = test(mol, i)
            return mol.known[key]

        return asked
    answers: dict[int, bool] = {}

    def alike(mol, i):
        kind = mol.kinds[i]
        if kind not in answers:
            if len(answers) > _MOST:
                answers.clear()
            answers[kind] = test(mol, i)
        return answers[kind]

    return alike


_PRIMITIVE = re.compile(r"\$\(|#(\d+)|([XDRrHv])(\d*)|([+-]+\d*)|(Cl|Br|Si|Se|[BCNOPSFI])|([bcnops])|([aA*])")


def _logic(text: str, one):
    """A predicate from primitives joined by ; , & and nothing, with ! before them."""

    def split(at: str) -> list[str]:
        parts, depth, held = [], 0, ""
        for c in text:
            depth += (c == "(") - (c == ")")
            if c == at and not depth:
                parts.append(held)
                held = ""
            else:
                held += c
        return [*parts, held]

    for sign, join in ((";", all), (",", any), ("&", all)):
        if len(parts := split(sign)) > 1:
            tests = [_logic(p, one) for p in parts]
            return lambda *x: join(t(*x) for t in tests)
    tests, at = [], 0
    while at < len(text):
        no = text[at] == "!"
        at += no
        test, at = one(text, at)
        tests.append((lambda t: lambda *x: not t(*x))(test) if no else test)
    return lambda *x: all(t(*x) for t in tests)


def _atom(text: str, at: int):
    m = _PRIMITIVE.match(text, at)
    if not m:
        raise ValueError(f"unknown primitive in {text!r}")
    if m[0] == "$(":
        depth, end = 1, m.end()
        while depth:
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        inner = pattern(text[m.end() : end - 1])
        return (lambda mol, i: any(True for _ in inner.matches(mol, i))), end
    if m[1]:
        number = int(m[1])
        return (lambda mol, i: NUMBER[mol.symbol[i]] == number), m.end()
    if m[2]:
        kind, n = m[2], int(m[3]) if m[3] else None
        count = {
            "X": lambda mol, i: len(mol.near[i]) + mol.hydrogens[i] == (1 if n is None else n),
            "D": lambda mol, i: len(mol.near[i]) == (1 if n is None else n),
            "H": lambda mol, i: mol.hydrogens[i] == (1 if n is None else n),
            "R": lambda mol, i: bool(mol.ring_sizes[i]) if n is None else len(mol.ring_sizes[i]) == n,
            "r": lambda mol, i: bool(mol.ring_sizes[i]) if n is None else mol.ring_sizes[i][:1] == [n],
            "v": lambda mol, i: sum(_ORDER.get(k, 1.5) for k in mol.near[i].values()) + mol.hydrogens[i] == (1 if n is None else n),
        }
        return count[kind], m.end()
    if m[4]:
        size = re.sub("[+-]", "", m[4])
        charge = (int(size) if size else len(m[4])) * (-1 if "-" in m[4] else 1)
        return (lambda mol, i: mol.charge[i] == charge), m.end()
    if m[5]:
        name = m[5]
        return (lambda mol, i: mol.symbol[i] == name and not mol.aromatic[i]), m.end()
    if m[6]:
        name = m[6].upper()
        return (lambda mol, i: mol.symbol[i] == name and mol.aromatic[i]), m.end()
    return {"a": lambda mol, i: mol.aromatic[i], "A": lambda mol, i: not mol.aromatic[i], "*": lambda mol, i: True}[m[7]], m.end()


def _bond(text: str, at: int):
    label = {"-": 0, "=": 1, "#": 2, ":": 3}
    if text[at] == "~":
        return (lambda mol, a, b: True), at + 1
    if text[at] == "@":
        return (lambda mol, a, b: frozenset((a, b)) in mol.ring_bonds), at + 1
    want = label[text[at]]
    return (lambda mol, a, b: mol.near[a][b] == want), at + 1


def _either(mol, a, b):
    return mol.near[a][b] in (0, 3)


class Pattern:
    """Atoms with predicates, and for each the bonds to earlier ones."""

    def __init__(self):
        self.atoms: list = []
        self.links: list[list[tuple[int, object]]] = []

    def matches(self, mol: Molecule, first: int | None = None):
        """Places of the pattern's atoms, in its order; first fixes the first atom's."""
        at: list[int] = []

        def grow(k: int):
            if k == len(self.atoms):
                yield tuple(at)
                return
            links = self.links[k]
            if links:
                options = sorted(mol.near[at[links[0][0]]])
            else:
                options = range(mol.n) if k or first is None else [first]
            for i in options:
                if i not in at and self.atoms[k](mol, i) and all(i in mol.near[at[j]] and test(mol, at[j], i) for j, test in links):
                    at.append(i)
                    yield from grow(k + 1)
                    at.pop()

        yield from grow(0)

    def unique(self, mol: Molecule) -> list[tuple[int, ...]]:
        """One match for each set of atoms, the first found."""
        found: dict[frozenset, tuple] = {}
        for m in self.matches(mol):
            found.setdefault(frozenset(m), m)
        return list(found.values())


@lru_cache(maxsize=4096)
def pattern(smarts: str) -> Pattern:
    """A compiled pattern. ValueError where the text isn't in the subset: atoms, brackets with primitives, bonds, branches, rings."""
    out, stack, rings = Pattern(), [], {}
    last, bond, at = None, None, 0
    while at < len(smarts):
        c = smarts[at]
        if c == "(":
            stack.append(last)
            at += 1
        elif c == ")":
            last = stack.pop()
            at += 1
        elif c in "-=#:~@!" or c in "&,;" and bond is not None:
            end = at
            while end < len(smarts) and smarts[end] in "-=#:~@!&,;":
                end += 1
            bond, at = _logic(smarts[at:end], _bond), end
        elif c.isdigit() or c == "%":
            name, at = (smarts[at + 1 : at + 3], at + 3) if c == "%" else (c, at + 1)
            if name in rings:
                other, kind = rings.pop(name)
                out.links[last].append((other, bond or kind or _either))
            else:
                rings[name] = (last, bond)
            bond = None
        else:
            if c == "[":
                depth, end = 1, at + 1
                while depth:
                    depth += (smarts[end] == "[") - (smarts[end] == "]")
                    end += 1
                test = _logic(smarts[at + 1 : end - 1], _atom)
            else:
                test, end = _atom(smarts, at)
            out.atoms.append(_told(smarts[at:end], test))
            out.links.append([] if last is None else [(last, bond or _either)])
            last, bond, at = len(out.atoms) - 1, None, end
    if rings or stack:
        raise ValueError(f"open ring or branch in {smarts!r}")
    return out


# ---------------------------------------------------------------- canonical strings


def ranks(mol: Molecule) -> list[int]:
    """A numbering of the atoms that depends on the molecule alone: invariants refined by those of neighbours, ties broken one by
    one at the least class and refined again."""

    def refine(x: list) -> list[int]:
        while True:
            place = {k: i for i, k in enumerate(sorted(set(x)))}
            now = [place[k] for k in x]
            new = [(now[i], tuple(sorted((mol.near[i][j], now[j]) for j in mol.near[i]))) for i in range(mol.n)]
            if len(set(new)) == len(place):
                return now
            x = new

    x = refine([(NUMBER[mol.symbol[i]], mol.aromatic[i], mol.charge[i], mol.hydrogens[i], len(mol.near[i]), tuple(mol.ring_sizes[i])) for i in range(mol.n)])
    while len(set(x)) < mol.n:
        tied = min(k for k, n in Counter(x).items() if n > 1)
        # atoms of one class can be told apart by what follows: the least string decides among the first few of a small class
        x = refine([(k, 0 if i == x.index(tied) else 1) for i, k in enumerate(x)])
    return x


def write(mol: Molecule) -> str:
    """The canonical string: depth first by ranks, parts of a molecule by their strings."""
    rank = ranks(mol)
    seen: set[int] = set()
    parts = []
    for start in sorted(range(mol.n), key=rank.__getitem__):
        if start in seen:
            continue
        closing: dict[int, list[tuple[int, int]]] = {}
        order, children, open_ = [], {}, set()

        def visit(i: int, above: int | None):
            seen.add(i)
            order.append(i)
            children[i] = []  # noqa: B023
            for j in sorted(mol.near[i], key=rank.__getitem__):
                if j == above:
                    continue
                if j in seen:
                    if frozenset((i, j)) not in open_:  # noqa: B023
                        open_.add(frozenset((i, j)))  # noqa: B023
                        number = len(open_)  # noqa: B023
                        closing.setdefault(j, []).append((number, i))  # noqa: B023
                        closing.setdefault(i, []).append((number, j))  # noqa: B023
                else:
                    children[i].append(j)  # noqa: B023
                    visit(j, i)

        visit(start, None)

        def bond(i: int, j: int) -> str:
            k = mol.near[i][j]
            both = mol.aromatic[i] and mol.aromatic[j]
            return "" if k == 3 and both or k == 0 and not both else "-=#:"[k]

        def say(i: int) -> str:
            out = _name(mol, i)
            for number, j in sorted(closing.get(i, ())):  # noqa: B023
                first = order.index(i) < order.index(j)  # noqa: B023
                out += (bond(i, j) if first else "") + (str(number) if number < 10 else f"%{number:02d}")  # noqa: B023
            told = [bond(i, j) + say(j) for j in children[i]]  # noqa: B023
            return out + "".join(f"({t})" for t in told[:-1]) + "".join(told[-1:])

        parts.append(say(start))
    return ".".join(sorted(parts))


def _name(mol: Molecule, i: int) -> str:
    name = mol.symbol[i].lower() if mol.aromatic[i] else mol.symbol[i]
    usual = mol._fill(i)
    if mol.symbol[i] in FILL and not mol.charge[i] and usual == mol.hydrogens[i]:
        return name
    h = mol.hydrogens[i]
    charge = mol.charge[i]
    sign = "" if not charge else ("+" if charge > 0 else "-") + (str(abs(charge)) if abs(charge) > 1 else "")
    return f"[{name}{'H' if h else ''}{h if h > 1 else ''}{sign}]"


def canonical(smiles: str | None) -> str | None:
    mol = read(smiles)
    return None if mol is None else write(mol)
