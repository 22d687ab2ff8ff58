"""Token sequences as Column expressions: rendering and vocabulary sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.operators.kernels import FLAT, HDT, HDTC, HSENT

SCHEMES = {"flat": FLAT, "hdt": HDT, "hsent": HSENT, "hdtc": HDTC}
ATOM_TYPES, BOND_TYPES = 10, 5


def render(tokens: Column, scheme: str) -> Column:
    """Names of special tokens in brackets, others as numbers from 0; in hdt, what follows ENTER reads level:id."""
    table = SCHEMES[scheme]
    offset = table["offset"]
    names = F.create_map(*[x for k, v in table.items() if k != "offset" for x in (F.lit(v), F.lit(f"[{k}]"))])
    plain = lambda t: F.when(t >= offset, (t - offset).cast("string")).otherwise(F.coalesce(F.try_element_at(names, t), F.concat(F.lit("?"), t.cast("string"))))
    if scheme != "hdt":
        return F.array_join(F.transform(tokens, plain), " ")
    enter = table["ENTER"]
    after = lambda i, n: F.coalesce(F.get(tokens, i - n), F.lit(-1)) == enter
    level = lambda t, i: F.when(after(i, 1), F.concat(F.lit("L"), plain(t), F.lit(":"), F.coalesce(F.get(tokens, i + 1) - offset, F.lit(-1)).cast("string"))).when(after(i, 2), F.lit(None)).otherwise(plain(t))
    return F.array_join(F.transform(tokens, level), " ")


def vocab_size(max_nodes: Column, scheme: str, labelled: bool = False) -> Column:
    """Special tokens, node ids and, in labelled schemes, atom and bond types; null while the number of nodes isn't known."""
    return F.lit(SCHEMES[scheme]["offset"]) + max_nodes + (ATOM_TYPES + BOND_TYPES if labelled else 0)
