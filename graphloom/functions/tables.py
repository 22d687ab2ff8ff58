"""Table functions for SQL: matches of a pattern in a molecule, and the transitions of a partition's rows."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from graphloom.functions import chem


@udtf(returnType="match_id int, atoms array<int>")
class MotifMatches:
    """motif_matches(smiles, smarts): a row a match, one for each set of atoms; none for what isn't a molecule or a pattern."""

    def eval(self, smiles: str, smarts: str):
        mol = chem.read(smiles) if smiles is not None else None
        if mol is None or smarts is None:
            return
        try:
            found = chem.pattern(smarts).unique(mol)
        except (ValueError, IndexError):
            return
        for k, at in enumerate(found):
            yield k, sorted(at)


@udtf(returnType="graph_id long, src string, dst string, n long")
class Transitions:
    """transitions(TABLE(rows) PARTITION BY id ORDER BY ...): rows hold an id and a state. A row a pair of different states that
    follow one another in the partition, smaller first, with how often they do."""

    def __init__(self):
        self.last, self.key, self.seen = None, None, {}

    def eval(self, row: Row):
        self.key, state = row[0], row[1]
        if self.last is not None and state is not None and state != self.last:
            pair = (min(self.last, state), max(self.last, state))
            self.seen[pair] = self.seen.get(pair, 0) + 1
        self.last = state

    def terminate(self):
        for (a, b), n in sorted(self.seen.items()):
            yield self.key, a, b, n


def register(spark: SparkSession) -> None:
    spark.udtf.register("motif_matches", MotifMatches)
    spark.udtf.register("transitions", Transitions)
