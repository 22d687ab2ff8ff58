"""Two sets of molecules compared: fragments, motifs, rings, similarity. mols: mol_id, smiles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import chem, patterns
from graphloom.functions import fragments as fr
from graphloom.operators import metrics, pairs
from graphloom.operators import molecules as m
from graphloom.sources.staging import staged

RING_NAMES = ("num_rings", "num_aromatic_rings", "num_aliphatic_rings", "num_saturated_rings", "num_heterocycles", "num_aromatic_heterocycles", "num_spiro_atoms", "num_bridgehead_atoms", *(f"ring_size_{n}" for n in range(3, 9)))


@m.once_a_string
def fragments(mols: DataFrame) -> DataFrame:
    """(mol_id, fragment, n): canonical strings of a molecule's pieces after all bonds between cleavable environments broke."""
    return m._per_molecule(mols, lambda x: [(f,) for f in fr.pieces(x)], "fragment string").groupBy("mol_id", "fragment").agg(F.count("*").alias("n"))


def fragment_counts(mols: DataFrame) -> DataFrame:
    """(fragment, mols): how many molecules hold each."""
    return fragments(mols).groupBy("fragment").agg(F.count("*").alias("mols"))


def fragment_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """cosine of two sets' fragment counts; 0 where a side has none."""
    out = m.cosine(fragments(a), fragments(b), "fragment")
    return out.select(F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


@m.once_a_string
def ring_vectors(mols: DataFrame) -> DataFrame:
    """(mol_id, v): fourteen numbers of each molecule's rings, in the order of RING_NAMES."""
    return m._per_molecule(mols, lambda x: [([float(v) for v in fr.ring_values(x).values()],)], "v array<double>")


@m.once_a_string
def motif_vectors(mols: DataFrame, table: dict[str, str] | None = None) -> DataFrame:
    """(mol_id, v): counts of the table's motifs by name; a row for every molecule, zeros where it has none."""
    table = patterns.EVALUATION if table is None else table
    names = sorted(table)
    every = m._per_molecule(mols, lambda x: [(True,)], "valid boolean").select("mol_id")
    held = m.vectors(m.motif_counts(mols, table), names)
    return every.join(held, "mol_id", "left").select("mol_id", F.coalesce("v", F.array_repeat(F.lit(0.0), len(names))).alias("v"))


def _profiles(mols: DataFrame) -> DataFrame:
    """(mols, groups, motifs, rings, fragments), staged: for each different string how many molecules have it, its counts of all
    functional groups and motifs by name, its ring numbers and all its pieces, read once."""
    tables = [[_known(t[n]) for n in sorted(t)] for t in ({n: s for n, (s, _) in patterns.FUNCTIONAL.items()}, patterns.EVALUATION)]
    count = lambda x, table: [float(len(chem.pattern(s).unique(x))) if s else 0.0 for s in table]
    rows = lambda x: [(*(count(x, t) for t in tables), [float(v) for v in fr.ring_values(x).values()], fr.pieces(x))]
    held = m._per_molecule(m.counted_strings(mols), rows, "groups array<double>, motifs array<double>, rings array<double>, fragments array<string>")
    return staged(held.withColumnRenamed("mol_id", "mols"), "profiles")


def _known(smarts: str) -> str | None:
    """The pattern; None outside the subset of SMARTS."""
    try:
        return chem.pattern(smarts) and smarts
    except (ValueError, IndexError):
        return None


def motif_bundle(gen: DataFrame, ref: DataFrame) -> DataFrame:
    """One row: squared discrepancies of functional groups (those the reference has), motifs and rings under a Gaussian kernel, and the
    distance of the fragments' shares. Infinite without generated molecules."""
    told = {"gen": _profiles(gen), "ref": _profiles(ref)}
    found = sorted(r["at"] for r in told["ref"].select(F.posexplode("groups").alias("at", "n")).where("n > 0").select("at").distinct().collect())
    both = told["gen"].withColumn("side", F.lit("gen")).unionByName(told["ref"].withColumn("side", F.lit("ref")))
    gap = lambda v, name: pairs.mmd(both.select("side", v.alias("v"), "mols"), weight="mols").select(F.col("mmd2").alias(name))
    counts = both.select("side", "mols", F.explode("fragments").alias("key")).groupBy("side", "key").agg(F.sum("mols").alias("n"))
    brics = metrics.two_sided(counts).agg(F.coalesce(metrics.share_l2(), F.lit(0.0)).alias("motif_brics_mmd"))
    out = gap(F.col("motifs"), "motif_smarts_mmd").crossJoin(gap(F.col("rings"), "motif_ring_mmd")).crossJoin(brics)
    out = out.crossJoin(gap(F.array(*[F.get("groups", F.lit(k)) for k in found]), "motif_fg_mmd")) if found else out.withColumn("motif_fg_mmd", F.lit(0.0))
    none = told["gen"].isEmpty()
    return out.select(*[(F.lit(float("inf")) if none else F.col(c)).alias(c) for c in ("motif_fg_mmd", "motif_smarts_mmd", "motif_ring_mmd", "motif_brics_mmd")])


def motif_summary(mols: DataFrame, most: int = 20) -> DataFrame:
    """(family, name, total): the most frequent functional groups, motifs and fragments, and all ring numbers."""
    top = lambda df, family: df.groupBy("name").agg(F.sum("n").cast("long").alias("total")).orderBy(F.desc("total"), "name").limit(most).withColumn("family", F.lit(family))
    groups = top(m.motif_counts(mols, {n: s for n, (s, _) in patterns.FUNCTIONAL.items()}).withColumnRenamed("motif", "name"), "functional_groups")
    motifs = top(m.motif_counts(mols, patterns.EVALUATION).withColumnRenamed("motif", "name"), "smarts_motifs")
    pieces = top(fragments(mols).withColumnRenamed("fragment", "name"), "fragments")
    each = F.arrays_zip(F.array(*map(F.lit, RING_NAMES)).alias("name"), F.col("v").alias("n"))
    counted = ring_vectors(mols).groupBy("v").agg(F.count("*").alias("mols"))
    rings = counted.select("mols", F.inline(each)).groupBy("name").agg(F.sum(F.col("n") * F.col("mols")).cast("long").alias("total")).withColumn("family", F.lit("ring_systems"))
    return groups.unionByName(motifs).unionByName(pieces).unionByName(rings).select("family", "name", "total")


def internal_diversity(mols: DataFrame) -> DataFrame:
    return pairs.internal_diversity(m.fingerprints(mols))


def snn(gen: DataFrame, ref: DataFrame) -> DataFrame:
    """snn: the mean over the generated molecules of the largest similarity to the reference; 0 without any."""
    prints = lambda x: m.fingerprints(x).select(F.col("words").alias("v"))
    return pairs.nearest(prints(gen), prints(ref)).agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("best")), F.sum("n")), F.lit(0.0)).alias("snn"))


def _told(mols: DataFrame) -> DataFrame:
    """(n, c, scaffold, fragments), staged: for each different string, null among them, how many molecules have it, its canonical
    string, its scaffold and its pieces, read once; null where it isn't a molecule."""

    def run(batches):
        for b in batches:
            read = [chem.read(x) for x in b.column("smiles").to_pylist()]
            each = lambda fn, kind: pa.array([None if x is None else fn(x) for x in read], kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column("n"), each(chem.write, pa.string()), each(m.scaffold, pa.string()), each(fr.pieces, pa.list_(pa.string()))], names=["n", "c", "scaffold", "fragments"])

    tasks = 4 * mols.sparkSession.sparkContext.defaultParallelism
    counted = mols.groupBy("smiles").agg(F.count("*").alias("n")).repartition(tasks, "smiles")
    return staged(counted.mapInArrow(run, "n long, c string, scaffold string, fragments array<string>"), "told")


def evaluation(gen: DataFrame, ref: DataFrame, similarities: bool = True) -> DataFrame:
    """(metric, value): validity, uniqueness and novelty, cosines of fragments and scaffolds, how many of the reference's scaffolds are
    kept, and, as their work grows with the square of the sets, if asked for: internal diversity, nearest similarity, and the
    discrepancies of the motif bundle."""
    own, known = _told(gen), _told(ref)
    fragment = lambda x: x.select("n", F.explode(F.array_distinct("fragments")).alias("fragment"))
    scaffold = lambda x: x.where("scaffold IS NOT NULL").select("n", "scaffold")
    some = lambda x: scaffold(x).select("scaffold").distinct()
    kept = some(known).join(some(own).withColumn("kept", F.lit(1)), "scaffold", "left")
    tables = [
        m.counted_quality(own.select("c", "n"), known),
        m.cosine(fragment(own), fragment(known), "fragment", "n").select(F.coalesce("cosine", F.lit(0.0)).alias("fragment_cosine")),
        m.cosine(scaffold(own), scaffold(known), "scaffold", "n").select(F.coalesce("cosine", F.lit(0.0)).alias("scaffold_cosine")),
        kept.agg(F.coalesce(F.try_divide(F.count("kept"), F.count("*")), F.lit(0.0)).alias("scaffold_retention")),
    ]
    if similarities:
        tables += [internal_diversity(gen).select(F.col("diversity").alias("internal_diversity")), snn(gen, ref), motif_bundle(gen, ref)]
    rows = [t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in t.columns])).alias("x")).select("x.*") for t in tables]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
