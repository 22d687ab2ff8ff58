"""Distances between histograms and sets as Column expressions; all stay in generated JVM code or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pad(a: Column, b: Column, f) -> Column:
    zero = F.lit(0.0)
    return F.zip_with(a, b, lambda x, y: f(F.coalesce(x, zero), F.coalesce(y, zero)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def gaussian(a: Column, b: Column, sigma: float = 1.0) -> Column:
    return F.exp(-_sum(_pad(a, b, lambda x, y: (x - y) * (x - y))) / (2 * sigma**2))


def gaussian_tv(a: Column, b: Column, sigma: float = 1.0) -> Column:
    tv = _sum(_pad(a, b, lambda x, y: F.abs(x - y))) / 2
    return F.exp(-tv * tv / (2 * sigma**2))


def emd(a: Column, b: Column, scaling: float = 1.0) -> Column:
    """Earth mover's distance on a line: the sum of absolute differences of the cumulated histograms."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda s, d: F.struct((s["run"] + d).alias("run"), (s["sum"] + F.abs(s["run"] + d)).alias("sum"))
    return F.aggregate(_pad(a, b, lambda x, y: x - y), start, step, lambda s: s["sum"]) / scaling


def tanimoto(a: Column, b: Column) -> Column:
    """Similarity of two bit sets held as arrays of bigint."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, x: s + x)
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def pad_tokens(tokens: Column, length: int, pad: int, eos: int) -> Column:
    """Tokens cut or padded to a length; a cut sequence ends in eos."""
    cut = F.concat(F.slice(tokens, 1, length - 1), F.array(F.lit(eos)))
    return F.when(F.size(tokens) > length, cut).otherwise(F.concat(tokens, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(tokens)))))


def without_overlaps(groups: Column) -> Column:
    """Of (priority, size, name, atoms), taken by priority, size and name from the highest, those that share no atom with one taken before."""
    ranked = F.reverse(F.array_sort(groups))
    start = F.slice(ranked, 1, 0)
    return F.aggregate(ranked, start, lambda kept, g: F.when(F.exists(kept, lambda k: F.arrays_overlap(k["atoms"], g["atoms"])), kept).otherwise(F.array_append(kept, g)))
