"""Scalar rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# SAM flag bits, and the bits that each stage drops.
PAIRED, UNMAP, MUNMAP, REVERSE, MREVERSE, SECONDARY, QCFAIL, DUP, SUPPLEMENTARY = 0x1, 0x4, 0x8, 0x10, 0x20, 0x100, 0x200, 0x400, 0x800
DROPPED = {
    "scan": QCFAIL | DUP | UNMAP,
    "assembly": QCFAIL | DUP | UNMAP | SECONDARY | SUPPLEMENTARY,
    "genotyping": QCFAIL | DUP | UNMAP | SECONDARY | SUPPLEMENTARY | MUNMAP,
    "long_coverage": SECONDARY | QCFAIL | DUP | UNMAP,
}
SMALLEST_GL = -1000.0


def passes(flag: Column, stage: str) -> Column:
    """None of the bits that the stage drops is set."""
    return flag.bitwiseAND(DROPPED[stage]) == 0


def pair_type(flag: Column, pos: Column, mate: Column) -> Column:
    """0 and 1 for pairs of one strand (forward, reverse), 2 where the forward read lies left, else 3. Equal places are 3."""
    back, mback = flag.bitwiseAND(REVERSE) != 0, flag.bitwiseAND(MREVERSE) != 0
    return F.when(~back & ~mback, 0).when(back & mback, 1).when(~back & (pos < mate), 2).when(back & (pos > mate), 2).otherwise(3)


def site_filter(pe: Column, mapq: Column, sr: Column, srmapq: Column, same: Column) -> Column:
    """Enough pairs or enough split reads of mapping quality 20; five instead of three across chromosomes."""
    least = F.when(same, 3).otherwise(5)
    return F.when(((pe >= least) & (mapq >= 20)) | ((sr >= least) & (srmapq >= 20)), "PASS").otherwise("LowQual")


def retain_allele(supp: Column, listed: Column, breakend: Column, precise: Column, sr: Column, srmapq: Column, srq: Column, ce: Column, alt: Column, recurrent: int = 2) -> Column:
    """Recurrent or listed alleles stay, breakends and imprecise ones by two samples, others by their split reads, else by alternative support."""
    split = (sr >= 3) & (srmapq >= 20) & (srq >= 0.8) & (ce >= 1.0)
    return F.when((supp >= recurrent) | listed, True).when(breakend | ~precise, supp >= 2).when((srq > 0) | (sr > 0), split).otherwise(alt >= 3)


def keep_cnv(loss: Column, gain: Column, precise_loss: Column, precise_gain: Column, size: Column, score: Column, uniq: Column, recurrent: int = 2, large: int = 10_000, quality: int = 15, least_uniq: float = 0.5, gain_uniq: float = 0.7) -> Column:
    """Losses by recurrence, breakpoint, size or score with unique sequence; gains by breakpoint, or recurrence with unique sequence."""
    return (loss >= recurrent) | precise_loss | (size >= large) | ((score >= quality) & (uniq >= least_uniq)) | precise_gain | ((gain >= recurrent) & (uniq >= gain_uniq))


def rounded_depth(rc: Column, left: Column, right: Column) -> Column:
    """round(2 * rc / (left + right)), -1 without flanks."""
    return F.when(left + right > 0, F.round(F.lit(2.0) * rc / F.nullif(left + right, F.lit(0))).cast("long")).otherwise(F.lit(-1).cast("long"))


def entropy(s: Column) -> Column:
    """bits per symbol; 0 for the empty text."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.length(s)
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / F.nullif(n, F.lit(0))
    return F.when(n == 0, 0.0).otherwise(-F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c))))


def min_rotation(s: Column) -> Column:
    """least of all rotations."""
    n = F.length(s)
    turned = lambda i: F.concat(F.substring(s, i + 1, n), F.substring(s, F.lit(1), i))
    return F.when(n < 2, s).otherwise(F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), turned)))


def reverse_complement_in_place(s: Column) -> Column:
    """F1 with its quirk: where the letter from the other end is not one of ACGTN, the own letter stays."""
    up = F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    n = F.length(up)

    def at(i):
        other = F.substring(up, n - i, F.lit(1))
        return F.when(F.instr(F.lit("ACGTN"), other) > 0, F.translate(other, "ACGT", "TGCA")).otherwise(F.substring(up, i + 1, F.lit(1)))

    return F.when(n == 0, "").otherwise(F.concat_ws("", F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)))


def error_probability(q: Column) -> Column:
    """10 ** (-q / 10)."""
    return F.pow(F.lit(10.0), q / -10.0)


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    """F23."""
    z = (x - mean) / sd
    return F.exp(-0.5 * z * z) / (sd * F.lit(2.5066282746310002))


# Coefficients of the rational Chebyshev fit of erfc, of relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def chi_square_tail(x: Column) -> Column:
    """upper tail at one degree of freedom, erfc(sqrt(x / 2))."""
    z = F.sqrt(x / 2)
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(-z * z + poly)


def genotype(ref: Column, alt: Column) -> Column:
    """G1: struct(gt, gq, pl_rr, pl_ra, pl_aa) from the mapping qualities of reads for and against; ./. and 0 without reads or without a difference."""
    log = lambda x: F.when(x > 0, F.log10(F.greatest(x, F.lit(1e-300)))).otherwise(-1e5)
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, q: s + f(error_probability(q)))
    wrong, right = (lambda p: log(p)), (lambda p: log(1 - p))
    n = F.size(ref) + F.size(alt)
    g = F.array(total(ref, wrong) + total(alt, right), -n * F.lit(0.3010299956639812), total(ref, right) + total(alt, wrong))

    def told(x):
        best = F.array_max(x)
        pl = F.transform(x, lambda v: F.round(-10 * F.greatest(v - best, F.lit(SMALLEST_GL))).cast("long"))
        which = F.when(x[2] >= best, "0/0").when(x[1] >= best, "0/1").otherwise("1/1")

        def rest(p):
            odds = F.aggregate(p, F.lit(0.0), lambda s, v: s + error_probability(v))
            quality = F.round(-10 * F.greatest(log(1 - 1 / odds), F.lit(SMALLEST_GL))).cast("long")
            seen = (n > 0) & (p[0] + p[1] + p[2] > 0)
            return F.struct(F.when(seen, which).otherwise("./.").alias("gt"), F.when(seen, quality).otherwise(F.lit(0).cast("long")).alias("gq"), p[2].alias("pl_rr"), p[1].alias("pl_ra"), p[0].alias("pl_aa"))

        return F.transform(F.array(pl), rest)[0]

    return F.transform(F.array(g), told)[0]
