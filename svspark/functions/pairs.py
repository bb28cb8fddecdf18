"""Rules of read pairs, alleles, copy numbers and methylation as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from svspark.functions.scalars import REVERSE, pair_type

# Classes 0 and 1 inversions, 2 deletion, 3 duplication, 4 insertion, 5 to 8 breakends, 9 copy number.
BREAKEND, INSERTION, COPY_NUMBER = 5, 4, 9
# Least sizes by class, short and long reads.
SHORT_SIZES = {0: 300, 1: 300, 2: 300, 3: 100}
LONG_SIZE = 15
# Least mapping qualities.
MIN_QUALITY = {"discovery": 1, "breakend": 20, "genotyping": 5, "copy_number": 10}


def quality_enough(mapq: Column, cls: Column) -> Column:
    """Discovery threshold, the higher one for breakends."""
    return mapq >= F.when(cls.between(BREAKEND, BREAKEND + 3), MIN_QUALITY["breakend"]).otherwise(MIN_QUALITY["discovery"])


def pair_class(flag: Column, tid: Column, mtid: Column, pos: Column, mpos: Column, isize: Column, cutoff) -> Column:
    """The class a pair supports, -1 for none.

    Across chromosomes 5 and 6 for equal strands, else 7 where the read on the
    later chromosome is the forward one and 8 where not. On one chromosome
    equal places give none, deletions reach the cutoff, duplications 100 bp.
    """
    turn = pair_type(flag, pos, mpos)
    forward = flag.bitwiseAND(REVERSE) == 0
    across = F.when(turn < 2, turn + BREAKEND).otherwise(F.when((tid > mtid) == forward, BREAKEND + 2).otherwise(BREAKEND + 3))
    none = (pos == mpos) | ((turn == 2) & (F.abs(isize) < cutoff)) | ((turn == 3) & (F.abs(pos - mpos) < 100))
    return F.when(tid != mtid, across).when(none, -1).otherwise(turn)


def size_enough(s: Column, e: Column, cls: Column) -> Column:
    """P5, short reads."""
    return reduce(lambda c, kv: c.when(cls == kv[0], e - s >= kv[1]), SHORT_SIZES.items(), F.when(F.lit(False), False)).otherwise(True)


def size_enough_long(s: Column, e: Column, cls: Column, inserted: Column) -> Column:
    """P6, long reads; insertions by their inserted length."""
    return F.when(cls < INSERTION, e - s >= LONG_SIZE).when(cls == INSERTION, inserted >= LONG_SIZE).otherwise(True)


def pairs_agree(cls: Column, a: dict, b: dict) -> Column:
    """Whether two pairs can support one event; a has the smaller lower end. Both are dicts of low, high, length, insert.

    The gap at the lower ends stays within the insert size of the pair that
    faces outward there, the gap at the upper ends within that of a or b,
    whichever end lies left. Pairs of a deletion overlap.
    """
    turn = cls % 5
    lower = F.when(turn.isin(0, 2), a["insert"]).otherwise(b["insert"])
    ahead = b["high"] < a["high"]
    apart = F.greatest(a["high"], b["high"]) + F.when(ahead, a["length"]).otherwise(b["length"]) - F.least(a["high"], b["high"])
    upper = F.when(ahead == turn.isin(1, 2), a["insert"]).otherwise(b["insert"])
    fits = (b["low"] + b["length"] - a["low"] <= lower) & (apart <= upper)
    return F.when(cls.isin(INSERTION, COPY_NUMBER), True).when(cls == 2, fits & (a["high"] >= b["low"]) & (b["high"] >= a["low"])).otherwise(fits)


# Ambiguity letters of both cases and the base each stands for.
AMBIGUOUS, BASE = "URYSWKMBDHVuryswkmbdhv", "TACCAGACAAATACCAGACAAA"


def plain_alt(alt: Column) -> Column:
    """ambiguity letters of ALT as one base, other letters as N. A symbolic name stays; from a bracket on all stays up to the end of the next symbolic name."""
    runs = F.regexp_extract_all(alt, F.lit(r"([\[\]][^<]*|<[^>\[\]]*>?|[^<\[\]]+)"), F.lit(1))
    plain = lambda x: F.regexp_replace(F.translate(x, AMBIGUOUS, BASE), "[^ACGTNacgtn>,]", "N")
    return F.concat_ws("", F.transform(runs, lambda x: F.when(F.substring(x, 1, 1).isin("<", "[", "]"), x).otherwise(plain(x))))


# Marks of subtypes 1 to 7, the first that occurs counts.
SUBTYPES = ("ME:ALU", "ME:LINE1", "ME:SVA", "NUMT", "LTR", "HERVK", "TR")


def subtype(alt: Column) -> Column:
    """code of the first mark that occurs, 0 without."""
    return F.coalesce(*(F.when(F.contains(alt, F.lit(m)), k) for k, m in enumerate(SUBTYPES, 1)), F.lit(0))


# Connection types in the order of their codes.
CONNECTIONS = ("3to3", "5to5", "3to5", "5to3")


def decode_class(svtype: Column, ct: Column) -> Column:
    """class of SVTYPE and CT; without CT the class other callers' types stand for; -1 for unknown ones."""
    code = F.coalesce(*(F.when(ct == c, k) for k, c in enumerate(CONNECTIONS)))
    told = F.when(svtype == "BND", F.coalesce(code + BREAKEND, F.lit(-1))).when(svtype == "CNV", COPY_NUMBER).otherwise(F.coalesce(code, F.lit(INSERTION)))
    known = F.when(svtype == "DEL", 2).when(svtype == "INS", INSERTION).when(svtype.startswith("DUP"), 3).when(svtype.startswith("INV"), 0).when(svtype == "CNV", COPY_NUMBER).when(svtype.isin("BND", "TRA"), BREAKEND)
    return F.when(ct.isNotNull(), told).otherwise(F.coalesce(known, F.lit(-1)))


# Endings of haplotype names; the first that fits goes, never the whole name.
HAPLOTYPES = (".hap1", ".hap2", ".hapA", ".hapB", ".h1", ".h2", ".mat", ".pat", ".maternal", ".paternal", ".1", ".2")


def without_haplotype(name: Column) -> Column:
    """a sample name less its haplotype ending."""
    return F.regexp_replace(name, "(?s)^(.+)(?:" + "|".join(h.replace(".", r"\.") for h in HAPLOTYPES) + ")$", "$1")


def common_name(a: Column, b: Column) -> Column:
    """the common beginning of two names less trailing ``._-``; where none is left, the first less its ending."""
    n = F.least(F.length(a), F.length(b))
    same = lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)
    k = F.size(F.filter(F.sequence(F.lit(0), n), same)) - 1
    head = F.regexp_replace(F.substring(a, F.lit(1), k), "[._-]+$", "")
    return F.when(head != "", head).otherwise(without_haplotype(a))


def expected_copies(purity: Column, ploidy: Column, control: Column) -> Column:
    """copies a mixture of tumor and control shows; purity between 0.1 and 1."""
    p = F.least(F.greatest(purity, F.lit(0.1)), F.lit(1.0))
    return p * ploidy + (1 - p) * control


def window_copies(covered: Column, expected: Column, purity: Column, ploidy: Column, control: Column, haploid: Column) -> Column:
    """struct(log_ratio, cn); haploid chromosomes have one copy less. Without expectation the ploidy and a ratio of 0."""
    p = F.least(F.greatest(purity, F.lit(0.1)), F.lit(1.0))
    less = F.when(haploid, 1).otherwise(0)
    cn = (expected_copies(purity, ploidy, control) * covered / F.nullif(expected, F.lit(0.0)) - (control - less) * (1 - p)) / p
    seen = expected > 0
    return F.struct(F.when(seen, F.log2((covered + 1) / (expected + 1))).otherwise(0.0).alias("log_ratio"), F.when(seen, cn).otherwise((ploidy - less).cast("double")).alias("cn"))


def counts_bases(paired: Column, read_length: Column) -> Column:
    """Bases are counted in single-end libraries of reads from 500 bp on, else fragments."""
    return ~paired & (read_length >= 500)


def percentage(part: Column, total: Column) -> Column:
    """Rounded percentage, -1 without any."""
    return F.when(total > 0, F.floor((200 * part + total) / F.nullif(2 * total, F.lit(0)))).otherwise(-1).cast("long")


def posterior_quality(pl: Column, freq: Column) -> Column:
    """Quality, 0 to 99, of the likeliest genotype (first least PL) once genotype frequencies weigh the likelihoods."""
    weight = F.zip_with(pl, freq, lambda x, f: f * F.pow(F.lit(10.0), x / -10.0))
    total = F.aggregate(weight, F.lit(0.0), lambda s, x: s + x)
    best = F.get(weight, F.array_position(pl, F.array_min(pl)).cast("int") - 1)
    rest = 1 - best / F.nullif(total, F.lit(0.0))
    return F.when(total <= 0, 0.0).when(rest <= 0, 99.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(99.0), -10 * F.log10(rest))))


def tandem_period(seq: Column, longest: int = 100) -> Column:
    """smallest period at which 85 % of the letters repeat, 0 without one or below 10 letters."""
    n = F.length(seq)
    agree = lambda p: F.size(F.filter(F.sequence(F.lit(1), n - p), lambda i: F.substring(seq, i, F.lit(1)) == F.substring(seq, i + p, F.lit(1))))
    fits = F.filter(F.sequence(F.lit(1), F.least(F.lit(longest), F.floor(n / 2).cast("int"))), lambda p: 20 * agree(p) >= 17 * (n - p))
    return F.when(n < 10, 0).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit(0)))


def mates(chrom: Column, pos: Column, base: Column, chrom2: Column, pos2: Column, base2: Column, ct: Column, name: Column) -> Column:
    """The two records (chrom, pos, id, mate, ref, alt, ct) of a breakend call; the second is seen from the other side."""
    back = F.when(ct == "3to5", "5to3").when(ct == "5to3", "3to5").otherwise(ct)

    def record(c, p, ref, c2, p2, turn, own, mate):
        at = F.concat(c2.cast("string"), F.lit(":"), p2.cast("string"))
        bracket = F.when(turn.startswith("3") == turn.endswith("3"), F.when(turn.endswith("3"), "]").otherwise("[")).otherwise(F.when(turn == "3to5", "[").otherwise("]"))
        tag = F.concat(bracket, at, bracket)
        alt = F.when(turn.startswith("3"), F.concat(ref, tag)).otherwise(F.concat(tag, ref))
        return F.struct(c.alias("chrom"), p.alias("pos"), F.concat(name, F.lit(own)).alias("id"), F.concat(name, F.lit(mate)).alias("mate"), ref.alias("ref"), alt.alias("alt"), turn.alias("ct"))

    return F.array(record(chrom, pos, base, chrom2, pos2, ct, "_2nd", "_1st"), record(chrom2, pos2, base2, chrom, pos, back, "_1st", "_2nd"))
