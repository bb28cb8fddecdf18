"""Junctions of reads: where alignments break off, and the events two junctions of a read support."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TOKENS = "regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1)"
_OPS = "regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1)"
_STEP = f"zip_with({_TOKENS}, {_OPS}, (n, o) -> struct(cast(n as bigint) AS n, o AS o))"


def junctions(reads: DataFrame, gap: int, clip: int) -> DataFrame:
    """reads(read, chrom, pos, reverse, qual, cigar) to (read, chrom, refpos, seqpos, forward, left, qual).

    Deletions and insertions above ``gap`` give their two edges, clips above
    ``clip`` one; left: the clipped part lies left. Places in reverse reads are
    counted from the other end. One walk over the operations, no shuffle.
    """
    put = "if({0}, concat(s.j, array(struct({1} AS refpos, {2} AS seqpos, {3} AS `left`))), s.j)"
    ref, seq = "s.r + if(x.o IN ('M', '=', 'X', 'D', 'N'), x.n, 0L)", "s.q + if(x.o IN ('M', '=', 'X', 'I', 'S', 'H'), x.n, 0L)"
    edges = f"if(x.o IN ('D', 'I') AND x.n > {gap}, concat(s.j, array(struct(s.r AS refpos, s.q AS seqpos, false AS `left`), struct({ref} AS refpos, {seq} AS seqpos, true AS `left`))), {{}})"
    clips = put.format(f"x.o IN ('S', 'H') AND x.n > {clip}", "s.r", "s.q + if(s.q = 0, x.n, 0L)", "s.q = 0")
    start = "struct(cast(pos as bigint) AS r, 0L AS q, cast(array() as array<struct<refpos:bigint,seqpos:bigint,left:boolean>>) AS j)"
    done = "s -> transform(s.j, j -> struct(j.refpos AS refpos, j.seqpos AS seqpos, j.`left` AS `left`, s.q AS n))"
    walk = F.expr(f"aggregate({_STEP}, {start}, (s, x) -> struct({ref} AS r, {seq} AS q, {edges.format(clips)} AS j), {done})")
    # The outer form draws no filter from the walk, which would take it twice.
    at = reads.select("read", "chrom", "reverse", "qual", F.explode_outer(walk).alias("j")).where("j.seqpos <= j.n")
    return at.select("read", "chrom", "j.refpos", F.when(F.col("reverse"), F.col("j.n") - F.col("j.seqpos")).otherwise(F.col("j.seqpos")).alias("seqpos"), (~F.col("reverse")).alias("forward"), "j.left", "qual")


def break_places(reads: DataFrame, gap: int, clip: int) -> DataFrame:
    """(read, chrom, place): both ends of deletions above ``gap``, and clips above ``clip``, inside the chromosome (reads carry its length as ``size``)."""
    ref = "s.r + if(x.o IN ('M', '=', 'X', 'D', 'N'), x.n, 0L)"
    put = f"CASE WHEN x.o = 'D' AND x.n > {gap} THEN concat(s.p, array(s.r, {ref})) WHEN x.o IN ('S', 'H') AND x.n > {clip} THEN concat(s.p, array(s.r)) ELSE s.p END"
    walk = F.expr(f"aggregate({_STEP}, struct(cast(pos as bigint) AS r, cast(array() as array<bigint>) AS p), (s, x) -> struct({ref} AS r, {put} AS p), s -> s.p)")
    return reads.select("read", "chrom", "size", F.explode_outer(walk).alias("place")).where("place >= 0 and place < size").drop("size")




def events(j: DataFrame, gap: int, near: int) -> DataFrame:
    """(read, cls, chrom, pos, pos2, seqpos, qual, length) from pairs of junctions of one read on one chromosome.

    Junctions are ordered by place in the read; pairs farther apart there than
    ``near`` count for insertions alone. Of deletions and insertions the first
    partner of a junction counts.
    """
    ordered = Window.partitionBy("read").orderBy("seqpos", "chrom", "refpos", "left", "forward", "qual")
    side = lambda x: F.struct(*(F.col(c) for c in ("k", "chrom", "refpos", "seqpos", "forward", "left", "qual"))).alias(x)
    k = j.withColumn("k", F.row_number().over(ordered))
    p = k.select("read", side("a")).join(k.select("read", side("b")), "read").where("a.k < b.k and a.chrom = b.chrom")
    span, step = F.col("b.refpos") - F.col("a.refpos"), F.col("b.seqpos") - F.col("a.seqpos")
    same, sides = F.col("a.forward") == F.col("b.forward"), F.col("a.left") != F.col("b.left")
    rising, left = span >= 0, F.col("a.left")
    outward = F.col("a.forward") != left  # the first junction looks along the read
    drift = F.when(outward, step).otherwise(-step)
    lost = F.when(rising != left, F.abs(span) - drift)
    gained = F.when(outward, step - F.when(F.col("a.forward"), span).otherwise(-span))
    dele = same & sides & (step <= near) & (lost > gap)
    dup = same & sides & (step <= near) & (F.abs(span) > gap) & (rising == left)
    inv = ~same & ~sides & (step <= near) & (F.abs(span) > gap)
    ins = same & sides & (F.abs(span) < near) & (gained > gap) & (gained <= F.greatest("a.seqpos", "b.seqpos"))
    kinds = F.array_compact(F.array(F.when(dele, F.struct(F.lit(2).alias("cls"), step.alias("length"))), F.when(dup, F.struct(F.lit(3).alias("cls"), step.alias("length"))),
                                    F.when(inv, F.struct(F.when(left, 1).otherwise(0).alias("cls"), step.alias("length"))), F.when(ins, F.struct(F.lit(4).alias("cls"), gained.alias("length")))))
    found = p.withColumn("e", F.explode(kinds)).withColumn("first", F.row_number().over(Window.partitionBy("read", "e.cls", "a.k").orderBy("b.k")))
    kept = found.where((F.col("first") == 1) | ~F.col("e.cls").isin(2, 4))
    return kept.select("read", "e.cls", F.col("a.chrom").alias("chrom"), F.least("a.refpos", "b.refpos").alias("pos"), F.greatest("a.refpos", "b.refpos").alias("pos2"),
                       F.col("a.seqpos").alias("seqpos"), F.expr("cast((a.qual + b.qual) div 2 as bigint)").alias("qual"), F.col("e.length").alias("length"))
