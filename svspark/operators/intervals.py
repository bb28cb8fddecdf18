"""Interval operators as DataFrame plans: islands, complement, sweep line, band and overlap joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(iv: DataFrame) -> DataFrame:
    """Overlapping or touching (chrom, s, e) flattened."""
    before = Window.partitionBy("chrom").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("chrom").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    opened = iv.select("chrom", "s", "e").distinct().withColumn("open", F.coalesce((F.col("s") > F.max("e").over(before)).cast("int"), F.lit(1)))
    return opened.withColumn("g", F.sum("open").over(run)).groupBy("chrom", "g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("g")


def complement(iv: DataFrame) -> DataFrame:
    """Gaps between islands, each ending one base before the next island."""
    w = Window.partitionBy("chrom").orderBy("s")
    return islands(iv).select("chrom", F.lag("e", 1, 0).over(w).alias("gs"), (F.col("s") - 1).alias("ge")).where("ge > gs").select("chrom", F.col("gs").alias("s"), F.col("ge").alias("e"))


def depth_runs(iv: DataFrame) -> DataFrame:
    """A4: sweep line; (chrom, s, e, depth) runs of positive depth. Steps are summed per position before they are ordered."""
    step = iv.select("chrom", F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit(1).alias("d")), F.struct(F.col("e").alias("p"), F.lit(-1).alias("d")))).alias("x"))
    at = step.groupBy("chrom", F.col("x.p").alias("s")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("chrom").orderBy("s")
    return at.select("chrom", "s", F.lead("s").over(w).alias("e"), F.sum("d").over(w).alias("depth")).where("depth > 0")


def gap_clusters(ev: DataFrame, gap: int, least: int) -> DataFrame:
    """Single linkage by gap, clusters of at least ``least``."""
    w = Window.partitionBy("chrom", "svt").orderBy("pos", "id")
    return (ev.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(w) > gap).cast("int"), F.lit(1))).withColumn("c", F.sum("new").over(w))
            .groupBy("chrom", "svt", "c").agg(F.count("*").alias("support"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).where(F.col("support") >= least).drop("c"))


def band_join(ev: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of one chrom and type with 0 <= b.pos - a.pos <= width, by bins; only one side is doubled."""
    left = ev.select("chrom", "svt", F.col("id").alias("a"), F.col("pos").alias("pa"), F.explode(F.array(F.expr(f"pos div {width}"), F.expr(f"pos div {width} + 1"))).alias("bin"))
    right = ev.select("chrom", "svt", F.col("id").alias("b"), F.col("pos").alias("pb"), F.expr(f"pos div {width}").alias("bin"))
    gap = F.col("pb") - F.col("pa")
    return left.join(right, ["chrom", "svt", "bin"]).where((gap <= width) & ((gap > 0) | ((gap == 0) & (F.col("a") < F.col("b"))))).select("a", "b", gap.alias("gap"))


def reciprocal_overlap(iv: DataFrame, r: float, bin_size: int) -> DataFrame:
    """Pairs with overlap / longer length >= r. Such pairs share the bin of the later start."""
    p = iv.select("id", "ln", "chrom", "t", "s", "e")
    left = p.withColumn("bin", F.explode(F.sequence(F.expr(f"s div {bin_size}"), F.expr(f"(e - 1) div {bin_size}"))))
    a = left.select("chrom", "t", "bin", *(F.col(c).alias(f"{c}_a") for c in ("id", "ln", "s", "e")))
    b = p.select("chrom", "t", F.expr(f"s div {bin_size}").alias("bin"), *(F.col(c).alias(f"{c}_b") for c in ("id", "ln", "s", "e")))
    over = F.least("e_a", "e_b") - F.col("s_b")
    longer = F.greatest(F.col("e_a") - F.col("s_a"), F.col("e_b") - F.col("s_b"))
    first = (F.col("s_a") < F.col("s_b")) | ((F.col("s_a") == F.col("s_b")) & (F.struct("id_a", "ln_a") < F.struct("id_b", "ln_b")))
    return a.join(b, ["chrom", "t", "bin"]).where(first & (over > 0) & (over >= r * longer)).select("id_a", "ln_a", "id_b", "ln_b", over.alias("overlap"))


def spanning(i: DataFrame) -> DataFrame:
    """chrom, bp, spanning: intervals (s <= bp < e) over the breakpoint 50 after the start of every interval, where there are any."""
    b = i.select("chrom", (F.col("s") + 50).alias("bp")).distinct().withColumn("bin", F.expr("bp div 1000"))
    near = i.select("chrom", "s", "e", F.explode(F.sequence(F.expr("s div 1000"), F.expr("(e - 1) div 1000"))).alias("bin"))
    return b.join(near, ["chrom", "bin"]).where("s <= bp and bp < e").groupBy("chrom", "bp").agg(F.count("*").alias("spanning"))


def range_of(x, borders: list, first: int = 0):
    """Number of the sorted ``borders`` below x, by halving; nulls fall in the last range."""
    if not borders:
        return F.lit(first)
    mid = len(borders) // 2
    return F.when(x <= borders[mid], range_of(x, borders[:mid], first)).otherwise(range_of(x, borders[mid + 1 :], first + mid + 1))
