"""Sites across files: band joins, components, collapse of redundant records, size groups, reference letters."""

from __future__ import annotations

import tempfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRETCH = 100


def _lineage_cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the folder of spark.checkpoint.dir; only in local mode a temporary one stands in."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        told = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not told and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="svspark-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges(a, b); component is the smallest node reachable.

    Labels spread to neighbours and then jump to their label's label, so the
    rounds grow with the logarithm of a chain; no label reaches the driver.
    """
    e = edges.select("a", "b").where("a <> b")
    both = _lineage_cut(e.union(e.select("b", "a")).distinct())
    now = _lineage_cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = now.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        jump = now.select(F.col("node").alias("c"), F.col("component").alias("j"))
        new = _lineage_cut(step.join(jump, "c", "left").select("node", "old", F.least("c", F.coalesce("j", "c")).alias("component")))
        now = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            return now


def band_components(rows: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """(node, component) of rows(id, keys, at) linked where they are equal in ``keys`` with ``at`` at most ``width`` apart, without their pairs.

    In order of ``at`` a step above ``width`` opens a run; a run of two places or
    ids is one component, named by its smallest id. Only ids in several runs
    need rounds, over their runs' names. A task orders the rows of one of ``keys``.
    """
    w, run = Window.partitionBy(*keys).orderBy(at), Window.partitionBy(*keys, "_run")
    r = rows.select("id", *keys, at).dropna()
    r = r.withColumn("_open", F.coalesce((F.col(at) - F.lag(at).over(w) > width).cast("long"), F.lit(0))).withColumn("_run", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    name = F.min("id").over(run)
    r = r.select("id", name.alias("m"), ((name < F.max("id").over(run)) | (F.min(at).over(run) < F.max(at).over(run))).alias("two")).where("two")
    of = _lineage_cut(r.groupBy("id").agg(F.min("m").alias("component"), F.max("m").alias("z")))
    several, of = of.where("component <> z").select("id", F.col("component").alias("a")), of.select(F.col("id").alias("node"), "component")
    if several.isEmpty():
        return of
    more = r.join(several, "id").select("a", F.col("m").alias("b"))
    name = components(more).select(F.col("node").alias("component"), F.col("component").alias("c"))
    return of.join(name, "component", "left").select("node", F.coalesce("c", "component").alias("component"))


def by_band(rows: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """Pairs (structs a, b) of rows equal in ``keys`` with |a.at - b.at| <= width and a before b by (at, id); only one side is doubled."""
    side = lambda x, extra: rows.select(*keys, F.struct(*rows.columns).alias(x), extra.alias("bin"))
    own = F.expr(f"{at} div {width + 1}")
    pairs = side("a", F.explode(F.array(own, own + 1))).join(side("b", own), [*keys, "bin"])
    gap = F.col(f"b.{at}") - F.col(f"a.{at}")
    return pairs.where((gap <= width) & ((gap > 0) | ((gap == 0) & (F.col("a.id") < F.col("b.id"))))).select("a", "b")


def size_groups(sites: DataFrame) -> DataFrame:
    """sites(component, id, size) plus grp, numbered from 0 by size: a step above 50 and a quarter of the larger size opens a group. Sites without size come last, as in SQL."""
    w = Window.partitionBy("component").orderBy(F.asc_nulls_last("size"), F.asc_nulls_last("id"))
    wide = F.greatest(F.lit(50), F.floor(F.lit(0.25) * F.greatest(F.col("size"), F.lit(1))))
    opened = F.coalesce((F.col("size") - F.lag("size").over(w) > wide).cast("int"), F.lit(0))
    return sites.withColumn("o", opened).withColumn("grp", F.sum("o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("o")


def overlap_share(a: str, b: str) -> Column:
    """Overlap of two spans by the longer one."""
    longer = F.greatest(F.col(f"{a}.e") - F.col(f"{a}.s"), F.col(f"{b}.e") - F.col(f"{b}.s"))
    return F.greatest(F.least(f"{a}.e", f"{b}.e") - F.greatest(f"{a}.s", f"{b}.s"), F.lit(0)) / F.nullif(longer, F.lit(0))


def sites_match(a: str = "a", b: str = "b", offset: int = 1000, overlap: float = 0.8, part: float = 0.5, tr_offset: int = 200, tr_part: float = 0.25, mei_offset: int = 50, mei_ratio: float = 0.85) -> Column:
    """C6 without sequences: whether two sites (structs cls, chrom2, s, e, pos2, size, hom, sub, strand, period) of one class are one.

    Mobile elements (subtypes 1 to 6) agree in strand, place and size, repeats
    (7) in place by size and period, others in place by size and in overlap.
    """
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    gap, hom = F.abs(x("s") - y("s")), F.greatest(x("hom"), y("hom"))
    small, large = F.least(x("size"), y("size")), F.greatest(x("size"), y("size"))
    ratio = F.when(large > 0, small / F.nullif(large, F.lit(0))).otherwise(1.0)
    sub = F.when((x("sub") > 0) & (y("sub") > 0), F.least(x("sub"), y("sub"))).otherwise(F.greatest(x("sub"), y("sub")))
    far = F.greatest(F.lit(offset), hom)
    breakend = (x("chrom2") == y("chrom2")) & (gap <= far) & (F.abs(x("pos2") - y("pos2")) <= far)
    turned = (x("strand") >= 0) & (y("strand") >= 0) & (x("strand") != y("strand"))
    mobile = ~turned & (gap <= F.greatest(F.lit(mei_offset), hom + 10)) & (ratio >= mei_ratio)
    repeat = gap <= F.greatest(F.lit(tr_offset), F.floor(tr_part * large), 2 * x("period"), 2 * y("period"))
    wide = F.greatest(F.least(F.lit(offset), F.floor(part * large)), F.lit(50), hom)
    other = (gap <= wide) & (F.coalesce(overlap_share(a, b), F.lit(0.0)) >= overlap) & ((x("cls") != 4) | (ratio >= 0.7))
    return F.when(x("cls").between(5, 8), breakend).when(sub.between(1, 6), mobile).when(sub == 7, repeat).otherwise(other)


def near_sites(sites: DataFrame, distance: int, ratio: float) -> DataFrame:
    """Pairs (a, b) of ids of sites(id, chrom, svt, s, e, size) that may be one: starts and, save for insertions, ends within ``distance``, sizes by ``ratio``; no breakends."""
    p = by_band(sites.where("svt <> 'BND'"), ["chrom", "svt"], "s", distance)
    small, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    fits = ((F.col("a.svt") == "INS") | (F.abs(F.col("a.e") - F.col("b.e")) <= distance)) & ((large <= 0) | (small >= ratio * large))
    return p.where(fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def collapsed(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """sites(id, s, precise, called, ac, qual) less redundant ones; edges(a, b) link sites that carry the same genotypes.

    In order of (s, id) a site meets the linked ones before it that still stand:
    the worse of the two (precise, called, ac, qual; the later one on ties)
    goes. Decisions need only the edges of one component; Python holds one, with the small ones beside it in a batch.
    """
    rank = ["precise", "called", "ac", "qual"]
    of = components(edges).withColumnRenamed("node", "a")
    node = sites.select("id", F.struct("s", "id", *rank).alias("x"))
    e = edges.join(of, "a").join(node.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").join(node.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b")
    flat = e.select("component", *(F.col(f"x{k}.{c}").alias(f"{c}_{k}") for k in "ab" for c in ("s", "id", *rank)))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        info, links = {}, {}
        for r in g.to_dict("records"):
            ends = []
            for k in "ab":
                key = (r[f"s_{k}"], r[f"id_{k}"])
                info[key] = tuple(r[f"{c}_{k}"] for c in rank)
                ends.append(key)
            links.setdefault(max(ends), []).append(min(ends))
        gone = set()
        for key in sorted(links):
            for old in sorted(links[key]):
                if old in gone:
                    continue
                if info[key] > info[old]:
                    gone.add(old)
                else:
                    gone.add(key)
                    break
        return pd.DataFrame({"id": [k[1] for k in gone]}, dtype="int64")

    def run(frames):
        held: list[pd.DataFrame] = []
        for f in frames:
            if len(f):
                open_ = f["component"] == f["component"].iloc[-1]
                if not open_.all() or (held and held[-1]["component"].iloc[-1] != f["component"].iloc[-1]):
                    yield fold(pd.concat([*held, f[~open_]]))
                    held = []
                held.append(f[open_])
        if held:
            yield fold(pd.concat(held))

    n = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gone = flat.repartition(n, "component").sortWithinPartitions("component").mapInPandas(run, "id long")
    return sites.join(gone, "id", "left_anti")


def collapsed_near(sites: DataFrame, distance: int, ratio: float) -> DataFrame:
    """C8 over the links of ``near_sites``: as ``collapsed`` of these, without their pairs and components.

    Sites of one chrom and svt pass through Python in order of (s, id), which
    holds those within ``distance`` that still stand. Bins of places whose first
    site lies farther than ``distance`` behind all before begin a new stretch,
    which no link crosses, so a chromosome is dealt over tasks.
    """
    rank = ["precise", "called", "ac", "qual"]
    k = sites.where("svt <> 'BND' and s is not null and chrom is not null").withColumn("bin", F.floor(F.col("s") / F.lit(STRETCH * (distance + 1))))
    w = Window.partitionBy("chrom", "svt").orderBy("bin")
    ends = k.groupBy("chrom", "svt", "bin").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    opened = F.coalesce((F.col("lo") - F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) > distance).cast("long"), F.lit(0))
    of = ends.withColumn("o", opened).select("chrom", "svt", "bin", F.sum("o").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    number = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in rank]
    flat = k.join(of, ["chrom", "svt", "bin"]).select("chrom", "svt", "stretch", "s", "id", "e", "size", *number)
    names = flat.columns

    def fits(x, y):
        if x[1] != "INS" and (x[5] is None or y[5] is None or abs(x[5] - y[5]) > distance):
            return False
        sizes = [z for z in (x[6], y[6]) if z is not None]
        return bool(sizes) and (max(sizes) <= 0 or min(sizes) >= ratio * max(sizes))

    def run(batches):
        key, stand = None, []
        for b in batches:
            gone = []
            for x in zip(*(b.column(c).to_pylist() for c in names)):
                if x[:3] != key:
                    key, stand = x[:3], []
                stand, keep = [y for y in stand if x[3] - y[3] <= distance], True
                left = []
                for i, y in enumerate(stand):
                    if y[4] != x[4] and fits(y, x):
                        if x[7:] > y[7:]:
                            gone.append(y[4])
                            continue
                        gone.append(x[4])
                        left += stand[i:]
                        keep = False
                        break
                    left.append(y)
                stand = left
                if keep:
                    stand.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(gone, b.schema.field("id").type)], ["id"])

    gone = flat.repartition("chrom", "svt", "stretch").sortWithinPartitions("chrom", "svt", "stretch", "s", "id").mapInArrow(run, flat.select("id").schema)
    return sites.join(gone.distinct(), "id", "left_anti")


def letters_at(places: DataFrame, reference: DataFrame, line: int) -> DataFrame:
    """places(chrom, pos, ...) plus base, from reference(chrom, line, seq) in lines of ``line`` letters; positions count from 1, N where there is none."""
    got = places.withColumn("line", F.expr(f"(pos - 1) div {line}")).join(reference, ["chrom", "line"], "left")
    letter = F.substring(F.col("seq"), ((F.col("pos") - 1) % line + 1).cast("int"), F.lit(1))
    return got.withColumn("base", F.when(F.coalesce(F.length(letter), F.lit(0)) > 0, letter).otherwise("N")).drop("line", "seq")


def least_length(lengths: DataFrame, share: float) -> DataFrame:
    """One row (least): the length at which the longest chromosomes together first exceed ``share`` of all. One row a chromosome."""
    w = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    return lengths.select("size", F.sum("size").over(w).alias("upto"), F.sum("size").over(Window.partitionBy()).alias("all")).select(F.max(F.when(F.col("upto") > share * F.col("all"), F.col("size"))).alias("m"), F.min("size").alias("z")).select(F.coalesce("m", "z").alias("least"))
