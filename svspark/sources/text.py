"""Text formats of the domain as distributed sources and sinks. gz files are read as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Chrom, pos, id, ref, alt, qual, filter, info (map; flags have the empty text), samples (array of struct<sample, call map>).

    The header names the samples; only its last line reaches the driver.
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("#CHROM")).limit(1).collect()
    names = head[0][0].rstrip().split("\t")[9:] if head else []
    f = F.split("value", "\t")
    info = F.transform(F.split(f[7], ";"), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_extract(x, "=(.*)$", 1).alias("v")))
    keys = F.split(f[8], ":")

    def call(j):
        values = F.split(f[9 + j], ":")
        return F.map_from_arrays(keys, F.transform(keys, lambda k, i: F.coalesce(F.get(values, i), F.lit("."))))

    calls = [F.struct(F.lit(s).alias("sample"), call(j).alias("call")) for j, s in enumerate(names)]
    cell = lambda i: F.when(f[i] != ".", f[i])
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    samples = F.array(*calls) if calls else F.array().cast("array<struct<sample:string,call:map<string,string>>>")
    return rows.select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), cell(2).alias("id"), f[3].alias("ref"), f[4].alias("alt"), cell(5).cast("double").alias("qual"), f[6].alias("filter"),
                       F.map_from_entries(F.filter(info, lambda x: ~x["k"].isin("", "."))).alias("info"), samples.alias("samples"))


def write_vcf(calls: DataFrame, path: str, samples: list[str], form: list[str], header: list[str] = ()) -> None:
    """K1, K2: the columns of ``read_vcf`` as lines sorted by chrom and pos, one part per range; keys of info in order of name, those of a call as ``form``."""
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))), ";")
    of = lambda s: F.element_at(F.filter("samples", lambda x: x["sample"] == s), 1)["call"]
    cells = [F.array_join(F.array(*(F.coalesce(F.try_element_at(of(s), F.lit(k)), F.lit(".")) for k in form)), ":") for s in samples]
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot("id"), "ref", "alt", dot("qual"), "filter", F.when(F.size("info") > 0, info).otherwise("."), *([F.lit(":".join(form)), *cells] if samples else []))
    first = ["##fileformat=VCFv4.2", *header, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])])]
    spark = calls.sparkSession
    top = spark.createDataFrame([("\n".join(first), "", -1)], "value string, chrom string, pos long")
    calls.select(line.alias("value"), "chrom", "pos").unionByName(top).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").select("value").write.text(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Chrom, s, e of a BED file, half open."""
    f = F.split("value", "\t")
    return spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").rlike("^(#|track|browser)")).select(f[0].alias("chrom"), f[1].cast("long").alias("s"), f[2].cast("long").alias("e"))


def read_exclude(spark: SparkSession, path: str) -> DataFrame:
    """Chrom, s, e of an exclude list, s and e null where the whole chromosome goes; parted by tabs, blanks, commas or semicolons.

    Rows of two columns, or whose start is no number below the end, raise an error.
    """
    f = F.split(F.trim("value"), "[\t ,;]+")
    s, e = F.get(f, F.lit(1)).try_cast("long"), F.get(f, F.lit(2)).try_cast("long")
    bad = F.raise_error(F.concat(F.lit("invalid exclude region: "), F.col("value")))
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("chrom"), F.when(F.size(f) == 1, F.lit(None)).when(F.coalesce(s < e, F.lit(False)), s).otherwise(bad.cast("long")).alias("s"), e.alias("e"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample, control. Another role, or a sample of both roles, raises an error."""
    f = F.split(F.trim("value"), "[\t ]+")
    role = F.lower(f[1])
    rows = spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("sample"), F.when(role == "control", True).when(role == "tumor", False).otherwise(F.raise_error(F.lit("sample type is neither tumor nor control")).cast("boolean")).alias("control"))
    one = rows.groupBy("sample").agg(F.min("control").alias("lo"), F.max("control").alias("hi"))
    return one.select("sample", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("sample is both tumor and control")).cast("boolean")).alias("control"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Name, seq; records are parted where a line begins with >."""
    r = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    return r.select(F.regexp_extract("value", r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1), r"\s", "").alias("seq"))


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Segments (name, seq) and links (a, a_forward, b, b_forward) of zero overlap; another overlap raises an error."""
    f = F.split("value", "\t")
    t = spark.read.text(path)
    overlap = F.when(f[5] == "0M", f[1]).otherwise(F.raise_error(F.lit("only links of 0M overlap are supported")))
    return t.where(F.col("value").startswith("S\t")).select(f[1].alias("name"), f[2].alias("seq")), t.where(F.col("value").startswith("L\t")).select(overlap.alias("a"), (f[2] == "+").alias("a_forward"), f[3].alias("b"), (f[4] == "+").alias("b_forward"))


def write_gfa(segments: DataFrame, links: DataFrame, path: str) -> None:
    """Segments, then links, as lines."""
    sign = lambda c: F.when(F.col(c), "+").otherwise("-")
    s = segments.select(F.concat_ws("\t", F.lit("S"), "name", "seq").alias("value"))
    s.unionByName(links.select(F.concat_ws("\t", F.lit("L"), "a", sign("a_forward"), "b", sign("b_forward"), F.lit("0M")).alias("value"))).write.text(path)


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Alignments to a graph with their path and CIGAR."""
    f = F.split("value", "\t")
    num = {"qlen": 1, "qstart": 2, "qend": 3, "plen": 6, "pstart": 7, "pend": 8, "matches": 9, "alignlen": 10, "mapq": 11}
    return spark.read.text(path).where(F.trim("value") != "").select(f[0].alias("qname"), *(f[i].cast("long").alias(k) for k, i in num.items()), f[4].alias("strand"), f[5].alias("path"), F.regexp_extract("value", r"\tcg:Z:([^\t]+)", 1).alias("cigar"))


def path_steps(path: str = "path"):
    """Array of struct<forward, name> of a graph path such as >s1<s2; a bare name is one forward step."""
    steps = F.transform(F.regexp_extract_all(path, F.lit("[><][^><]+"), F.lit(0)), lambda x: F.struct(x.startswith(">").alias("forward"), F.substring(x, F.lit(2), F.length(x)).alias("name")))
    return F.when(F.col(path).rlike("^[><]"), steps).otherwise(F.array(F.struct(F.lit(True).alias("forward"), F.col(path).alias("name"))))
