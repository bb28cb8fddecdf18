"""Operator 8: URL filter by host/path rules and a character language-model ratio.

Null urls and urls without ``://`` have an empty host and path, fit no rule and
score 0, which is an allow. Rows are judged one by one, so repeats agree.

The urls that the rules allow and block are the accepted and rejected examples;
the models then judge every url without a rule by its characters. Both models
count all distinct urls of their kind but a fifth by hash, which calibrates;
counts stay distributed and meet the urls by a join. Where the rules give no
examples of one kind, every url without a rule is allowed. Input columns named
host, path, rule, verdict, ratio, or beginning with ``_sv_``, are replaced.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, table, width, without, written

# The rules (verdict, host, path prefix).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
ORDER, SCALE = 4, 1e9


def host_path(url) -> tuple:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    stop = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = F.translate(stop, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host, path, rules=RULES) -> tuple:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def grams(urls: DataFrame) -> DataFrame:
    """urls(u, ...) with each ORDER + 1 characters of u, start and end marked, and how often (n) u has them."""

    def run(batches):
        for b in batches:
            row, gram, n = [], [], []
            for i, u in enumerate(b.column("u").to_pylist()):
                t = "\x02" * ORDER + u + "\x03"
                for g, c in Counter(t[j : j + ORDER + 1] for j in range(len(t) - ORDER)).items():
                    row.append(i)
                    gram.append(g)
                    n.append(c)
            got = b.take(pa.array(row, pa.int64())).drop_columns(["u"])
            yield got.append_column("gram", pa.array(gram, pa.string())).append_column("n", pa.array(n, pa.int64()))

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in urls.schema.fields if f.name != "u")
    return urls.mapInArrow(run, f"{kept}, gram string, n long")


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, v): log-likelihood of the last character under the accepted less the rejected model, times SCALE, a whole number.

    counts(gram, good, bad) holds every gram, those never trained on with 0.
    Witten-Bell interpolation from uniform up; unseen contexts change nothing.
    """
    p = None
    for k in range(ORDER + 1):
        c = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("ctx", F.substring("gram", 1, k) if k else F.lit(""))
        seen = c.groupBy("ctx").agg(*(f(x).alias(x + y) for x in ("good", "bad") for f, y in ((F.sum, "_n"), (lambda x: F.count_if(F.col(x) > 0), "_d"))))
        if p is None:
            c = c.withColumns({"good_p": F.lit(1 / 256), "bad_p": F.lit(1 / 256)})
        else:
            c = c.withColumn("tail", F.substring("gram", 2, k)).join(p.withColumnRenamed("gram", "tail"), "tail").drop("tail")
        c = c.join(seen, "ctx")
        p = written(c.select("gram", *(F.when(F.col(f"{x}_n") > 0, (F.col(x) + F.col(f"{x}_d") * F.col(f"{x}_p")) / (F.col(f"{x}_n") + F.col(f"{x}_d"))).otherwise(F.col(f"{x}_p")).alias(f"{x}_p") for x in ("good", "bad"))), *([] if k == 0 else [p]))
    return p.select("gram", F.round((F.log("good_p") - F.log("bad_p")) * SCALE).cast("long").alias("v"))


def cut_point(points: DataFrame) -> float:
    """Least balanced error over the midpoints of all neighbouring ratios, the lowest on ties; points(ratio, bad). Sums of each range are all that reaches the driver."""
    per = points.groupBy("ratio").agg(F.count_if(~F.col("bad")).alias("g"), F.count_if("bad").alias("b"))
    per = written(per.repartitionByRange(width(points.sparkSession), "ratio").withColumn("_pid", F.spark_partition_id()))
    sums = per.groupBy("_pid").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.max("ratio").alias("last")).orderBy("last").collect()
    good, bad = (sum(r[c] for r in sums) for c in ("g", "b"))
    if not sums:
        return 0.0
    before, at = [], [0, 0]
    for r in sums:
        before.append((r["_pid"], at[0], at[1]))
        at = [at[0] + r["g"], at[1] + r["b"]]
    w = Window.partitionBy("_pid").orderBy("ratio")
    base = F.broadcast(points.sparkSession.createDataFrame(before, "_pid int, g0 long, b0 long"))
    err = per.join(base, "_pid").select("ratio", ((F.lit(bad) - F.col("b0") - F.sum("b").over(w)) / max(1, bad) + (F.col("g0") + F.sum("g").over(w)) / max(1, good)).alias("err"))
    best = err.where(F.col("ratio") < sums[-1]["last"]).orderBy("err", "ratio").limit(1).collect()
    if not best or best[0]["err"] >= 2:
        return 0.0
    return (best[0]["ratio"] + per.where(F.col("ratio") > best[0]["ratio"]).agg(F.min("ratio")).first()[0]) / 2


def judge(pages: DataFrame) -> DataFrame:
    """pages(url, ...) plus host, path, rule, verdict and ratio."""
    host, path = host_path(F.col("url"))
    p = without(pages, "host", "path", "rule", "verdict", "ratio").withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule, verdict = rule_columns(F.col("host"), F.col("path"))
    bad = verdict == "block"
    u = written(p.where("host <> ''").select(F.concat("host", "path").alias("u"), bad.alias("bad")).distinct())
    of = {r["bad"]: r["n"] for r in u.where("bad is not null").groupBy("bad").agg(F.count("*").alias("n")).collect()}
    back = F.pmod(F.xxhash64("u"), F.lit(5)) == 0
    few = F.lit(False)
    for b in (False, True):
        if of.get(b, 0) < 5:
            few = few | F.col("bad").eqNullSafe(b)
    at = written(grams(u.select("u", F.xxhash64("u").alias("k1"), F.xxhash64(F.lit("u"), "u").alias("k2"), "bad", (F.col("bad").isNotNull() & (few | ~back)).alias("train"))))
    n = lambda b: F.sum(F.when(F.col("train") & (F.col("bad") == b), F.col("n")).otherwise(0))
    v = log_ratios(written(at.groupBy("gram").agg(n(False).alias("good"), n(True).alias("bad"))))
    score = at.join(v, "gram").groupBy("k1", "k2", "bad").agg((F.sum(F.col("v") * F.col("n")) / SCALE / F.sum("n")).alias("ratio"))
    score = written(score, at)
    cutoff = -math.inf
    if len(of) == 2:
        held = u.where(back & F.col("bad").isNotNull()).select(F.xxhash64("u").alias("k1"), F.xxhash64(F.lit("u"), "u").alias("k2"), "bad")
        cutoff = cut_point(score.join(held, ["k1", "k2", "bad"], "left_semi").select("ratio", "bad"))
    of_page = F.when(F.col("host") != "", F.concat("host", "path"))
    found = score.groupBy("k1", "k2").agg(F.min("ratio").alias("ratio"))
    found = found.select(F.col("k1").alias("_sv_1"), F.col("k2").alias("_sv_2"), "ratio")
    s = p.withColumns({"_sv_1": F.xxhash64(of_page), "_sv_2": F.xxhash64(F.lit("u"), of_page)}).join(found, ["_sv_1", "_sv_2"], "left").drop("_sv_1", "_sv_2")
    s = s.withColumn("ratio", F.when(F.col("host") == "", 0.0).otherwise(F.col("ratio")))
    by_model = F.when((F.col("host") == "") | (F.col("ratio") >= cutoff), "allow").otherwise("block")
    return s.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_model)})


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "ratio")
