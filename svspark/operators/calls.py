"""Filters and population statistics over calls: one row per site and sample, sites as records of their samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svspark.functions.scalars import chi_square_tail, normal_density
from svspark.functions.stats import upper_nth


def _support(precise: str = "precise"):
    """Alternative and all support: split reads of precise sites, else pairs."""
    alt = F.when(F.col(precise), F.col("rv")).otherwise(F.col("dv"))
    return alt, alt + F.when(F.col(precise), F.col("rr")).otherwise(F.col("dr"))


def _with_shares(calls: DataFrame) -> DataFrame:
    alt, total = _support()
    flank = F.col("rcl") + F.col("rcr")
    return calls.withColumns({"total": total, "share": F.try_divide(alt.cast("double"), total), "depth": F.coalesce(F.try_divide(F.col("rc").cast("double"), flank), F.col("rc").cast("double"))})


def somatic(calls: DataFrame, altaf: float = 0.03, coverage: int = 10, contamination: float = 0.0, genotyped: float = 0.75) -> DataFrame:
    """L1: site, rd_ratio, filter from (site, control, gt, precise, rr, rv, dr, dv, rc, rcl, rcr); gt counts alternative alleles, null where missing.

    Every genotyped control is 0/0 with a share up to the contamination, some
    tumor has share and coverage, and enough samples are genotyped.
    """
    c, seen = F.col("control"), F.col("gt").isNotNull()
    clean = c & (F.col("gt") == 0)
    s = _with_shares(calls).groupBy("site").agg(
        F.count("*").alias("n"), F.count_if(seen).alias("seen"), F.count_if(seen & c).alias("controls"), F.count_if(clean & F.coalesce(F.col("share") <= contamination, F.lit(False))).alias("clean"),
        F.count_if(seen & ~c & F.coalesce(F.col("share") >= altaf, F.lit(False)) & (F.col("total") >= coverage)).alias("hit"),
        upper_nth(F.when(clean, F.col("depth"))).alias("dc"), upper_nth(F.when(seen & ~c, F.col("depth"))).alias("dt"))
    ok = (F.col("clean") > 0) & (F.col("hit") > 0) & (F.col("clean") == F.col("controls")) & (F.col("seen") >= genotyped * F.col("n"))
    return s.select("site", F.round(F.when(F.coalesce(F.col("dc"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("dt") / F.nullif("dc", F.lit(0.0))), 9).alias("rd_ratio"), F.when(ok, "PASS").otherwise("FailSomatic").alias("filter"))


def germline(calls: DataFrame, altaf: float = 0.03, genotyped: float = 0.75, rd_del: float = 0.8, rd_dup: float = 1.2) -> DataFrame:
    """L2: site, af, rd_ratio, filter from the columns of ``somatic`` and svt. Deletions and duplications by depth ratio, others by clean 0/0 samples."""
    gt, seen = F.col("gt"), F.col("gt").isNotNull()
    s = _with_shares(calls).groupBy("site", "svt").agg(
        F.count("*").alias("n"), F.count_if(seen).alias("seen"), F.coalesce(F.sum("gt"), F.lit(0)).alias("ac"),
        upper_nth(F.when(gt == 0, F.col("share")), 0.9).alias("p90"), upper_nth(F.when(gt > 0, F.col("share"))).alias("med"),
        upper_nth(F.when(gt == 0, F.col("depth"))).alias("d0"), upper_nth(F.when(gt > 0, F.col("depth"))).alias("d1"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    ratio = F.when(zero("d0") == 0, 1.0).otherwise(zero("d1") / F.nullif("d0", F.lit(0.0)))
    ok = (F.col("ac") > 0) & (zero("med") >= altaf) & (F.col("seen") >= genotyped * F.col("n"))
    kind = F.when(F.col("svt") == "DEL", F.col("ratio") <= rd_del).when(F.col("svt") == "DUP", F.col("ratio") >= rd_dup).otherwise(zero("p90") <= 0)
    return s.withColumn("ratio", ratio).select("site", F.round(F.try_divide(F.col("ac"), 2 * F.col("seen")), 6).alias("af"), F.round("ratio", 9).alias("rd_ratio"), F.when(ok & kind, "PASS").otherwise("FailGermline").alias("filter"))


def somatic_cnv(calls: DataFrame, offset: float = 0.1, pgerm: float = 0.001) -> DataFrame:
    """L3: site, somatic from (site, control, cn, sd). Some tumor's copy number is unlikely under, and away from, that of every control; cn -1 makes a site invalid.

    Samples of a site meet in its record; pairs never become rows.
    """
    own = F.struct("cn", F.greatest("sd", F.lit(0.025)).alias("sd"))
    s = calls.groupBy("site").agg(F.collect_list(F.when(F.col("control"), own)).alias("c"), F.collect_list(F.when(~F.col("control"), own)).alias("t"), F.max((F.col("cn") == -1).cast("int")).alias("bad"))
    apart = lambda x, y: (F.greatest(normal_density(x["cn"], y["cn"], y["sd"]), normal_density(y["cn"], x["cn"], x["sd"])) <= pgerm) & (F.abs(x["cn"] - y["cn"]) >= offset)
    return s.select("site", ((F.col("bad") == 0) & (F.size("c") > 0) & F.exists("t", lambda x: F.forall("c", lambda y: apart(x, y)))).alias("somatic"))


def population(gl: DataFrame, rounds: int = 1000, epsilon: float = 1e-20) -> DataFrame:
    """Site, af, gf_rr, gf_ra, gf_aa, fic, rsq, hwe_p from (site, l0, l1, l2): linear likelihoods of 0/0, 0/1, 1/1.

    Expectation maximisation inside the site's record, from one half and from
    thirds, until the squared change is epsilon or ``rounds`` are over.
    """
    s = gl.groupBy("site").agg(F.collect_list(F.struct("l0", "l1", "l2")).alias("g"))
    n = F.size("g")
    total = lambda f: F.aggregate("g", F.lit(0.0), lambda a, x: a + f(x))
    hwe = lambda x, p: (x["l0"] * (1 - p) * (1 - p), x["l1"] * 2 * p * (1 - p), x["l2"] * p * p)

    def share(x, p):
        a, b, c = hwe(x, p)
        return F.try_divide(c + 0.5 * b, a + b + c)

    af = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(0.5).alias("p"), F.lit(1.0).alias("e")),
                     lambda s, _: F.when(s["e"] > epsilon, _step(s, total(lambda x: share(x, s["p"])) / n)).otherwise(s))["p"]

    def freq(x, s):
        a, b, c = x["l0"] * s["a"], x["l1"] * s["b"], x["l2"] * s["c"]
        return a / (a + b + c), b / (a + b + c), c / (a + b + c)

    def turn(s):
        f = F.aggregate("g", F.struct(*(F.lit(0.0).alias(k) for k in "abc")), lambda acc, x: F.struct(*((acc[k] + v).alias(k) for k, v in zip("abc", freq(x, s)))))
        return F.transform(F.array(f), lambda v: F.struct(*((v[k] / n).alias(k) for k in "abc"), sum(((v[k] / n - s[k]) * (v[k] / n - s[k]) for k in "abc"), F.lit(0.0)).alias("e")))[0]

    third = F.lit(1.0) / 3
    gf = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(*(third.alias(k) for k in "abc"), F.lit(1.0).alias("e")), lambda s, _: F.when(s["e"] > epsilon, turn(s)).otherwise(s))
    s = s.withColumns({"p": af, "f": gf})
    p = F.col("p")
    odd = 2 * p * (1 - p)
    part = lambda x: hwe(x, p)
    het = total(lambda x: part(x)[1] / sum(part(x)[1:], part(x)[0]))
    dose = lambda x: (part(x)[1] + 2 * part(x)[0]) / sum(part(x)[1:], part(x)[0])
    sums = s.withColumns({"het": het, "d": total(dose), "dd": total(lambda x: dose(x) * dose(x)), "null": total(lambda x: F.log(sum(part(x)[1:], part(x)[0]))),
                          "alt": total(lambda x: F.log(x["l0"] * F.col("f.a") + x["l1"] * F.col("f.b") + x["l2"] * F.col("f.c")))})
    spread = F.greatest(F.col("dd") - F.col("d") * F.col("d") / n, F.lit(0.0))
    return sums.select("site", F.round("p", 5).alias("af"), *(F.round(f"f.{k}", 5).alias(f"gf_{v}") for k, v in zip("abc", ("rr", "ra", "aa"))), F.round(1 - F.col("het") / (n * odd), 4).alias("fic"),
                       F.round(F.try_divide(F.try_divide(spread, n - 1), odd), 4).alias("rsq"), F.round(chi_square_tail(F.greatest(-2 * (F.col("null") - F.col("alt")), F.lit(0.0))), 4).alias("hwe_p"))


def _step(s, p):
    return F.transform(F.array(p), lambda v: F.struct(v.alias("p"), (2 * (v - s["p"]) * (v - s["p"])).alias("e")))[0]


def merged_counts(records: DataFrame) -> DataFrame:
    """Grp, supp, ac, an, af, ci_lo, ci_hi from (grp, file, supp, ac, n, s, rep_s): per file the record of most alternative alleles, summed; offsets from the representative."""
    per = records.groupBy("grp", "file").agg(F.max(F.struct("ac", "supp")).alias("b"), F.max("n").alias("n"), F.min(F.col("s") - F.col("rep_s")).alias("lo"), F.max(F.col("s") - F.col("rep_s")).alias("hi"))
    g = per.groupBy("grp").agg(F.sum("b.supp").alias("supp"), F.sum("b.ac").alias("ac"), F.sum("n").alias("n"), F.least(F.lit(0), F.min("lo")).alias("ci_lo"), F.greatest(F.lit(0), F.max("hi")).alias("ci_hi"))
    an = F.greatest(2 * F.col("n"), F.col("ac"))
    return g.select("grp", "supp", "ac", an.alias("an"), F.round(F.try_divide(F.col("ac").cast("double"), an), 6).alias("af"), "ci_lo", "ci_hi")
