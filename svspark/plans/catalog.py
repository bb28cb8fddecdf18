"""Queries of the relational operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from svspark.functions.stats import reverse_complement
from svspark.operators import intervals as iv
from svspark.plans.views import E_SQL, G_SQL, I_SQL, evidence, genotypes, intervals, read

_Q: dict = {}
_S: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _Q[f.__name__] = f
        if sql:
            _S[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)


_ISL = f"{I_SQL}, o AS (SELECT DISTINCT chrom, s, e FROM i), p AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT FALSE THEN 1 ELSE 0 END AS n FROM o), q AS (SELECT *, sum(n) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM p), isl AS (SELECT chrom, min(s) AS s, max(e) AS e FROM q GROUP BY chrom, k)"


@_query(f"WITH {_ISL} SELECT chrom, s, e FROM isl")
def islands_union(spark, d):
    return iv.islands(intervals(spark, d)).select("chrom", "s", "e")


@_query(f"WITH {_ISL}, c AS (SELECT chrom, coalesce(lag(e) OVER (PARTITION BY chrom ORDER BY s), 0) AS s, s - 1 AS e FROM isl) SELECT * FROM c WHERE e > s")
def exclude_complement(spark, d):
    return iv.complement(intervals(spark, d))


@_query(f"WITH {I_SQL}, x AS (SELECT chrom, s AS p, 1 AS v FROM i UNION ALL SELECT chrom, e, -1 FROM i), y AS (SELECT chrom, p, sum(v) AS v FROM x GROUP BY ALL), z AS (SELECT chrom, p AS s, lead(p) OVER w AS e, CAST(sum(v) OVER w AS BIGINT) AS depth FROM y WINDOW w AS (PARTITION BY chrom ORDER BY p)) SELECT * FROM z WHERE depth > 0")
def depth_sweep_runs(spark, d):
    return iv.depth_runs(intervals(spark, d))


@_query(f"WITH {E_SQL} SELECT chrom, svt, pos // 3600 AS win, count(*) AS n, CAST(sum(qual) AS BIGINT) AS qual FROM e GROUP BY ALL")
def fixed_window_counts(spark, d):
    return evidence(spark, d).groupBy("chrom", "svt", F.expr("pos div 3600").alias("win")).agg(F.count("*").alias("n"), F.sum("qual").alias("qual"))


@_query(f"WITH {E_SQL}, x AS (SELECT chrom, pos // 3600 AS hi FROM e), y AS (SELECT chrom, hi AS win FROM x UNION ALL SELECT chrom, hi - 1 FROM x) SELECT chrom, win, count(*) AS n FROM y WHERE win >= 0 GROUP BY ALL")
def sliding_window_counts(spark, d):
    """Windows of two hours every hour."""
    e = evidence(spark, d)
    return e.select("chrom", F.explode(F.array(F.expr("pos div 3600"), F.expr("pos div 3600 - 1"))).alias("win")).where("win >= 0").groupBy("chrom", "win").agg(F.count("*").alias("n"))


@_query(f"WITH {E_SQL}, m AS (SELECT sample, list_sort(list(qual))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS median FROM e GROUP BY sample) SELECT sample, median, list_sort(list(abs(qual - median)))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS mad FROM e JOIN m USING (sample) GROUP BY sample, median")
def lib_params_upper_median_mad(spark, d):
    per = evidence(spark, d).groupBy("sample").agg(F.collect_list("qual").alias("x")).withColumn("n", F.floor(F.size("x") / 2).cast("int") + 1)
    m = per.withColumn("median", F.element_at(F.array_sort("x"), F.col("n")))
    return m.select("sample", "median", F.element_at(F.array_sort(F.transform("x", lambda v: F.abs(v - F.col("median")))), F.col("n")).alias("mad"))


@_query(f"WITH {E_SQL}, x AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 600 THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY chrom, svt ORDER BY pos, id)), y AS (SELECT *, sum(n) OVER (PARTITION BY chrom, svt ORDER BY pos, id) AS c FROM x) SELECT chrom, svt, count(*) AS support, min(pos) AS lo, max(pos) AS hi FROM y GROUP BY chrom, svt, c HAVING count(*) >= 3")
def gap_single_linkage(spark, d):
    return iv.gap_clusters(evidence(spark, d), 600, 3)


@_query(f"WITH {E_SQL} SELECT a.id AS a, b.id AS b, b.pos - a.pos AS gap FROM e a JOIN e b ON a.chrom = b.chrom AND a.svt = b.svt AND b.pos - a.pos <= 60 AND (b.pos > a.pos OR (b.pos = a.pos AND a.id < b.id))")
def band_join_edges(spark, d):
    return iv.band_join(evidence(spark, d), 60)


@_query(f"WITH {I_SQL} SELECT a.id AS id_a, a.ln AS ln_a, b.id AS id_b, b.ln AS ln_b, least(a.e, b.e) - b.s AS overlap FROM i a JOIN i b ON a.chrom = b.chrom AND a.t = b.t AND (a.s < b.s OR (a.s = b.s AND (a.id, a.ln) < (b.id, b.ln))) AND b.s < a.e AND least(a.e, b.e) - b.s >= 0.8 * greatest(a.e - a.s, b.e - b.s)")
def reciprocal_overlap_pairs(spark, d):
    return iv.reciprocal_overlap(intervals(spark, d), 0.8, 1000)


@_query("SELECT a.l_orderkey AS qname, a.l_linenumber AS first, b.l_linenumber AS second, least(a.l_quantity, b.l_quantity) AS quality FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber AND b.l_partkey > a.l_partkey")
def mate_pair_join(spark, d):
    r = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    a = r.select(F.col("l_orderkey").alias("qname"), F.col("l_linenumber").alias("first"), F.col("l_partkey").alias("pa"), F.col("l_quantity").alias("qa"), (F.col("l_linenumber") + 1).alias("second"))
    b = r.select(F.col("l_orderkey").alias("qname"), F.col("l_linenumber").alias("second"), F.col("l_partkey").alias("pb"), F.col("l_quantity").alias("qb"))
    return a.join(b, ["qname", "second"]).where("pb > pa").select("qname", "first", "second", F.least("qa", "qb").alias("quality"))


@_query(f"WITH {G_SQL} SELECT site, count(*) FILTER (WHERE alt > 0) AS supp, CAST(coalesce(sum(CASE WHEN alt > ref THEN 2 WHEN alt > 0 THEN 1 END), 0) AS BIGINT) AS ac, 2 * count(*) AS an FROM g GROUP BY site")
def carrier_counts(spark, d):
    g = genotypes(spark, d)
    return g.groupBy("site").agg(F.count_if(F.col("alt") > 0).alias("supp"), F.coalesce(F.sum(F.when(F.expr("alt > ref"), 2).when(F.expr("alt > 0"), 1)), F.lit(0)).alias("ac"), (2 * F.count("*")).alias("an"))


@_query("SELECT doc_id, reverse(translate(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'ACGT', 'TGCA')) AS rc FROM documents")
def revcomp(spark, d):
    return read(spark, d, "documents").select("doc_id", reverse_complement("text").alias("rc"))


@_query(f"WITH {E_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom, svt ORDER BY qual DESC, id) AS k FROM e) SELECT id, chrom, svt, k FROM r WHERE k <= 20")
def topk_reads_per_sv(spark, d):
    w = Window.partitionBy("chrom", "svt").orderBy(F.desc("qual"), "id")
    return evidence(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 20").select("id", "chrom", "svt", F.col("k").cast("long").alias("k"))


@_query(f"WITH {E_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY pos, id) AS k FROM e) SELECT sample, count(*) AS n, CAST(sum(qual) AS BIGINT) AS qual FROM r WHERE k % 2 = 1 GROUP BY sample")
def every_second_ref(spark, d):
    w = Window.partitionBy("sample").orderBy("pos", "id")
    return evidence(spark, d).withColumn("k", F.row_number().over(w)).where("k % 2 = 1").groupBy("sample").agg(F.count("*").alias("n"), F.sum("qual").alias("qual"))


@_query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def anti_unmatched(spark, d):
    alt = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(alt, "o_orderkey", "left_anti")


@_query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_alt_reads(spark, d):
    alt = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(alt, "o_orderkey", "left_semi")


_BND = "CASE o_custkey % 4 WHEN 0 THEN concat('N]', p, ']') WHEN 1 THEN concat('[', p, '[N') WHEN 2 THEN concat('N[', p, '[') ELSE concat(']', p, ']N') END"


@_query(f"WITH b AS (SELECT o_orderkey, o_custkey, concat('chr', CAST(o_custkey % 22 + 1 AS VARCHAR), ':', CAST(o_orderkey * 13 AS VARCHAR)) AS p FROM orders), a AS (SELECT o_orderkey, {_BND} AS alt FROM b) SELECT o_orderkey, alt, regexp_extract(alt, '[\\[\\]](.+):([0-9]+)[\\[\\]]', 1) AS chr2, CAST(regexp_extract(alt, '[\\[\\]](.+):([0-9]+)[\\[\\]]', 2) AS BIGINT) AS pos2 FROM a")
def bnd_alt(spark, d):
    """breakend ALT of the four orientations, and the mate parsed back."""
    b = read(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", "concat('chr', o_custkey % 22 + 1, ':', o_orderkey * 13) p")
    part = lambda k: F.regexp_extract("alt", r"[\[\]](.+):([0-9]+)[\[\]]", k)
    return b.select("o_orderkey", F.expr(_BND).alias("alt")).select("o_orderkey", "alt", part(1).alias("chr2"), part(2).cast("long").alias("pos2"))


@_query(f"WITH {G_SQL}, c AS (SELECT id, ln, (ref + alt) / 10.0::DOUBLE AS x FROM g), l AS (SELECT id, ln, list_sort([{{'a': -greatest(-0.5::DOUBLE * (x - m) * (x - m) / 0.25::DOUBLE / 2.302585092994046::DOUBLE, -1000.0::DOUBLE), 'cn': m}} FOR m IN range(10)]) AS l FROM c) SELECT id, ln, l[1].cn AS cn, round(10 * (l[2].a - l[1].a), 4) AS gq FROM l")
def cn_likelihoods(spark, d):
    """Normal log likelihoods of copy numbers 0 to 9 at sd 0.5; quality is best less second. No shuffle: an array per row."""
    g = genotypes(spark, d).selectExpr("id", "ln", "(ref + alt) / 10D x")
    l = g.withColumn("l", F.expr("array_sort(transform(sequence(0L, 9L), c -> struct(-greatest(-0.5D * (x - c) * (x - c) / 0.25D / 2.302585092994046D, -1000D) as a, c as cn)))"))
    return l.select("id", "ln", F.expr("l[0].cn").alias("cn"), F.expr("round(10 * (l[1].a - l[0].a), 4)").alias("gq"))


@_query(f"WITH {G_SQL}, v AS (SELECT site, sample, max(CASE WHEN alt > ref THEN 2 WHEN alt > 0 THEN 1 ELSE 0 END) AS x FROM g GROUP BY ALL), p AS (SELECT a.site, a.x AS x, b.x AS y FROM v a JOIN v b ON a.sample = b.sample AND b.site = a.site + 1), s AS (SELECT site, count(*) AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy, sum(x * y)::DOUBLE AS sxy, sum(x * x)::DOUBLE AS sxx, sum(y * y)::DOUBLE AS syy FROM p GROUP BY site) SELECT site, n, CASE WHEN n < 2 OR n * sxx - sx * sx <= 0 OR n * syy - sy * sy <= 0 THEN -1.0::DOUBLE ELSE round((n * sxy - sx * sy) * (n * sxy - sx * sy) / ((n * sxx - sx * sx) * (n * syy - sy * sy)), 6) END AS r2 FROM s")
def dosage_r2_pairs(spark, d):
    """Squared correlation of the dosages of neighbouring sites over shared samples; -1 without variance."""
    v = genotypes(spark, d).groupBy("site", "sample").agg(F.max(F.expr("case when alt > ref then 2 when alt > 0 then 1 else 0 end")).alias("x"))
    p = v.join(v.select((F.col("site") - 1).alias("site"), "sample", F.col("x").alias("y")), ["site", "sample"])
    s = p.groupBy("site").agg(F.count("*").alias("n"), *(F.sum(F.expr(e)).cast("double").alias(a) for a, e in (("sx", "x"), ("sy", "y"), ("sxy", "x * y"), ("sxx", "x * x"), ("syy", "y * y"))))
    return s.selectExpr("site", "n", "case when n < 2 or n * sxx - sx * sx <= 0 or n * syy - sy * sy <= 0 then -1D else round((n * sxy - sx * sy) * (n * sxy - sx * sy) / ((n * sxx - sx * sx) * (n * syy - sy * sy)), 6) end r2")


@_query(f"WITH {G_SQL} SELECT site, arg_max(id, (alt, ref, -id, -ln)) AS id, max(alt) AS score FROM g GROUP BY site")
def best_rep_per_group(spark, d):
    """Highest score, then quality, then first. max_by combines before the shuffle, so no group is ever sorted in one task."""
    return genotypes(spark, d).groupBy("site").agg(F.max_by("id", F.expr("struct(alt, ref, -id, -ln)")).alias("id"), F.max("alt").alias("score"))


@_query(f"WITH {E_SQL}, x AS (SELECT sample, abs(qual - lag(qual) OVER (PARTITION BY sample ORDER BY pos, id)) AS z FROM e) SELECT sample, greatest(round(list_sort(list(z) FILTER (WHERE z IS NOT NULL))[CAST(floor(count(z) * 0.5) AS INT) + 1] / 0.9539, 6), 0.02) AS noise FROM x GROUP BY sample")
def adjacent_noise(spark, d):
    """Upper median of the neighbours' differences over 0.9539, at least 0.02."""
    w = Window.partitionBy("sample").orderBy("pos", "id")
    x = evidence(spark, d).select("sample", F.abs(F.col("qual") - F.lag("qual").over(w)).alias("z")).groupBy("sample").agg(F.array_sort(F.collect_list("z")).alias("v"))
    return x.select("sample", F.greatest(F.round(F.get("v", F.floor(F.size("v") / 2).cast("int")) / 0.9539, 6), F.lit(0.02)).alias("noise"))


@_query("SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N' AND l_discount > 0.05")
def intersect_reads(spark, d):
    """Reads in both evidence sets."""
    r = read(spark, d, "lineitem")
    return r.where("l_returnflag = 'R'").select("l_suppkey").intersect(r.where("l_returnflag = 'N' and l_discount > 0.05").select("l_suppkey"))


