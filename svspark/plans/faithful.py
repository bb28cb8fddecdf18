"""Queries of the call rules, and their SQL, over the tables seen as calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from svspark.functions import scalars as sc
from svspark.operators import calls as op
from svspark.operators import intervals as iv
from svspark.plans.catalog import _query
from svspark.plans.views import E_SQL, G_SQL, I_SQL, evidence, genotypes, intervals, read

# Orders are sites, their lines samples.
_C = """SELECT l_orderkey AS site, l_linenumber AS sample, l_returnflag = 'N' AS control, l_orderkey % 2 = 0 AS precise,
 CASE l_orderkey % 4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'DUP' WHEN 2 THEN 'INV' ELSE 'BND' END AS svt, rr, rv, rr + 1 AS dr, rv AS dv, rr * 10 + rv AS rc, rv AS rcl, l_linenumber - 1 AS rcr,
 CASE WHEN l_suppkey % 10 = 0 THEN NULL WHEN rv = 0 THEN 0 WHEN rv < 7 THEN 1 ELSE 2 END AS gt
 FROM (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS rr, CASE WHEN l_suppkey % 3 = 0 THEN CAST(floor(l_discount * 100 + 0.5) AS BIGINT) ELSE 0 END AS rv FROM {0}) AS v"""
C_SQL = f"c AS ({_C.format('lineitem')})"
_SHARE = """x AS (SELECT *, CASE WHEN precise THEN rv ELSE dv END AS a, CASE WHEN precise THEN rr + rv ELSE dr + dv END AS t, CASE WHEN rcl + rcr <> 0 THEN rc::DOUBLE / (rcl + rcr) ELSE rc::DOUBLE END AS depth FROM c),
 y AS (SELECT *, CASE WHEN t <> 0 THEN a::DOUBLE / t END AS share FROM x)"""


def calls(spark, d):
    read(spark, d, "lineitem").createOrReplaceTempView("svspark_lines")
    return spark.sql(_C.format("svspark_lines"))


def _nth(x: str, cond: str, p: float = 0.5) -> str:
    return f"list_sort(list({x}) FILTER ({cond} AND {x} IS NOT NULL))[CAST(floor(count({x}) FILTER ({cond}) * {p}) AS INT) + 1]"


@_query(f"""WITH {C_SQL}, {_SHARE}, s AS (SELECT site, count(*) AS n, count(gt) AS seen, count(*) FILTER (control AND gt IS NOT NULL) AS controls, count(*) FILTER (control AND gt = 0 AND share <= 0) AS clean,
 count(*) FILTER (NOT control AND gt IS NOT NULL AND share >= 0.03 AND t >= 10) AS hit, {_nth('depth', 'control AND gt = 0')} AS dc, {_nth('depth', 'NOT control AND gt IS NOT NULL')} AS dt FROM y GROUP BY site)
 SELECT site, round(CASE WHEN coalesce(dc, 0) = 0 THEN 1 ELSE dt / dc END, 9) AS rd_ratio, CASE WHEN clean > 0 AND hit > 0 AND clean = controls AND seen >= 0.75 * n THEN 'PASS' ELSE 'FailSomatic' END AS filter FROM s""")
def somatic_filter(spark, d):
    """L1."""
    return op.somatic(calls(spark, d))


@_query(f"""WITH {C_SQL}, {_SHARE}, s AS (SELECT site, svt, count(*) AS n, count(gt) AS seen, coalesce(sum(gt), 0) AS ac, {_nth('share', 'gt = 0', 0.9)} AS p90, {_nth('share', 'gt > 0')} AS med, {_nth('depth', 'gt = 0')} AS d0, {_nth('depth', 'gt > 0')} AS d1 FROM y GROUP BY site, svt),
 r AS (SELECT *, CASE WHEN coalesce(d0, 0) = 0 THEN 1 ELSE coalesce(d1, 0) / d0 END AS ratio FROM s)
 SELECT site, round(CASE WHEN seen > 0 THEN ac::DOUBLE / (2 * seen) END, 6) AS af, round(ratio, 9) AS rd_ratio, CASE WHEN ac > 0 AND coalesce(med, 0) >= 0.03 AND seen >= 0.75 * n AND CASE svt WHEN 'DEL' THEN ratio <= 0.8 WHEN 'DUP' THEN ratio >= 1.2 ELSE coalesce(p90, 0) <= 0 END THEN 'PASS' ELSE 'FailGermline' END AS filter FROM r""")
def sv_germline_filter(spark, d):
    """L2."""
    return op.germline(calls(spark, d))


_PDF = "exp(-0.5::DOUBLE * (({0}) - ({1})) * (({0}) - ({1})) / (greatest({2}, 0.025::DOUBLE) * greatest({2}, 0.025::DOUBLE))) / (greatest({2}, 0.025::DOUBLE) * 2.5066282746310002::DOUBLE)"


@_query(f"""WITH k AS (SELECT l_orderkey AS site, l_returnflag = 'N' AS control, CASE WHEN l_suppkey % 50 = 0 THEN -1::DOUBLE ELSE l_quantity / 10 END AS cn, l_tax * 2 AS sd FROM lineitem),
 s AS (SELECT site, bool_or(cn = -1) AS bad, bool_or(control) AS any_c FROM k GROUP BY site),
 g AS (SELECT t.site, t.cn, t.sd, bool_and(greatest({_PDF.format('t.cn', 'c.cn', 'c.sd')}, {_PDF.format('c.cn', 't.cn', 't.sd')}) <= 0.001 AND abs(t.cn - c.cn) >= 0.1) AS apart FROM k t JOIN k c ON t.site = c.site AND NOT t.control AND c.control GROUP BY ALL)
 SELECT s.site, NOT bad AND any_c AND coalesce(h, FALSE) AS somatic FROM s LEFT JOIN (SELECT site, bool_or(apart) AS h FROM g GROUP BY site) q ON q.site = s.site""")
def somatic_cnv(spark, d):
    """L3."""
    k = read(spark, d, "lineitem").selectExpr("l_orderkey site", "l_returnflag = 'N' control", "case when l_suppkey % 50 = 0 then -1D else l_quantity / 10 end cn", "l_tax * 2 sd")
    return op.somatic_cnv(k)


_GL = "SELECT label AS site, vec_id AS sample, CAST(abs(embedding[{0}]) AS DOUBLE) + 0.000001 AS l0, CAST(abs(embedding[{1}]) AS DOUBLE) + 0.000001 AS l1, CAST(abs(embedding[{2}]) AS DOUBLE) + 0.000001 AS l2 FROM {3}"
_T = "(1.0::DOUBLE / (1 + 0.5::DOUBLE * sqrt(x / 2)))"
_POLY = "::DOUBLE + t * (".join(map(str, sc.ERFC)) + "::DOUBLE" + ")" * (len(sc.ERFC) - 1)


@_query(f"""WITH RECURSIVE gl AS ({_GL.format(1, 2, 3, 'embeddings')}),
 em AS (SELECT DISTINCT site, 0 AS k, 0.5::DOUBLE AS p FROM gl UNION ALL SELECT em.site, k + 1, avg((l2 * p * p + l1 * p * (1 - p)) / (l0 * (1 - p) * (1 - p) + 2 * l1 * p * (1 - p) + l2 * p * p)) FROM em JOIN gl ON gl.site = em.site WHERE k < 40 GROUP BY em.site, k),
 gf AS (SELECT DISTINCT site, 0 AS k, 1.0::DOUBLE / 3 AS a, 1.0::DOUBLE / 3 AS b, 1.0::DOUBLE / 3 AS c FROM gl UNION ALL SELECT gf.site, k + 1, avg(l0 * a / (l0 * a + l1 * b + l2 * c)), avg(l1 * b / (l0 * a + l1 * b + l2 * c)), avg(l2 * c / (l0 * a + l1 * b + l2 * c)) FROM gf JOIN gl ON gl.site = gf.site WHERE k < 40 GROUP BY gf.site, k),
 q AS (SELECT gl.*, p, a, b, c, l0 * (1 - p) * (1 - p) AS h0, 2 * l1 * p * (1 - p) AS h1, l2 * p * p AS h2 FROM gl JOIN em ON em.site = gl.site AND em.k = 40 JOIN gf ON gf.site = gl.site AND gf.k = 40),
 s AS (SELECT site, p, a, b, c, count(*) AS n, sum(h1 / (h0 + h1 + h2)) AS het, sum((h1 + 2 * h0) / (h0 + h1 + h2)) AS d, sum(((h1 + 2 * h0) / (h0 + h1 + h2)) * ((h1 + 2 * h0) / (h0 + h1 + h2))) AS dd, sum(ln(h0 + h1 + h2)) AS nul, sum(ln(l0 * a + l1 * b + l2 * c)) AS alt FROM q GROUP BY ALL),
 r AS (SELECT *, greatest(-2 * (nul - alt), 0) AS x FROM s), u AS (SELECT *, {_T} AS t FROM r)
 SELECT site, round(p, 5) AS af, round(a, 5) AS gf_rr, round(b, 5) AS gf_ra, round(c, 5) AS gf_aa, round(1 - het / (n * 2 * p * (1 - p)), 4) AS fic, round(greatest(dd - d * d / n, 0) / (n - 1) / (2 * p * (1 - p)), 4) AS rsq, round(t * exp(-x / 2 + ({_POLY})), 4) AS hwe_p FROM u""")
def population_em(spark, d):
    """G3 to G7 with 40 rounds at most."""
    read(spark, d, "embeddings").createOrReplaceTempView("svspark_vectors")
    return op.population(spark.sql(_GL.format(0, 1, 2, "svspark_vectors")), rounds=40, epsilon=0.0)


@_query(f"""WITH {G_SQL}, m AS (SELECT site AS grp, sample % 5 AS file, alt AS ac, ref % 4 AS supp, sample % 7 + 1 AS n, id * 10 + ln AS s FROM g), r AS (SELECT grp, min(s) AS rep_s FROM m GROUP BY grp),
 p AS (SELECT m.grp, file, max(ROW(ac, supp)) AS b, max(n) AS n, min(s - rep_s) AS lo, max(s - rep_s) AS hi FROM m JOIN r ON r.grp = m.grp GROUP BY m.grp, file),
 t AS (SELECT grp, sum(b[2]) AS supp, sum(b[1]) AS ac, sum(n) AS n, least(0, min(lo)) AS ci_lo, greatest(0, max(hi)) AS ci_hi FROM p GROUP BY grp)
 SELECT grp, CAST(supp AS BIGINT) AS supp, CAST(ac AS BIGINT) AS ac, CAST(greatest(2 * n, ac) AS BIGINT) AS an, round(ac::DOUBLE / greatest(2 * n, ac), 6) AS af, ci_lo, ci_hi FROM t""")
def merged_counts(spark, d):
    """A8, A9."""
    m = genotypes(spark, d).selectExpr("site grp", "sample % 5 file", "alt ac", "ref % 4 supp", "sample % 7 + 1 n", "id * 10 + ln s")
    return op.merged_counts(m.join(m.groupBy("grp").agg(F.min("s").alias("rep_s")), "grp"))


@_query("SELECT o_orderkey, " + ", ".join(f"(o_custkey % 4096) & {m} = 0 AS {k}" for k, m in sc.DROPPED.items()) + " FROM orders")
def flag_masks(spark, d):
    """P1."""
    return read(spark, d, "orders").select("o_orderkey", *(sc.passes(F.col("o_custkey") % 4096, k).alias(k) for k in sc.DROPPED))


@_query("SELECT o_orderkey, CASE WHEN f = 0 THEN 0 WHEN f = 48 THEN 1 WHEN f = 32 THEN CASE WHEN p < m THEN 2 ELSE 3 END ELSE CASE WHEN p > m THEN 2 ELSE 3 END END AS svt FROM (SELECT o_orderkey, (o_custkey % 4096) & 48 AS f, o_orderkey % 10 AS p, o_custkey % 10 AS m FROM orders)")
def svt_class_flags(spark, d):
    """P3."""
    return read(spark, d, "orders").select("o_orderkey", sc.pair_type(F.col("o_custkey") % 4096, F.col("o_orderkey") % 10, F.col("o_custkey") % 10).alias("svt"))


_E12 = "ref % 8 AS pe, alt * 6 AS mapq, alt AS sr, ref AS srmapq, precise AS same"


@_query(f"WITH {G_SQL}, e AS (SELECT id, ln, {_E12} FROM g) SELECT id, ln, CASE WHEN same THEN CASE WHEN (pe < 3 OR mapq < 20) AND (sr < 3 OR srmapq < 20) THEN 'LowQual' ELSE 'PASS' END WHEN (pe < 5 OR mapq < 20) AND (sr < 5 OR srmapq < 20) THEN 'LowQual' ELSE 'PASS' END AS filter FROM e")
def site_filter(spark, d):
    """P12."""
    e = genotypes(spark, d).selectExpr("id", "ln", *_E12.split(", "))
    return e.select("id", "ln", sc.site_filter(*map(F.col, ("pe", "mapq", "sr", "srmapq", "same"))).alias("filter"))


_K = "ref % 4 AS supp, ln = 7 AS listed, role = 'A' AS breakend, precise, alt AS sr, ref AS srmapq, alt / 10.0 AS srq, ref / 20.0 AS ce, alt AS altsup, ref * 400 AS size, alt * 3 AS score, alt / 10.0 AS uniq, precise AND ln = 1 AS ploss, precise AND ln = 2 AS pgain"


@_query(f"WITH {G_SQL}, k AS (SELECT id, ln, {_K}, alt % 3 AS gain, alt >= 5 AS gq FROM g) SELECT id, ln, CASE WHEN supp >= 2 OR listed THEN TRUE WHEN breakend THEN supp >= 2 WHEN NOT precise THEN supp >= 2 WHEN srq > 0 OR sr > 0 THEN sr >= 3 AND srmapq >= 20 AND srq >= 0.8 AND ce >= 1.0 ELSE altsup >= 3 END AS retained, (supp >= 2 OR ploss OR size >= 10000 OR (score >= 15 AND uniq >= 0.5)) OR (pgain OR (gain >= 2 AND uniq >= 0.7)) AS cnv_kept, CASE WHEN score < 15 THEN 'LowQual' ELSE 'PASS' END AS ft FROM k")
def allele_keep_rules(spark, d):
    """P14, P15 and P13 (sample filter by a genotype quality of 15, here score)."""
    k = genotypes(spark, d).selectExpr("id", "ln", *_K.split(", "), "alt % 3 gain")
    c = F.col
    return k.select("id", "ln", sc.retain_allele(*map(c, ("supp", "listed", "breakend", "precise", "sr", "srmapq", "srq", "ce", "altsup"))).alias("retained"),
                    sc.keep_cnv(*map(c, ("supp", "gain", "ploss", "pgain", "size", "score", "uniq"))).alias("cnv_kept"), F.when(c("score") < 15, "LowQual").otherwise("PASS").alias("ft"))


_RQ, _AQ = "[(i * 7 + ln * 3) % 40 + 1 FOR i IN range(1, CAST(ref % 6 AS INT) + 1)]", "[(i * 11 + ln) % 40 + 1 FOR i IN range(1, CAST(alt % 5 AS INT) + 1)]"
_SUM = lambda a, e: f"coalesce(list_sum([{e} FOR q IN {a}]), 0)"
_P10, _NP10 = "log10(power(10.0::DOUBLE, q / -10.0::DOUBLE))", "log10(1 - power(10.0::DOUBLE, q / -10.0::DOUBLE))"


@_query(f"""WITH {G_SQL}, a AS (SELECT id, ln, {_RQ} AS rq, {_AQ} AS aq FROM g), l AS (SELECT id, ln, len(rq) + len(aq) AS n, {_SUM('rq', _P10)} + {_SUM('aq', _NP10)} AS g0, -(len(rq) + len(aq)) * 0.3010299956639812::DOUBLE AS g1, {_SUM('rq', _NP10)} + {_SUM('aq', _P10)} AS g2 FROM a),
 b AS (SELECT *, greatest(g0, g1, g2) AS m FROM l), p AS (SELECT *, CAST(round(-10 * greatest(g2 - m, -1000)) AS BIGINT) AS pl_rr, CAST(round(-10 * greatest(g1 - m, -1000)) AS BIGINT) AS pl_ra, CAST(round(-10 * greatest(g0 - m, -1000)) AS BIGINT) AS pl_aa FROM b),
 o AS (SELECT *, power(10.0::DOUBLE, pl_rr / -10.0::DOUBLE) + power(10.0::DOUBLE, pl_ra / -10.0::DOUBLE) + power(10.0::DOUBLE, pl_aa / -10.0::DOUBLE) AS odds, n > 0 AND pl_rr + pl_ra + pl_aa > 0 AS seen FROM p)
 SELECT id, ln, CASE WHEN NOT seen THEN './.' WHEN g2 >= m THEN '0/0' WHEN g1 >= m THEN '0/1' ELSE '1/1' END AS gt, CASE WHEN NOT seen THEN 0 WHEN odds <= 1 THEN 10000 ELSE CAST(round(-10 * greatest(log10(1 - 1 / odds), -1000)) AS BIGINT) END AS gq, pl_rr, pl_ra, pl_aa FROM o""")
def diploid_gl_pl_gq(spark, d):
    """G1 from arrays of mapping qualities."""
    quals = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), f)).otherwise(F.array().cast("array<int>"))
    g = genotypes(spark, d).select("id", "ln", sc.genotype(quals(F.col("ref") % 6, lambda i: (i * 7 + F.col("ln") * 3) % 40 + 1), quals(F.col("alt") % 5, lambda i: (i * 11 + F.col("ln")) % 40 + 1)).alias("g"))
    return g.select("id", "ln", "g.*")


@_query(f"WITH {G_SQL} SELECT id, ln, concat(CASE role WHEN 'R' THEN 'DEL' WHEN 'A' THEN 'DUP' ELSE 'INV' END, lpad(CAST(site AS VARCHAR), 8, '0')) AS name, CASE WHEN alt + ln - 1 > 0 THEN CAST(round(2.0::DOUBLE * ref / (alt + ln - 1)) AS BIGINT) ELSE -1 END AS rdcn FROM g")
def padded_id_rdcn(spark, d):
    """F16 and G13."""
    g = genotypes(spark, d)
    return g.select("id", "ln", F.expr("concat(case role when 'R' then 'DEL' when 'A' then 'DUP' else 'INV' end, lpad(cast(site as string), 8, '0'))").alias("name"), sc.rounded_depth(F.col("ref"), F.col("alt"), F.col("ln") - 1).alias("rdcn"))


_CIGAR = "concat(CAST(l_linenumber AS {0}), 'S', CAST(l_suppkey % 90 + 10 AS {0}), 'M', CAST(l_partkey % 7 + 1 AS {0}), 'D', CAST(l_orderkey % 50 + 1 AS {0}), 'M', CAST(l_partkey % 3 + 1 AS {0}), 'H')"
_LEN = "CAST(list_sum([CAST(x AS BIGINT) FOR x IN regexp_extract_all(cigar, '([0-9]+)[{0}]', 1)]) AS BIGINT)"


@_query(f"WITH c AS (SELECT l_orderkey AS id, l_linenumber AS ln, {_CIGAR.format('VARCHAR')} AS cigar FROM lineitem) SELECT id, ln, cigar, {_LEN.format('MDN=X')} AS ref_len, {_LEN.format('MISH=X')} AS read_len, {_LEN.format('MDN=X')} // 2 AS half_len FROM c")
def cigar_tokens(spark, d):
    """Lengths on the reference and of the read with its clips, and half of the alignment."""
    c = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), F.expr(_CIGAR.format("string")).alias("cigar"))
    total = lambda ops: F.expr(f"aggregate(regexp_extract_all(cigar, '([0-9]+)[{ops}]', 1), 0L, (a, x) -> a + cast(x as bigint))")
    return c.select("id", "ln", "cigar", total("MDN=X").alias("ref_len"), total("MISH=X").alias("read_len")).withColumn("half_len", F.expr("ref_len div 2"))


@_query("SELECT item_id, round(-coalesce(list_sum([(length(text) - length(replace(text, c, '')))::DOUBLE / length(text) * log2((length(text) - length(replace(text, c, '')))::DOUBLE / length(text)) FOR c IN list_distinct(string_split(text, ''))]), 0), 6) AS bits FROM benchmark")
def text_entropy(spark, d):
    """F2."""
    return read(spark, d, "benchmark").select("item_id", F.round(sc.entropy(F.col("text")), 6).alias("bits"))


@_query("WITH b AS (SELECT item_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM benchmark) SELECT item_id, CASE WHEN length(s) < 2 THEN s ELSE list_min([concat(substr(s, CAST(i AS INT) + 1), substr(s, 1, CAST(i AS INT))) FOR i IN range(length(s))]) END AS turned FROM b")
def least_rotation(spark, d):
    """F5."""
    return read(spark, d, "benchmark").select("item_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s")).select("item_id", sc.min_rotation(F.col("s")).alias("turned"))


_UP = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@_query(f"WITH b AS (SELECT item_id, {_UP} AS u FROM benchmark) SELECT item_id, array_to_string([CASE WHEN contains('ACGTN', substr(u, CAST(length(u) - i AS INT), 1)) THEN translate(substr(u, CAST(length(u) - i AS INT), 1), 'ACGT', 'TGCA') ELSE substr(u, CAST(i AS INT) + 1, 1) END FOR i IN range(length(u))], '') AS rc FROM b")
def revcomp_in_place(spark, d):
    """F1 with its quirk."""
    return read(spark, d, "benchmark").select("item_id", sc.reverse_complement_in_place(F.col("text")).alias("rc"))


@_query("WITH b AS (SELECT item_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM benchmark) SELECT a.item_id, levenshtein(a.s, b.s) AS ed, CASE WHEN greatest(length(a.s), length(b.s)) > 0 THEN round(1 - levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)), 6) END AS identity FROM b a JOIN b ON b.item_id = a.item_id + 1")
def edit_identity(spark, d):
    """F6, raw form: 1 - distance / longer length of whole neighbouring sequences."""
    b = read(spark, d, "benchmark").select("item_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("t"))
    longer = F.greatest(F.length("s"), F.length("t"))
    ed = F.levenshtein("s", "t")
    return b.join(n, "item_id").select("item_id", ed.cast("long").alias("ed"), F.when(longer > 0, F.round(1 - ed / F.nullif(longer, F.lit(0)), 6)).alias("identity"))


@_query(f"WITH {I_SQL}, b AS (SELECT DISTINCT chrom, s + 50 AS bp FROM i), j AS (SELECT chrom, s, e, unnest(range(s // 1000, (e - 1) // 1000 + 1)) AS bin FROM i) SELECT b.chrom, bp, count(*) AS spanning FROM b JOIN j ON j.chrom = b.chrom AND j.bin = bp // 1000 AND j.s <= bp AND bp < j.e GROUP BY ALL")
def interval_overlap_depth(spark, d):
    """Intervals over the breakpoint of every interval."""
    return iv.spanning(intervals(spark, d))


@_query(f"WITH {E_SQL}, b AS (SELECT DISTINCT chrom, pos FROM e WHERE svt = 'click'), u AS (SELECT e.id, e.pos, max(b.pos) AS before FROM e LEFT JOIN b ON b.chrom = e.chrom AND b.pos <= e.pos GROUP BY ALL), v AS (SELECT e.id, min(b.pos) AS after FROM e LEFT JOIN b ON b.chrom = e.chrom AND b.pos >= e.pos GROUP BY ALL) SELECT id, CASE WHEN after IS NULL OR pos - before <= after - pos THEN before ELSE after END AS boundary FROM u JOIN v USING (id)")
def nearest_boundary(spark, d):
    """Nearest boundary, the lower on ties. Running extremes in both directions, linear in a chromosome's rows."""
    e = evidence(spark, d).withColumn("b", F.when(F.col("svt") == "click", F.col("pos")))
    up, down = Window.partitionBy("chrom").orderBy("pos"), Window.partitionBy("chrom").orderBy(F.desc("pos"))
    at = e.withColumn("before", F.max("b").over(up)).withColumn("after", F.min("b").over(down))
    return at.select("id", F.expr("case when after is null or pos - before <= after - pos then before else after end").alias("boundary"))


@_query(f"WITH {G_SQL}, v AS (SELECT site, min(ROW(-alt, id, ln)) AS k FROM g GROUP BY site) SELECT site, dense_rank() OVER (ORDER BY site) AS nr, k[2] AS id FROM v")
def dense_numbers(spark, d):
    """Sites numbered from 1 in order. Ranges are numbered apart; one offset for each crosses between them.

    The ranges' borders are taken once and are the same in every branch of the
    plan: sampled anew by each, they would not fit the offsets.
    """
    v = genotypes(spark, d).groupBy("site").agg(F.min(F.struct(-F.col("alt"), "id", "ln")).alias("k")).select("site", F.col("k.id").alias("id"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = v.agg(F.percentile_approx("site", [i / n for i in range(1, n)], 10000)).first()[0] if n > 1 else None
    r = v.withColumn("p", iv.range_of(F.col("site"), sorted(set(borders or []))))
    of = r.groupBy("p").agg(F.count("*").alias("c"))
    base = of.select("p", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    return r.join(F.broadcast(base), "p").select("site", (F.row_number().over(Window.partitionBy("p").orderBy(F.asc_nulls_last("site"))) + F.col("o")).alias("nr"), "id")


@_query(f"WITH {C_SQL} SELECT site, CAST(coalesce(sum(gt), 0) AS BIGINT) AS ac, 2 * count(gt) AS an, count(*) FILTER (gt > 0) AS supp, count(*) FILTER (gt IS NULL) AS missing FROM c GROUP BY site")
def allele_counts(spark, d):
    """Alternative and all alleles of genotyped samples, carriers, samples without genotype."""
    gt = F.col("gt")
    return calls(spark, d).groupBy("site").agg(F.coalesce(F.sum("gt"), F.lit(0)).cast("long").alias("ac"), (2 * F.count("gt")).alias("an"), F.count_if(gt > 0).alias("supp"), F.count_if(gt.isNull()).alias("missing"))


@_query(f"WITH {I_SQL} SELECT id, ln, e - s >= 100 AND e - s <= 400 AND t IN ('A', 'R') AS kept FROM i")
def size_type_gate(spark, d):
    """Size within bounds, type among those chosen."""
    size = F.col("e") - F.col("s")
    return intervals(spark, d).select("id", "ln", (size.between(100, 400) & F.col("t").isin("A", "R")).alias("kept"))
