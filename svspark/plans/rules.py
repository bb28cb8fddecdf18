"""Queries of the pair, junction, depth, site and allele rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from svspark.functions import pairs as pr
from svspark.functions import sequences as sq
from svspark.operators import depth as dp
from svspark.operators import reads as rd
from svspark.operators import sites as st
from svspark.plans.catalog import _query
from svspark.plans.faithful import _CIGAR
from svspark.plans.views import E_SQL, G_SQL, I_SQL, evidence, genotypes, intervals, read


def _view(spark, d, sql: str, table: str = "lineitem"):
    read(spark, d, table).createOrReplaceTempView(f"svspark_{table}")
    return spark.sql(sql.format(f"svspark_{table}"))


_PAIRS = """SELECT l_orderkey AS id, l_linenumber AS ln, l_suppkey % 3 AS tid, l_partkey % 3 AS mtid, (l_partkey % 2) * 16 + (l_orderkey % 2) * 32 AS flag, l_partkey % 500 AS pos, l_suppkey % 500 AS mpos,
 CAST(floor(l_quantity) AS BIGINT) * 20 AS isize, l_orderkey % 61 AS mapq FROM {0}"""


@_query(f"""WITH p AS ({_PAIRS.format('lineitem')}), q AS (SELECT *, (flag // 16) % 2 AS r, flag // 32 AS m FROM p),
 c AS (SELECT id, ln, mapq, CASE WHEN tid <> mtid THEN CASE WHEN r = 0 AND m = 0 THEN 5 WHEN r = 1 AND m = 1 THEN 6 WHEN tid > mtid AND r = 0 OR tid < mtid AND r = 1 THEN 7 ELSE 8 END
  WHEN pos = mpos THEN -1 WHEN r = m THEN r WHEN r = 0 AND pos < mpos OR r = 1 AND pos > mpos THEN CASE WHEN isize < 500 THEN -1 ELSE 2 END WHEN abs(pos - mpos) < 100 THEN -1 ELSE 3 END AS cls FROM q)
 SELECT id, ln, cls, CASE WHEN cls >= 5 THEN mapq >= 20 ELSE mapq >= 1 END AS enough FROM c""")
def pair_classes(spark, d):
    """Class a pair supports, and whether its mapping quality suffices."""
    p = _view(spark, d, _PAIRS)
    c = p.withColumn("cls", pr.pair_class(*(F.col(x) for x in ("flag", "tid", "mtid", "pos", "mpos", "isize")), 500))
    return c.select("id", "ln", F.col("cls").cast("int").alias("cls"), pr.quality_enough(F.col("mapq"), F.col("cls")).alias("enough"))


@_query(f"WITH {I_SQL} SELECT id, ln, CASE s % 10 WHEN 0 THEN e - s >= 300 WHEN 1 THEN e - s >= 300 WHEN 2 THEN e - s >= 300 WHEN 3 THEN e - s >= 100 ELSE TRUE END AS short_ok, CASE WHEN s % 10 < 4 THEN e - s >= 15 WHEN s % 10 = 4 THEN sample % 30 >= 15 ELSE TRUE END AS long_ok FROM i")
def least_sizes(spark, d):
    """P5, P6."""
    cls = F.col("s") % 10
    return intervals(spark, d).select("id", "ln", pr.size_enough(F.col("s"), F.col("e"), cls).alias("short_ok"), pr.size_enough_long(F.col("s"), F.col("e"), cls, F.col("sample") % 30).alias("long_ok"))


_FAR = "CASE WHEN b.e < a.e THEN a.e + 100 - b.e > {0} ELSE b.e + 100 - a.e > {1} END"


@_query(f"""WITH {I_SQL}, k AS (SELECT id * 10 + ln AS id, chrom, id % 9 AS cls, s, e, 200 + sample % 3 * 100 AS m FROM i),
 p AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.cls = 4 THEN FALSE WHEN a.cls % 5 IN (0, 2) THEN b.s + 100 - a.s > a.m ELSE b.s + 100 - a.s > b.m END
  OR CASE a.cls % 5 WHEN 0 THEN {_FAR.format('b.m', 'a.m')} WHEN 1 THEN {_FAR.format('a.m', 'b.m')} WHEN 2 THEN {_FAR.format('a.m', 'b.m')} WHEN 3 THEN {_FAR.format('b.m', 'a.m')} ELSE FALSE END
  OR a.cls = 2 AND (a.e < b.s OR b.e < a.s) AS bad FROM k a JOIN k b ON a.chrom = b.chrom AND a.cls = b.cls AND (a.s < b.s OR a.s = b.s AND a.id < b.id) AND b.s + 100 - a.s <= 400) SELECT a, b FROM p WHERE NOT bad""")
def pair_edges(spark, d):
    """Edges between pairs of one class whose lower ends lie within the variability and that can support one event."""
    k = intervals(spark, d).select((F.col("id") * 10 + F.col("ln")).alias("id"), "chrom", (F.col("id") % 9).alias("cls"), "s", "e", (200 + F.col("sample") % 3 * 100).alias("m"))
    side = lambda x: {"low": F.col(f"{x}.s"), "high": F.col(f"{x}.e"), "length": F.lit(100), "insert": F.col(f"{x}.m")}
    return st.by_band(k, ["chrom", "cls"], "s", 300).where(pr.pairs_agree(F.col("a.cls"), side("a"), side("b"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


_READS = f"SELECT l_orderkey * 10 + l_linenumber AS read, l_suppkey % 10 AS chrom, l_partkey AS pos, l_returnflag = 'R' AS reverse, CAST(floor(l_quantity) AS BIGINT) AS qual, 150 AS size, {{1}} AS cigar FROM {{0}}"
_WALK = f"""r AS (SELECT *, row_number() OVER () AS nr FROM ({_READS.format('lineitem', _CIGAR.format('VARCHAR'))})), t AS (SELECT *, unnest(regexp_extract_all(cigar, '([0-9]+)[A-Z=]', 1)) AS n, unnest(regexp_extract_all(cigar, '[0-9]+([A-Z=])', 1)) AS o, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[A-Z=]'), 1) AS k FROM r),
 u AS (SELECT * REPLACE (CAST(n AS BIGINT) AS n), pos + coalesce(sum(CASE WHEN o IN ('M', 'D', 'N', '=', 'X') THEN CAST(n AS BIGINT) END) OVER w, 0) AS r0, coalesce(sum(CASE WHEN o IN ('M', 'I', 'S', 'H', '=', 'X') THEN CAST(n AS BIGINT) END) OVER w, 0) AS q0 FROM t WINDOW w AS (PARTITION BY nr ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@_query(f"""WITH {_WALK}, j AS (SELECT nr, r0 AS refpos, q0 AS seqpos, FALSE AS l FROM u WHERE o IN ('D', 'I') AND n > 3 UNION ALL SELECT nr, r0 + CASE WHEN o = 'D' THEN n ELSE 0 END, q0 + CASE WHEN o = 'I' THEN n ELSE 0 END, TRUE FROM u WHERE o IN ('D', 'I') AND n > 3
  UNION ALL SELECT nr, r0, CASE WHEN q0 = 0 THEN n ELSE q0 END, q0 = 0 FROM u WHERE o IN ('S', 'H') AND n > 2), z AS (SELECT nr, sum(n) FILTER (o IN ('M', 'I', 'S', 'H', '=', 'X')) AS n FROM u GROUP BY nr)
 SELECT read, chrom, CAST(refpos AS BIGINT) AS refpos, CAST(CASE WHEN reverse THEN z.n - seqpos ELSE seqpos END AS BIGINT) AS seqpos, NOT reverse AS forward, l AS "left", qual FROM j JOIN z USING (nr) JOIN r USING (nr)""")
def read_junctions(spark, d):
    """X1."""
    return rd.junctions(_reads(spark, d), 3, 2)


def _reads(spark, d):
    return _view(spark, d, _READS.format("{0}", _CIGAR.format("string")))


@_query(f"WITH {_WALK}, p AS (SELECT read, chrom, size, r0 AS place FROM u WHERE o = 'D' AND n > 3 OR o IN ('S', 'H') AND n > 2 UNION ALL SELECT read, chrom, size, r0 + n FROM u WHERE o = 'D' AND n > 3) SELECT read, chrom, CAST(place AS BIGINT) AS place FROM p WHERE place >= 0 AND place < size")
def read_break_places(spark, d):
    """X5."""
    return rd.break_places(_reads(spark, d), 3, 2)


_JUNCTIONS = """SELECT l_orderkey AS read, l_suppkey % 2 AS chrom, l_partkey % 997 AS refpos, (l_linenumber * 13 + l_partkey % 50) AS seqpos, l_partkey % 3 > 0 AS forward, l_suppkey % 4 < 2 AS l, CAST(floor(l_quantity) AS BIGINT) AS qual FROM {0}"""
_PAIRED = f"""j AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY seqpos, chrom, refpos, l, forward, qual) AS k FROM ({_JUNCTIONS.format('lineitem')})),
 p AS (SELECT a.read, a.k AS ka, b.k AS kb, a.chrom, least(a.refpos, b.refpos) AS pos, greatest(a.refpos, b.refpos) AS pos2, least(a.seqpos, b.seqpos) AS seqpos, (a.qual + b.qual) // 2 AS qual, a.forward AS f, b.forward AS g, a.l, b.l AS m, b.refpos - a.refpos AS dr, b.seqpos - a.seqpos AS ds, b.seqpos AS hi FROM j a JOIN j b ON a.read = b.read AND a.k < b.k AND a.chrom = b.chrom)"""


@_query(f"""WITH {_PAIRED},
 del AS (SELECT *, CASE WHEN f AND NOT l AND dr >= 0 THEN dr - ds WHEN f AND l AND dr < 0 THEN ds - dr WHEN NOT f AND l AND dr < 0 THEN -dr - ds WHEN NOT f AND NOT l AND dr >= 0 THEN dr + ds ELSE 0 END AS n FROM p WHERE f = g AND l <> m AND ds <= 40),
 ins AS (SELECT *, CASE WHEN f AND NOT l THEN ds - dr WHEN NOT f AND l THEN ds + dr ELSE 0 END AS n FROM p WHERE f = g AND l <> m AND abs(dr) < 40),
 e AS (SELECT 2 AS cls, * EXCLUDE (n), ds AS length FROM del WHERE n > 15 QUALIFY row_number() OVER (PARTITION BY read, ka ORDER BY kb) = 1
  UNION ALL SELECT 4, * EXCLUDE (n), n FROM ins WHERE n > 15 AND n <= hi QUALIFY row_number() OVER (PARTITION BY read, ka ORDER BY kb) = 1
  UNION ALL SELECT 3, *, ds FROM p WHERE f = g AND l <> m AND ds <= 40 AND abs(dr) > 15 AND CASE WHEN dr >= 0 THEN l AND NOT m ELSE m AND NOT l END
  UNION ALL SELECT CASE WHEN l THEN 1 ELSE 0 END, *, ds FROM p WHERE f <> g AND l = m AND ds <= 40 AND abs(dr) > 15)
 SELECT read, cls, chrom, pos, pos2, seqpos, qual, length FROM e""")
def junction_events(spark, d):
    """Deletions, duplications, inversions and insertions from the junctions of a read."""
    return rd.events(_view(spark, d, _JUNCTIONS).withColumnRenamed("l", "left"), 15, 40)


@_query(f"""WITH {I_SQL}, v AS (SELECT id * 10 + ln AS id, chrom, s, e, t = 'R' AS point, CASE WHEN t = 'R' THEN 500 ELSE (e - s) // 2 END AS h FROM i WHERE ln <= 7),
 w AS (SELECT id, chrom, point OR e - s <= 250 AS bases, unnest(['l', 'm', 'r']) AS k, unnest([greatest(s - h, 0), CASE WHEN point THEN greatest(s - h, 0) ELSE s END, CASE WHEN point THEN s ELSE e END]) AS ws, unnest([s, CASE WHEN point THEN s + h ELSE e END, CASE WHEN point THEN s + h ELSE e + h END]) AS we FROM v),
 c AS (SELECT *, unnest(range(ws // 1000, (we - 1) // 1000 + 1)) AS bin FROM w WHERE we > ws), ib AS (SELECT chrom, s, e, unnest(range(s // 1000, (e - 1) // 1000 + 1)) AS bin FROM i), mb AS (SELECT chrom, (s + e) // 2 AS m, (s + e) // 2 // 1000 AS bin FROM i),
 b AS (SELECT id, k, sum(least(we, e, (c.bin + 1) * 1000) - greatest(ws, s, c.bin * 1000)) AS n FROM c JOIN ib ON ib.chrom = c.chrom AND ib.bin = c.bin AND bases AND least(we, e, (c.bin + 1) * 1000) > greatest(ws, s, c.bin * 1000) GROUP BY ALL
  UNION ALL SELECT id, k, count(*) FROM c JOIN mb ON mb.chrom = c.chrom AND mb.bin = c.bin AND NOT bases AND m >= ws AND m < we GROUP BY ALL),
 g AS (SELECT id, sum(n) FILTER (k = 'l') AS l, sum(n) FILTER (k = 'm') AS m, sum(n) FILTER (k = 'r') AS r FROM b GROUP BY id)
 SELECT v.id, CAST(coalesce(l, 0) AS BIGINT) AS rc_l, CAST(coalesce(m, 0) AS BIGINT) AS rc_m, CAST(coalesce(r, 0) AS BIGINT) AS rc_r FROM v LEFT JOIN g USING (id)""")
def depth_triples(spark, d):
    """A6."""
    i = intervals(spark, d)
    sv = i.where("ln <= 7").select((F.col("id") * 10 + F.col("ln")).alias("id"), "chrom", "s", "e", (F.col("t") == "R").alias("point"))
    return dp.depth_triple(sv, i.select("chrom", "s", "e"), 250)


_HIST = "SELECT l_partkey % 41 AS bin, count(*) AS reference, CAST(sum(floor(l_quantity)) AS BIGINT) AS sample FROM {0} WHERE l_partkey % 41 NOT IN (0, 7, 8, 20, 40) GROUP BY l_partkey % 41"


@_query(f"""WITH h AS ({_HIST.format('lineitem')}), t AS (SELECT g AS bin, coalesce(reference, 0) AS r, coalesce(sample, 0) AS s FROM range(41) AS x(g) LEFT JOIN h ON h.bin = g),
 f AS (SELECT *, coalesce((SELECT u.s::DOUBLE / u.r FROM t u WHERE u.bin >= t.bin AND u.r > 0 ORDER BY u.bin LIMIT 1), (SELECT u.s::DOUBLE / u.r FROM t u WHERE u.bin < t.bin AND u.r > 0 ORDER BY u.bin DESC LIMIT 1), 0) AS c FROM t),
 z AS (SELECT f.bin, CASE WHEN a.bin IS NULL OR b.bin IS NULL THEN f.c ELSE (a.c * (a.r + 1) + 2 * f.c * (f.r + 1) + b.c * (b.r + 1)) / (a.r + 1 + 2 * (f.r + 1) + b.r + 1) END AS coverage FROM f LEFT JOIN f a ON a.bin = f.bin - 1 LEFT JOIN f b ON b.bin = f.bin + 1),
 p AS (SELECT t.bin, CAST((SELECT sum(s) FROM t u WHERE u.bin <= t.bin) AS DOUBLE) / CAST((SELECT sum(s) FROM t) AS DOUBLE) AS ps, CAST((SELECT sum(r) FROM t u WHERE u.bin <= t.bin) AS DOUBLE) / CAST((SELECT sum(r) FROM t) AS DOUBLE) AS pr, CASE WHEN r > 0 THEN (s::DOUBLE / CAST((SELECT sum(s) FROM t) AS DOUBLE)) / (r::DOUBLE / CAST((SELECT sum(r) FROM t) AS DOUBLE)) ELSE 1 END AS oe FROM t),
 b AS (SELECT coalesce(max(bin) FILTER (ps < 0.05 OR pr < 0.05), 0) AS lo, coalesce(min(bin) FILTER (ps + 0.05 > 1 OR pr + 0.05 > 1), 41) AS hi FROM p)
 SELECT p.bin, round(coverage, 6) AS coverage, round(ps, 6) AS p_sample, round(pr, 6) AS p_reference, round(oe, 6) AS obs_exp, p.bin >= lo AND p.bin < greatest(hi, lo + 1) AS inside FROM p JOIN z USING (bin), b""")
def gc_curve(spark, d):
    """A13, A14, W10."""
    c = dp.gc_curve(_view(spark, d, _HIST), 41, 0.05)
    return c.select("bin", *(F.round(x, 6).alias(x) for x in ("coverage", "p_sample", "p_reference", "obs_exp")), "inside")


@_query(f"WITH {E_SQL}, w AS (SELECT count(*) AS cov FROM e GROUP BY chrom, pos // 3600), m AS (SELECT list_sort(list(cov))[count(*) // 2 + 1] AS med FROM w), q AS (SELECT any_value(med) AS med, list_sort(list(abs(cov - med)))[count(*) // 2 + 1] AS mad FROM w, m) SELECT greatest(med - mad, 0) AS low, med + mad AS high FROM q")
def window_bounds(spark, d):
    """A16."""
    return dp.count_bounds(evidence(spark, d).groupBy("chrom", F.expr("pos div 3600")).agg(F.count("*").alias("cov")))


@_query(f"WITH {I_SQL}, x AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i) SELECT chrom, before AS s, s AS e, s - before <= 60 AS kept FROM x WHERE before < s")
def zero_runs(spark, d):
    """W6, D5."""
    return dp.zero_runs(intervals(spark, d).select("chrom", "s", "e"), 60)


@_query("WITH s AS (SELECT l_suppkey % 10 AS chrom, l_partkey AS pos, count(*) AS depth FROM lineitem GROUP BY ALL), r AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS run FROM s), k AS (SELECT chrom, run, (row_number() OVER (PARTITION BY chrom, run ORDER BY pos) - 1) // 2 AS k, depth FROM r), c AS (SELECT chrom, sum(depth) AS depth FROM k GROUP BY chrom, run, k) SELECT chrom, count(*) FILTER (depth >= 3) AS clusters FROM c GROUP BY chrom")
def cpg_clusters(spark, d):
    """W14."""
    return dp.cpg_clusters(read(spark, d, "lineitem").selectExpr("l_suppkey % 10 chrom", "l_partkey pos", "1L depth"), 3)


@_query(f"WITH {G_SQL} SELECT site, CAST(floor((200 * sum(alt) + sum(ref)) / nullif(2 * sum(ref), 0)) AS BIGINT) AS pct FROM (SELECT site, alt, ref + 20 AS ref FROM g) GROUP BY site")
def methylation_share(spark, d):
    """Rounded percentage of calls."""
    return genotypes(spark, d).groupBy("site").agg(pr.percentage(F.sum("alt"), F.sum(F.col("ref") + 20)).alias("pct"))


_ALT = "concat(substr(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 1, 6), '[', CAST(item_id AS {0}), ':', CAST(item_id * 7 AS {0}), '[', substr(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 7, 4), ',<', substr(text, 3, 5), '>', substr(text, 1, 9), ',', substr(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 4, 9))"
_PLAIN = "regexp_replace(translate(x, 'URYSWKMBDHVuryswkmbdhv', 'TACCAGACAAATACCAGACAAA'), '[^ACGTNacgtn>,]', 'N', 'g')"


@_query(f"WITH b AS (SELECT item_id, {_ALT.format('VARCHAR')} AS alt FROM benchmark) SELECT item_id, array_to_string([CASE WHEN substr(x, 1, 1) IN ('<', '[', ']') THEN x ELSE {_PLAIN} END FOR x IN regexp_extract_all(alt, '[\\[\\]][^<]*|<[^>\\[\\]]*>?|[^<\\[\\]]+')], '') AS plain FROM b")
def plain_alts(spark, d):
    """F13."""
    return read(spark, d, "benchmark").select("item_id", pr.plain_alt(F.expr(_ALT.format("string"))).alias("plain"))


_MARK = "concat('<INS:', CASE l_partkey % 9 WHEN 0 THEN 'ME:ALU' WHEN 1 THEN 'ME:LINE1' WHEN 2 THEN 'ME:SVA' WHEN 3 THEN 'NUMT' WHEN 4 THEN 'LTR' WHEN 5 THEN 'HERVK' WHEN 6 THEN 'TR' WHEN 7 THEN 'ME:ALU:TR' ELSE '' END, '>')"
_TYPE = "CASE l_suppkey % 8 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'DUP:TANDEM' WHEN 3 THEN 'INV' WHEN 4 THEN 'CNV' WHEN 5 THEN 'BND' WHEN 6 THEN 'TRA' ELSE 'XYZ' END"
_CT = "CASE l_orderkey % 6 WHEN 0 THEN '3to3' WHEN 1 THEN '5to5' WHEN 2 THEN '3to5' WHEN 3 THEN '5to3' WHEN 4 THEN 'NtoN' END"


@_query(f"""WITH a AS (SELECT l_orderkey AS id, l_linenumber AS ln, {_MARK} AS m, {_TYPE} AS t, {_CT} AS ct FROM lineitem)
 SELECT id, ln, CASE WHEN m LIKE '%ME:ALU%' THEN 1 WHEN m LIKE '%ME:LINE1%' THEN 2 WHEN m LIKE '%ME:SVA%' THEN 3 WHEN m LIKE '%NUMT%' THEN 4 WHEN m LIKE '%LTR%' THEN 5 WHEN m LIKE '%HERVK%' THEN 6 WHEN m LIKE '%TR%' THEN 7 ELSE 0 END AS sub,
 CASE WHEN ct IS NULL THEN CASE t WHEN 'DEL' THEN 2 WHEN 'INS' THEN 4 WHEN 'DUP:TANDEM' THEN 3 WHEN 'INV' THEN 0 WHEN 'CNV' THEN 9 WHEN 'BND' THEN 5 WHEN 'TRA' THEN 5 ELSE -1 END
  WHEN t = 'BND' THEN CASE ct WHEN '3to3' THEN 5 WHEN '5to5' THEN 6 WHEN '3to5' THEN 7 WHEN '5to3' THEN 8 ELSE -1 END WHEN t = 'CNV' THEN 9 ELSE CASE ct WHEN '3to3' THEN 0 WHEN '5to5' THEN 1 WHEN '3to5' THEN 2 WHEN '5to3' THEN 3 ELSE 4 END END AS cls FROM a""")
def decoded_types(spark, d):
    """F14, F15."""
    a = read(spark, d, "lineitem").selectExpr("l_orderkey id", "l_linenumber ln", f"{_MARK} m", f"{_TYPE} t", f"{_CT} ct")
    return a.select("id", "ln", pr.subtype(F.col("m")).alias("sub"), pr.decode_class(F.col("t"), F.col("ct")).alias("cls"))


_NAMES = "SELECT o_orderkey AS id, concat('S', CAST(o_custkey % 5 AS {1}), CASE o_orderkey % 5 WHEN 0 THEN '.hap1' WHEN 1 THEN '.maternal' WHEN 2 THEN '.1' WHEN 3 THEN '' ELSE '_x.h2' END) AS a, concat('S', CAST(o_custkey % 7 AS {1}), '.hap2') AS b FROM {0}"


@_query(f"WITH n AS ({_NAMES.format('orders', 'VARCHAR')}), k AS (SELECT *, regexp_replace(a, '\\.(hap1|hap2|hapA|hapB|h1|h2|mat|pat|maternal|paternal|1|2)$', '') AS cut, list_max([CASE WHEN starts_with(b, substr(a, 1, CAST(i AS INT))) THEN i ELSE 0 END FOR i IN range(length(a) + 1)]) AS k FROM n), h AS (SELECT *, regexp_replace(substr(a, 1, CAST(k AS INT)), '[._-]+$', '') AS h FROM k) SELECT id, cut, CASE WHEN h <> '' THEN h ELSE cut END AS common FROM h")
def sample_names(spark, d):
    """F17."""
    n = _view(spark, d, _NAMES.format("{0}", "string"), "orders")
    return n.select("id", pr.without_haplotype(F.col("a")).alias("cut"), pr.common_name(F.col("a"), F.col("b")).alias("common"))


@_query("""WITH w AS (SELECT l_orderkey AS id, l_linenumber AS ln, l_quantity AS c, CASE WHEN l_suppkey % 9 = 0 THEN 0::DOUBLE ELSE l_extendedprice / 2000 END AS e, l_discount * 10 AS p0, l_suppkey % 2 = 0 AS hap FROM lineitem), q AS (SELECT *, least(greatest(p0, 0.1::DOUBLE), 1::DOUBLE) AS p FROM w)
 SELECT id, ln, round(CASE WHEN e > 0 THEN log2((c + 1) / (e + 1)) ELSE 0 END, 6) AS log_ratio, round(CASE WHEN e > 0 THEN ((p * 2 + (1 - p) * 2) * c / e - CASE WHEN hap THEN 1 ELSE 2 END * (1 - p)) / p WHEN hap THEN 1 ELSE 2 END, 6) AS cn FROM q""")
def window_copies(spark, d):
    """F21, D8."""
    w = read(spark, d, "lineitem").selectExpr("l_orderkey id", "l_linenumber ln", "l_quantity c", "case when l_suppkey % 9 = 0 then 0D else l_extendedprice / 2000 end e", "l_discount * 10 p", "l_suppkey % 2 = 0 hap")
    x = w.withColumn("x", pr.window_copies(F.col("c"), F.col("e"), F.col("p"), F.lit(2), F.lit(2), F.col("hap")))
    return x.select("id", "ln", F.round("x.log_ratio", 6).alias("log_ratio"), F.round("x.cn", 6).alias("cn"))


@_query(f"""WITH {G_SQL}, p AS (SELECT id, ln, [alt * 10, abs(ref - alt) * 3, ref * 2] AS pl FROM g), w AS (SELECT *, [0.49::DOUBLE * pow(10::DOUBLE, pl[1] / -10.0::DOUBLE), 0.42::DOUBLE * pow(10::DOUBLE, pl[2] / -10.0::DOUBLE), 0.09::DOUBLE * pow(10::DOUBLE, pl[3] / -10.0::DOUBLE)] AS w FROM p),
 r AS (SELECT id, ln, 1 - CASE WHEN pl[1] <= pl[2] AND pl[1] <= pl[3] THEN w[1] WHEN pl[2] <= pl[3] THEN w[2] ELSE w[3] END / (w[1] + w[2] + w[3]) AS rest FROM w) SELECT id, ln, CAST(floor(greatest(0, least(99, CASE WHEN rest <= 0 THEN 99 ELSE -10 * log10(rest) END)) + 0.5) AS BIGINT) AS gq FROM r""")
def posterior_quality(spark, d):
    """G8."""
    pl = F.array(F.col("alt") * 10, F.abs(F.col("ref") - F.col("alt")) * 3, F.col("ref") * 2)
    return genotypes(spark, d).select("id", "ln", F.floor(pr.posterior_quality(pl, F.array(*map(F.lit, (0.49, 0.42, 0.09)))) + 0.5).alias("gq"))


_TANDEM = "concat(repeat(substr(regexp_replace(lower(text), '[^a-z]', ''{0}), 1, CAST(item_id % 7 + 1 AS INT)), CAST(item_id % 5 + 3 AS INT)), substr(text, 1, CAST(item_id % 4 AS INT)))"


@_query(f"WITH b AS (SELECT item_id, {_TANDEM.format(", 'g'")} AS s FROM benchmark), p AS (SELECT item_id, length(s) AS n, unnest(range(1, least(100, length(s) // 2) + 1)) AS p, s FROM b), a AS (SELECT item_id, n, p, list_sum([CASE WHEN substr(s, CAST(i AS INT), 1) = substr(s, CAST(i + p AS INT), 1) THEN 1 ELSE 0 END FOR i IN range(1, n - p + 1)]) AS m FROM p) SELECT b.item_id, CASE WHEN length(s) < 10 THEN 0 ELSE coalesce((SELECT min(p) FROM a WHERE a.item_id = b.item_id AND 20 * m >= 17 * (n - p)), 0) END AS period FROM b")
def tandem_periods(spark, d):
    """F9."""
    return read(spark, d, "benchmark").select("item_id", pr.tandem_period(F.expr(_TANDEM.format(""))).alias("period"))


_BND = "SELECT o_orderkey AS id, o_custkey % 40 AS chrom, o_custkey % 90 + 1 AS pos, o_orderkey % 40 AS chrom2, o_orderkey % 70 + 1 AS pos2, CASE o_orderkey % 4 WHEN 0 THEN '3to3' WHEN 1 THEN '5to5' WHEN 2 THEN '3to5' ELSE '5to3' END AS ct FROM {0}"


@_query(f"""WITH c AS ({_BND.format('orders')}), r AS (SELECT c.*, coalesce(nullif(substr(x.text, CAST(pos AS INT), 1), ''), 'N') AS b, coalesce(nullif(substr(y.text, CAST(pos2 AS INT), 1), ''), 'N') AS b2 FROM c LEFT JOIN benchmark x ON x.item_id = chrom LEFT JOIN benchmark y ON y.item_id = chrom2)
 SELECT chrom, pos, concat('B', id, '_2nd') AS id, concat('B', id, '_1st') AS mate, b AS ref, CASE ct WHEN '3to5' THEN concat(b, '[', chrom2, ':', pos2, '[') WHEN '5to3' THEN concat(']', chrom2, ':', pos2, ']', b) WHEN '3to3' THEN concat(b, ']', chrom2, ':', pos2, ']') ELSE concat('[', chrom2, ':', pos2, '[', b) END AS alt, ct FROM r
 UNION ALL SELECT chrom2, pos2, concat('B', id, '_1st'), concat('B', id, '_2nd'), b2, CASE ct WHEN '3to5' THEN concat(']', chrom, ':', pos, ']', b2) WHEN '5to3' THEN concat(b2, '[', chrom, ':', pos, '[') WHEN '3to3' THEN concat(b2, ']', chrom, ':', pos, ']') ELSE concat('[', chrom, ':', pos, '[', b2) END, CASE ct WHEN '3to5' THEN '5to3' WHEN '5to3' THEN '3to5' ELSE ct END FROM r""")
def breakend_pairs(spark, d):
    """Two records of every breakend call, with the reference letters at both places."""
    lines = read(spark, d, "benchmark").select(F.col("item_id").alias("chrom"), "text", F.explode(F.sequence(F.lit(0), F.expr("cast(length(text) div 20 as int)"))).alias("line")).select("chrom", "line", F.expr("substring(text, line * 20 + 1, 20)").alias("seq"))
    c = st.letters_at(_view(spark, d, _BND, "orders"), lines, 20).withColumnsRenamed({"base": "b", "chrom": "c1", "pos": "p1", "chrom2": "chrom", "pos2": "pos"})
    c = st.letters_at(c, lines, 20)
    both = pr.mates(F.col("c1"), F.col("p1"), F.col("b"), F.col("chrom"), F.col("pos"), F.col("base"), F.col("ct"), F.concat(F.lit("B"), F.col("id").cast("string")))
    return c.select(F.explode(both).alias("r")).select("r.*")


_EDGES = f"{E_SQL}, b AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.chrom = b.chrom AND a.svt = b.svt AND b.pos >= a.pos AND b.pos - a.pos <= 30 AND (a.pos < b.pos OR a.id < b.id))"


@_query(f"WITH RECURSIVE {_EDGES}, u AS (SELECT a, b FROM b UNION SELECT b, a FROM b), c AS (SELECT a AS node, a AS r FROM u UNION SELECT u.a, c.r FROM c JOIN u ON u.b = c.node) SELECT node, min(r) AS component FROM c GROUP BY node")
def band_components(spark, d):
    """Components of the graph of neighbouring evidence."""
    return st.band_components(evidence(spark, d), ["chrom", "svt"], "pos", 30)


@_query("WITH s AS (SELECT l_orderkey AS component, l_linenumber AS id, CAST(floor(l_quantity * 10) AS BIGINT) AS size FROM lineitem), o AS (SELECT *, CASE WHEN size - lag(size) OVER w > greatest(50, CAST(floor(0.25 * greatest(size, 1)) AS BIGINT)) THEN 1 ELSE 0 END AS o FROM s WINDOW w AS (PARTITION BY component ORDER BY size, id)) SELECT component, id, size, CAST(sum(o) OVER (PARTITION BY component ORDER BY size, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM o")
def size_groups(spark, d):
    """W2."""
    return st.size_groups(read(spark, d, "lineitem").selectExpr("l_orderkey component", "l_linenumber id", "cast(floor(l_quantity * 10) as bigint) size"))


_SITES = "SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 10 AS chrom, l_partkey % 9 AS cls, l_suppkey % 2 AS chrom2, l_partkey * 20 AS s, l_partkey * 20 + 1 + CAST(floor(l_quantity) AS BIGINT) * 8 AS e, l_partkey * 20 + l_orderkey % 1500 AS pos2, 1 + CAST(floor(l_quantity) AS BIGINT) * 8 AS size, l_orderkey % 80 AS hom, l_orderkey % 11 AS sub, l_suppkey % 3 - 1 AS strand, l_orderkey % 200 AS period FROM {0}"


@_query(f"""WITH k AS ({_SITES.format('lineitem')}), p AS (SELECT a.id AS ia, b.id AS ib, a.cls, b.s - a.s AS gap, a.chrom2 = b.chrom2 AS same, abs(a.pos2 - b.pos2) AS gap2, least(a.size, b.size)::DOUBLE / greatest(a.size, b.size) AS ratio, greatest(a.size, b.size) AS big, greatest(a.hom, b.hom) AS hom, a.strand AS sa, b.strand AS sb, greatest(a.period, b.period) AS per,
  CASE WHEN a.sub > 0 AND b.sub > 0 THEN least(a.sub, b.sub) ELSE greatest(a.sub, b.sub) END AS sub, greatest(least(a.e, b.e) - greatest(a.s, b.s), 0)::DOUBLE / greatest(a.e - a.s, b.e - b.s) AS over FROM k a JOIN k b ON a.chrom = b.chrom AND a.cls = b.cls AND b.s BETWEEN a.s AND a.s + 400 AND (a.s < b.s OR a.id < b.id))
 SELECT ia AS a, ib AS b FROM p WHERE CASE WHEN cls BETWEEN 5 AND 8 THEN same AND gap2 <= greatest(1000, hom) WHEN sub BETWEEN 1 AND 6 THEN NOT (sa >= 0 AND sb >= 0 AND sa <> sb) AND gap <= greatest(50, hom + 10) AND ratio >= 0.85::DOUBLE WHEN sub = 7 THEN gap <= greatest(200, floor(0.25 * big), 2 * per) ELSE gap <= greatest(least(1000, floor(0.5 * big)), 50, hom) AND over >= 0.8::DOUBLE AND (cls <> 4 OR ratio >= 0.7::DOUBLE) END""")
def site_matches(spark, d):
    """J13, C6 without sequences: pairs of sites of one class that are one."""
    p = st.by_band(_view(spark, d, _SITES), ["chrom", "cls"], "s", 400)
    return p.where(st.sites_match()).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


_RED = "SELECT o_orderkey AS id, o_custkey % 3 AS chrom, CASE o_orderkey % 4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'DUP' ELSE 'BND' END AS svt, o_custkey * 60 + o_orderkey % 30 AS s, o_custkey * 60 + o_orderkey % 30 + CAST(floor(o_totalprice) AS BIGINT) % 60 + 100 AS e, CAST(floor(o_totalprice) AS BIGINT) % 60 + 100 AS size, o_orderkey % 3 = 0 AS precise, o_orderkey % 7 AS called, o_orderkey % 5 AS ac, o_totalprice AS qual FROM {0}"


@_query(f"WITH k AS ({_RED.format('orders')}) SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.chrom = b.chrom AND a.svt = b.svt AND a.svt <> 'BND' AND b.s BETWEEN a.s AND a.s + 50 AND (a.s < b.s OR a.id < b.id) WHERE (a.svt = 'INS' OR abs(a.e - b.e) <= 50) AND least(a.size, b.size) >= 0.8 * greatest(a.size, b.size)")
def near_sites(spark, d):
    """Places, types and sizes of redundant sites."""
    return st.near_sites(_view(spark, d, _RED, "orders"), 50, 0.8)


@_query()
def redundant_collapse(spark, d):
    """Greedy, so tested against a plain loop."""
    sites = _view(spark, d, _RED, "orders")
    return st.collapsed_near(sites, 50, 0.8).select("id", "chrom", "svt", "s", "e")


@_query("WITH z AS (SELECT l_suppkey % 50 AS chrom, max(l_partkey * 100 + l_linenumber) AS size FROM lineitem GROUP BY ALL), u AS (SELECT size, sum(size) OVER (ORDER BY size DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS n FROM z) SELECT coalesce(max(size) FILTER (upto > 0.95 * n), min(size)) AS least FROM u")
def least_chromosome(spark, d):
    """P16."""
    return st.least_length(read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("chrom")).agg(F.max(F.expr("l_partkey * 100 + l_linenumber")).alias("size")), 0.95)


@_query(f"WITH {G_SQL}, r AS (SELECT site, min(ROW(-alt, id, ln)) AS k FROM g GROUP BY site) SELECT g.site, g.id, g.ln, g.ref, g.role = 'N' AS control FROM g JOIN r ON r.site = g.site AND r.k[2] = g.id AND r.k[3] = g.ln")
def chosen_records(spark, d):
    """The records chosen to represent their sites, with the role of their sample."""
    g = genotypes(spark, d)
    best = g.groupBy("site").agg(F.min(F.struct(-F.col("alt"), "id", "ln")).alias("k")).select("site", "k.id", "k.ln")
    return g.join(best, ["site", "id", "ln"]).select("site", "id", "ln", "ref", (F.col("role") == "N").alias("control"))


@_query(f"WITH {G_SQL} SELECT site, count(DISTINCT id) AS reads, bool_or(role = 'N') AND bool_or(role <> 'N') AS both FROM g GROUP BY site")
def distinct_reads(spark, d):
    """Reads of a site counted once, and whether control and other samples share it."""
    return genotypes(spark, d).groupBy("site").agg(F.countDistinct("id").alias("reads"), (F.bool_or(F.col("role") == "N") & F.bool_or(F.col("role") != "N")).alias("both"))


@_query("SELECT l_suppkey % 10 AS lib, greatest(max(CAST(floor(l_quantity * 9) AS BIGINT)), max(l_orderkey % 400)) AS variability, bool_or(l_returnflag <> 'R') AS paired, NOT bool_or(l_returnflag <> 'R') AND max(l_orderkey % 400) >= 500 AS bases FROM lineitem GROUP BY ALL")
def library_limits(spark, d):
    """Largest insert size or read length of a library, and what it counts."""
    g = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("lib")).agg(F.max(F.floor(F.col("l_quantity") * 9)).alias("m"), F.max(F.col("l_orderkey") % 400).alias("rs"), F.bool_or(F.col("l_returnflag") != "R").alias("paired"))
    return g.select("lib", F.greatest("m", "rs").alias("variability"), "paired", pr.counts_bases(F.col("paired"), F.col("rs")).alias("bases"))


@_query(f"WITH {E_SQL}, {I_SQL}, u AS (SELECT chrom, pos, id, 0 AS file FROM e UNION ALL SELECT chrom, s, id * 10 + ln, 1 FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY file, id) AS nr FROM u) SELECT chrom, pos, file, id, nr FROM r WHERE nr <= 250")
def merged_files(spark, d):
    """Records of two files in order of place, then file; 250 of a place at most."""
    e = evidence(spark, d).select("chrom", "pos", "id", F.lit(0).alias("file"))
    u = e.unionByName(intervals(spark, d).select("chrom", F.col("s").alias("pos"), (F.col("id") * 10 + F.col("ln")).alias("id"), F.lit(1).alias("file")))
    return u.withColumn("nr", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("file", "id"))).where("nr <= 250").select("chrom", "pos", "file", "id", "nr")


_WINS = "SELECT l_suppkey % 10 AS chrom, l_partkey * 100 AS s, l_partkey * 100 + 100 AS e, l_partkey % 13 <> 0 AS valid, sum(l_quantity) * CASE WHEN l_partkey % 7 IN (2, 3, 5) THEN 0.01 ELSE 1 END AS cov, count(*) * CASE WHEN l_partkey % 11 = 0 THEN 0 ELSE 25 END AS expected FROM {0} GROUP BY l_suppkey % 10, l_partkey"


@_query(f"""WITH w AS (SELECT chrom, s, e, CASE WHEN NOT valid OR expected <= 0 THEN 'masked' WHEN cov / expected < 0.1 THEN 'low' WHEN cov / expected >= 0.5 THEN 'strong' ELSE 'other' END AS state FROM ({_WINS.format('lineitem')})),
 r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY s) - row_number() OVER (PARTITION BY chrom, state ORDER BY s) AS k FROM w), g AS (SELECT chrom, state, k, min(s) AS s, max(e) AS e, count(*) AS n FROM r GROUP BY chrom, state, k),
 n AS (SELECT *, lag(state) OVER (PARTITION BY chrom ORDER BY s) AS before, lead(state) OVER (PARTITION BY chrom ORDER BY s) AS after FROM g)
 SELECT chrom, s, e, n AS windows, state, state = 'masked' OR state = 'low' AND NOT (before IS NOT DISTINCT FROM 'strong' AND after IS NOT DISTINCT FROM 'strong' AND e - s <= 250) AS masked FROM n""")
def loss_runs(spark, d):
    """W7."""
    return dp.loss_runs(_view(spark, d, _WINS), 250)


@_query(f"""WITH {E_SQL}, z AS (SELECT chrom, max(pos) AS size FROM e GROUP BY chrom), w AS (SELECT chrom, pos // 3600 AS win, count(*) AS cov, count(*) FILTER (qual >= 10) AS uniq FROM e GROUP BY ALL), v AS (SELECT w.*, uniq > 0.7 * cov AS good FROM w JOIN z USING (chrom) WHERE win < size // 3600),
 m AS (SELECT list_sort(list(cov))[count(*) // 2 + 1] AS med FROM v WHERE good), q AS (SELECT any_value(med) AS med, list_sort(list(abs(cov - med)))[count(*) // 2 + 1] AS mad FROM v, m WHERE good) SELECT chrom, win, cov, coalesce(good AND cov > greatest(med - mad, 0) AND cov < med + mad, FALSE) AS chosen FROM v LEFT JOIN q ON TRUE""")
def scan_windows(spark, d):
    """J20, D1."""
    return dp.scan_windows(evidence(spark, d), 3600, 0.7, 10)


_LETTERS = "SELECT item_id AS chrom, text AS seq FROM {0}"


@_query("WITH p AS (SELECT item_id, length(text) AS n, unnest(range(length(text))) AS pos, text FROM benchmark), g AS (SELECT item_id AS chrom, n, pos, CASE WHEN substr(text, CAST(pos + 1 AS INT), 1) IN ('c', 'C', 'g', 'G') THEN 1 ELSE 0 END AS gc FROM p) SELECT chrom, pos, CAST(CASE WHEN pos >= 5 AND pos < n - 5 THEN sum(gc) OVER (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) ELSE 0 END AS BIGINT) AS gc FROM g")
def gc_content(spark, d):
    """C and G within 5 letters of every place."""
    return dp.gc_content(_view(spark, d, _LETTERS, "benchmark"), 5, 40)


@_query()
def merged_segments(spark, d):
    """A running fold, so tested by hand."""
    seg = read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("chrom"), (F.col("l_partkey") * 100).alias("s")).agg(F.round(F.max("l_quantity") / 12).alias("cn"), F.avg("l_tax").alias("sd"), F.max("l_discount").alias("mappable"))
    return dp.merged_segments(seg.withColumn("e", F.col("s") + 100), 0.1)


@_query()
def infix_distances(spark, d):
    """F3, F4, F8 of neighbouring sequences; the functions are tested against plain tables."""
    b = read(spark, d, "benchmark").select("item_id", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("s"))
    n = b.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("t"))
    x = b.join(n, "item_id").withColumn("p", F.substring("s", 1, 12))
    return x.select("item_id", sq.infix_distance("p", "t").alias("i"), sq.prefix_distance("p", "t").alias("prefix"), sq.common_subsequence("s", "t").alias("common")).select("item_id", "i.*", "prefix", "common")
