import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from svspark.functions import pairs as pr
from svspark.functions import sequences as sq
from svspark.operators import depth as dp
from svspark.operators import reads as rd
from svspark.operators import sites as st
from svspark.plans import catalog, rules

DATA = "/root/testdata/sf0.001"


def one(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()[0])


def test_pair_classes_by_hand(spark):
    lit = F.lit
    c = lambda flag, tid, mtid, pos, mpos, isize: pr.pair_class(*map(lit, (flag, tid, mtid, pos, mpos, isize)), 500)
    got = one(spark, c(0x20, 1, 1, 100, 900, 800), c(0x20, 1, 1, 100, 500, 400), c(0x20, 1, 1, 900, 100, 800), c(0x20, 1, 1, 150, 100, 50), c(0, 1, 1, 1, 9, 8), c(0x30, 1, 1, 1, 9, 8), c(0, 1, 1, 9, 9, 0),
              c(0, 2, 1, 1, 9, 0), c(0x30, 2, 1, 1, 9, 0), c(0x20, 2, 1, 1, 9, 0), c(0x20, 1, 2, 1, 9, 0), c(0x10, 2, 1, 1, 9, 0), c(0x10, 1, 2, 1, 9, 0))
    assert got == [2, -1, 3, -1, 0, 1, -1, 5, 6, 7, 8, 8, 7]


def test_pairs_agree_by_hand(spark):
    side = lambda low, high, insert: {"low": F.lit(low), "high": F.lit(high), "length": F.lit(100), "insert": F.lit(insert)}
    a = side(0, 1000, 400)
    ask = lambda cls, b: pr.pairs_agree(F.lit(cls), a, b)
    # 300 + 100 - 0 is a's whole insert size; 301 is beyond it. Class 3 asks b's at the lower end.
    assert one(spark, ask(2, side(300, 1000, 100)), ask(2, side(301, 1000, 900)), ask(3, side(301, 1000, 900)), ask(3, side(300, 1000, 100)), ask(2, side(100, 50, 400)), ask(7, side(100, 900, 400)), ask(4, side(9999, 9999, 1))) == [True, False, True, False, False, True, True]
    # The upper ends: ahead of a's in class 2 by b's insert size, behind by a's; the other way round in class 0.
    assert one(spark, ask(2, side(0, 1200, 300)), ask(2, side(0, 1200, 299)), ask(2, side(0, 700, 1)), ask(0, side(0, 700, 399)), ask(0, side(0, 700, 400)), ask(0, side(0, 1200, 1))) == [True, False, True, False, True, True]


def test_alleles_and_names_by_hand(spark):
    lit = F.lit
    got = one(spark, pr.plain_alt(lit("RyQ")), pr.plain_alt(lit("<RY>R")), pr.plain_alt(lit("R[1:9[R,R")), pr.plain_alt(lit("]1:9]R,<Y>R")), pr.subtype(lit("<INS:ME:ALU:TR>")), pr.subtype(lit("X")), pr.decode_class(lit("DUP:T"), lit(None).cast("string")), pr.decode_class(lit("BND"), lit("x")),
              pr.without_haplotype(lit("S.hap1")), pr.without_haplotype(lit(".1")), pr.without_haplotype(lit("S.1.2")), pr.common_name(lit("S_1.hap1"), lit("S_1.hap2")), pr.common_name(lit("S.1.h1"), lit("T.h2")), pr.common_name(lit("S1."), lit("S1.")))
    assert got == ["ACN", "<RY>A", "A[1:9[R,R", "]1:9]R,<Y>A", 1, 0, 3, -1, "S", ".1", "S.1", "S_1.hap", "S.1", "S1"]


def test_copies_and_quality(spark):
    lit = F.lit
    w = pr.window_copies(lit(30.0), lit(10.0), lit(0.5), lit(2), lit(2), lit(False))
    none = pr.window_copies(lit(30.0), lit(0.0), lit(0.5), lit(2), lit(2), lit(True))
    pl = lambda *x: F.array(*map(lit, x))
    q = lambda *x: pr.posterior_quality(pl(*x), pl(0.5, 0.3, 0.2))
    got = one(spark, w, none, q(0, 300, 300), q(0, 0, 0), pr.percentage(lit(1), lit(8)), pr.percentage(lit(0), lit(0)), pr.tandem_period(lit("ACACACACACAC")), pr.tandem_period(lit("ACAC")), pr.tandem_period(lit("ABCDEFGHIJKL")))
    assert (round(got[0].log_ratio, 6), got[0].cn) == (1.494765, 10.0) and tuple(got[1]) == (0.0, 1.0)
    assert got[2] == 99.0 and abs(got[3] - 3.0103) < 1e-4 and got[4:] == [13, -1, 2, 0, 0]


def test_junctions_by_hand(spark):
    reads = spark.createDataFrame([(1, 1, 100, False, 60, "10S20M30D20M5H"), (2, 1, 100, True, 60, "10S20M"), (3, 1, 0, False, 60, "5M4I5M")], "read int, chrom int, pos int, reverse boolean, qual int, cigar string")
    got = {(r.read, r.refpos, r.seqpos, r.forward, r.left) for r in rd.junctions(reads, 3, 4).collect()}
    assert got == {(1, 100, 10, True, True), (1, 120, 30, True, False), (1, 150, 30, True, True), (1, 170, 50, True, False), (2, 100, 20, False, True), (3, 5, 5, True, False), (3, 5, 9, True, True)}
    at = rd.break_places(reads.withColumn("size", F.lit(160)), 3, 4)
    assert sorted((r.read, r.place) for r in at.collect()) == [(1, 100), (1, 120), (1, 150), (2, 100)]


def test_events_by_hand(spark):
    cols = "read int, chrom int, refpos long, seqpos long, forward boolean, `left` boolean, qual long"
    deletion = [(1, 1, 100, 50, True, False, 60), (1, 1, 400, 50, True, True, 41)]
    duplication = [(2, 1, 100, 50, True, True, 60), (2, 1, 400, 50, True, False, 60)]
    inversion = [(3, 1, 100, 50, True, False, 60), (3, 1, 400, 50, False, False, 60)]
    insertion = [(4, 1, 100, 50, True, False, 60), (4, 1, 102, 150, True, True, 60)]
    other = [(5, 1, 100, 50, True, False, 60), (5, 2, 400, 50, True, True, 60)]
    got = {r.read: (r.cls, r.pos, r.pos2, r.qual, r.length) for r in rd.events(spark.createDataFrame(deletion + duplication + inversion + insertion + other, cols), 15, 40).collect()}
    assert got == {1: (2, 100, 400, 50, 0), 2: (3, 100, 400, 60, 0), 3: (0, 100, 400, 60, 0), 4: (4, 100, 102, 60, 98)}


def test_depth_by_hand(spark):
    reads = spark.createDataFrame([(1, 0, 10), (1, 5, 15), (1, 995, 1005)], "chrom int, s long, e long")
    sv = spark.createDataFrame([(1, 1, 4, 8, False), (2, 1, 900, 1100, False), (3, 1, 20, 21, True), (4, 2, 5, 9, False)], "id int, chrom int, s long, e long, point boolean")
    got = {r.id: (r.rc_l, r.rc_m, r.rc_r) for r in dp.depth_triple(sv, reads, 50, 10).collect()}
    assert got == {1: (2, 7, 4), 2: (0, 1, 0), 3: (5, 5, 0), 4: (0, 0, 0)}


def test_curve_clusters_and_runs(spark):
    c = dp.gc_curve(spark.createDataFrame([(1, 2, 4), (3, 2, 8)], "bin long, reference long, sample long"), 5, 0.05).orderBy("bin").collect()
    # Filled 2 2 4 4 4; weights 1 3 1 3 1.
    assert [round(r.coverage, 9) for r in c] == [2.0, round((2 + 12 + 4) / 8, 9), round((3 * 2 + 2 * 4 + 3 * 4) / 8, 9), 4.0, 4.0]
    assert [r.inside for r in c] == [True, True, True, False, False] and round(c[1].p_sample, 9) == round(1 / 3, 9)
    sites = spark.createDataFrame([(1, p, 2) for p in (1, 2, 3, 7, 20, 21)], "chrom int, pos long, depth long")
    assert dp.cpg_clusters(sites, 4).collect()[0].clusters == 2
    iv = spark.createDataFrame([(1, 0, 10), (1, 15, 20), (1, 90, 95)], "chrom int, s long, e long")
    assert [tuple(r) for r in dp.zero_runs(iv, 5).orderBy("s").collect()] == [(1, 10, 15, True), (1, 20, 90, False)]
    assert tuple(dp.count_bounds(spark.createDataFrame([(x,) for x in (1, 5, 6, 9)], "cov long")).collect()[0]) == (3, 9)


def plain_distance(a, b, free_start, free_end):
    row = [0 if free_start else j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row) if free_end else row[-1]


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(v for v in _common_row(x, b, row))]
    return row[-1]


def _common_row(x, b, row):
    left = 0
    for j, y in enumerate(b):
        left = row[j] + 1 if x == y else max(left, row[j + 1])
        yield left


def test_sequences_against_plain_tables(spark):
    r = random.Random(5)
    for _ in range(400):
        a, b = ("".join(r.choice("ACG") for _ in range(r.randrange(n))) for n in (12, 90))
        distance, lo, hi = sq.infix(a, b)
        assert distance == plain_distance(a, b, True, True) == plain_distance(a, b[lo:hi], False, False)
        assert min(sq.last_row(a, b, False)) == plain_distance(a, b, False, True) and sq.last_row(a, b, False)[-1] == plain_distance(a, b, False, False)
        assert sq.common_length(a, b) == plain_common(a, b)
    rows = rules.infix_distances(spark, DATA).toPandas()
    assert len(rows) and (rows.distance <= rows.prefix).all()


def test_collapse_against_a_plain_loop(spark):
    rows = [r.asDict() for r in rules._view(spark, DATA, rules._RED, "orders").collect()]
    near = lambda a, b: (a["chrom"] == b["chrom"] and a["svt"] == b["svt"] != "BND" and abs(a["s"] - b["s"]) <= 50 and (a["svt"] == "INS" or abs(a["e"] - b["e"]) <= 50)
                         and min(a["size"], b["size"]) >= 0.8 * max(a["size"], b["size"]))
    rank = lambda x: (x["precise"], x["called"], x["ac"], x["qual"])
    stand = []
    for x in sorted(rows, key=lambda x: (x["s"], x["id"])):
        x["gone"] = False
        for y in stand:
            if not y["gone"] and near(x, y):
                if rank(x) > rank(y):
                    y["gone"] = True
                else:
                    x["gone"] = True
                    break
        stand.append(x)
    want = {x["id"] for x in stand if not x["gone"]}
    got = [r.id for r in rules.redundant_collapse(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(rows)


@pytest.mark.parametrize("edges, want", [([(1, 2), (2, 3), (7, 9)], {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}), ([], {})])
def test_components(spark, edges, want):
    got = st.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want


def test_size_groups_and_least_length(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate((10, 60, 111, 400, 450, 520))], "component int, id int, size long")
    assert [r.grp for r in st.size_groups(s).orderBy("id").collect()] == [0, 0, 1, 2, 2, 2]
    chrom = spark.createDataFrame([(x,) for x in (50, 30, 15, 5)], "size long")
    assert [st.least_length(chrom, p).collect()[0].least for p in (0.4, 0.5, 0.95, 1.0)] == [50, 30, 5, 5]


def test_segments_runs_and_content(spark):
    seg = spark.createDataFrame([(1, 0, 100, 2.0, 1.0, 0.1), (1, 100, 400, 2.1, 0.5, 0.3), (1, 400, 500, 3.0, 1.0, 0.1), (1, 500, 600, -1.0, 1.0, 0.1), (1, 600, 700, -1.0, 1.0, 0.1), (2, 0, 10, 2.0, 1.0, 0.1)], "chrom int, s long, e long, cn double, mappable double, sd double")
    got = [(r.chrom, r.s, r.e, round(r.cn, 6), round(r.mappable, 6), round(r.sd, 6)) for r in dp.merged_segments(seg, 0.1).orderBy("chrom", "s").collect()]
    assert got == [(1, 0, 400, 2.075, 0.625, 0.25), (1, 400, 500, 3.0, 1.0, 0.1), (1, 500, 600, -1.0, 1.0, 0.1), (1, 600, 700, -1.0, 1.0, 0.1), (2, 0, 10, 2.0, 1.0, 0.1)]
    win = spark.createDataFrame([(1, i, i + 1, True, c, 10) for i, c in enumerate((9.0, 0.0, 0.5, 9.0, 0.0, 3.0))], "chrom int, s long, e long, valid boolean, cov double, expected long")
    assert [(r.s, r.e, r.state, r.masked) for r in dp.loss_runs(win, 2).orderBy("s").collect()] == [(0, 1, "strong", False), (1, 3, "low", False), (3, 4, "strong", False), (4, 5, "low", True), (5, 6, "other", False)]
    gc = dp.gc_content(spark.createDataFrame([(1, "GATTACAg"), (2, "C")], "chrom int, seq string"), 1, 3)
    assert [(r.chrom, r.pos, r.gc) for r in gc.orderBy("chrom", "pos").collect()] == [(1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 0), (1, 4, 1), (1, 5, 1), (1, 6, 2), (1, 7, 0), (2, 0, 0)]


def test_size_groups_with_nulls_and_twins(spark, tmp_path):
    """Sites without size are in the last group, as in SQL; rows equal in all the columns of the order are in one group."""
    line = spark.createDataFrame([(1, 1, 1.0), (1, 2, 40.0), (1, 2, 40.0), (1, 3, None), (2, 1, None), (None, 1, 5.0), (None, 2, 50.0)], "l_orderkey long, l_linenumber int, l_quantity double")
    line.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, rules.size_groups(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"set threads = 1; create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.oracle_sql()["size_groups"]).fetchall(), key=str) and (1, 3, None, 1) in got and got.count((1, 2, 400, 1)) == 2


def test_segments_pass_in_batches(spark):
    """A chromosome of many segments reaches Python in batches, never whole, with the rows of a plain fold."""
    r = random.Random(4)
    rows = [(c, 10 * i, 10 * i + 10, r.choice([0.0, 2.0, 2.1, 3.0, -1.0, None]), 1.0, r.choice([0.5, None])) for c in (1, 2) for i in range(500)]
    want = []
    for x in map(list, rows):
        p = want[-1] if want else None
        if p and p[0] == x[0] and None not in (p[3], x[3]) and min(p[3], x[3]) >= 0 and abs(math.log2(max(p[3], 0.03) / max(x[3], 0.03))) < 0.1:
            n = p[2] - p[1]
            p[3:], p[2] = [None if None in (a, b) else (a * n + b * 10) / (n + 10) for a, b in zip(p[3:], x[3:])], x[2]
        else:
            want.append(x)
    seg = spark.createDataFrame(rows, "chrom int, s long, e long, cn double, mappable double, sd double").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = dp.merged_segments(seg, 0.1)
        got, plan = [list(x) for x in out.orderBy("chrom", "s").collect()], out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and "FlatMapGroups" not in plan and len(want) < len(rows)


def test_band_components_without_pairs(spark):
    """Many rows in one band make no pairs; ids in several runs join them, twins alone make no component."""
    r = random.Random(6)
    rows = [(i % 90, i % 2, r.randrange(4000)) for i in range(150)] + [(200, 0, 9000), (200, 0, 9000), (201, 0, 9500), (201, 0, 9510), (202, 1, None)]
    link = {}
    for i, (x, c, p) in enumerate(rows):
        for j, (y, d, q) in enumerate(rows):
            if i != j and c == d and None not in (p, q) and abs(p - q) <= 10 and (p != q or x != y):
                link.setdefault(x, set()).add(y)
    want = {}
    for x in sorted(link):
        todo = [x]
        while todo:
            if (y := todo.pop()) not in want:
                want[y] = x
                todo += link[y]
    sites = spark.createDataFrame(rows, "id long, chrom int, pos long")
    got = st.band_components(sites, ["chrom"], "pos", 10).collect()
    assert {x.node: x.component for x in got} == want and len(got) == len(want) > 30 and 201 in want and 200 not in want
    dense = st.band_components(spark.range(3000).selectExpr("id", "1 chrom", "id % 7 pos"), ["chrom"], "pos", 10)
    assert "Join" not in dense._jdf.queryExecution().toString() and {tuple(x) for x in dense.collect()} == {(i, 0) for i in range(3000)}


def test_depth_against_plain_sums(spark):
    """Events and reads across stretches, empty and repeated ones, by plain sums; no pairs of windows and reads are made."""
    r = random.Random(8)
    place = lambda: r.choice([0, dp.BIN, 2 * dp.BIN]) + r.randrange(-300, 300)
    reads = [(r.choice(["1", "2", None]), s := max(0, place()), s + r.choice([0, 1, 40, 500, 3 * dp.BIN])) for _ in range(300)] + [("1", 500, 400)]
    sv = [(i % 110, r.choice(["1", "2", "3", None]), s := max(0, place()), s + r.choice([0, 1, 30, 900, 2 * dp.BIN]), r.choice([True, False, None])) for i in range(120)]
    want = {i: [0, 0, 0] for i, *_ in sv}
    for i, c, s, e, point in sv:
        h = 60 if point else (e - s) // 2
        low = max(s - h, 0)
        for k, (x, y) in enumerate([(low, s), (low, s + h) if point else (s, e), (s, s + h) if point else (e, e + h)]):
            on = [(a, b) for d, a, b in reads if c is not None and d == c]
            if point or e - s <= 50:
                want[i][k] += sum(max(0, min(b, y) - max(a, x)) for a, b in on) if y > x else 0
            elif point is not None:
                want[i][k] += sum(x <= (a + b) // 2 < y for a, b in on)
    frame = lambda rows, cols: spark.createDataFrame(rows, cols).repartition(5)
    out = dp.depth_triple(frame(sv, "id int, chrom string, s long, e long, point boolean"), frame(reads, "chrom string, s long, e long"), 50, 60)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {x.id: [x.rc_l, x.rc_m, x.rc_r] for x in got} == want and len(got) == len(sv) and any(sum(v) for v in want.values())
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the events' ids alone


def test_collapse_in_order_of_place(spark):
    """Crowded sites in one stretch and in several: as by pairs and components, of which the plan has neither."""
    r = random.Random(9)
    rows = [(i, i % 2, r.choice(["DEL", "INS", "BND"]), s := r.randrange(3000) + r.choice([0, 40000]), s + r.randrange(100, 160), r.choice([0, 100, 110, 130, None]), r.random() < 0.5, r.randrange(3), r.randrange(3), r.random()) for i in range(1500)]
    sites = spark.createDataFrame(rows, "id long, chrom int, svt string, s long, e long, size long, precise boolean, called int, ac int, qual double").repartition(6)
    want = {x.id for x in st.collapsed(sites, st.near_sites(sites, 50, 0.8)).collect()}
    out = st.collapsed_near(sites, 50, 0.8)
    got = [x.id for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) < 1200
    plan = rules.redundant_collapse(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "LogicalRDD" not in plan  # stretches of bins, and those gone
