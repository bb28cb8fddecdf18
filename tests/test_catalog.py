import duckdb
import pytest
from pyspark.sql import functions as F

from svspark.operators import intervals
from svspark.plans import catalog, faithful, rules  # noqa: F401  register their queries

DATA = "/root/testdata/sf0.001"


def rows(frame):
    c = sorted(frame.columns)
    return sorted(map(str, frame[c].astype(object).where(frame[c].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(con.sql(catalog.oracle_sql()[name]).df())


def test_islands_and_complement_by_hand(spark):
    iv = spark.createDataFrame([(1, 5, 10), (1, 8, 12), (1, 12, 15), (1, 20, 21)], "chrom int, s long, e long")
    assert sorted(map(tuple, intervals.islands(iv).collect())) == [(1, 5, 15), (1, 20, 21)]
    assert sorted(map(tuple, intervals.complement(iv).collect())) == [(1, 0, 4), (1, 15, 19)]
    assert [tuple(r) for r in intervals.depth_runs(iv).orderBy("s").collect()] == [(1, 5, 8, 1), (1, 8, 10, 2), (1, 10, 12, 1), (1, 12, 15, 1), (1, 20, 21, 1)]


def test_breakpoints_of_all_intervals(spark):
    rows = [(1, 100, 300, 1), (1, 120, 160, 2), (1, 990, 1100, 2), (2, 100, 110, 1), (1, 120, 2500, 3)]
    want = {(c, s + 50): n for c, s, _, _ in rows if (n := sum(x == c and a <= s + 50 < b for x, a, b, _ in rows))}
    got = intervals.spanning(spark.createDataFrame(rows, "chrom int, s long, e long, ln int")).collect()
    assert {(r.chrom, r.bp): r.spanning for r in got} == want and (1, 1040) in want


def test_identity_of_whole_sequences(spark, tmp_path):
    a = "ACGT" * 20
    want = a[:70] + "TTTTTTTTTT"
    spark.createDataFrame([(1, a), (2, want)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    row = list(range(81))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(want, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    assert [(r.ed, r.identity) for r in catalog.queries()["edit_identity"](spark, str(tmp_path)).collect()] == [(row[-1], round(1 - row[-1] / 80, 6))] and row[-1] > 0


@pytest.mark.parametrize("n", [1, 3, 4])
def test_dense_numbers_in_several_ranges(spark, tmp_path, n):
    line = "id % 9000 l_partkey; id l_orderkey; 1 l_linenumber; 1L l_suppkey; 1D l_quantity; (id % 11) / 100D l_discount; 'F' l_linestatus; 'A' l_returnflag"
    part = spark.range(20000).selectExpr(*line.split("; "))
    part.union(part.limit(1).withColumn("l_partkey", F.lit(None).cast("long"))).write.parquet(str(tmp_path / "lineitem.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = catalog.queries()["dense_numbers"](spark, str(tmp_path)).select("site", "nr").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(((r.site is None, r.site or 0), r.nr) for r in got) == [((False, i), i + 1) for i in range(9000)] + [((True, 0), 9001)]
