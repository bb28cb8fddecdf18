import math

import pytest
from pyspark.sql import functions as F

from svspark.functions import scalars as sc
from svspark.operators import calls as op
from svspark.sources import text as src


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).collect()[0]


def test_scalars_by_hand(spark):
    lit = F.lit
    r = one(spark, sc.entropy(lit("ACGT")), sc.entropy(lit("AAAA")), sc.entropy(lit("")), sc.min_rotation(lit("CGA")), sc.min_rotation(lit("")), sc.reverse_complement_in_place(lit("AXCG")),
            sc.pair_type(lit(0x20), lit(5), lit(5)), sc.pair_type(lit(0x10), lit(5), lit(5)), sc.pair_type(lit(0x10), lit(6), lit(5)), sc.rounded_depth(lit(30), lit(10), lit(20)), sc.rounded_depth(lit(30), lit(0), lit(0)))
    assert [round(x, 9) for x in r[:3]] == [2.0, 0.0, 0.0]
    # The X meets the C of the other end; the other end's X leaves the own letter.
    assert list(r[3:6]) == ["ACG", "", "CGCT"] and list(r[6:]) == [3, 3, 2, 2, -1]


def test_tails(spark):
    r = one(spark, sc.chi_square_tail(F.lit(3.841458820694124)), sc.chi_square_tail(F.lit(0.0)), sc.normal_density(F.lit(1.0), F.lit(1.0), F.lit(0.5)))
    assert abs(r[0] - 0.05) < 1e-6 and abs(r[1] - 1) < 1e-6 and abs(r[2] - 2 / math.sqrt(2 * math.pi)) < 1e-12


def test_genotype_by_formula(spark):
    arr = lambda x: F.lit(x) if x else F.array().cast("array<int>")
    got = one(spark, *(sc.genotype(arr(r), arr(a)) for r, a in (([30, 30], []), ([], [30, 30]), ([], []), ([30], [30]))))
    assert [g.gt for g in got] == ["0/0", "1/1", "./.", "0/1"] and got[2].gq == 0
    ref = 2 * math.log10(0.999)
    assert got[0].pl_ra == round(-10 * (-2 * math.log10(2) - ref)) and got[0].pl_rr == 0 and got[0].pl_aa == round(-10 * (2 * math.log10(0.001) - ref))


def test_population_frequencies(spark):
    sure = lambda k: [1.0 if i == k else 1e-9 for i in range(3)]
    rows = [(1, *sure(k)) for k in [0] * 49 + [1] * 42 + [2] * 9]
    r = op.population(spark.createDataFrame(rows, "site int, l0 double, l1 double, l2 double"), rounds=100).collect()[0]
    assert (r.af, r.gf_rr, r.gf_ra, r.gf_aa) == (0.3, 0.49, 0.42, 0.09) and abs(r.fic) < 1e-3 and r.hwe_p > 0.99


def test_somatic_needs_clean_controls(spark):
    cols = "site int, control boolean, gt int, precise boolean, rr int, rv int, dr int, dv int, rc int, rcl int, rcr int"
    tumor = (False, 1, True, 10, 10, 0, 0, 30, 10, 10)
    rows = [(1, True, 0, True, 20, 0, 0, 0, 20, 10, 10), (1, *tumor), (2, True, 0, True, 20, 1, 0, 0, 20, 10, 10), (2, *tumor), (3, True, 1, True, 20, 0, 0, 0, 20, 10, 10), (3, *tumor), (4, True, 0, True, 0, 0, 0, 0, 20, 10, 10), (4, *tumor)]
    got = {r.site: (r.filter, r.rd_ratio) for r in op.somatic(spark.createDataFrame(rows, cols)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "PASS", 2: "FailSomatic", 3: "FailSomatic", 4: "FailSomatic"} and got[1][1] == 1.5


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb
1\t100\tDEL1\tN\t<DEL>\t50.0\tPASS\tEND=200;PRECISE;SVTYPE=DEL\tGT:GQ\t0/1:30\t./.:.
2\t7\t.\tA\tA]1:9]\t.\tLowQual\t.\tGT:GQ\t0/0\t1/1:9
"""


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "in.vcf").write_text(VCF)
    v = src.read_vcf(spark, str(tmp_path / "in.vcf"))
    a, b = v.orderBy("chrom").collect()
    assert a.info == {"END": "200", "PRECISE": "", "SVTYPE": "DEL"} and a.samples[0].call == {"GT": "0/1", "GQ": "30"} and a.qual == 50.0
    assert b.id is None and b.qual is None and b.info == {} and b.samples[0].call == {"GT": "0/0", "GQ": "."}
    src.write_vcf(v, str(tmp_path / "out"), ["a", "b"], ["GT", "GQ"])
    again = src.read_vcf(spark, str(tmp_path / "out"))
    assert again.orderBy("chrom").collect() == [a, b]
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0].startswith("##fileformat") and lines[1].startswith("#CHROM") and [x.split("\t")[0] for x in lines[2:]] == ["1", "2"]


def test_region_and_sample_files(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert [tuple(r) for r in src.read_bed(spark, put("r.bed", "#x\nchr1\t5\t9\n")).collect()] == [("chr1", 5, 9)]
    assert sorted(map(str, map(tuple, src.read_exclude(spark, put("e.tsv", "chrY\nchr1 5;9,telomere\n")).collect()))) == ["('chr1', 5, 9)", "('chrY', None, None)"]
    for bad in ("chr1\t9\t5\n", "chr1\t9\n", "chr1\tx\t9\n"):
        with pytest.raises(Exception, match="invalid exclude region"):
            src.read_exclude(spark, put("bad.tsv", bad)).collect()
    assert sorted(map(tuple, src.read_samples(spark, put("s.tsv", "a\ttumor\nb\tcontrol\n")).collect())) == [("a", False), ("b", True)]
    for bad in ("a\tother\n", "a\ttumor\na\tcontrol\n"):
        with pytest.raises(Exception, match="tumor"):
            src.read_samples(spark, put("bad2.tsv", bad)).collect()


def test_sequence_and_graph_files(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert sorted(map(tuple, src.read_fasta(spark, put("a.fa", ">x one\nACG\nT\n>y\nGG\n")).collect())) == [("x", "ACGT"), ("y", "GG")]
    s, l = src.read_gfa(spark, put("g.gfa", "S\ts1\tACGT\nS\ts2\tGG\nL\ts1\t+\ts2\t-\t0M\n"))
    assert sorted(map(tuple, s.collect())) == [("s1", "ACGT"), ("s2", "GG")] and list(map(tuple, l.collect())) == [("s1", True, "s2", False)]
    src.write_gfa(s, l, str(tmp_path / "out"))
    assert [sorted(x.collect()) for x in src.read_gfa(spark, str(tmp_path / "out"))] == [sorted(s.collect()), sorted(l.collect())]
    g = src.read_gaf(spark, put("x.gaf", "r\t9\t0\t9\t+\t>s1<s2\t6\t0\t6\t5\t6\t60\tcg:Z:6M\n")).select("cigar", src.path_steps().alias("p")).collect()[0]
    assert g.cigar == "6M" and [tuple(x) for x in g.p] == [(True, "s1"), (False, "s2")]
