"""Ranks, curves, draws and windows against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from juncture.functions import sequence as S
from juncture.operators import evaluation as E
from juncture.operators import ordering as O
from juncture.operators import reference as R
from juncture.operators import statistics as T
from juncture.sources import sinks


def test_running_totals_over_many_buckets(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randint(0, 300)) ** 3, rng.randint(1, 5)) for _ in range(900)]
    hist = spark.createDataFrame(rows, "k string, v double, n int").groupBy("k", "v").agg(F.sum("n").alias("n"))
    got = {(r.k, r.v): (r.c, r.low) for r in O.with_running(hist, "v", {"n": "c"}, ["k"], below="low", buckets=16).collect()}
    for k in "ab":
        values = sorted({v for kk, v, _ in rows if kk == k})
        for i, v in enumerate(values):
            total = sum(n for kk, x, n in rows if kk == k and x >= v)
            assert got[(k, v)] == (total, values[i - 1] if i else None)


def test_number_rows_is_a_permutation_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = O.number_rows(df, [-F.col("x")], "n").collect()
    assert sorted((r.n, r.x) for r in got) == [(i + 1, 999 - i) for i in range(1000)]


def test_index_rows_covers_every_index_once(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    got = T.index_rows(df, "k", ["g"]).groupBy("g").agg(F.collect_list("idx").alias("i"), F.count("*").alias("n")).collect()
    assert all(sorted(r.i) == list(range(r.n)) for r in got)


def test_hashed_draws_are_uniform_and_repeatable(spark):
    df = spark.range(20000).select(T.hashed_draw(5)(F.lit(9), F.col("id"), F.lit(0), F.lit(10)).alias("i"))
    counts = [r["count"] for r in df.groupBy("i").count().orderBy("i").collect()]
    assert len(counts) == 10 and max(counts) < 1.15 * min(counts)
    assert df.agg(F.sum("i")).first() == df.agg(F.sum("i")).first()


def test_rank_cutoff_matches_a_full_sort(spark):
    rng = random.Random(2)
    reads = [rng.choice([1, 1, 2, 3, 5, 8, 40]) for _ in range(500)]
    df = spark.createDataFrame([(r,) for r in reads], "n int")
    got = {r.percentile: (r.x, r.y) for r in T.rank_cutoff(df, "n", [10, 75, 95]).collect()}
    ordered, total = sorted(reads, reverse=True), sum(reads)
    for p in (10, 75, 95):
        run = 0
        for i, v in enumerate(ordered):
            run += v
            if 100 * run / total >= p:
                assert got[float(p)] == (pytest.approx(math.log10(i + 1)), v)
                break


@pytest.mark.parametrize("table,odds,p", [((8, 2, 1, 5), 20.0, 0.03497), ((3, 1, 1, 3), 9.0, 0.48571), ((10, 0, 0, 10), math.inf, 1.0825e-05)])
def test_fisher_known_tables(table, odds, p):
    got = T.fisher_exact()(*table)
    assert got[0] == odds and got[1] == pytest.approx(p, rel=1e-3)


def test_curves_match_direct_counting(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.4, float(rng.randint(-6, 6))) for _ in range(120)]
    df = spark.createDataFrame(rows, "t boolean, x double")

    def auc(form):
        f = {"raw": lambda v: v, "neg": lambda v: -v, "abs": abs}[form]
        pos = [f(x) for t, x in rows if t]
        neg = [f(x) for t, x in rows if not t]
        return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)

    best = max(["raw", "neg", "abs"], key=auc)
    got = E.roc_curve(df, "t", ["x"]).first()
    assert got.form == best and got.auc == pytest.approx(auc(best))


def contig(spark, n=3000):
    return spark.createDataFrame([("c", i + 1, "ACGTTGCAAC"[i * i % 10]) for i in range(n)], "chrom string, pos int, base string")


def test_windows_across_chunk_edges_and_contig_ends(spark):
    base = contig(spark)
    text = "".join(r.base for r in base.orderBy("pos").collect())
    rows = spark.createDataFrame([("c", p) for p in (1, 3, 63, 64, 65, 128, 2999, 3000, 3050)], "chrom string, pos int")
    chunks = R.reference_chunks(base, chunk=64, flank=16)
    for r in R.with_window(rows, chunks, 7, 9, chunk=64, flank=16).collect():
        want = "".join(text[i - 1] if 1 <= i <= 3000 else "N" for i in range(r.pos - 7, r.pos + 10))
        assert r.window == want
    whole = spark.createDataFrame([("c", text)], "name string, seq string")
    again = R.with_window(rows, R.chunk_sequences(whole, 64, 16), 7, 9, chunk=64, flank=16)
    assert {(r.pos, r.window) for r in again.collect()} == {(r.pos, r.window) for r in R.with_window(rows, chunks, 7, 9, chunk=64, flank=16).collect()}


def test_window_wider_than_the_flank_is_refused(spark):
    with pytest.raises(ValueError):
        R.with_window(contig(spark, 10), R.reference_chunks(contig(spark, 10)), 300, 0)


def test_kmers_worked_example(spark):
    df = spark.createDataFrame([("GGCATGTAACT",)], "s string")
    assert df.select(S.window_kmers("s", 6).alias("k")).first().k == ["GGCATG", "GCATGT", "CATGTA", "ATGTAA", "TGTAAC", "GTAACT"]
    assert spark.createDataFrame([("AC",)], "s string").select(S.kmers("s", 3).alias("k")).first().k == []


def test_genetic_code():
    code = S.codon_table()
    assert len(code) == 64 and code["ATG"] == "M" and code["TGG"] == "W"
    assert sorted(c for c, a in code.items() if a == "X") == ["TAA", "TAG", "TGA"]


def test_apply_variant_refuses_another_reference(spark):
    df = spark.createDataFrame([("ACGT", 2, "C", "TT")], "s string, p int, r string, a string")
    assert df.select(S.apply_variant("s", "p", "r", "a").alias("x")).first().x == "ATTGT"
    with pytest.raises(Exception, match="reference mismatch"):
        df.select(S.apply_variant("s", F.lit(1), "r", "a")).collect()


def test_long_ranges_explode_in_steps(spark):
    df = spark.createDataFrame([(5, 25000), (7, 7)], "a int, b int")
    out = sinks.explode_range(df, "a", "b", "p")
    assert out.count() == 24997 and out.agg(F.min("p"), F.max("p")).first() == (5, 25000)


def test_bedgraph_gap_is_an_error(spark):
    from juncture.operators.annotation import expand_bedgraph

    bg = spark.createDataFrame([("1", 0, 5, 1.0), ("1", 6, 9, 2.0)], "chrom string, start_pos int, end_pos int, value double")
    with pytest.raises(Exception, match="gaps"):
        expand_bedgraph(bg).collect()


def test_splice_flags_use_both_neighbours(spark):
    # positions 1..6 read A G T A T C
    base = spark.createDataFrame([("c", i + 1, b) for i, b in enumerate("AGTATC")], "chrom string, pos int, base string")
    tbv = spark.createDataFrame([("c", p, "AGTATC"[p - 1], a, True) for p in range(1, 7) for a in "ACGT" if a != "AGTATC"[p - 1]], "chrom string, pos int, ref string, alt string, sdv boolean")
    got = {(r.pos, r.alt): r for r in R.splice_dinucleotide_flags(tbv, R.reference_chunks(base), "sdv").collect()}
    assert got[(1, "C")].wt_acc and got[(2, "C")].wt_acc and got[(2, "C")].wt_don and got[(3, "C")].wt_don
    assert got[(5, "G")].psbl_snv_acc and not got[(4, "G")].psbl_snv_acc
    assert not got[(4, "G")].psbl_snv_don  # A at the front decides before the T at the end


def test_pair_effects_keep_singles_and_pairs_apart(spark):
    import __spark_entry__ as entry

    out = entry.queries()["pair_effects"](spark, "/root/testdata/sf0.01")
    r = out.groupBy("snv").agg(F.count("*").alias("n"), F.count("pos_snv2").alias("m"), F.count("splai_cat").alias("c")).collect()
    by = {x.snv: x for x in r}
    assert by[True].m == 0 and by[False].m == by[False].n and all(x.c == x.n for x in r)


def test_kmers_are_cut_in_one_pass(spark):
    texts = ["", "abc", "abcd", "a\nb\r cde", "x\U0001f600yz\U0001f600\U0001f601w", "\u00e9e\u0301abc", "\x00ab\u0085cd", "ab" * 9]
    for k in (1, 4):
        got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", S.kmers("s", k).alias("k"))
        assert "transform" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert {r.s: r.k for r in got.collect()} == {t: [t[i : i + k] for i in range(len(t) - k + 1)] for t in texts}
    assert spark.createDataFrame([(None,)], "s string").select(S.kmers("s", 4).alias("k")).first().k == [None]
