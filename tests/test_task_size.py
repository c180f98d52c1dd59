"""Rows per task, and tables that are read several times."""

import re

import pytest

import __spark_entry__ as entry
from juncture.operators import annotation as A
from juncture.operators import barcodes as B
from juncture.operators import pairs as P
from juncture.operators.reference import reference_chunks
from juncture.plans import fixtures, registry
from juncture.plans.scoring import stub_ensemble

SF = "/root/testdata/sf0.001"


def _tasks(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("view", ["fx_bc", "fx_bcs", "fx_reads_bc", "fx_subasm_bc"])
def test_reads_are_dealt_by_rows(spark, monkeypatch, view):
    t = registry.Tables(spark, SF)
    monkeypatch.setattr(registry, "TASK_BYTES", 1 << 40)
    assert t.tasks("lineitem") == 1 == _tasks(t(view))
    monkeypatch.setattr(registry, "TASK_BYTES", 10_000)
    assert 8 < t.tasks("lineitem") == _tasks(t(view))


@pytest.mark.parametrize("view", ["fx_long", "fx_tbv", "fx_null"])
def test_variants_and_null_count_reads_that_are_dealt_by_rows(spark, monkeypatch, view):
    """Both sides of the join of reads and barcodes; a number that is given is not joined up again by adaptive execution."""
    monkeypatch.setattr(registry, "TASK_BYTES", 10_000)
    t = registry.Tables(spark, SF)
    plan = t(view)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {t.tasks('lineitem')}), REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("name", ["combine_isoform_groups", "barcode_isoform_counts_se"])
def test_barcode_counts_are_made_in_as_many_tasks_as_rows_ask_for(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "TASK_BYTES", 5_000)
    wanted = registry.Tables(spark, SF).tasks("lineitem")
    assert wanted > 8 and _tasks(entry.queries()[name](spark, SF)) >= wanted


def test_views_for_spark_have_the_rows_of_the_views(spark, tmp_path):
    """Barcodes of several orders, variants, samples and statuses; null keys."""
    reads = [("b1", "S0", None, "[]"), ("b1", "S0", None, "[]"), ("b1", "S1", None, "[[1267,1359]]"), ("b1", "S1", "unmapped", None), ("b2", "S0", None, None),
             ("b2", None, None, "[]"), (None, "S0", None, "[]"), ("b3", "S1", None, "[[1267,1350]]"), ("b4", "S1", None, "[]")]
    subasm = [("b1", 1, "v1"), ("b1", 1, "v1"), ("b1", 1, "v2"), ("b2", 1, "v1"), ("b2", 2, "v2"), (None, 1, "v1"), ("b3", 1, None), ("b5", 1, "v1")]
    spark.createDataFrame(reads, "barcode string, sample string, status string, isoform string").createOrReplaceTempView("own_reads")
    spark.createDataFrame(subasm, "barcode string, n_variants_passing int, variant_list string").createOrReplaceTempView("own_subasm")
    own = {"fx_reads": "select * from own_reads", "fx_subasm": "select * from own_subasm"}
    for name in ("fx_bc", "fx_bcs", "fx_long"):
        plain, dealt = (spark.sql(fixtures.with_views(f"select * from {name}", [name], views | own).replace("{tasks}", "3")) for views in (fixtures.VIEWS, fixtures.SPARK_VIEWS))
        assert plain.columns == dealt.columns and plain.count() > 0
        assert plain.exceptAll(dealt).isEmpty() and dealt.exceptAll(plain).isEmpty()


def test_groups_meet_repeated_and_null_keys(spark):
    long = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 3.0), ("a", "x", 1.0), (None, "x", 5.0), ("c", "w", 4.0)], "barcode string, isoform string, n double")
    totals = spark.createDataFrame([("a", 10), ("a", 20), (None, 5), ("b", 0)], "barcode string, usable_reads long")
    mapping = spark.createDataFrame([("x", "G"), ("y", "H"), ("y", "G"), ("x", None)], "isoform string, `group` string")
    want = [("a", "G", 10, 6.0, 0.6), ("a", "G", 20, 6.0, 0.3), ("a", "H", 10, 3.0, 0.3), ("a", "H", 20, 3.0, 0.15), ("b", "G", 0, 0.0, 0.0), ("b", "H", 0, 0.0, 0.0),
            (None, "G", 5, 0.0, 0.0), (None, "H", 5, 0.0, 0.0)]
    for tasks in (None, 3):
        got = [tuple(r) for r in B.combine_isoform_groups(long, totals, mapping, tasks=tasks).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name, table", [
    ("bonferroni_calls", "lineitem"), ("stouffer_z_weighted", "lineitem"), ("window_delta_scan", "orders"), ("pairs_long", "orders"),
])
def test_inputs_read_several_times_are_written_once(spark, name, table):
    files = entry.queries()[name](spark, SF).inputFiles()
    assert files and not any(f"/{table}.parquet" in f for f in files)


def test_each_change_is_scored_once(spark):
    plan = entry.queries()["pair_effects"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan


def _joins(df, kind, key):
    """Joins by a key in the plan, the one that ran if ``df`` was collected."""
    return re.findall(rf"{kind}\w*Join \[[^]]*{key}#", df._jdf.queryExecution().executedPlan().toString())


def test_positions_pairs_and_single_changes_are_not_broadcast(spark):
    """Few exons have many positions and pairs, and single changes that are read back stand in small files."""
    seq = "ACGTTGCAAGGTCCATAGGT" * 20
    base = spark.createDataFrame([("c", i + 1, b) for i, b in enumerate(seq)] + [("c", None, "A")], "chrom string, pos int, base string")
    exons = spark.createDataFrame([("e1", "c", "+", 100, 104), ("e2", "c", "-", 200, 203), ("e1", "c", "+", 100, 104), ("e3", "c", "+", None, 9)], "exon string, chrom string, strand string, start_pos int, end_pos int")
    snvs = A.all_snvs(exons, base, ("exon", "strand"))
    one = lambda e, s, lo, hi: [(e, s, "c", p, seq[p - 1], a) for p in range(lo, hi + 1) for a in "ACGT" if a != seq[p - 1]]
    want = 2 * one("e1", "+", 101, 104) + one("e2", "-", 201, 203)
    assert sorted((r.exon, r.strand, r.chrom, r.pos, r.ref, r.alt) for r in snvs.collect()) == sorted(want)
    assert _joins(snvs, "SortMerge", "pos") and not _joins(snvs, "Broadcast", "pos")
    dnvs = A.all_dnvs(snvs, ("exon", "chrom", "strand"))
    assert len(dnvs.collect()) == sum(a[0] == b[0] and a[3] < b[3] for a in want for b in want)
    assert _joins(dnvs, "SortMerge", "_i") and not _joins(dnvs, "Broadcast", "_i")

    kinds = "transcript_id string, name string, chrom string, strand string, tx_start int, tx_end int, exon_starts array<int>, exon_ends array<int>"
    annot = spark.createDataFrame([("t1", "g1", "c", "+", 90, 150, [100], [104]), ("t2", "g2", "c", "-", 190, 250, [200], [203])], kinds)
    bed = spark.createDataFrame([("E", 50, 350, 550, 10, 10)], "exon string, start_hg19 int, end_hg19 int, start_hg38 int, exon_len_hg19 int, exon_len_hg38 int")
    freqs = [spark.createDataFrame([("c", 101 + s, seq[100], "T", 1, 2, 0, 0.5)], f"chrom string, {k} int, ref string, alt string, n_alt int, n_allele int, n_homo int, af double") for k, s in (("hg19_pos", 0), ("hg38_pos", 500))]
    out = P.pair_effects(exons, base, reference_chunks(base), annot, bed, "E", 10, 20, stub_ensemble(), *freqs)["long"]
    got = [r.snv for r in out.collect()]
    assert (got.count(True), got.count(False)) == (len(want), dnvs.count())
    assert _joins(out, "SortMerge", "_bin")


def test_positions_are_not_broadcast_to_meet_the_barcodes(spark):
    plan = entry.queries()["pair_effects"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [(o_custkey" in plan and "BroadcastHashJoin [(o_custkey" not in plan
