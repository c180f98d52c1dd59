"""Exact quantiles, row numbers, outer merges, paths by rank, pair tiles, shapes and Fisher tails against brute force."""

import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from juncture.functions.coordinates import isoform_text
from juncture.operators import annotation as A
from juncture.operators import barcodes as B
from juncture.operators import evaluation as E
from juncture.operators import isoforms as I
from juncture.operators import ordering as O
from juncture.operators import paths as P
from juncture.operators import reads as R
from juncture.operators import reference as RF
from juncture.operators import relational as RL
from juncture.operators import statistics as T
from juncture.plans import load_all

CNST = ((649, 696), (3478, 3533))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# quantiles


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 1.0])
def test_exact_quantiles(spark, q):
    rng = random.Random(7)
    # a key with a third of all rows, ties, odd and even sizes, one value, nulls, a key without a value
    rows = [("hot", rng.choice([rng.random(), 0.5]), rng.randint(0, 9)) for _ in range(400)]
    rows += [(f"k{k}", float(rng.randint(-5, 5)), rng.randint(0, 3)) for k in range(40) for _ in range(k % 7 + 1)]
    rows += [("none", None, None), ("half", None, 4), ("half", None, 5)]
    df = spark.createDataFrame(rows, "k string, x double, n int").repartition(5)
    values = {"x": F.col("x"), "n": F.col("n")}
    got = {r.k: (r.x, r.n) for r in O.exact_quantiles(df, ["k"], values, q, buckets=32).collect()}
    assert got == {r.k: (r.x, r.n) for r in O.exact_quantiles(df, ["k"], values, q, buckets=8, span=(0.0, 2.0)).collect()}
    assert set(got) == {k for k, x, n in rows if x is not None or n is not None}
    for k, pair in got.items():
        for have, values in zip(pair, ([x for kk, x, _ in rows if kk == k and x is not None], [n for kk, _, n in rows if kk == k and n is not None])):
            assert have == (pytest.approx(float(np.quantile(values, q))) if values else None)


def test_exact_quantiles_without_keys(spark):
    df = spark.createDataFrame([(3.0,), (None,), (1.0,), (8.0,), (2.0,)], "x double")
    assert O.exact_quantiles(df, [], {"m": F.col("x")}).collect()[0].m == 2.5
    assert O.exact_quantiles(df.filter("x > 2"), [], {"m": F.col("x")}, buckets=4).collect()[0].m == 5.5
    assert O.exact_quantiles(df.filter("x > 99"), [], {"m": F.col("x")}).collect()[0].m is None


def test_no_median_keeps_a_groups_values_in_one_buffer(spark):
    sa = spark.createDataFrame([("b1", 1, "1:5:A:C"), ("b2", 1, "1:5:A:C"), ("b3", 1, "1:5:A:C")], "barcode string, n_variants_passing int, variant_list string")
    rna = spark.createDataFrame(
        [("b1", 10, 10, 0, 0, 0, 0, 0, 1), ("b2", 10, 10, 0, 0, 0, 0, 0, 4), ("b3", 10, 8, 0, 0, 0, 0, 0, 8)],
        "barcode string, num_reads int, usable_reads int, unmapped_reads int, bad_starts int, bad_ends int, soft_clipped int, other_isoform int, A int",
    )
    many = B.variant_summary(sa, rna, 1, ["A"])
    wt = B.wildtype_summary(rna, 1, ["A"], "1")
    assert many.first().median_A == wt.first().median_A == 0.4
    low = B.low_barcode_samples(spark.createDataFrame([("s", 60), ("s", 40), ("t", 90)], "sample string, n_bc_passfilt int"))
    assert [r.sample for r in low.collect()] == ["t"]
    youden = E.youden_summary(spark.createDataFrame([("t", "a", 1.0), ("t", "b", 2.0), ("t", "standard", 9.0)], "tool string, data string, v double"), "v")
    assert youden.first().median == 1.5
    for df in (many, wt, low, youden):
        assert "percentile(" not in plan_of(df)


# row numbers


def test_number_rows_by_several_columns(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1.5, 2.5, 9.0]), f"{i % 50:02d}-{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, k string").repartition(6)
    got = O.number_rows(df, [F.col("v").isNull(), -F.col("v"), F.col("k")], "n", cuts=64)
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.v, r.k) for r in got.orderBy("n").collect()] == want
    assert O.number_rows(df.filter("k = ''"), [F.col("k")]).count() == 0


def test_building_numbered_queries_starts_no_job(spark):
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    queries = load_all()
    queries["variant_summary"].run(spark, "/root/testdata/sf0.001")
    before = jobs()
    for name in ("isoform_catalog", "collapse_isoforms", "benchmark_rank_join"):
        queries[name].run(spark, "/root/testdata/sf0.001")
    assert jobs() == before


# outer merge


def test_outer_merge_is_one_shuffle(spark):
    rng = random.Random(9)
    tables, want = {}, {}
    for name in "abc":
        rows = [(k, rng.randint(0, 9)) for k in rng.sample([None, *"pqrstu"], 4)]
        tables[name] = spark.createDataFrame(rows, "k string, n int")
        for k, n in rows:
            want.setdefault(k, {})[name] = n
    tables["b"] = tables["b"].union(tables["b"].selectExpr("k", "n + 5"))  # the smallest of repeated rows counts
    out = RL.outer_merge_suffix(tables, ["k"], ["n"])
    assert plan_of(out).count("Exchange hashpartitioning") == 1
    assert {r.k: (r.n_a, r.n_b, r.n_c, r.total_n) for r in out.collect()} == {k: (v.get("a"), v.get("b"), v.get("c"), sum(v.values())) for k, v in want.items()}


# paths


def brute_paths(exons):
    exons = sorted(exons)
    start, end = exons[0][1], exons[-1][2]
    out = []

    def walk(path):
        if path[-1][2] == end:
            out.append(path)
        for e in exons:
            if e[1] > path[-1][2]:
                walk([*path, e])

    for e in exons:
        if e[1] == start:
            walk([e])
    return sorted(out, key=lambda p: [e[0] for e in p])


def test_paths_by_rank_match_recursion():
    rng = random.Random(2)
    for _ in range(60):
        exons = []
        for i in range(rng.randint(1, 9)):
            s = rng.randint(1, 60)
            exons.append((i + 1, s, s + rng.randint(0, 12)))
        if rng.random() < 0.7:
            exons = [(i + 1, s, e) for i, (_, s, e) in enumerate(sorted(exons, key=lambda e: e[1:]))]
        graph, want = P.whole_paths(exons, None), brute_paths(exons)
        assert graph.total == len(want) and list(graph.paths(0, 10**9)) == want
        for rank in range(0, len(want), 3):
            assert list(graph.paths(rank, 2)) == want[rank : rank + 2]


def test_a_gene_of_150_exons_has_paths_at_any_rank(spark):
    rows = [("g", i + 1, 10 * i + 1, 10 * i + 5) for i in range(150)]
    ex = spark.createDataFrame(rows, "gene string, exon_num int, start_pos int, end_pos int")
    assert P.whole_paths([r[1:] for r in rows], None).total == 2**148
    ranks = spark.createDataFrame([("g", 0, 2), ("g", 2**60, 1)], "gene string, first long, number long")
    got = {r.iso: [tuple(b) for b in r.path] for r in I.exon_path_enumeration(ex, ranks=ranks).collect()}
    assert got["iso00"] == [(s, e) for _, _, s, e in rows]
    assert got["iso01"] == [(s, e) for _, n, s, e in rows if n != 149]
    # a rank's binary digits say which of the inner exons are left out
    assert got[f"iso{2**60}"] == [(s, e) for _, n, s, e in rows if n != 89] and len(got) == 3
    with pytest.raises(Exception, match="ask for ranks"):
        I.exon_path_enumeration(ex).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit", None) != "-1"


def test_paths_of_one_gene_are_dealt_to_tasks(spark):
    rows = [("g", i + 1, 10 * i + 1, 10 * i + 5) for i in range(17)] + [("h", 1, 1, 5)]
    ex = spark.createDataFrame(rows, "gene string, exon_num int, start_pos int, end_pos int")
    paths = I.exon_path_enumeration(ex)
    assert paths.groupBy("gene").agg(F.countDistinct("iso").alias("n"), F.countDistinct("path").alias("p")).orderBy("gene").collect() == [("g", 2**15, 2**15), ("h", 1, 1)]
    assert paths.filter("gene = 'g'").select(F.spark_partition_id().alias("p")).distinct().count() > 3


# pair tiles


def test_pairs_of_a_long_exon_meet_by_tile(spark):
    rng = random.Random(4)
    rows = [(e, "1", p, "A", a) for e in ("x", "y") for p in rng.sample(range(1, 400), 60) for a in rng.sample("CGT", 2)]
    snvs = spark.createDataFrame(rows, "exon string, chrom string, pos int, ref string, alt string")
    got = sorted(tuple(r) for r in A.all_dnvs(snvs, block=16).collect())
    want = sorted((a[0], "1", *a[2:], *b[2:]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2])
    assert got == want and got == sorted(tuple(r) for r in A.all_dnvs(snvs).collect())


def test_windows_of_a_crowded_locus(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(300))
    base = spark.createDataFrame([("1", i + 1, b) for i, b in enumerate(seq)], "chrom string, pos int, base string")
    rows = [("1", rng.choice([150, 151, 2, 299, None, 5000]), i) for i in range(200)] + [("2", 5, 999), (None, 5, 998)]
    df = spark.createDataFrame(rows, "chrom string, pos int, i int")
    got = {r.i: r.window for r in RF.with_window(df, RF.reference_chunks(base, 64, 16), 3, 4, chunk=64, flank=16).collect()}
    at = lambda p: seq[p - 1] if 1 <= p <= len(seq) else "N"
    assert got == {i: "N" * 8 if c != "1" or p is None else "".join(at(q) for q in range(p - 3, p + 5)) for c, p, i in rows}


# shapes and single ends


def test_shapes_are_worked_out_once(spark):
    rows = [(f"q{i}", 65 + (64 if m else 0), 627 if not m else 1320, ("70M570N93M", "40M2119N60M")[m] if i % 5 else "*") for i in range(50) for m in (0, 1)]
    reads = spark.createDataFrame([("S", "B", *r) for r in rows], "sample string, barcode string, qname string, flag int, pos int, cigar string")
    got = R.normalize_junctions_pe(R.pair_reads(reads), CNST).groupBy("status", isoform_text("isoform").alias("iso")).count().collect()
    assert {(r.status, r.iso): r["count"] for r in got} == {(None, "[[1267,1359]]"): 40, ("unmapped", None): 10}
    lead = spark.createDataFrame([(10, "5S3D10M"), (10, "4M"), (10, "*"), (10, "3I2N1H7=")], "pos int, cigar string")
    got = lead.select(R.first_block_start(F.col("pos"), F.col("cigar")).alias("s"), F.get(R.cigar_to_blocks("pos", "cigar"), F.lit(0))["start"].alias("b")).collect()
    assert [r.s for r in got] == [r.b for r in got] == [12, 9, None, 11]
    blocks = R.with_blocks(lead.union(lead).withColumn("_shape", F.lit(1))).collect()
    assert len(blocks) == 8 and [tuple(b) for r in blocks if r.cigar == "4M" for b in r.blocks] == [(9, 13), (9, 13)]


def test_single_end_outcomes(spark):
    cases = [
        (0, 627, "70M570N93M2119N60M", None, "[[1267,1359]]"),
        (4, 627, "70M570N93M2119N60M", "unmapped", None),
        (0, 700, "90M", "bad_starts", None),
        (0, 627, "70M570N93M2200N60M", "bad_ends", None),
        (0, 677, "20M2781N30M", "soft_clipped", None),
        (0, 627, "*", "bad_starts", None),
    ]
    reads = spark.createDataFrame([("S", "B", i, *c[:3]) for i, c in enumerate(cases)], "sample string, barcode string, i int, flag int, pos int, cigar string")
    out = R.single_end_outcomes(reads, CNST, 3, 120).withColumn("isoform", isoform_text("isoform"))
    assert {r.i: (r.status, r.isoform) for r in out.collect()} == {i: c[3:] for i, c in enumerate(cases)}
    assert R.rejected_reads(out).count() == 5 and I.soft_clipped_reads(out).count() == 1
    assert {(r.isoform, r.read_count) for r in I.isoform_read_counts(out, keep_qc=False).collect()} == {("[[1267,1359]]", 1), ("unmapped", 1), ("bad_starts", 2)}


def test_borders_are_repaired_from_looked_up_bases(spark):
    # two bases beyond the donor read like the two before the next block ends
    seq = "".join(random.Random(8).choice("ACGT") for _ in range(4000))
    base = spark.createDataFrame([("c", i + 1, b) for i, b in enumerate(seq)], "chrom string, pos int, base string")
    chunks = RF.reference_chunks(base)
    rows = []
    for nxt in range(1000, 1400):
        rows.append((nxt, 0, [(600, 694), (nxt, nxt + 50), (3478, 3500)]))
        rows.append((nxt, 4, [(600, 694), (nxt, nxt + 50), (3478, 3500)]))
        rows.append((nxt, 0, [(600, 696), (nxt, nxt + 50), (3480, 3500)]))
    reads = spark.createDataFrame(rows, "nxt int, flag int, blocks array<struct<start:int,end:int>>")
    got = sorted((r.nxt, r.flag, [tuple(b) for b in r.blocks]) for r in R.repair_constant_junctions(reads, chunks, CNST, "c").collect())
    want = []
    for nxt, flag, b in rows:
        if not flag and b[0][1] == 694 and seq[694:696] == seq[nxt : nxt + 2]:
            b = [(600, 696), (nxt + 2, nxt + 50), b[2]]
        if not flag and b[2][0] == 3480 and seq[3478:3480] == seq[nxt + 48 : nxt + 50]:
            b = [b[0], (nxt, nxt + 48), (3478, 3500)]
        want.append((nxt, flag, b))
    assert got == sorted(want) and sum(a != b for a, b in zip(sorted(want), sorted(rows))) > 20


# Fisher


def plain_fisher(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    total = math.comb(n, col)
    p = [math.comb(row, k) * math.comb(n - row, col - k) for k in range(lo, hi + 1)]
    return sum(x for x in p if x <= p[a - lo] * (1 + 1e-7)) / total


def test_fisher_matches_whole_sums():
    rng = random.Random(6)
    test = T.fisher_exact()
    tables = [[rng.randint(0, m) for _ in range(4)] for m in (1, 3, 8, 30, 200) for _ in range(40)] + [[5, 5, 5, 5], [0, 0, 0, 0], [0, 9, 0, 4], [400, 3, 2, 500]]
    for t in tables:
        assert test(*t)[1] == pytest.approx(plain_fisher(*t), rel=1e-9, abs=1e-300)
    # symmetric tables tie exactly with their counterpart
    assert test(30, 70, 70, 30)[1] == pytest.approx(plain_fisher(30, 70, 70, 30), rel=1e-9)


def test_fisher_of_huge_counts_in_constant_memory():
    test = T.fisher_exact()
    tracemalloc.start()
    base = 10**9
    # margins alike: twice the upper tail of a normal with continuity correction
    for shift in (0, 8_000, 30_000, 60_000):
        p = test(base + shift, base - shift, base - shift, base + shift)[1]
        spread = math.sqrt((2 * base) ** 4 / ((4 * base) ** 2 * (4 * base - 1)))
        want = min(1.0, math.erfc((shift - 0.5) / spread / math.sqrt(2)))
        assert p == pytest.approx(want, rel=2e-3)
    assert test(2 * base, 10, 10, 2 * base)[1] == 0.0
    assert tracemalloc.get_traced_memory()[1] < 5 << 20
    tracemalloc.stop()


def test_motifs_are_named_by_proteins_of_the_species(spark):
    rows = [(m, p, p % 2 == 0, 0.9, -1.0 if p % 2 == 0 and p % 4 else -0.1) for m in ("m0", "m1") for p in range(80)]
    long = spark.createDataFrame(rows, "motif string, pos int, sdv boolean, wt double, chg double")
    names = spark.createDataFrame([("m0", "B", "Homo_sapiens"), ("m0", "A", "Homo_sapiens"), ("m0", "C", "Mus_musculus"), ("m1", "D", "Mus_musculus")], "motif string, protein string, species string")
    out = T.motif_enrichment(long, None, 0.5, -0.8, 0.05, names).collect()
    assert [(r.motif, r.name) for r in out] == [("m0", "A_B_m0")]
    assert out[0].p == pytest.approx(plain_fisher(20, 20, 0, 40))
    assert {r.motif for r in T.motif_enrichment(long, (0, 80), 0.5, -0.8, 0.05).collect()} == {"m0", "m1"}


# lists of variants


def test_every_filter_code_occurs(spark):
    got = load_all()["isoform_filter_code_lists"].run(spark, "/root/testdata/sf0.01").groupBy("filter").count().collect()
    assert {r["filter"] for r in got} == {0, 1, 2, 3, 4, 5}
    first = load_all()["isoform_filter_code_first_junction"].run(spark, "/root/testdata/sf0.01").groupBy("filter").count().collect()
    assert 3 not in {r["filter"] for r in first}


def test_resampled_curves_draw_rows_once(spark):
    # the joins of the caller's rows must not come back once per pass over the histograms
    left = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "k int, score double")
    right = spark.createDataFrame([(i, i % 3 == 0, "a" if i % 2 else "b") for i in range(60)], "k int, truth boolean, cat string")
    out = E.balanced_pr_bootstrap(left.join(F.broadcast(right), "k"), "truth", "score", "cat", "k", bootstraps=3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "cat" not in plan and plan.count("LogicalRDD") == 0
    assert {r.group for r in out.collect()} == {"a", "b", "Transcriptome"}


def test_draws_and_histograms_are_not_broadcast(spark, monkeypatch, tmp_path):
    # few groups make many draws, and many rows of a histogram a small file: sizes that Catalyst takes for small
    from juncture.sources import sinks

    kept = []
    monkeypatch.setattr(sinks, "write_once", lambda df, name: kept.append(df) or df)
    rows = [(i, float(i % 7), i % 3 == 0, "a" if i % 2 else "b") for i in range(60)] + [(60, None, True, "a"), (61, 2.0, None, "b"), (62, 3.0, False, None), (5, 5.0, False, "b")]
    df = spark.createDataFrame(rows, "k int, score double, truth boolean, cat string")
    out = E.balanced_pr_bootstrap(df, "truth", "score", "cat", "k", bootstraps=3)
    drawn = {g: sum(r.p + r.n for r in kept[0].collect() if r.group == g) for g in ("a", "b", "Transcriptome")}
    assert drawn == {"a": 3 * 30, "b": 3 * 31, "Transcriptome": 3 * 62}
    plan = plan_of(kept[0])
    assert re.search(r"SortMergeJoin \[[^]]*idx", plan) and not re.search(r"Broadcast\w+Join \[[^]]*idx", plan)
    assert {r.group for r in out.collect()} == {"a", "b", "Transcriptome"}

    path = str(tmp_path / "hist")
    spark.range(2000).selectExpr("id % 4 as k", "cast(id as double) as score", "1 as n").write.parquet(path)
    run = O.with_running(spark.read.parquet(path), "score", {"n": "cn"}, ["k"])
    assert sorted(r.cn for r in run.collect()) == sorted(list(range(1, 501)) * 4)
    plan = plan_of(run)
    assert re.search(r"SortMergeJoin \[[^]]*_b#", plan) and not re.search(r"Broadcast\w+Join \[[^]]*_b#", plan)
