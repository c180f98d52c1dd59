"""Windows of any length, contigs as part of the key, and bins in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from juncture.operators import annotation as A
from juncture.operators import pairs as P
from juncture.operators import reference as R
from juncture.operators import scoring as S

SIZE = 12_000


@pytest.fixture(scope="module")
def genome():
    draw = random.Random(8)
    return {c: "".join(draw.choice("ACGT") for _ in range(SIZE)) for c in ("1", "2", "X")}


@pytest.fixture(scope="module")
def chunks(spark, genome):
    return R.chunk_sequences(spark.createDataFrame(list(genome.items()), "name string, seq string")).cache()


def test_chunks_agree_whatever_they_are_made_from(spark, genome):
    rows = spark.createDataFrame([(c, i + 1, b) for c, s in genome.items() for i, b in enumerate(s)], "chrom string, pos int, base string")
    lines = spark.createDataFrame([(c, i + 1, s[i : i + 70]) for c, s in genome.items() for i in range(0, SIZE, 70)], "name string, start long, seq string")
    whole = spark.createDataFrame(list(genome.items()), "name string, seq string")
    want = {tuple(r) for r in R.reference_chunks(rows, 128, 16).collect()}
    assert {tuple(r) for r in R.chunk_lines(lines, 128, 16).collect()} == want
    assert {tuple(r) for r in R.chunk_sequences(whole, 128, 16).collect()} == want


def test_spans_of_any_length(spark, genome, chunks):
    wanted = [("1", 5, 9), ("1", 4000, 9000), ("2", 4000, 9000), ("X", -3, 4), ("X", SIZE - 2, SIZE + 3), ("Y", 1, 4), ("2", 1, SIZE)]
    got = {(r.chrom, r.a, r.b): r.text for r in R.with_span(spark.createDataFrame(wanted, "chrom string, a int, b int"), chunks, "a", "b", "text").collect()}
    for c, a, b in wanted:
        s = genome.get(c, "")
        assert got[c, a, b] == "".join(s[i - 1] if 1 <= i <= len(s) else "N" for i in range(a, b + 1))


@pytest.mark.parametrize("size", [10, 257, 300, 2000, 9000])
def test_edit_distance_of_long_exons(spark, genome, chunks, size):
    exons = spark.createDataFrame([("g", "2", 1, 101, 100 + size), ("g", "2", 2, 10_001, 10_050)], "gene string, chrom string, exon_num int, start_pos int, end_pos int")
    seq = genome["2"][100 : 100 + size] + "A" + genome["2"][10_000:10_049]
    out = R.segment_edit_distance(spark.createDataFrame([("g", seq)], "gene string, seq string"), exons, chunks, "gene").collect()
    assert {r.exon_num: r.distance for r in out}[1] == 0 and {r.exon_num: r.distance for r in out}[2] <= 2


@pytest.mark.parametrize("n", [1, 64, 66, 100, 230, 234, 700, 5000])
def test_scan_windows_of_long_reference_alleles(spark, genome, chunks, n):
    size, pos = 23, 3001
    ref = genome["X"][pos - 1 : pos - 1 + n]
    rows = S.scan_windows(spark.createDataFrame([("X", pos, ref, "T")], "chrom string, pos int, ref string, alt string"), chunks, size).collect()
    assert len(rows) == (size - n - 2) - (1 - n) + 1
    assert all(len(r["var"]) == size and len(r["wt"]) == size for r in rows)
    changed = genome["X"][: pos - 1] + "T" + genome["X"][pos - 1 + n :]
    assert all(r["var"] in changed for r in rows) and all(r["wt"] in genome["X"] for r in rows)


def test_created_sites_of_long_reference_alleles(spark, genome, chunks):
    rows = [("1", 500, genome["1"][499 : 499 + n], "A") for n in (1, 65, 66, 300)]
    assert R.created_site_flags(spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string"), chunks).count() == 4


@pytest.mark.parametrize("strand", ["+", "-"])
@pytest.mark.parametrize("distance", [30, 255, 256, 257, 300, 2000])
def test_categories_far_from_the_change(spark, strand, distance):
    """An AG that is there before and after is an existing cryptic site, however far away."""
    seq = ["C"] * 6000
    pos = 3000
    at = pos + distance if strand == "+" else pos - distance
    # the motif ends right before the event along the strand
    if strand == "+":
        seq[at - 3], seq[at - 2] = "A", "G"
    else:
        seq[at + 1], seq[at] = "T", "C"
    chunk = R.chunk_sequences(spark.createDataFrame([("1", "".join(seq))], "name string, seq string"))
    annot = spark.createDataFrame([("g", "1", strand, 0, 6000, [0], [6000])], "name string, chrom string, strand string, tx_start int, tx_end int, exon_starts array<int>, exon_ends array<int>")
    one = spark.createDataFrame([("1", pos, "C", "G", strand, "DS_AGrw", distance)], "chrom string, pos int, ref string, alt string, strand string, DS_maxrw_type string, POS_maxrw int")
    assert P.categorize_snvs(one, chunk, annot, 5000).first()["splai_cat"] == "Existing distal cryptic AGrw"
    two = one.withColumns({"pos2": F.lit(pos + 4), "ref2": F.lit("C"), "alt2": F.lit("T")})
    assert P.categorize_dnvs(two, chunk, annot, 5000).first()["splai_cat"] == "Existing distal cryptic AGrw"


def test_annotation_keys_have_the_contig(spark):
    tbv = spark.createDataFrame([("chr1", 5, "A", "C"), ("chr2", 5, "A", "C"), ("chr3", 5, "A", "C")], "chrom string, pos int, ref string, alt string")
    scores = spark.createDataFrame([("1", 5, "A", "C", 1.0), ("2", 5, "A", "C", 2.0)], "chrom string, pos int, ref string, alt string, score double")
    want = {("chr1", 1.0), ("chr2", 2.0), ("chr3", None)}
    keys = ["pos", "ref", "alt"]
    assert {(r.chrom, r.score) for r in A.merge_conservation(tbv, scores.drop("ref", "alt")).collect()} == want
    assert {(r.chrom, r.score_v2) for r in A.merge_population(tbv, scores, keys, "v2").collect()} == want
    assert {(r.chrom, r.cadd_raw) for r in A.merge_cadd(tbv, scores.selectExpr("chrom", "pos", "ref", "alt", "score as RawScore", "score as PHRED"), keys).collect()} == want
    top = scores.selectExpr("chrom", "pos", "ref", "alt", "score as DBP_max", "score as DBP_event", "score as DBP_POS_max")
    assert {(r.chrom, r.DBP_max) for r in A.merge_branchpoint(tbv, top, keys).collect()} == want
    assert {r.score for r in A.merge_scores(tbv, scores.drop("chrom").limit(1), keys).collect()} == {1.0}


def test_nearest_exon_over_blocks_of_bins(spark, monkeypatch):
    monkeypatch.setattr(A, "BIN_BLOCK", 4)
    draw = random.Random(5)
    exons = [(c, s, a, a + draw.randint(0, 40), f"{c}{s}{a}") for c in "12" for s in "+-" for a in sorted(draw.sample(range(1, 20_000), 25))]
    sites = [(draw.choice("12"), draw.randint(1, 20_000), draw.choice("+-")) for _ in range(300)]
    out = A.nearest_exon(
        spark.createDataFrame(sites, "chrom string, pos int, strand string"), spark.createDataFrame(exons, "chrom string, strand string, start_pos int, end_pos int, name string"), width=64
    ).collect()
    assert len(out) == 300
    for r in out:
        assert r.dist == min(max(a - r.pos, r.pos - b, 0) for c, s, a, b, _ in exons if (c, s) == (r.chrom, r.strand))
