"""Inputs of splicing models and exon scores over tables of exons, against sequences cut by hand."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from juncture.operators import annotation as A
from juncture.operators import scoring as S
from juncture.operators.reference import reference_chunks

SEQ = "".join("ACGT"[(i * i + i // 3) % 4] for i in range(120))
EXONS = [("1", "a", "+", 21, 32), ("1", "b", "-", 25, 40), ("2", "c", "-", 3, 10)]
#: In one exon, in two, at both borders, an insertion, a deletion, outside of all.
CHANGES = [("1", 21, 1, "T"), ("1", 28, 1, "G"), ("1", 30, 1, "CCC"), ("1", 30, 3, "A"), ("1", 40, 1, "A"), ("1", 41, 1, "A"), ("2", 3, 1, "G"), ("3", 22, 1, "G")]


def turned(s):
    return s[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))


def bases(lo, hi):
    return SEQ[lo - 1 : hi]


@pytest.fixture(scope="module")
def inputs(spark):
    base = spark.createDataFrame([(c, i + 1, b) for c in "12" for i, b in enumerate(SEQ)], "chrom string, pos int, base string")
    variants = spark.createDataFrame([(c, p, bases(p, p + n - 1), a) for c, p, n, a in CHANGES], "chrom string, pos int, ref string, alt string")
    exons = spark.createDataFrame(EXONS, "chrom string, exon string, strand string, start_pos int, end_pos int")
    return variants, exons, reference_chunks(base)


def inside():
    for chrom, exon, strand, lo, hi in EXONS:
        for c, p, n, alt in CHANGES:
            if c == chrom and lo <= p <= hi:
                yield exon, strand, lo, hi, p, n, alt


def intron(lo, hi):
    return "".join(SEQ[i - 1] if 1 <= i <= len(SEQ) else "N" for i in range(lo, hi + 1)).lower()


def test_skip_input_over_exons(inputs):
    want = set()
    for exon, strand, lo, hi, p, n, alt in inside():
        ref, var = bases(lo, hi), bases(lo, p - 1) + alt + bases(p + n, hi)
        texts = [turned(intron(lo - 6, lo - 1).upper() + x) for x in (ref, var)] if strand == "-" else [x + intron(hi + 1, hi + 6) for x in (ref, var)]
        if strand == "-":
            texts = [x[:-6] + x[-6:].lower() for x in texts]
        want.add((exon, p, alt, *[x.replace("n", "N") for x in texts]))
    got = S.skip_model_input(*inputs, width=8).select("exon", "pos", "alt", "refseq", "altseq").collect()
    assert len(got) == len(want)
    assert {(*r[:3], *[x.replace("n", "N") for x in r[3:]]) for r in got} == want


def test_donor_input_over_exons(inputs):
    variants, exons, chunks = inputs
    exons = exons.withColumn("donor", F.when(F.col("strand") == "-", F.col("start_pos") + 4).otherwise(F.col("end_pos") - 3))
    want = set()
    for exon, strand, lo, hi, p, n, alt in inside():
        border = lo + 4 if strand == "-" else hi - 2  # first base after it
        one = [(bases(lo, border - 1), bases(border, hi))]
        before = p < border
        one.append((bases(lo, p - 1) + alt + bases(p + n, border - 1), bases(border, hi)) if before else (bases(lo, border - 1), bases(border, p - 1) + alt + bases(p + n, hi)))
        want.add((exon, p, alt, *[turned(a.lower() + b) if strand == "-" else a + b.lower() for a, b in one]))
    got = S.donor_model_input(variants, exons, chunks, width=8).select("exon", "pos", "alt", "refseq", "altseq").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_wrong_reference_stops(inputs):
    variants, exons, chunks = inputs
    with pytest.raises(PySparkException, match="reference mismatch"):
        S.skip_model_input(variants.withColumn("ref", F.lit("N")), exons, chunks).collect()


def test_exon_scores_on_both_strands(spark, inputs):
    _, exons, chunks = inputs
    k = 3
    score = {SEQ[i : i + k]: float(i % 11) for i in range(40)}
    motifs = spark.createDataFrame(list(score.items()), "kmer string, score double")
    want = {}
    for chrom, exon, strand, lo, hi in EXONS:
        for p in range(lo + k - 1, hi - k + 2):
            w = bases(p - k + 1, p + k - 1)
            w = turned(w) if strand == "-" else w
            for alt in "ACGT".replace(w[k - 1], ""):
                mean = [sum(score.get(x[i : i + k], 0.0) for i in range(k)) / k for x in (w, w[: k - 1] + alt + w[k:])]
                want[exon, p, w[k - 1], alt] = pytest.approx(mean)
    got = S.motif_score_exon(exons, chunks, motifs, k, "m").collect()
    assert {(r["exon"], r["pos"], r["ref"], r["alt"]): [r["m_wtMEAN"], r["m_snvMEAN"]] for r in got} == want
    assert len(got) == len(want)


def test_exons_shorter_than_a_window_have_no_scores(spark, inputs):
    _, exons, chunks = inputs
    motifs = spark.createDataFrame([("A" * 9, 1.0)], "kmer string, score double")
    assert {r["exon"] for r in S.motif_score_exon(exons, chunks, motifs, 9, "m").collect()} == set()


def test_annotations_compare_by_transcript(spark):
    schema = "transcript_id string, name string, tx_start int, tx_end int, exon_starts array<int>, exon_ends array<int>"
    a = spark.createDataFrame([("t1", "g", 0, 9, [0, 5], [2, 9]), ("t2", "g", 0, 9, [0], [9])], schema)
    b = spark.createDataFrame([("t1", "g", 0, 9, [0, 6], [2, 9]), ("t2", "g", 1, 9, [1], [9]), ("t3", "g", 1, 9, [1], [9])], schema)
    got = {r["transcript_id"]: r for r in A.compare_annotations(a, b, "transcript_id").collect()}
    assert set(got) == {"t1", "t2"} and got["t1"]["same_bounds"] and not got["t2"]["same_bounds"]
    assert got["t1"]["exon_starts_only_a"] == [5] and got["t1"]["exon_starts_only_b"] == [6] and got["t2"]["exon_starts_only_b"] == [1]
