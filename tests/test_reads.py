"""One case per branch of the read rules."""

import pytest
from pyspark.sql import functions as F

from juncture.functions.coordinates import isoform_text
from juncture.operators import isoforms as I
from juncture.operators import reads as R
from juncture.operators.reference import chunk_sequences

CNST = ((649, 696), (3478, 3533))
BLK = "array<struct<start:int,end:int>>"


def blocks(spark, cigar, pos=101):
    df = spark.createDataFrame([(pos, cigar)], "pos int, cigar string")
    return [tuple(b) for b in df.select(R.cigar_to_blocks("pos", "cigar").alias("b")).first().b]


@pytest.mark.parametrize(
    "cigar,want",
    [
        ("10M", [(100, 110)]),
        ("5S10M3H", [(100, 110)]),
        ("10M5D10M", [(100, 110), (115, 125)]),
        ("10M5I10M", [(100, 110), (110, 120)]),
        ("10M100N4=1X", [(100, 110), (210, 214), (214, 215)]),
        ("*", []),
    ],
)
def test_cigar_to_blocks(spark, cigar, want):
    assert blocks(spark, cigar) == want


def pe(spark, r1, r2):
    rows = [("S", "B", "q", 65, *r1), ("S", "B", "q", 129, *r2)]
    reads = spark.createDataFrame(rows, "sample string, barcode string, qname string, flag int, pos int, cigar string")
    out = R.normalize_junctions_pe(R.pair_reads(reads), CNST).select("status", isoform_text("isoform").alias("iso")).first()
    return out.status, out.iso


@pytest.mark.parametrize(
    "r1,r2,want",
    [
        # spliced through the middle exon; the mates meet inside it
        ((627, "70M570N93M"), (1320, "40M2119N60M"), (None, "[[1267,1359]]")),
        # skipped, and a block just before the downstream exon
        ((627, "70M2782N50M"), (3479, "52M"), (None, "[]")),
        ((627, "70M2781N50M"), (3429, "48M1N52M"), (None, "[[3429,3476]]")),
        # the mates do not meet: the gap between them counts as covered
        ((627, "70M570N30M"), (1340, "20M2119N60M"), (None, "[[1267,1359]]")),
        # small deletion closed, large one kept
        ((627, "70M570N40M5D48M"), (1320, "40M2119N60M"), (None, "[[1267,1359]]")),
        ((627, "70M570N30M30D33M"), (1330, "30M2119N60M"), (None, "[[1267,1296],[1327,1359]]")),
        ((627, "*"), (1320, "40M2119N60M"), ("unmapped", None)),
        ((627, "40M"), (1320, "40M2119N60M"), ("soft_clipped", None)),
        ((700, "90M"), (1320, "40M2119N60M"), ("bad_starts", None)),
        ((627, "70M570N93M"), (1300, "60M"), ("bad_ends", None)),
    ],
)
def test_normalize_pe(spark, r1, r2, want):
    assert pe(spark, r1, r2) == want


def test_pair_order_does_not_depend_on_mate_number(spark):
    a = pe(spark, (627, "70M570N93M"), (1320, "40M2119N60M"))
    assert a == pe(spark, (1320, "40M2119N60M"), (627, "70M570N93M"))


def se(spark, b, tol=3, min_matches=10):
    df = spark.createDataFrame([(b,)], f"b {BLK}")
    out = df.select(R.normalize_junctions_se("b", CNST, tol, min_matches).alias("n")).select("n.status", isoform_text("n.isoform").alias("i")).first()
    return out.status, out.i


def test_normalize_se(spark):
    assert se(spark, [(626, 696), (1266, 1359), (3478, 3500)]) == (None, "[[1267,1359]]")
    assert se(spark, [(626, 696), (1266, 1300), (1300, 1359), (3478, 3500)]) == (None, "[[1267,1359]]")
    assert se(spark, [(626, 696), (1266, 1359), (3490, 3500)])[0] == "bad_ends"
    assert se(spark, [(626, 630)])[0] == "soft_clipped"
    # a read that ends before the downstream exon is fine, and a tiny last block is dropped
    assert se(spark, [(626, 696), (1266, 1359), (1400, 1403)]) == (None, "[[1267,1359]]")


def test_repair_moves_only_matching_boundaries(spark):
    seq = list("A" * 4000)
    seq[691:696] = "CGCGC"
    seq[1266:1271] = "CGCGC"
    rows = [("hit", 0, [(626, 691), (1266, 1359)]), ("other", 0, [(626, 691), (1280, 1359)]), ("fine", 0, [(626, 696), (1266, 1359)]), ("one", 0, [(626, 691)])]
    reads = spark.createDataFrame(rows, f"q string, flag int, blocks {BLK}")
    chunks = chunk_sequences(spark.createDataFrame([("construct", "".join(seq))], "name string, seq string"))
    got = {r.q: [tuple(b) for b in r.blocks] for r in R.repair_constant_junctions(reads, chunks, CNST, "construct").collect()}
    assert got["hit"] == [(626, 696), (1271, 1359)]
    assert got["other"] == [(626, 691), (1280, 1359)]
    assert got["fine"] == [(626, 696), (1266, 1359)] and got["one"] == [(626, 691)]


def test_status_order_differs_between_passes(spark):
    df = spark.createDataFrame([(0x100,), (0x1 | 0x4,), (0x1 | 0x8,), (0x1,)], "flag int")
    got = df.select(R.read_status().alias("d"), R.read_status("flag", True).alias("c")).collect()
    assert [(r.d, r.c) for r in got] == [("secondary", "unpaired"), ("unmapped", "unmapped"), ("unmapped", "unmapped"), (None, None)]


def exons(spark, rows):
    return spark.createDataFrame([("g", i + 1, s, e) for i, (s, e) in enumerate(rows)], "gene string, exon_num int, start_pos int, end_pos int")


def test_path_enumeration(spark):
    ex = exons(spark, [(1, 10), (20, 30), (40, 50)])
    got = I.exon_path_enumeration(ex).select("iso", isoform_text("path").alias("p")).collect()
    assert {(r.iso, r.p) for r in got} == {("iso00", "[[1,10],[20,30],[40,50]]"), ("iso01", "[[1,10],[40,50]]")}


def test_junction_paths_worked_example(spark):
    ex = exons(spark, [(347, 697), (1304, 1454), (3742, 3856)])
    start = spark.createDataFrame([("g", 649)], "gene string, read_start int")
    got = {tuple(r.path) for r in I.junction_path_enumeration(ex, start).collect()}
    assert got == {(649, 697, 1304, 1454, 3742, 3856), (649, 697, 3742, 3856)}


def test_visible_isoforms_group_what_a_read_cannot_tell_apart(spark):
    ex = exons(spark, [(1, 10), (20, 30), (40, 50), (60, 70)])
    out = I.visible_isoforms(I.exon_path_enumeration(ex), F.lit(5), 8).collect()
    got = {r.members: [tuple(b) for b in r.visible] for r in out}
    assert got == {"iso00,iso01": [(5, 10), (20, 21)], "iso02": [(5, 10), (40, 41)], "iso03": [(5, 10), (60, 61)]}


def test_named_groups(spark):
    rows = [("a", [(1267, 1359)]), ("b", [(1267, 1357)]), ("c", []), ("d", [(1235, 1239), (1267, 1359)]), ("e", [(1268, 1359)])]
    cat = spark.createDataFrame(rows, f"isonum string, isoform {BLK}")
    out = I.named_isoform_groups(cat, {"FULL": [(1267, 1359)], "SKIP": []}, [(1230, 1240)], 57, 150, 4)
    assert {r.isonum: r.group for r in out.collect()} == {"a": "FULL", "b": "FULL", "c": "SKIP", "d": "FULL", "e": "OTHER"}


def brute_cluster(rows, min_size, tol, mean):
    clusters = []
    for varlist, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        for v in varlist.split(","):
            p = int(v.split(":")[1])
            home = next((c for c in clusters if abs(c[0] - p) <= tol), None)
            if home is None:
                clusters.append([p, 1, n])
                continue
            home[1] += 1
            home[2] += n
            if home[1] == min_size and home[2] / min_size >= mean:
                return True
    return False


def test_cluster_matches_one_pass_over_all_variants(spark):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for k in range(30):
        iso = f"i{k}"
        mine = {}
        for _ in range(rng.randint(1, 14)):
            vs = [f"1:{rng.randint(1, 120)}:A:{rng.choice('CGT')}" for _ in range(rng.choice([1, 1, 2]))]
            mine[",".join(vs)] = rng.randint(1, 6)
        rows += [("s", iso, v, n) for v, n in mine.items()]
        want[iso] = brute_cluster(list(mine.items()), 3, 10, 3)
    df = spark.createDataFrame(rows, "sample string, isoform string, variant_list string, n_bc int")
    got = {r.isoform: r.clustered for r in I.variant_position_cluster(df, 3, 10, 3).collect()}
    assert got == want and any(want.values()) and not all(want.values())


def test_cluster_search_is_linear_in_a_dense_stretch(spark):
    # 60,000 first members in one stretch: comparing a variant with all of them takes minutes
    import time

    df = spark.range(60000).select(
        F.lit("s").alias("sample"), F.lit("i").alias("isoform"),
        F.concat(F.lit("1:"), (F.col("id") * 11).cast("string"), F.lit(":A:C")).alias("variant_list"), F.lit(5).alias("n_bc"))
    more = spark.createDataFrame([("s", "j", f"1:{p}:A:C", n) for p, n in [(5, 7), (9, 1), (14, 1), (400, 2), (401, 2), (402, 2)]]
                                 + [("s", "k", f"1:{p}:A:C", 2) for p in (5, 6, 7)], df.schema)
    start = time.time()
    got = {r.isoform: r.clustered for r in I.variant_position_cluster(df.unionByName(more), 3, 10, 3).collect()}
    assert got == {"i": False, "j": True, "k": False}
    assert time.time() - start < 60
