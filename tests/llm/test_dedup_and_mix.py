"""Exact dedup, SimHash, repeated substrings and mixing."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from juncture.llm import components, exact_dedup, mixing, repeats, simhash
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fx.rows(), fx.SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], fx.SCHEMA)


def test_exact_dedup_edge_cases(docs):
    out = exact_dedup.mark_duplicates(docs).collect()
    assert len(out) == len(fx.rows())
    groups = Counter(fx.lower(r[1]) for r in fx.rows())
    best = {}
    for r in fx.rows():
        if r[0] is not None:
            best[fx.lower(r[1])] = max(r[0], best.get(fx.lower(r[1]), r[0]))
    kept = Counter()
    for r in out:
        norm = fx.lower(r.text)
        assert (r.keep_id, r.group_size, r.text_sha256) == (best.get(norm), groups[norm], fx.sha(norm))
        kept[norm] += r.kept
        assert not r.kept or r.doc_id == best.get(norm)
    assert set(kept.values()) == {1}


def test_exact_dedup_keeps_smallest_on_request(docs):
    out = exact_dedup.mark_duplicates(docs, keep="smallest")
    assert {r.keep_id for r in out.filter("text is null or text = ''").collect()} == {3}


def test_exact_dedup_splits_common_texts(spark):
    """A third of all rows has one text; it is dealt over blocks and joined up again."""
    rows = spark.range(30_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'Same text' when id % 3 = 1 then concat('t', id) else concat('t', id div 6) end as text")
    keys = rows.select(F.concat(F.lower("text"), F.lit("\u0000"), F.sha2(F.lower("text"), 256)).alias("_key"), F.xxhash64("doc_id", F.lit(7)).alias("_row"))
    assert len(exact_dedup.find_splitters(keys, 30_000)[1]) == 1
    out = exact_dedup.mark_duplicates(rows)
    same = out.filter("lower(text) = 'same text'").agg(F.sum(F.col("kept").cast("int")), F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.max("group_size"), F.count("*")).first()
    assert tuple(same) == (1, 29_997, 29_997, 10_000, 10_000, 10_000)
    assert out.filter("kept").count() == out.select(F.lower("text")).distinct().count()


def test_simhash_edge_cases(docs):
    out = simhash.near_duplicates(docs.select("doc_id", "text")).select("doc_id", simhash.hex_digits(F.col("fp")).alias("fp"), "component_id").collect()
    prints = [(r[0], fx.simhash(r[1])) for r in fx.rows()]
    assert Counter((r.doc_id, r.fp) for r in out) == Counter((i, f"{f:016x}") for i, f in prints)
    values = sorted({f for _, f in prints})
    root = fx.union_find(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r.component_id == least.get(root[int(r.fp, 16)]) for r in out)


def test_simhash_keeps_one_row_of_each_component(spark):
    """Unlike texts without an identifier, and unlike texts under one identifier, of which the first is a near copy of another's."""
    draw = random.Random(4)
    a, b, c, d, e = (" ".join(f"{draw.getrandbits(40):x}" for _ in range(60)) for _ in range(5))
    rows = [(None, a, "x"), (None, b, "x"), (None, b + "\n", "x"), (1, c, "x"), (2, c + "\n", "x"), (2, d, "x"), (2, d, "x"), (None, d + " ", "x"), (3, None, "x"), (3, "", "x"), (None, e, "x"), (4, e + " ", "x")]
    out = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, root string"))
    assert out.columns == ["doc_id", "text", "root"]
    assert Counter(map(tuple, out.collect())) == Counter([(None, a, "x"), (None, b, "x"), (1, c, "x"), (2, d, "x"), (3, None, "x"), (4, e + " ", "x")])


def test_simhash_long_text_in_runs():
    text = " ".join(f"w{i} x" for i in range(3000))
    whole = simhash.fingerprint(text)
    assert whole == fx.simhash(text)
    runs = [w for run in simhash.word_runs(text.encode(), 100) for w in run]
    assert runs == text.encode().split()


def brute_links(values):
    v = np.array(values, np.uint64)
    return {(int(a), int(b)) for a in v for b in v[np.bitwise_count(v ^ a) <= 2] if a < b}


@pytest.mark.parametrize("crowd", [0, 400])
def test_grid_join_loses_no_component(spark, crowd):
    """Chains of one- and two-bit steps, random values, and a crowd whose members share cells."""
    draw = np.random.default_rng(4)
    values = [int(x) for x in draw.integers(0, 1 << 63, 200)]
    for _ in range(300):
        values.append(values[-1 if draw.random() < 0.5 else int(draw.integers(0, 200))] ^ (1 << int(draw.integers(0, 64))) ^ (1 << int(draw.integers(0, 64))))
    for _ in range(crowd):
        values.append(values[0] ^ (1 << int(draw.integers(0, 8))) ^ (1 << int(draw.integers(0, 8))) ^ (1 << int(draw.integers(40, 44))))
    values = sorted(set(values))
    fps = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "fp long")
    found = simhash.compare_cells(simhash.cell_rows(fps, simhash.grids(len(values))))
    crowded = found.filter("b is null").select("a").distinct()
    assert (crowded.count() > 0) == (crowd > 0)
    links = found.filter("b is not null").union(simhash.one_bit_links(crowded))
    unsigned = lambda x: x % (1 << 64)
    pairs = {(unsigned(r.a), unsigned(r.b)) for r in links.collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs) or crowd
    assert fx.union_find(values, pairs) == fx.union_find(values, brute_links(values))


@pytest.mark.parametrize("n", [4, 1000, 10**6, 10**8, 10**10])
def test_every_two_segments_are_left_out_of_some_grid(n):
    chosen = [set(g) for g in simhash.grids(n)]
    for a in range(simhash.SEGMENTS):
        for b in range(simhash.SEGMENTS):
            assert any(a not in g and b not in g for g in chosen)


def test_components_of_long_chains(spark, monkeypatch):
    monkeypatch.setattr(components, "LINKS_PER_TASK", 40)  # several parts, several rounds
    links = [(i, i + 7) for i in range(0, 400, 7)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5), (2000, 1000)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == fx.union_find({x for pair in links for x in pair}, links)


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeats_against_brute_force(spark):
    docs = fx.passages()
    out = repeats.remove_repeats(spark.createDataFrame([(i, t.decode()) for i, t in docs.items()], "doc_id long, text string")).collect()
    want = fx.repeats(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == want
    assert all(r.kept_sha256 == fx.sha(want[r.doc_id][3]) for r in out)


def test_repeats_edge_cases(docs):
    out = repeats.remove_repeats(docs)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in fx.rows())
    by = {(r.doc_id, r.n_bytes): r for r in out.collect()}
    assert by[(3, 0)].kept_sha256 == fx.sha("")
    assert by[(2, len(fx.EN))].n_removed == 0  # the upper-case text is another one, repeated in one document only
    assert by[(None, len(fx.EN))].n_removed == len(fx.EN)  # no number: larger than all
    assert by[(11, len(fx.EN) + 1)].n_removed >= len(fx.EN) - 1


def brute_rows(rows):
    """(id, text, removed bytes, spans) of rows whose identifiers may be null or repeated."""
    number = [repeats.NO_ID if i is None else i for i, _ in rows]
    least = {}
    for i, (_, t) in zip(number, rows):
        for a in range(len(t) - 49):
            least[t[a : a + 50]] = min(i, least.get(t[a : a + 50], i))
    out = []
    for i, (own, t) in zip(number, rows):
        gone = bytearray(len(t))
        for a in range(len(t) - 49):
            if least[t[a : a + 50]] < i:
                gone[a : a + 50] = b"\1" * 50
        out.append((own, t.decode(), sum(gone), len([x for x in bytes(gone).split(b"\0") if x])))
    return out


def test_repeats_of_null_and_repeated_identifiers(spark):
    texts = list(fx.passages(5, 24).values())
    own = [None, None, None, 4, 4, 4, 7, 8, None, 9, 2, None]
    rows = [(own[n % len(own)], t.decode(errors="ignore").encode()) for n, t in enumerate(texts)]
    rows += [(None, rows[3][1]), (4, rows[3][1]), (None, rows[0][1]), (4, rows[6][1])]
    df = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(df).collect()
    want = Counter((i, len(t.encode()), removed, spans) for i, t, removed, spans in brute_rows(rows))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == want
    assert sum(n for (*_, removed, _), n in want.items() if removed) > 5


def test_rows_without_identifier_carry_their_own_anchors_only(spark):
    """What a row is told of grows with its text, not with the number of rows without an identifier."""
    shared = fx.LONG[:128]
    rows = [(None if n else 1, shared + "".join(f" {n}-{k}" for k in range(40))) for n in range(60)]
    keyed = spark.createDataFrame(rows, "id long, text string").selectExpr(f"coalesce(id, {repeats.NO_ID}) as id", "text", "xxhash64(text) as key")
    told = repeats.shared_anchors(repeats.anchors(keyed, 16)).groupBy("id", "key").agg(F.sum(F.length("hashes")).alias("n")).collect()
    assert len(told) == 60 and max(r.n for r in told) <= 2 * 8 * 128


def test_repeats_in_a_long_text_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 700)
    docs = {i: t for i, t in fx.passages(3, 20).items()} | {100: b"".join(fx.passages(3, 20).values()) + fx.LONG.encode()[:5000], 101: fx.LONG.encode()[60:4000]}
    out = repeats.remove_repeats(spark.createDataFrame([(i, t.decode(errors="ignore")) for i, t in docs.items()], "doc_id long, text string")).collect()
    want = fx.repeats({i: t.decode(errors="ignore").encode() for i, t in docs.items()})
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == want


def test_merge_of_many_shards_sorts_as_one():
    draw = np.random.default_rng(2)
    texts = [draw.integers(97, 100, draw.integers(60, 200)).astype(np.uint8) for _ in range(9)]
    texts.append(texts[0].copy())
    numbers = repeats.merged_intervals(texts)
    prefix = lambda t, i: bytes(np.roll(t, -i)[:50].tobytes() if len(t) >= 50 else b"")
    seen = {}
    for t, own in zip(texts, numbers):
        for i in range(len(t)):
            assert seen.setdefault(prefix(t, i), own[i]) == own[i]
    assert len(set(seen.values())) == len(seen)
    in_order = sorted(seen, key=lambda p: seen[p])
    assert in_order == sorted(in_order)


def test_mix_edge_cases_and_targets(docs):
    out = mixing.mix(docs).collect()
    assert len(out) == len(fx.rows())
    sizes = Counter()
    for r in out:
        assert r.size == len(fx.words(r.text)) and r.taken == r.size * r["copies"] and r.taken <= 3 * r.size
        sizes[r.source] += r.size
    target = {r.source: r.target for r in out}
    assert all(r.source_size == sizes[r.source] for r in out)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    assert all(t <= 3 * sizes[s] + 1e-9 for s, t in target.items())


def test_targets_fill_and_share_the_excess(spark):
    sizes = {"a": 10, "b": 100, "c": 1000, "d": 0, None: 5}
    got = {r["_source"]: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "_source string, source_size long")).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    want, stopped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        rest = sum(w for s, w in weight.items() if s not in stopped)
        want = {s: 3.0 * sizes[s] if s in stopped else left * weight[s] / rest for s in sizes}
        more = {s for s in sizes if s not in stopped and want[s] > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    assert got == pytest.approx(want)


def test_mix_is_near_its_targets_and_reruns_agree(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(1 + pow(id % 97, 2) as int)) as text", "case when id % 3 = 0 then 'hot' else concat('s', id % 5) end as source")
    first = mixing.mix(rows)
    sums = first.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.03 * r.target for r in sums)
    again = mixing.mix(rows.repartition(5))
    assert first.select("doc_id", "taken").exceptAll(again.select("doc_id", "taken")).isEmpty()
    emitted = mixing.emit_copies(first)
    assert emitted.count() == first.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("operate", [exact_dedup.mark_duplicates, simhash.near_duplicates, simhash.keep_one, repeats.remove_repeats, mixing.mix])
def test_empty_tables(none, operate):
    assert operate(none).count() == 0
