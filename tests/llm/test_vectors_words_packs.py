"""Whitening, spelling variants and packing, each against a plain version."""

import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from juncture.llm import language, packing, spelling, whitening
from juncture.llm.plans import QUERIES, tokenizer
from tests.llm import fixtures as fx

SF = "/root/testdata/sf0.001"
WORDS = tokenizer("word_bpe_49k.json")[0]


# whitening


def plain_whitening(vectors, k=8):
    """Exact covariance from fractions, and eigh of it."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    mean = [Fraction(sum(r[i] for r in x), n) for i in range(width)]
    centred = [[r[i] - mean[i] for i in range(width)] for r in x]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(width)] for i in range(width)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    deviation = [int(sum((n * c) ** 2 for c in r)) for r in centred]
    return n, v, values, axes, deviation, np.array([[float(c) for c in r] for r in centred])


def check_whitening(rows, vectors, k):
    n, v, values, axes, deviation, centred = plain_whitening(vectors, k)
    by_id = defaultdict(dict)
    for r in rows:
        by_id[r.vec_id][r.component] = r
    assert len(rows) == n * k and set(by_id) == set(range(n))
    got = np.array([[by_id[i][c].whitened for c in range(1, k + 1)] for i in range(n)])
    want = centred @ axes / np.sqrt(values)
    for c in range(k):
        assert min(np.abs(got[:, c] - want[:, c]).max(), np.abs(got[:, c] + want[:, c]).max()) < 1e-8
    for i in range(n):
        for c in range(1, k + 1):
            r = by_id[i][c]
            assert (r.n, r.deviation, int(r.deviation_exact)) == (n, deviation[i], deviation[i])
            assert math.isclose(r.explained, values[c - 1] / np.trace(v), rel_tol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9


def test_whitening_matches_fractions(spark):
    draw = np.random.default_rng(3)
    base = draw.normal(size=(90, 10)) @ draw.normal(size=(10, 10)) / 30
    good = [[float(np.float32(c)) for c in v] for v in base]
    bad = [None, [], [None] * 10, [0.1] * 9 + [None], [float("nan")] + [0.0] * 9, [0.0] * 9 + [float("inf")], [1.0, 2.0]]
    data = [(i, v, "x") for i, v in enumerate(good)] + [(1000 + i, v, "x") for i, v in enumerate(bad)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, n string").repartition(5)
    rows = whitening.whiten(vectors).collect()
    check_whitening(rows, good, 8)


def test_whitening_of_a_table(spark):
    rows = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in table] == list(range(len(table)))
    check_whitening(rows, [r.embedding for r in table], 8)


def test_covariance_is_exact_whatever_the_values(spark):
    draw = np.random.default_rng(4)
    for scale in (1e-3, 1.0, 3e6, 1e12):
        v = draw.normal(size=(40, 4)) * scale + 7 * scale
        m = whitening.moments(spark.createDataFrame([([float(c) for c in r],) for r in v], "embedding array<double>").repartition(3))
        x = [[math.floor(1024 * float(c)) + 100000 for c in r] for r in v]
        sums = [sum(r[i] for r in x) for i in range(4)]
        assert (m.n, list(m.sums)) == (40, sums)
        assert m.products == tuple(tuple(sum((40 * r[i] - sums[i]) * (40 * r[j] - sums[j]) for r in x) for j in range(4)) for i in range(4))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**61), 2**61), min_size=3, max_size=3), max_size=5))
def test_square_sums(rows):
    got = whitening.square_sums(np.array(rows, np.int64).reshape(-1, 3))
    want = [sum((r[i] + r[j]) ** 2 if i != j else r[i] ** 2 for r in rows) for i in range(3) for j in range(i, 3)]
    assert got.tolist() == want
    for total in (*want, -5, -(2**90), 2**32, -(2**32)):
        assert sum(v << 32 * k for k, v in enumerate(whitening.limbs_of(total))) == total


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [0.5, 3e38])], schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(None, c, 1, 0, 0.0, 0.0, 0.0) for c in (1, 2)]
    # a constant column, repeated rows, huge entries: a deviation that no long holds is null
    rows = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 2.0]), *[(3, [1.0, 1e30])] * 20], schema)).orderBy("vec_id", "component").collect()
    assert {r.whitened for r in rows if r.component == 2} == {0.0} and rows[0].identity_error < 1e-9
    assert rows[-1].deviation is None and rows[-1].deviation_exact is not None and rows[0].deviation_exact is None
    wide = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (2, [3e6, 2.0])], schema)).collect()
    assert all(int(r.deviation_exact) == (math.floor(1024 * 3e6) - 1024) ** 2 * 2 // 2 + 2048**2 for r in wide)


# spelling

ALPHABET = "abcdé"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_spelling(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def spelling_docs(draw, words=260, repeat=4):
    pool = []
    for _ in range(words):
        w = "".join(draw.choice(list(ALPHABET), size=draw.integers(6, 10)))
        pool += [w, w[:3] + w[4:], w[:-1], w + "a", w[:2] + "é" + w[2:], w[:4] + "b" + w[5:]]
    weight = 1 / np.arange(1, len(pool) + 1)
    order = draw.permutation(len(pool))
    texts = [" ".join(pool[order[k]] for k in draw.choice(len(pool), p=weight / weight.sum(), size=300)) for _ in range(repeat * 10)]
    texts = [t.upper() if i % 7 == 0 else t.replace(" ", "×, ") if i % 5 == 0 else t for i, t in enumerate(texts)]
    texts.append("xxabcdefg " * 900 + "xxabcdegg " * 60 + "xxabcdegh " * 4 + "xxabcdeghi " * 4)
    return [*enumerate(texts), (None, texts[0]), (None, texts[0]), (7, None), (8, ""), (9, "x" * 50_000 + " " + "x" * 49_999 + " y" + "x" * 49_999), (9, "x" * 50_000 + " " + "x" * 49_999)]


@pytest.mark.parametrize("block", [spelling.BLOCK, 40])
def test_spelling_matches_all_pairs(spark, block):
    docs = spelling_docs(np.random.default_rng(11))
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, n int, word string").repartition(6)
    got = spelling.spelling_groups(df, block=block).collect()
    want = plain_spelling(docs)
    assert len(got) == len(want) and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    # chains, ties and groups all occur
    assert any(f not in (None, r) for _, f, r, *_ in want) and any(k > 5 for *_, k, _ in want)


def test_spelling_of_a_table(spark):
    got = QUERIES["op12_spelling_variants"](spark, SF)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    counts = {w: c for w, _, _, c, *_ in plain_counts(docs)}
    assert {r.word: r.n for r in got.collect()} == counts


def plain_counts(docs):
    n = Counter(w for i, t in docs for w in (spelling.variant_of(i, fx.lower(r), 31) for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")))
    return [(w, None, w, c, 0, None) for w, c in n.items() if len(w) >= 7 and c >= 2]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("ab", min_size=1, max_size=6), min_size=2, max_size=12))
def test_every_single_edit_counts_once(words):
    words = sorted(words)
    found = Counter()
    for longest in range(1, 8):
        for part in range(spelling.PARTS):
            low, high = longest * part // spelling.PARTS, longest * (part + 1) // spelling.PARTS
            tiles = defaultdict(list)
            for w in words:
                if len(w) in (longest, longest - 1):
                    tiles[w[:low], w[len(w) - (longest - high) :] if longest > high else ""].append(w)
            for tile in tiles.values():
                k = len(tile)
                i, j = spelling.single_edits(tile, np.full(k, k), np.full(k, longest), np.full(k, part), np.zeros(k), np.zeros(k, bool))
                found.update(frozenset((tile[a], tile[b])) for a, b in zip(i, j))
    assert found == Counter(frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b))


def test_spelling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_groups(empty).count() == 0
    assert spelling.spelling_groups(spark.createDataFrame([(1, None), (2, "short words only")], "doc_id long, text string")).count() == 0


# packing


def plain_order(tokens, weights, window, quantum):
    """Deficit round-robin with counters, a quantum at a time: the stream as (queue, token in the queue)."""
    left, sent, deficit = [n // quantum for n in tokens], [0] * len(tokens), [Fraction(0)] * len(tokens)
    stream = []
    while any(left):
        for q, w in enumerate(weights):
            deficit[q] += Fraction(window // quantum * w, sum(weights))
            while left[q] and deficit[q] >= 1:
                stream += [(q, sent[q] * quantum + t) for t in range(quantum)]
                left[q], sent[q], deficit[q] = left[q] - 1, sent[q] + 1, deficit[q] - 1
    return stream + [(q, t) for q, n in enumerate(tokens) for t in range(n // quantum * quantum, n)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 90), max_size=8), st.integers(1, 9)), min_size=1, max_size=6), st.booleans(), st.sampled_from([(32, 4), (32, 32), (24, 1)]))
def test_cut_continues_the_round_robin_anywhere(queues, own, sizes):
    window, quantum = sizes
    docs = [d for d, _ in queues]
    tokens = [sum(d) for d in docs]
    weights = [w for _, w in queues] if own or not all(tokens) else tokens
    stream = plain_order(tokens, weights, window, quantum)
    turns = packing.RoundRobin(tokens, weights, window, quantum)
    seen = {}
    sequences = defaultdict(dict)
    for q, sizes in enumerate(docs):
        first = np.cumsum([0, *sizes])[:-1]
        # each document by itself, as if it were read by a task of its own
        for f, n in zip(first, sizes):
            total = 0
            for _, start, length, number, offset in zip(*turns.cut(np.array([q]), np.array([f]), np.array([n]))):
                assert start == total
                total += length
                for t in range(length):
                    sequences[number][offset + t] = (q, f + start + t)
            assert total == n
    for number, seq in sequences.items():
        assert sorted(seq) == list(range(len(seq)))
        assert len(seq) == window or (len(seq) & (len(seq) - 1)) == 0
        seen[number] = [seq[i] for i in range(len(seq))]
    assert sorted(seen) == list(range(len(seen)))
    assert [x for k in sorted(seen) for x in seen[k]] == stream


def ids_of(texts):
    t = Tokenizer.from_file(WORDS)
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check_pack(pieces, docs, window=2048):
    """Pieces as rows against (id, text) of each document; repeated documents are told apart by nothing."""
    want = Counter((i, tuple(ids)) for (i, _), ids in zip(docs, ids_of([t for _, t in docs])))
    by_id, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        by_id[p.doc_id].append((p.start, ids, p.doc_tokens))
        by_seq[p.sequence_id].append((p.offset, p.length))
    for i, parts in by_id.items():
        ways = [ids for (j, ids) in want.elements() if j == i]
        if len(ways) == 1:
            joined = []
            for start, ids, total in sorted(parts):
                assert start == len(joined) and total == len(ways[0])
                joined += ids
            assert tuple(joined) == ways[0]
        else:
            assert sorted(x for _, ids, _ in parts for x in ids) == sorted(x for w in ways for x in w)
    assert set(by_id) == {i for i, _ in want}
    for seq, parts in by_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0
    assert sum(n < window for n in (sum(x for _, x in p) for p in by_seq.values())) <= window.bit_length()
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_pack_of_awkward_rows(spark):
    docs = spark.createDataFrame(fx.rows(), fx.SCHEMA).repartition(5)
    for more in ({}, {"most_queues": 2}, {"weights": {"a": 5, None: 3}}, {"window": 256, "quantum": 16}):
        pieces = packing.pack(docs, WORDS, **more).collect()
        check_pack(pieces, [(r[0], r[1]) for r in fx.rows()], more.get("window", 2048))
    assert packing.pack(spark.createDataFrame([], fx.SCHEMA), WORDS).count() == 0
    assert [tuple(r)[2:] for r in packing.pack(spark.createDataFrame([(1, None, None)], "doc_id int, text string, source string"), WORDS).collect()] == [(0, 1, b"\1\0\0\0", 1, 0, 0)]


def test_pack_of_a_table_keeps_the_mixture(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.pack(table, WORDS)
    rows = pieces.collect()
    check_pack(rows, [tuple(r) for r in table.select("doc_id", "text").collect()])
    total, per, seqs = 0, Counter(), defaultdict(Counter)
    for p in rows:
        total += p.length
        per[p.source] += p.length
        seqs[p.sequence_id][p.source] += p.length
    main = sum(n // 64 for n in per.values()) * 64
    for s in range(main // 2048):
        for source, n in per.items():
            assert abs(seqs[s][source] - 2048 * n / total) <= 3 * 64
    # and over any run of windows from the first on
    so_far = Counter()
    for s in range(main // 2048):
        so_far.update(seqs[s])
        for source, n in per.items():
            assert abs(so_far[source] - 2048 * (s + 1) * n / total) <= 3 * 64 + (len(per) * 64 * n / total)
    q = QUERIES["op13_mixture_packing"](spark, SF)
    assert dict(q.dtypes) == {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in q.collect()) == sorted((r.doc_id, r.start, zlib.crc32(r.ids)) for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abE'’ \n\t\x0b ́İßΣ,.1<|endoftext|>")), max_size=40), max_size=4))
def test_chunks_encode_as_whole_texts(texts):
    global ENCODE
    ENCODE = globals().get("ENCODE") or packing.chunk_encoder(packing.read_tokenizer(WORDS), 1)
    counts, ids = ENCODE(pa.array([*texts, None], pa.string()))
    want = ids_of([*texts, None])
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


def test_a_tokenizer_that_keeps_white_space_reads_whole_texts():
    path = tokenizer("byte_bpe_50k.json")[0]
    t = Tokenizer.from_file(path)
    assert not packing.drops_white_space(t) and packing.drops_white_space(Tokenizer.from_file(WORDS))
    counts, ids = packing.chunk_encoder(packing.read_tokenizer(path), 50256)(pa.array(["a  b\n c", ""]))
    want = [*t.encode("a  b\n c", add_special_tokens=False).ids, 50256]
    assert counts.tolist() == [len(want), 1] and ids.tolist() == [*want, 50256]


# the floor of language ID


def test_the_floor_rises_with_the_bytes_alone(spark):
    model = language.train([])
    model.languages = ["a", "b", "c", "d"]
    rows = [("x" * n, score / 100) for n in (1, 20, 127, 128, 129, 400, 100_000) for score in range(25, 45)]
    df = spark.createDataFrame(rows, "text string, score double").withColumn("kept", language.in_a_language(model))
    lowest = {r.n: r.s for r in df.filter("kept").groupBy(F.length("text").alias("n")).agg(F.min("score").alias("s")).collect()}
    want = {n: min(s for t, s in rows if len(t) == n and s >= 0.25 - 1e-9 + 0.15 * n / (n + language.WINDOW)) for n in {len(t) for t, _ in rows}}
    assert lowest == want and sorted(lowest.values()) == [lowest[n] for n in sorted(lowest)]
    # one byte more or less decides little, a guess passes only where there is next to no evidence
    assert lowest[127] == lowest[128] == lowest[129] and lowest[1] == 0.26 and lowest[100_000] == 0.4
    model.languages = ["a", "b"]
    assert df.select(language.in_a_language(model).alias("k")).filter("not k").count() == len([s for _, s in rows if s < 0.5])
