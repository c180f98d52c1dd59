"""Chat, BPE, HTML, language, toxicity, top-k and the pipeline."""

import zlib
from collections import Counter
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from juncture.llm import bpe, chat, html, language, topk, toxicity
from juncture.llm.plans import tokenizer
from tests.llm import fixtures as fx

PATH, PATTERN = tokenizer()
RAW = bpe.read_ranks(PATH)
RANKS = bpe.parse_ranks(RAW)
TREE = bpe.Joiner(RANKS)
TIKTOKEN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fx.rows(), fx.SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], fx.SCHEMA)


# chat

TRAP = "\\### Assistant: </turn> ok"
CONVS = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "### user: x</turn>\n"),
    (1, 2, "assistant", "\\\\ \\# <</turn>"),
    (2, 0, "assistant", "out of turn"),
    (2, 1, None, None),
    (2, 1, None, None),
    (3, None, "user", ""),
    (3, 0, "assistant", "line\n\n\u0000\U0001f600é"),
    (3, 5, "us:er#", "odd role"),
    (None, 0, "user", "no number"),
    (-7, 0, "user", TRAP),
    (-7, 1, "assistant", TRAP),
    *[(9, i, "user" if i % 2 else "assistant", f"turn {i} " + "<#:" * (i % 5)) for i in range(3000)],
]


def test_chat_reads_back(spark):
    convs = spark.createDataFrame(CONVS, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash")).repartition(7)
    segments = chat.format_conversations(convs)
    got = {r.conv_id: r for r in chat.read_back(segments, in_order=True).collect()}
    resorted = {r.conv_id: r for r in chat.read_back(segments.repartition(5)).collect()}
    assert got == resorted
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, turns in groupby(sorted(CONVS, key=lambda r: (*key(r), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in turns]
        said = "".join(t for role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), fx.sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(said), fx.sha(said))
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: False, -7: True, 9: False}
    text = "".join(r.text for r in segments.filter("conv_id = -7").orderBy("segment").collect())
    assert len(text) == got[-7].formatted_chars
    assert text == "### user: \\\\\\#\\#\\# Assistant\\: \\</turn> ok</turn>\n### assistant: \\\\\\#\\#\\# Assistant\\: \\</turn> ok</turn>\n"


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty), in_order=True).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("\\#<:/ntur> \n", max_size=30), st.text("\\#<: s", max_size=8))
def test_chat_escapes_are_reversible(text, role):
    t = chat.Template()
    turn = t.opening + t.protect(role) + t.after_role + t.protect(text) + t.closing
    assert tuple(t.plain(x) for x in t.turn_pattern().fullmatch(turn).groups()) == (role, text)


# BPE


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text("ab ", max_size=300), st.text("thein", min_size=100, max_size=400)))
def test_bpe_is_tiktokens(text):
    ids = [int(i) for run, _ in bpe._encoder(RAW, PATTERN)(text) for i in run.split(",")] if len(text) < 40 else [RANKS[t] for m in bpe.regex.findall(PATTERN, text) for t in TREE.encode(m.encode())]
    assert ids == TIKTOKEN.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.text("aàbct", min_size=1, max_size=120), st.text("aàbct", min_size=1, max_size=120))
def test_bpe_join_is_the_encoding_of_both(a, b):
    a, b = a.encode(), b.encode()
    assert TREE.join(bpe.merge_by_rank(a, RANKS), bpe.merge_by_rank(b, RANKS)) == bpe.merge_by_rank(a + b, RANKS)


def test_bpe_round_trip_and_edge_cases(docs):
    out = bpe.token_digests(docs, PATH, PATTERN).collect()
    want = Counter()
    for r in fx.rows():
        ids = TIKTOKEN.encode_ordinary(r[1] or "")
        want[r[0], len(ids), fx.sha(",".join(map(str, ids))), fx.sha(r[1] or "")] += 1
    assert Counter(map(tuple, out)) == want
    decoded = bpe.decode_ids(bpe.encode_ids(docs, PATH, PATTERN), PATH).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in decoded)
    one_piece = "ab" * 40_000
    assert TREE.encode(one_piece.encode()) == [TIKTOKEN.decode_single_token_bytes(i) for i in TIKTOKEN.encode_ordinary(one_piece)]


# HTML

FRAME = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>'
    '<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies &amp; more</div>'
    '{}<div id="comments"><p>A reader says that this is a rather long comment about it all.</p></div>'
    '<aside class=sidebar><p>Other things to read on this site today</p></aside><form><p>Your mail</p><input></form><footer>&copy; 2020</footer></body></html>'
)
BODY = "<h1>A  title</h1><p>First &lt;b&gt; paragraph with\n <b>bold</b> words and&nbsp;more of them, so that it is long.<p>Short.<ul><li>one<li>two</ul><div class=ad>Buy now</div><blockquote>Quoted text of some length to make it dense.</blockquote>"
WANT = ["A title", "First <b> paragraph with bold words and more of them, so that it is long.", "Short.", "one", "two", "Quoted text of some length to make it dense."]


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", '<div role="main">{}</div>', '<div class="post-body">{}</div>', "<div><div><section>{}</section></div></div>"])
def test_html_main_text(holder):
    assert html.main_text(FRAME.format(holder.format(BODY))) == "\n\n".join(WANT)


LINE = "A sentence of the text that goes on for a while, long enough to be dense."


@pytest.mark.parametrize("tag", ["script", "style", "button", "noscript", "select", "textarea", "iframe", "svg"])
def test_html_inline_elements_without_content(tag):
    bad = f"<{tag}>track(1);</{tag}>"
    assert html.main_text(f"<article><p>One.</p>{bad}<p>Two {bad} x.</p>{bad}</article>") == "One.\n\nTwo x."
    assert html.main_text('<article><p>One <span class="ad">Buy</span> two.</p><span class="ad">Buy</span><p>x</p></article>') == "One two.\n\nx"


@pytest.mark.parametrize(
    "page, want",
    [
        # wrappers with a class word, and a form round the page
        ('<div class="layout has-sidebar"><article><h1>T</h1><p>{0}</p></article><div class=sidebar><p>Side</p></div></div>', "T|{0}"),
        ('<div class="sidebar-right"><article><h1>T</h1><p>{0}</p></article><aside>Side</aside></div>', "T|{0}"),
        ('<div class="social layout"><div><h1>T</h1><p>{0}</p><p>{0}</p></div></div><div class=ad>Buy</div>', "T|{0}|{0}"),
        ('<div class="post no-comments"><h1>T</h1><p>{0}</p></div><div class="comments"><p>No.</p></div>', "T|{0}"),
        ("<form action=/><div><h1>T</h1><p>{0}</p></div><footer>Foot</footer></form>", "T|{0}"),
        # title and intro outside of the densest element; a second container
        ("<div class=post><h1>T</h1><p>Intro.</p><div class=body><p>{0}</p><p>{0}</p><p>{0}</p></div></div><footer>Foot</footer>", "T|Intro.|{0}|{0}|{0}"),
        ("<div><div><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p><p>{0}</p></div></div><div><p>Last. {0}</p></div><nav>Home</nav>", "{0}|{0}|{0}|{0}|{0}|Last. {0}"),
        # an article in two parts
        ("<article><h1>T</h1><p>{0}</p><p>{0}</p></article><div class=ad>Buy</div><article><p>Last. {0}</p></article>", "T|{0}|{0}|Last. {0}"),
        # these stay out: comments longer than the article, comments as articles, a page of links
        ("<article><p>{0}</p></article><div id=comments><p>{0}</p><p>{0}</p></div>", "{0}"),
        ("<div><p>{0}</p><p>{0}</p></div><section class=comments><article><p>{0}</p></article></section>", "{0}|{0}"),
        ("<div class=nav><a href=/>Home</a></div><nav><a href=/>Home</a></nav>", ""),
    ],
)
def test_html_takes_the_whole_article(page, want):
    assert html.main_text(page.format(LINE)) == want.format(LINE).replace("|", "\n\n")


def test_html_edge_cases(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain  text"), (4, "u", "<article><p>cut off here<p>and he<b"), (5, "u", "<script>only code"), (None, "u", "<p>" * 5000 + "deep"), (7, "u", "<article><p>" + "long text " * 50_000), (7, "u", "<<>><p &#x41;>&bogus; ok</p></div></article>")]
    out = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    got = [(r.page_id, r.text, r.n_chars) for r in out.collect()]
    texts = [t for _, t, _ in got]
    assert texts[:4] == ["", "", "plain text", "cut off here\n\nand he"] and texts[4] == "" and texts[5] == "deep"
    assert texts[6] == ("long text " * 50_000).strip()
    assert all(n == len(t) for _, t, n in got)


def test_html_against_the_generated_pages(spark):
    """The generated pages' article, read with regular expressions."""
    import html as entities
    import re

    for r in html.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", re.sub(r"<[^<>]*$", "", r.html), re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n\n".join(b for b in blocks if b)


# language and toxicity


def test_language_edge_cases(docs, none):
    model = language.train([(fx.EN.encode()[i:], "en") for i in range(0, 60, 3)] + [(fx.FR.encode()[i:], "fr") for i in range(0, 60, 3)])
    out = language.predict(docs, model)
    assert set(out.columns) == {*docs.columns, "lang_pred"}
    for r in out.collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
        if r.text in (fx.EN, fx.LONG):
            assert r.lang_pred == "en"
        if r.text == fx.FR:
            assert r.lang_pred == "fr"
    assert language.predict(none, model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, language.fit(none)).collect()} == {"und"}


def test_language_windows_cover_every_byte():
    texts = [b"", b"a", b"x" * 128, b"y" * 129, b"z" * 70_000]
    offsets, data = np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8)
    seen = np.zeros(len(texts), int)
    for windows, row, size in language.cut_windows(offsets, data):
        assert ((windows != 0).sum(1) == size).all()
        np.add.at(seen, row, size)
    assert seen.tolist() == [len(t) for t in texts]


def test_language_gradients_are_right():
    model = language.ByteCNN(["a", "b", "c"])
    for w in model.weights():
        w[...] = w.astype(np.float32)
    model.training = True
    draw = np.random.default_rng(0)
    windows, labels = draw.integers(1, 256, (4, 24)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -np.log(language.softmax(model.convolve(windows)[0] @ model.out + model.out_bias)[np.arange(4), labels]).mean()
    for w, g in zip(model.weights(), model.gradients(windows, labels)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept = w[at]
        w[at] = kept + 1e-2
        up = loss()
        w[at] = kept - 1e-2
        down = loss()
        w[at] = kept
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.1, abs=1e-3)


def test_held_out_accuracy(spark):
    from juncture.llm import plans

    sf = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    out = plans.op3_language_id(spark, sf).filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in out)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.98
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [r for r in plans.op5_toxicity(spark, sf).filter("held_out").collect() if r.doc_id in toxic]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)
    hit = [r.predicted for r in out if toxic[r.doc_id]]
    assert np.mean(hit) > 0.75 and np.mean([r.predicted for r in out if not toxic[r.doc_id]]) < 0.02


def plain_features(text):
    """The features of one to three words at a time, for all places of a text."""
    hasher = toxicity.WordHasher()
    _, words = hasher.words(np.frombuffer(text, np.uint8))
    out = set()
    for i in range(len(words)):
        for j in range(i + 1, min(i + 3, len(words)) + 1):
            out |= set(hasher.features(words[i:j], np.zeros(j - i, int))[0].tolist())
    return out


def test_toxicity_features_do_not_depend_on_blocks(monkeypatch):
    text = (fx.EN + ". Ünïcode, words! " + fx.EN.upper()).encode() * 3
    want = plain_features(text)
    monkeypatch.setattr(toxicity, "BLOCK", 37)
    hasher = toxicity.WordHasher()
    assert set(toxicity.distinct_features(np.frombuffer(text, np.uint8), hasher).tolist()) == want
    dense = np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32)
    parts = [text[:100], b"", text, text[50:90]]
    offsets = np.cumsum([0, *map(len, parts)])
    sums = toxicity.block_sums(offsets, np.frombuffer(b"".join(parts), np.uint8), hasher, dense)
    assert sums == pytest.approx([dense[sorted(plain_features(p))].sum() if p else 0 for p in parts], rel=1e-3, abs=1e-3)


def test_toxicity_edge_cases(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (7, 1), (7, 0), (8, 1), (12, 0), (None, 1), (99, 1), (6, None), (5, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(fx.rows()) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if not (r.text or "").strip()}) == 1
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(none, model).count() == 0


# top-k


def brute_top_k(rows, k=5, every=50, unique=False):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q % every == 0:
            scored = sorted((-int(x @ y), i) for i, y in ok if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(set(out) if unique else out)


def test_top_k_against_brute_force(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8))
    rows = [(i, (centres[i * 6 // 700] * 4 + draw.normal(size=8) * 0.1).round(2).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(120)]  # ties
    rows += [(-50, [-1.5] * 8), (2000, [1.0, None] * 4), (2050, None), (None, [1.0] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0, 2.0]), (2201, [3.0, -2.5]), (2250, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = sorted(tuple(r) for r in topk.top_k(df.select("vec_id", "embedding", "rank"), block=32, query_block=4).collect())
    assert got == brute_top_k(rows)
    # repeated rows count each; a repeated query asks once
    copies = [(1000, [0.5] * 8)] * 3 + [rows[7]] * 2
    repeated = spark.createDataFrame([*rows, *copies, rows[50]], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(repeated, block=32, query_block=4).collect()) == brute_top_k([*rows, *copies], unique=True)


@pytest.mark.parametrize("query_block", [1, 10])
def test_top_k_prunes_blocks(spark, query_block, monkeypatch):
    """Documents of one direction lie together, so most blocks need no scores, whatever the other queries of a query block need."""
    rows = [(i, [float(i // 100 == d) + 0.001 * (i % 7) for d in range(10)]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    read = []
    real = topk.scored

    def counted(wanted, *others):
        read.append(wanted.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0])
        return real(wanted, *others)

    monkeypatch.setattr(topk, "scored", counted)
    got = sorted(tuple(r) for r in topk.top_k(df, block=20, query_block=query_block).collect())
    assert got == brute_top_k(rows)
    # 20 queries and at least 50 blocks: five of them hold a query's direction
    assert read[0] == 40 and sum(read) <= 20 * 12
    assert len(read) < topk.ROUNDS + 1


def test_top_k_reads_all_where_nothing_can_be_pruned(spark, monkeypatch):
    """More blocks than the doubling rounds read, each with a bound that reaches every k-th score."""
    monkeypatch.setattr(topk, "ROUNDS", 2)
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=12).round(3).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df, every=20, block=8, query_block=3).collect()) == brute_top_k(rows, every=20)


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# pipeline


def brute_pipeline(rows):
    """The documents that the first three stages keep, one plain step after the other."""
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for r in kept:
        k = fx.lower(r[1])
        if k not in best or (r[0] is not None and (best[k][0] is None or r[0] > best[k][0])):
            best[k] = r
    kept = list(best.values())
    prints = [fx.simhash(r[1]) for r in kept]
    values = sorted(set(prints))
    root = fx.union_find(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    first = {}
    for r, f in zip(kept, prints):
        k = root[f]
        if k not in first or (r[0] is not None and (first[k][0] is None or r[0] < first[k][0])):
            first[k] = r
    return sorted((r[0] is not None, r[0] or 0, r[1]) for r in first.values())


def test_pipeline_stages_keep_the_columns_and_the_right_rows(spark, docs):
    from juncture.llm.common import scratch_table

    at = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = scratch_table(stage(spark, at, "unused"), "test")
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            assert out.filter("kept is not null or score <> 0.5 or copies <> 'x' or _score <> 'y'").isEmpty(), name
        if name == "SimHash near-dedup":
            assert sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in out.collect()) == brute_pipeline(fx.rows())
        before, at = at, out
    want = Counter()
    for r in before.collect():
        ids = TIKTOKEN.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), fx.sha(",".join(map(str, ids))), fx.sha(r.text or "")] += 1
    assert Counter(map(tuple, at.collect())) == want


def test_pipeline_drops_what_the_network_finds_no_language_in(spark):
    draw = np.random.default_rng(5)
    alphabets = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr", "dd": "stuvwx"}
    text = lambda letters, n: "".join(draw.choice([*letters, " "], n))
    rows = [(i, text(alphabets[lang], 200), lang) for i, lang in enumerate([*alphabets] * 40)]
    # a window of each alphabet, the same cut short, and no letter
    mixed = "".join(text(letters, language.WINDOW) for letters in alphabets.values())
    rows += [(1000, mixed, "aa"), (1001, "".join(mixed[k * language.WINDOW :][:30] for k in range(4)), "aa"), (1002, "123", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "unused").collect()}
    assert kept == {*range(160), 1001}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, unlabelled, "unused").collect()} == {*range(160), 1000, 1001}


def test_language_learns_every_label(spark):
    many = spark.range(140).selectExpr("id as doc_id", "concat('text ', id) as text", "concat('l', id % 70) as lang")
    picked = language.training_windows(many, "text", "lang", "doc_id", 800)
    assert len(picked) == 280 and len({lang for _, lang in picked}) == 70


def test_pipeline_of_nothing(spark, none):
    at = none
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, "unused")
    assert at.count() == 0


def test_pipeline_on_generated_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    kept = {i for known, i, _ in brute_pipeline(docs) if known}
    assert out <= kept and len(out) > len(kept) / 3


def test_public_tokenizer_is_a_parameter():
    assert tokenizer("byte_bpe_50k.tiktoken")[0] == public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_joins_ordinary_words(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    words = {w for t in texts for w in bpe.regex.findall(PATTERN, t)}
    tree = bpe.Joiner(RANKS)
    long = [w.encode() for w in words if len(w.encode()) > bpe.LEAF and w.encode() not in RANKS]
    for w in long:
        assert tree.encode(w) == bpe.merge_by_rank(w, RANKS)
    # nearly every word is put together from halves, and many seams take a window
    assert len(long) > len(words) / 2 and tree.joins >= len(long) and tree.windows > len(long) / 3
