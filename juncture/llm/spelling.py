"""Spelling variants: words one edit apart, found in dense tiles of words that share a prefix and a suffix.

Let L be the length of the longer of two words. They are one edit apart exactly if common prefix and common suffix together
reach L - 1. Then the edit lies in one third of L positions, and the words agree before and after that third. So words meet in tiles
keyed by L, the third, and what is before and after it. In a tile, padded matrices of code points, one flush left and
one flush right, are compared pair by pair. A tile with many words is cut into blocks, and each pair of blocks is a tile.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juncture.llm.common import LOWER, UPPER, scratch_table

#: Parts in which an edit is looked for; code points of a block of a tile; cells of a matrix; distinct words that a task counts at a time.
PARTS, BLOCK, CELLS, COUNTED = 3, 1 << 16, 1 << 22, 200_000
FIRST, LAST = "À", "ÿ"


def variant_of(doc_id: object, run: str, every: int) -> str:
    """The run itself, or, if ``every`` divides the crc32 of ``<doc_id>:<run>``, the run less one code point; a null id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n) for words of at least ``shortest`` code points that occur at least ``least`` times.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. One in ``every`` runs of a document is
    misspelt on purpose (:func:`variant_of`). A null text has no words; repeated rows count each.
    """
    # a run below the shortest stays below it
    runs, low = re.compile(f"[A-Za-z{FIRST}-{LAST}]{{{shortest},}}"), str.maketrans(UPPER, LOWER)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        found: dict[str, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own: dict[str, int] = {}
                for m in runs.finditer(text.as_py() or ""):
                    own[m[0]] = own.get(m[0], 0) + 1
                for run, n in own.items():
                    word = variant_of(doc_id, run if run.islower() else run.translate(low), every)
                    if len(word) >= shortest:
                        found[word] = found.get(word, 0) + n
                if len(found) >= COUNTED:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points padded with zeros, flush left and from the last one back."""
    left = np.array(words, dtype=np.str_)
    size = np.char.str_len(left).astype(np.int64)
    left = left.view(np.uint32).reshape(len(words), -1)
    if left.max(initial=0) < 256:
        left = left.astype(np.uint8)
    back = size[:, None] - 1 - np.arange(left.shape[1])
    right = np.where(back >= 0, np.take_along_axis(left, np.maximum(back, 0), axis=1), 0).astype(left.dtype)
    return size, left, right


def single_edits(words: list[str], ends: np.ndarray, longest: np.ndarray, part: np.ndarray, block: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows one edit apart that have the longest length and the part of their tile; each row's tile ends at ``ends``.

    Row i is compared with row i + 1, then i + 2 and so on to the end of its tile. In a tile of two blocks (``cross``) only rows of
    different ones are. A pair can fit several parts of a tile's length; it counts in the one where its common prefix ends.
    """
    size, left, right = matrices(words)
    found_i, found_j = [], []
    rows = np.arange(len(words))
    for gap in range(1, int((ends - rows).max(initial=1))):
        rows = rows[rows + gap < ends[rows]]
        i = rows[~cross[rows] | (block[rows] != block[rows + gap])]
        i = i[np.maximum(size[i], size[i + gap]) == longest[i]]
        if not len(i):
            continue
        j = i + gap
        prefix = np.argmax(left[i] != left[j], axis=1)
        suffix = np.argmax(right[i] != right[j], axis=1)
        near = (prefix + suffix >= longest[i] - 1) & (prefix >= longest[i] * part[i] // PARTS) & (prefix < longest[i] * (part[i] + 1) // PARTS)
        found_i.append(i[near])
        found_j.append(j[near])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))


def near_words(words: DataFrame, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) for words of ``(word, n)``, distinct and not null, that have a near word.

    ``form`` is the near word of largest n (the smallest in code-point order of equals), if that n is at least ``ratio`` times the word's.
    Tiles of more than ``block`` code points are cut into blocks by a hash of the word, so that no task holds more than two blocks
    and their matrices, and a crowded tile spreads over tasks.
    """
    longest = F.length("word") + F.lit(1)
    keys = []
    for more in (0, 1):
        size = F.length("word") + more
        for part in range(PARTS):
            low, high = F.floor(size * part / PARTS).cast("int"), F.floor(size * (part + 1) / PARTS).cast("int")
            before, after = F.substring("word", F.lit(1), low), F.substring("word", longest - (size - high), F.length("word"))
            keys.append(F.struct(size.alias("longest"), F.lit(part).alias("part"), F.xxhash64(before, F.lit("\u0000"), after).alias("key")))
    keyed = words.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("k.*", "word", "n")
    tile = ["longest", "part", "key"]
    crowded = keyed.groupBy(*tile).agg(F.sum(F.length("word")).alias("chars")).filter(F.col("chars") > block)
    crowded = scratch_table(crowded.select(*tile, F.ceil(F.col("chars") / block).cast("int").alias("blocks")), "crowded")
    dealt = keyed.join(crowded, tile, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "word"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    whole = [*tile, "first", "second"]
    dealt = dealt.select(*whole, "block", "word", "n").repartition(*whole).sortWithinPartitions(*whole)

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole tiles, in order."""
        number = {c: table.column(c).to_numpy().astype(np.int64) for c in (*whole, "block", "n")}
        new = np.ones(len(table), bool)
        new[1:] = np.any([number[c][1:] != number[c][:-1] for c in whole], axis=0)
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(table))
        # tiles of one word hold no pair
        keep = np.repeat(ends - heads > 1, ends - heads)
        if not keep.any():
            return
        number = {c: v[keep] for c, v in number.items()}
        words = table.column("word").filter(pa.array(keep)).to_pylist()
        sizes = (ends - heads)[ends - heads > 1]
        tile_end = np.cumsum(sizes)
        # matrices of bounded size, whole tiles each
        cells = np.cumsum(sizes * number["longest"][tile_end - 1])
        at = 0
        while at < len(sizes):
            until = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + CELLS, "right")))
            low, high = int(tile_end[at] - sizes[at]), int(tile_end[until - 1])
            of = {c: v[low:high] for c, v in number.items()}
            own = words[low:high]
            i, j = single_edits(own, np.repeat(tile_end[at:until] - low, sizes[at:until]), of["longest"], of["part"], of["block"], of["first"] != of["second"])
            near = np.bincount(np.concatenate((i, j)), minlength=len(own))
            best: dict[int, tuple[int, str]] = {}
            for a, b in zip(np.concatenate((i, j)).tolist(), np.concatenate((j, i)).tolist()):
                n = int(of["n"][b])
                if n >= ratio * of["n"][a] and (a not in best or (-n, own[b]) < best[a]):
                    best[a] = (-n, own[b])
            at = until
            hit = np.flatnonzero(near).tolist()
            forms = [best.get(r) for r in hit]
            columns = [pa.array([own[r] for r in hit], pa.string()), pa.array(near[hit].astype(np.int64)), pa.array([f and f[1] for f in forms], pa.string()), pa.array([f and -f[0] for f in forms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["word", "near", "form", "form_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            # the last tile may go on
            same = np.all([(v := table.column(c).to_numpy()) == v[-1] for c in whole], axis=0) if len(table) else np.zeros(0, bool)
            cut = len(table) - int(same.sum())
            yield from compare(table.slice(0, cut))
            held = table.slice(cut).combine_chunks()
        if held is not None and len(held):
            yield from compare(held)

    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), "form"))).alias("best")
    found = dealt.mapInArrow(run, "word string, near long, form string, form_n long").groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return found.select("word", "n_near", "best.form", (-F.col("best.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where following ``form`` from each word of (word, form) ends.

    A form occurs ``ratio`` times as often as its word, so a path has as many steps as the largest count has digits at most. Only words that still moved go on.
    """
    links = links.select("word", "form")
    paths, done = links.select("word", F.col("form").alias("root")), None
    while True:
        step = paths.join(links.select(F.col("word").alias("root"), "form"), "root", "left")
        step = scratch_table(step.select("word", "root", "form"), "paths")
        ended = step.filter("form is null").select("word", "root")
        done = ended if done is None else done.unionByName(ended)
        paths = step.filter("form is not null").select("word", F.col("form").alias("root"))
        if paths.isEmpty():
            return done


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 31, shortest: int = 7, least: int = 2, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word, see :func:`count_words` and :func:`near_words`.

    ``root`` is reached from the word by following forms; without a form it is the word itself. Columns of ``docs`` other than identifier and
    text are not read. No words, as in an empty table, give no rows. A run of letters of any length is a word.
    """
    words = scratch_table(count_words(docs, id_col, text_col, every, shortest, least), "words")
    near = scratch_table(near_words(words, ratio, block), "near")
    ends = roots(near.filter("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
