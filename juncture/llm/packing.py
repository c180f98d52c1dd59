"""Mixture-controlled packing of documents into sequences: deficit round-robin over one queue of tokens per source.

A source's documents, one after the other, are its queue. In every round each queue is credited its share of a window, sends
as many whole quanta of tokens as its credit pays for and carries the rest of the credit, its deficit, into the next
round. What the rounds send, one after the other, is cut into windows, so each window holds every source near its
share, and every queue ends at about the same time. Tokens short of a quantum at the end of a queue follow the last round.

After ``r`` rounds a queue has been credited ``r * share`` and has sent the whole part of it, so the deficits that a window or
a task starts with follow from the round's number. A task therefore continues the round-robin where the others
leave off without hearing from them, and documents are cut where they are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juncture.llm.common import row_blocks, shared_dir, text_buffers

#: A source with less than one part in so many of all tokens shares a queue with others like it; so this many queues at most, and one.
MOST_QUEUES = 1024
#: Bytes handled at a time; chunks of text in each of the two generations that a task remembers; cells of a table of rounds by queues.
BLOCK_BYTES, REMEMBERED, CELLS = 8 << 20, 400_000, 1 << 22


def read_tokenizer(path: str) -> str:
    """The tokenizer's file, read by the driver; a few MB, and refused beyond 32 MB, because it goes to every task."""
    with open(path, encoding="utf-8") as f:
        text = f.read((32 << 20) + 1)
    if len(text) > 32 << 20:
        raise ValueError(f"{path} is too large for a tokenizer")
    return text


def drops_white_space(tokenizer) -> bool:
    """Whether texts can be encoded chunk by chunk between white space: tried on a few, for all six ASCII white-space characters."""
    encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    samples = ["Don't", "été,", "x1", "--", "á"]
    apart = [encode(s) for s in samples]
    return all(encode(f"{a}{gap}{b}") == x + y for gap in (*" \t\n\r\x0b\x0c", " \n ") for a, x in zip(samples, apart) for b, y in zip(samples, apart)) and not encode(" \n")


#: Fixed values of one family of tokenizer files: how they normalise a text and cut it into pieces before the merges.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUTTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Chunks for which normalising is lower-casing and the cutter is the pattern below: printable ASCII and the letters and signs U+00C0 to U+00FF.
PLAIN, PIECE = "[!-~\u00c0-\u00ff]+", "'(?:s|t|re|ve|m|ll|d)|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+"

MARK = "([a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,;:!?])"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows, else the next free one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


def chunk_encoder(text: str, end_id: int):
    """A function from an Arrow array of texts to (tokens of each, little-endian unsigned 32-bit ids of all in a row).

    Distinct chunks between white space are encoded once per block of texts at most. In files of the family above the pieces of a plain
    chunk go to the tokenizer's merges one by one; all else goes through the whole tokenizer. Pieces, or else chunks, are
    remembered.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    apart = drops_white_space(tokenizer)
    spec = json.loads(text)
    # the strings of special tokens are looked for before anything else
    special = [t["content"] for t in spec["added_tokens"]]
    family = apart and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == CUTTER and spec["post_processor"] is None
    merges, plain, cut, letters = tokenizer.model.tokenize, re.compile(PLAIN).fullmatch, re.compile(PIECE).findall, byte_letters()
    known: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(p: str) -> bytes:
        found = packed([t.id for t in merges(p if p.isascii() else p.encode().decode("latin-1").translate(letters))])
        if len(p) <= 64:
            known[p] = found
        return found

    def ids_of(chunks: list[str], by_piece: bool) -> list[bytes]:
        nonlocal known, older
        if len(known) > REMEMBERED:
            known, older = {}, known
        get, get_older = known.get, older.get
        found: list[bytes | None] = []
        rest = []
        for c in chunks:
            ids = get(c) or get_older(c)
            if ids is None:
                if by_piece and plain(c):
                    ids = b"".join([get(p) or get_older(p) or piece(p) for p in cut(c.lower())])
                else:
                    rest.append(len(found))
            found.append(ids)
        for start in range(0, len(rest), 10_000):
            part = rest[start : start + 10_000]
            for i, e in zip(part, tokenizer.encode_batch_fast([chunks[i] for i in part], add_special_tokens=False)):
                found[i] = packed(e.ids)
                if len(chunks[i]) <= 64:
                    known[chunks[i]] = found[i]
        return found

    def settled(texts: pa.Array) -> pa.Array:
        """Texts up to U+00FF in small letters, and with a space between a letter or digit and a mark after it, where pieces part anyway."""
        marked = pc.replace_substring_regex(pc.ascii_lower(texts), MARK, r"\1 \2")
        return pc.if_else(pc.match_substring_regex(texts, r"[^\x00-\x{FF}]"), texts, marked)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        by_piece = family and not any(pc.any(pc.match_substring(pc.ascii_lower(texts), x.lower())).as_py() for x in special)
        texts = settled(texts) if by_piece else texts
        lists = pc.ascii_split_whitespace(texts) if apart else pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32), texts)
        coded = lists.flatten().dictionary_encode()
        edges = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        raw = [*ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), by_piece), packed([end_id])]
        sizes = np.array([len(x) // 4 for x in raw], np.int64)
        order = np.insert(coded.indices.to_numpy().astype(np.int64), edges[1:], len(raw) - 1)  # the end of each text
        starts, size = np.cumsum(sizes) - sizes, sizes[order]
        ends = np.cumsum(size)
        at = np.repeat(starts[order] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        ids = np.frombuffer(b"".join(raw), "<u4")[at]
        last = ends[edges[1:] + np.arange(len(texts))]
        return np.diff(np.concatenate(([0], last))), ids

    return encode


def binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary array of so many bytes each from one run of bytes."""
    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])


def tokenised(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """A written table (_part, _at, doc_tokens, _source, _id, ids): ``_at`` counts the tokens before the document in its part and source."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # one encoder, with what it remembers, for all tasks of a Python worker
        kept = sys.modules.setdefault("_packing_encoders", types.ModuleType("_packing_encoders")).__dict__
        key = f"{zlib.crc32(shared.value.encode())}:{len(shared.value)}:{end_id}"
        if key not in kept:
            kept[key] = chunk_encoder(shared.value, end_id)
        part, before, encode = TaskContext.get().partitionId(), {}, kept[key]
        for batch in batches:
            texts = batch.column("_text")
            for i, j in row_blocks(text_buffers(texts)[0], BLOCK_BYTES):
                counts, ids = encode(texts.slice(i, j - i))
                at = []
                sources = batch.column("_source").slice(i, j - i)
                for source, n in zip(sources.to_pylist(), counts.tolist()):
                    at.append(before.get(source, 0))
                    before[source] = at[-1] + n
                columns = [pa.array([part] * (j - i), pa.int32()), pa.array(at, pa.int64()), pa.array(counts), sources, batch.column("_id").slice(i, j - i), binaries(4 * counts, ids)]
                yield pa.RecordBatch.from_arrays(columns, ["_part", "_at", "doc_tokens", "_source", "_id", "ids"])

    out = docs.mapInArrow(run, f"_part int, _at long, doc_tokens long, _source string, _id {kind}, ids binary")
    return written(out, "tokens")


def written(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, compressed more than usual, because ids take four bytes each."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class RoundRobin:
    """Where each token of each queue comes to lie.

    ``tokens`` and ``weights`` by queue. In a round a queue is credited ``window * weight / sum(weights)`` tokens, until it is empty.
    """

    def __init__(self, tokens: list[int], weights: list[int], window: int, quantum: int):
        if window % quantum:
            raise ValueError("a window is a whole number of quanta")
        self.quantum, self.window, self.total = quantum, window, sum(tokens)
        slots = [n // quantum for n in tokens]
        per_round, all_weights = window // quantum, sum(weights)
        rounds = max((-(-s * all_weights // (per_round * w)) for s, w in zip(slots, weights)), default=0)
        # plain integers where 64 bits would not hold the credit
        kind = np.int64 if (rounds + 2) * per_round * max(weights, default=1) < 1 << 62 and all_weights * (max(slots, default=0) + 1) < 1 << 62 else object
        self.slots, self.credit, self.price = np.array(slots, kind), np.array([per_round * w for w in weights], kind), all_weights
        short = np.array([n % quantum for n in tokens], np.int64)
        self.sent_slots = sum(slots)
        self.short_at = self.sent_slots * quantum + np.cumsum(short) - short
        # the last tokens, fewer than a window, are cut at powers of two, so that no sequence needs padding
        full = self.total // window * window
        rest, edges = self.total - full, [full]
        while rest:
            edges.append(edges[-1] + (1 << rest.bit_length() - 1))
            rest -= 1 << rest.bit_length() - 1
        self.edges = np.array(edges, np.int64)

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Quanta that each queue has sent before each of the rounds; what is left of its credit is its deficit."""
        return np.minimum(self.slots, rounds[:, None] * self.credit // self.price)

    def slot(self, queue: np.ndarray, quantum: np.ndarray) -> np.ndarray:
        """Position in the stream, in quanta, of the given quantum of each queue."""
        out = np.empty(len(queue), np.int64)
        step = max(1, CELLS // len(self.slots))
        for i in range(0, len(queue), step):
            q, k = queue[i : i + step], quantum[i : i + step].astype(self.slots.dtype)
            rounds, which = np.unique(-(-(k + 1) * self.price // self.credit[q]) - 1, return_inverse=True)
            before = self.sent(rounds)
            turn = self.sent(rounds + 1) - before
            ahead = before.sum(axis=1)[:, None] + np.cumsum(turn, axis=1) - turn - before
            out[i : i + step] = ahead[which, q] + k
        return out

    def sequence(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the sequence that holds a position of the stream, and the place in it."""
        full = int(self.edges[0])
        late = np.searchsorted(self.edges, at, "right") - 1
        start = np.where(at < full, at // self.window * self.window, self.edges[np.maximum(late, 0)])
        return np.where(at < full, at // self.window, full // self.window + late), at - start

    def cut(self, queue: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents that lie at ``first`` of their queue: (document, start in it, length, sequence, offset)."""
        low, high = first // self.quantum, (first + count - 1) // self.quantum
        per = high - low + 1
        doc = np.repeat(np.arange(len(queue)), per)
        k = np.repeat(low - (np.cumsum(per) - per), per) + np.arange(per.sum())
        q, s = queue[doc], first[doc]
        a, b = np.maximum(s, k * self.quantum), np.minimum(s + count[doc], (k + 1) * self.quantum)
        whole = k < self.slots[q]
        at = np.where(whole, 0, self.short_at[q] + a - self.slots[q] * self.quantum).astype(np.int64)
        at[whole] = self.slot(q[whole], k[whole]) * self.quantum + (a - k * self.quantum)[whole]
        # only tokens after the last round are cut inside a quantum
        tail = np.flatnonzero(~whole)
        if len(tail):
            marks = np.concatenate((np.arange(self.sent_slots * self.quantum // self.window + 1, self.edges[0] // self.window + 1) * self.window, self.edges[1:]))
            inside = np.searchsorted(marks, at[tail] + (b - a)[tail], "left") - np.searchsorted(marks, at[tail], "right")
            times = np.ones(len(at), np.int64)
            times[tail] += inside
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            doc, a, b, at, s = (np.repeat(x, times) for x in (doc, a, b, at, s))
            late = np.flatnonzero(np.repeat(times > 1, times))
            mark = np.searchsorted(marks, at[late], "right") + nth[late]
            start = np.where(nth[late] > 0, marks[np.maximum(mark - 1, 0)], at[late])
            end = np.minimum(marks[np.minimum(mark, len(marks) - 1)], at[late] + (b - a)[late])
            b[late] = a[late] + end - at[late]
            a[late] += start - at[late]
            at[late] = start
        number, offset = self.sequence(at)
        size = b - a
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + size[:-1]) | (number[1:] != number[:-1])
        heads = np.flatnonzero(new)
        length = np.add.reduceat(size, heads) if len(heads) else size
        return doc[heads], (a - s)[heads], length, number[heads], offset[heads]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: dict[str | None, int] | None = None,
    window: int = 2048,
    quantum: int = 64,
    end_id: int = 1,
    most_queues: int = MOST_QUEUES,
) -> DataFrame:
    """(id, source, start, length, ids, doc_tokens, sequence_id, offset): one row per piece of a document.

    ``ids`` are the piece's token ids, little-endian, four bytes each; pieces of one ``sequence_id`` ordered by ``offset`` are the sequence.
    Every sequence has ``window`` tokens, but for a few last ones whose lengths are powers of two. Targets are the
    sources' shares of all tokens, or ``weights`` (positive whole numbers; 1 for a source that is not named and for the shared
    queue): then the other sources go on at their proportions when a queue is empty.

    A null text is an empty one and consists of ``end_id``. A null source is a source of its own. Rows repeated with one identifier are
    documents of their own, a null identifier stays null. Other columns of ``docs`` are not read. An empty table gives no
    rows. Texts of any length are cut into pieces like others; a task holds one text and its tokens at least.

    Token ids are written once to the shared folder; the pieces are cut from that table without a shuffle of tokens, unless
    the table of starts (a row per part and source) is too large for Catalyst to broadcast.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).cast("string").alias("_source"))
    rows = tokenised(plain, tokenizer_path, end_id)
    lines = written(rows.groupBy("_part", "_source").agg(F.sum("doc_tokens").alias("_tokens")), "lines")

    total = lines.agg(F.sum("_tokens")).first()[0] or 0
    sources = lines.groupBy("_source").agg(F.sum("_tokens").alias("_all"))
    # no more than most_queues sources can have a share of one in most_queues
    large = sources.filter(F.col("_all") * most_queues >= total).orderBy(F.col("_source").asc_nulls_last()).collect()
    small = total - sum(r["_all"] for r in large)
    queues = spark.createDataFrame([(r["_source"], i) for i, r in enumerate(large)], "_source string, _queue int")
    tokens = [r["_all"] for r in large] + [small] * (small > 0)
    shares = tokens if weights is None else [weights.get(r["_source"], 1) for r in large] + [1] * (small > 0)
    turns = RoundRobin(tokens, shares, window, quantum)

    # a queue runs through the parts in order, the shared one through the sources of each part
    named = lines.alias("l").join(queues.alias("q"), F.col("l._source").eqNullSafe(F.col("q._source")), "left")
    named = named.select("_part", "l._source", "_tokens", F.coalesce("_queue", F.lit(len(large))).alias("_queue"))
    inside = Window.partitionBy("_queue", "_part").orderBy(F.col("_source").asc_nulls_last())
    earlier = Window.partitionBy("_queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = named.groupBy("_queue", "_part").agg(F.sum("_tokens").alias("_tokens"))
    parts = parts.select("_queue", "_part", F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_earlier"))
    named = named.withColumn("_inside", F.sum("_tokens").over(inside) - F.col("_tokens")).join(parts, ["_queue", "_part"])
    starts = written(named.select("_part", F.col("_source").alias("_name"), "_queue", (F.col("_earlier") + F.col("_inside")).alias("_start")), "starts")

    rows = rows.join(starts.withColumnRenamed("_part", "_of"), (F.col("_part") == F.col("_of")) & F.col("_source").eqNullSafe(F.col("_name")))
    rows = rows.select(F.col("_id"), "_source", "_queue", (F.col("_start") + F.col("_at")).alias("_first"), "doc_tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges, data = text_buffers(batch.column("ids"))
            for i, j in row_blocks(edges, BLOCK_BYTES):
                part = batch.slice(i, j - i)
                number = lambda name: part.column(name).to_numpy().astype(np.int64)  # noqa: E731, B023
                doc, start, length, sequence, offset = turns.cut(number("_queue"), number("_first"), number("doc_tokens"))
                whose = pa.array(doc)
                columns = [part.column("_id").take(whose), part.column("_source").take(whose), pa.array(start), pa.array(length)]
                columns += [binaries(4 * length, data[edges[i] : edges[j]]), part.column("doc_tokens").take(whose), pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_id {kind}, _source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnsRenamed({"_id": id_col, "_source": source_col})
