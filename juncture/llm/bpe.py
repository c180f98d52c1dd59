"""Byte-level BPE by a tree reduction over a monoid of token lists.

A piece of text is halved until its parts are short, the parts are merged by rank, and neighbours are joined up the
tree. A join is right as soon as every two adjacent tokens are, by themselves, the encoding of their own bytes:
the first merge of a run over the whole that crossed two of them would cross them in a run over the two alone. So only
a window of tokens around the seam is encoded again, and it grows until the pairs at its two edges pass that test.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import types
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a leaf of the tree; bytes up to which a list of pairs is quicker than a heap; pieces, and pairs of neighbours, in each of
#: the two generations that a worker remembers; pieces handled at a time.
LEAF, SHORT, REMEMBERED, AT_ONCE = 4, 48, 250_000, 1 << 16


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merge the adjacent pair of the lowest rank, the leftmost of equals, until no pair has a rank."""
    n = len(data)
    if n < 2:
        return [data] if data else []
    if n <= SHORT:
        return _merge_short(data, ranks)
    parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue  # one of the two has been merged since
        parts[i], parts[j] = left + right, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(parts[i] + parts[k])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p is not None]


def _merge_short(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same for few bytes: a list of the pairs' ranks in place of a heap."""
    get, none = ranks.get, len(ranks)
    parts = [data[i : i + 1] for i in range(len(data))]
    pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return parts


class Joiner:
    """The tree reduction over one vocabulary. It remembers leaves, windows and settled neighbours, and counts the joins it makes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.joins, self.windows = ranks, 0, 0
        self.seams: dict[tuple[bytes, bytes], bool] = {}
        self.merged: dict[bytes, list[bytes]] = {}

    def merge(self, data: bytes) -> list[bytes]:
        found = self.merged.get(data)
        if found is None:
            found = merge_by_rank(data, self.ranks)
            if len(data) <= 16:
                if len(self.merged) >= REMEMBERED:
                    self.merged.clear()
                self.merged[data] = found
        return found

    def settled(self, a: bytes, b: bytes) -> bool:
        """Whether two adjacent tokens are the encoding of their bytes."""
        found = self.seams.get((a, b))
        if found is None:
            if len(self.seams) >= REMEMBERED:
                self.seams.clear()
            found = self.seams[a, b] = self.merge(a + b) == [a, b]
        return found

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of both sides from the encodings of each."""
        self.joins += 1
        if not left or not right or self.settled(left[-1], right[0]):
            return left + right
        size = 1
        while True:
            size *= 2
            self.windows += 1
            head, tail = left[:-size], right[size:]
            window = self.merge(b"".join(left[-size:] + right[:size]))
            if (not head or self.settled(head[-1], window[0])) and (not tail or self.settled(window[-1], tail[0])):
                return head + window + tail

    def encode(self, data: bytes) -> list[bytes]:
        """Tokens of one piece, halves first."""
        if data in self.ranks:
            return [data]
        if len(data) <= LEAF:
            return self.merge(data)
        middle = len(data) // 2
        return self.join(self.encode(data[:middle]), self.encode(data[middle:]))


def decode_tree(ids: list[int], tokens: dict[int, bytes]) -> bytes:
    """Bytes of the ids, neighbours joined level by level."""
    level = [tokens[i] for i in ids]
    while len(level) > 1:
        level = [b"".join(level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0] if level else b""


def read_ranks(path: str) -> bytes:
    """The vocabulary file, read by the driver; a few hundred kB, and refused beyond 32 MB, because it goes to every task."""
    with open(path, "rb") as f:
        raw = f.read((32 << 20) + 1)
    if len(raw) > 32 << 20:
        raise ValueError(f"{path} is too large for a vocabulary")
    return raw


def _encoder(raw: bytes, pattern: str):
    """A function from text to an iterator of (ids, their decimal text, decoded bytes) for runs of pieces."""
    ranks = parse_ranks(raw)
    tokens = {rank: token for token, rank in ranks.items()}
    split, tree = regex.compile(pattern), Joiner(ranks)
    known: dict[str, tuple[str, bytes]] = {}
    older: dict[str, tuple[str, bytes]] = {}

    def look(piece: str) -> tuple[str, bytes]:
        nonlocal older
        found = older.get(piece)
        if found is None:
            ids = [ranks[t] for t in tree.encode(piece.encode())]
            found = ",".join(map(str, ids)), decode_tree(ids, tokens)
        if len(piece) <= SHORT:
            if len(known) >= REMEMBERED:
                older = dict(known)
                known.clear()
            known[piece] = found
        return found

    def encode(text: str) -> Iterator[tuple[str, bytes]]:
        if len(text) <= AT_ONCE:
            pieces = iter((split.findall(text),))
        else:
            matches = (m[0] for m in split.finditer(text))
            pieces = iter(lambda: list(islice(matches, AT_ONCE)), [])
        for run in pieces:
            if run:
                both = [known.get(p) or look(p) for p in run]
                yield ",".join([x[0] for x in both]), b"".join([x[1] for x in both])

    return encode


def kept_encoder(raw: bytes, pattern: str):
    """The encoder of a Python worker, with what it remembers from its earlier tasks."""
    kept = sys.modules.setdefault("_bpe_encoders", types.ModuleType("_bpe_encoders")).__dict__
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in kept:
        kept[key] = _encoder(raw, pattern)
    return kept[key]


def encode_ids(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All rows and columns of ``docs`` plus the token ids as ``array<int>``; a null text is an empty one."""
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = kept_encoder(raw.value, pattern)
        for texts in batches:
            yield pa.array([[int(i) for run, _ in encode(t or "") for i in run.split(",")] for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(out_col, ids(F.col(text_col)))


def decode_ids(rows: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All rows and columns plus the decoded bytes; null ids give no bytes."""
    raw = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = {rank: token for token, rank in parse_ranks(raw.value).items()}
        for ids in batches:
            yield pa.array([decode_tree(x or [], tokens) for x in ids.to_pylist()], pa.binary())

    return rows.withColumn(out_col, decoded(F.col(ids_col)))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) per row: digests of the decimal ids and of the bytes they decode to.

    The token ids never leave the task. A null or empty text has no tokens; repeated rows are rows of their own; a text of
    any length is handled in runs of pieces. An empty table gives no rows.
    """
    raw = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = kept_encoder(raw.value, pattern)
        for texts in batches:
            counts, ids_hex, bytes_hex = [], [], []
            for text in texts:
                n, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
                for run, data in encode(text.as_py() or ""):
                    ids_sha.update(("," + run if n else run).encode())
                    bytes_sha.update(data)
                    n += run.count(",") + 1
                counts.append(n)
                ids_hex.append(ids_sha.hexdigest())
                bytes_hex.append(bytes_sha.hexdigest())
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(bytes_hex, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), digests(F.col(text_col)).alias("_d")).select(id_col, "_d.*")
