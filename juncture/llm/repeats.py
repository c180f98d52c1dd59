"""Repeated substrings across documents by merging Burrows-Wheeler transforms.

Every 50-byte string has an anchor: of the ``GRAM``-byte grams in it the one of the least hash, the leftmost of equals. Equal strings
have equal anchors, so only strings whose anchor occurs in two documents can repeat, and all occurrences of a string meet where its
anchor is sent. That much only says where to look:

1. Tasks find the anchors of their documents; the hashes that several documents have go back to these documents.
2. The strings with such anchors are cut out as slices, runs of starts with one anchor, and sent to their anchor. Slices equal in
   full are put together beforehand.
3. There, starts go whose string can't repeat, because the anchor with the 17 bytes on the string's longer side is in no other
   document. What is left is dealt over shards, every shard gets the Burrows-Wheeler transform of its bytes, and the transforms are merged
   by refining their interleave: an array with the shard of each suffix, sorted stably by the bytes that precede the suffixes, is
   right for two more bytes after each round. The intervals of suffixes with a common prefix are refined by the same step; after
   50 bytes they are the repeated strings, and the smallest document of an interval covers it in all others.
4. Covered stretches go back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juncture.llm.common import row_blocks, scratch_table, text_buffers

#: Bytes of a string, of an anchor, and grams in a string.
LENGTH, GRAM = 50, 16
GRAMS = LENGTH - GRAM + 1
#: Bytes that a string has at least on one side of its anchor.
HALF = (LENGTH - GRAM) // 2
#: Bytes that are hashed at a time; bits of a place in them; bits of an anchor's hash.
BLOCK, PLACE_BITS = 1 << 18, 20
#: Bytes of text for each bucket of anchors; bytes of a merge and of each of its shards.
BUCKET_BYTES, MERGE_BYTES, SHARD_BYTES = 2 << 20, 1 << 18, 1 << 16
#: Documents whose slices a task compares before it sends them.
DOCS_AT_ONCE = 5000
NO_ID = (1 << 63) - 1

_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes (a power of two) from each place on, by doubling."""
    h, factor, width = data.astype(np.uint64) + np.uint64(1), 0x5851F42D4C957F2D, 1
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(32)
    return h * _ODD


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[: len(x) - (width - reach)], x[width - reach :]) if width > reach else x


def anchored_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, end of starts, anchor's hash, anchor's place) of each run of starts with one anchor, at most 2**PLACE_BITS bytes."""
    places = np.uint64((1 << PLACE_BITS) - 1)
    keys = gram_hashes(data) & ~places
    keys |= np.arange(len(keys), dtype=np.uint64)
    least = sliding_min(keys, GRAMS)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    return first, np.append(first[1:], len(least)), least[first] >> np.uint64(PLACE_BITS), (least[first] & places).astype(np.int64)


def runs_of_rows(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first start, end of starts, hash, anchor's place) of all rows, block by block; places count from the row's first byte."""
    for low, high in row_blocks(offsets, BLOCK):
        if high - low == 1 and offsets[high] - offsets[low] > 2 * BLOCK:
            # a long text in overlapping pieces
            for at in range(int(offsets[low]), int(offsets[high]) - LENGTH + 1, BLOCK):
                first, end, key, place = anchored_runs(data[at : min(at + BLOCK + LENGTH - 1, int(offsets[high]))])
                moved = at - offsets[low]
                yield np.full(len(first), low), first + moved, end + moved, key, place + moved
            continue
        base = offsets[low]
        if offsets[high] - base < LENGTH:
            continue
        first, end, key, place = anchored_runs(data[base : offsets[high]])
        # cut the runs at the texts' ends and leave out starts of strings that would reach into the next text
        row = np.searchsorted(offsets[low : high + 1] - base, first, "right") - 1
        last = np.searchsorted(offsets[low : high + 1] - base, end - 1, "right") - 1
        whole = row == last
        parts = [(row[whole], first[whole], end[whole], key[whole], place[whole])]
        for i in np.flatnonzero(~whole):
            for r in range(row[i], last[i] + 1):
                a, b = max(first[i], offsets[low + r] - base), min(end[i], offsets[low + r + 1] - base)
                parts.append((np.array([r]), np.array([a]), np.array([b]), key[i : i + 1], place[i : i + 1]))
        row, first, end, key, place = (np.concatenate(x) for x in zip(*parts))
        end = np.minimum(end, offsets[low + row + 1] - base - LENGTH + 1)
        ok = first < end
        row, first, end, key, place = row[ok], first[ok], end[ok], key[ok], place[ok]
        start = offsets[low + row] - base
        yield row + low, first - start, end - start, key, place - start


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by key, and where each key starts in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)


def grouped_rows(ids: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by two keys."""
    order = np.lexsort((texts, ids))
    i, t = ids[order], texts[order]
    return order, np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])])) if len(ids) else np.zeros(0, np.int64)


def packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that those of little range compress to little."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def packed_sorted(x: np.ndarray) -> bytes:
    """The same for ascending numbers, as steps."""
    return packed(np.diff(x.astype(np.int64), prepend=np.int64(0)))


def unpacked_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def packets(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), schema)], [n for n, _ in schema])


ANCHORS = [("bucket", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary())]
SLICES = [("bucket", pa.int32())] + [(c, pa.binary()) for c in ("ids", "keys", "starts", "ends", "places", "hashes", "text")]
COVERS = [("id", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("end", pa.int64())]


def anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """Packets of anchors: (bucket, hashes, ids, keys) to be compared, and (id, key, hashes) of those known to be shared inside a batch.

    A hash goes out once per batch, however many documents of the batch have it, or once for each text of a single identifier.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            found = [(row, key) for row, _, _, key, _ in runs_of_rows(*text_buffers(batch.column("text")))]
            if not found:
                continue
            row, key = (np.concatenate(x) for x in zip(*found))
            del found
            order = np.lexsort((texts[row], ids[row], key))
            row, key = row[order], key[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[row[1:]] != ids[row[:-1]]) | (texts[row[1:]] != texts[row[:-1]])])
            row, key = row[new], key[new]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            several = np.repeat(ids[row[start]] != ids[row[start + size - 1]], size)
            send = ~several
            send[start] = True
            out = []
            sent_key, sent_row, sent_known = key[send], row[send], several[send]
            order, first = grouped(sent_key % np.uint64(buckets))
            for a, b in zip(first, np.append(first[1:], len(order))):
                at = order[a:b]
                # the last bit says that the batch has two documents with it
                marked = (sent_key[at] << np.uint64(1)) | sent_known[at].astype(np.uint64)
                out.append((int(sent_key[at[0]] % np.uint64(buckets)), None, None, packed_sorted(marked), packed(ids[sent_row[at]]), packed(texts[sent_row[at]])))
            order, first = grouped_rows(ids[row[several]], texts[row[several]])
            known_row, known_key = row[several][order], key[several][order]
            for a, b in zip(first, np.append(first[1:], len(order))):
                own = int(ids[known_row[a]])
                out.append((own % buckets, own, int(texts[known_row[a]]), known_key[a:b].tobytes(), None, None))
            yield packets(ANCHORS, out)

    return docs.mapInArrow(run, "bucket int, id long, key long, hashes binary, ids binary, keys binary")


def shared_anchors(sent: DataFrame) -> DataFrame:
    """(id, key, hashes): the anchors of a document that another one has too, as far as its own task couldn't tell."""
    types, names = (pa.int64(), pa.int64(), pa.binary()), ["id", "key", "hashes"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, keys, ids, texts = None, [], [], []

        def told() -> pa.RecordBatch | None:
            key, own, text = np.concatenate(keys), np.concatenate(ids), np.concatenate(texts)
            known, key = (key & 1).astype(bool), key >> 1
            order, first = grouped(key)
            count = np.diff(np.append(first, len(key)))
            low, high = np.minimum.reduceat(own[order], first), np.maximum.reduceat(own[order], first)
            shared = np.repeat((low != high) | np.logical_or.reduceat(known[order], first), count)
            key, own, text = key[order][shared], own[order][shared], text[order][shared]
            order, first = grouped_rows(own, text)
            own, text, key, first = own[order], text[order], key[order].tobytes(), first.tolist()
            rows = [(i, t, key[8 * a : 8 * b]) for i, t, a, b in zip(own[first].tolist(), text[first].tolist(), first, [*first[1:], len(own)])]
            return made(rows) if rows else None

        for batch in batches:
            passed = []
            for at, one, text, hashes, many, theirs in zip(*(batch.column(c).to_pylist() for c, _ in ANCHORS)):
                if many is None:
                    passed.append((one, text, hashes))
                    continue
                if at != bucket and keys:
                    if (rows := told()) is not None:
                        yield rows
                    keys, ids, texts = [], [], []
                bucket = at
                keys.append(unpacked_sorted(hashes))
                ids.append(unpacked(many))
                texts.append(unpacked(theirs))
            if passed:
                yield made(passed)
        if keys and (rows := told()) is not None:
            yield rows

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "id long, key long, hashes binary")


def slices(docs: DataFrame, buckets: int) -> DataFrame:
    """Packets of slices for each bucket of anchors from (id, key, text, told: lists of shared hashes).

    Of slices equal in full inside a batch, one of the smallest document goes out; those of larger documents are
    covered, whatever else there is, and go out without text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, DOCS_AT_ONCE) for whole in batches for i in range(0, len(whole), DOCS_AT_ONCE)):
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            offsets, data = text_buffers(batch.column("text"))
            told = [np.unique(np.frombuffer(b"".join(lists or []), np.uint64)) for lists in batch.column("told").to_pylist()]
            raw = memoryview(data)
            best: dict[bytes, int] = {}
            found, covered, order = [], [], []
            for row, first, end, key, place in runs_of_rows(offsets, data):
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else []
                hit = np.zeros(len(row), bool)
                for a, b in zip(start, np.append(start[1:], len(row))):
                    own = told[row[a]]
                    if len(own):
                        at = np.minimum(np.searchsorted(own, key[a:b]), len(own) - 1)
                        hit[a:b] = own[at] == key[a:b]
                if hit.any():
                    order.append((row[hit], first[hit], end[hit], key[hit], place[hit]))
            if not order:
                continue
            row, first, end, key, place = (np.concatenate(x) for x in zip(*order))
            low = (offsets[row] + first).tolist()
            high = (offsets[row] + end + (LENGTH - 1)).tolist()
            own = ids[row].tolist()
            for i, (a, b) in enumerate(zip(low, high)):
                text = bytes(raw[a:b])
                j = best.setdefault(text, i)
                if own[j] > own[i]:
                    covered.append(j)
                    best[text] = i
                elif own[j] < own[i]:
                    covered.append(i)
                elif i != j:
                    found.append(i)  # the same document twice: both wait for the answer
            found = np.array(sorted({*found, *best.values()} - set(covered)), np.int64)
            out = []
            for at, with_text in ((found, True), (np.array(covered, np.int64), False)):
                # by bucket, and by anchor inside: slices of one anchor are alike
                at = at[np.argsort(key[at], kind="stable")]
                by_bucket, start = grouped(key[at] % np.uint64(buckets))
                at = at[by_bucket]
                for a, b in zip(start, np.append(start[1:], len(at))):
                    some = at[a:b]
                    cells = [packed(x) for x in (ids[row[some]], keys[row[some]], first[some], end[some] - first[some], place[some] - first[some])]
                    text = b"".join(bytes(raw[low[i] : high[i]]) for i in some.tolist()) if with_text else None
                    out.append((int(key[some[0]] % np.uint64(buckets)), *cells, packed_sorted(key[some]), text))
            yield packets(SLICES, out)

    return docs.mapInArrow(run, "bucket int, ids binary, keys binary, starts binary, ends binary, places binary, hashes binary, text binary")


def shard_order(text: np.ndarray) -> np.ndarray:
    """Circular suffixes of a shard in the order of their first 64 bytes, by doubling."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.roll(text, -i)
    step = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if step >= 64 or rank[order[-1]] == n - 1:
            return order
        key = (rank * n + np.roll(rank, -step)).astype(np.uint64)
        step *= 2


def merged_intervals(texts: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each shard's text the interval number of each circular suffix: equal numbers have equal first ``length`` bytes.

    ``preceding`` is the transform over pairs of bytes: what stands before each suffix in the shard's order. The
    interleave ``shard`` says which shard each merged suffix is from; sorted stably by preceding pairs it is right for
    two more bytes, and an interval goes on where both the pair and the interval behind it are the same.
    """
    orders = [shard_order(t) for t in texts]
    preceding = np.concatenate([(np.roll(t, 2)[o].astype(np.uint16) << np.uint16(8)) | np.roll(t, 1)[o] for t, o in zip(texts, orders)])
    shard = np.repeat(np.arange(len(texts), dtype=np.uint16 if len(texts) > 255 else np.uint8), [len(t) for t in texts])
    parts = np.split(preceding, np.cumsum([len(t) for t in texts])[:-1])
    interval = np.zeros(len(shard), np.int32)
    for _ in range(0, length, 2):
        merged = np.empty_like(preceding)
        for number, part in enumerate(parts):
            merged[shard == number] = part
        order = np.argsort(merged, kind="stable")
        shard, behind, pair = shard[order], interval[order], merged[order]
        interval[0] = 0
        np.cumsum((behind[1:] != behind[:-1]) | (pair[1:] != pair[:-1]), out=interval[1:])
        if interval[-1] == len(interval) - 1:
            break
    place = np.argsort(shard, kind="stable")
    out, start = [], 0
    for text, order in zip(texts, orders):
        numbers = np.empty(len(text), np.int32)
        numbers[order] = interval[place[start : start + len(text)]]
        out.append(numbers)
        start += len(text)
    return out


def covered_starts(texts: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each slice, of which no two are equal, whether the string at each start is in a slice of a smaller document."""
    shards, sizes, held = [], [], 0
    for text in texts:
        if not shards or held >= SHARD_BYTES:
            shards.append([])
            held = 0
        shards[-1].append(text)
        held += len(text)
    numbers = np.concatenate(merged_intervals([np.frombuffer(b"".join(s), np.uint8) for s in shards]))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = sizes - (LENGTH - 1)
    begin = np.cumsum(sizes) - sizes
    slice_of = np.repeat(np.arange(len(texts)), starts)
    at = np.arange(len(slice_of)) - np.repeat(np.cumsum(starts) - starts, starts) + begin[slice_of]
    number, own = numbers[at], ids[slice_of]
    least = np.full(int(numbers.max(initial=0)) + 1, NO_ID)
    np.minimum.at(least, number, own)
    return np.split(own > least[number], np.cumsum(starts)[:-1])


def halves_in_two_documents(
    data: np.ndarray, begin: np.ndarray, first: np.ndarray, end: np.ndarray, place: np.ndarray, hashes: np.ndarray, ids: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The starts of each slice, narrowed to those whose string can be in another document.

    A string reaches HALF bytes or more to the left or to the right of its anchor. So it can only repeat if the anchor
    with HALF bytes on that side does, which is looked up by hash among the slices of the anchor.
    """
    grams = gram_hashes(data)

    def shared(at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Which of the slices have the HALF + GRAM bytes from ``at`` on in common with another document."""
        out = np.zeros(len(first), bool)
        i = np.flatnonzero(which)
        if len(i):
            x = at[i]
            mark = ((grams[x] * _ODD) ^ grams[x + HALF]) * _ODD ^ data[x + GRAM].astype(np.uint64) ^ (hashes[i].astype(np.uint64) << np.uint64(20))
            order, start = grouped(mark)
            own = ids[i][order]
            several = np.minimum.reduceat(own, start) != np.maximum.reduceat(own, start)
            out[i[order]] = np.repeat(several, np.diff(np.append(start, len(i))))
        return out

    middle = place - HALF
    left = shared(begin + (middle - first), first <= middle)
    right = shared(begin + (place - first), end - 1 >= middle)
    low = np.where(left, first, np.maximum(first, middle))
    high = np.where(right, end, np.minimum(end, middle + 1))
    return low, np.where(left | right, high, low)


def solve(ids: np.ndarray, keys: np.ndarray, first: np.ndarray, end: np.ndarray, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
    """Covered runs (id, key, first, end) of the slices of one merge."""
    least: dict[bytes, int] = {}
    own = ids.tolist()
    for text, i in zip(texts, own):
        if least.setdefault(text, i) > i:
            least[text] = i
    distinct = list(least)
    answers = dict(zip(distinct, covered_starts(distinct, np.fromiter(least.values(), np.int64, len(least)))))
    for i, text in enumerate(texts):
        if own[i] > least[text]:
            yield own[i], int(keys[i]), int(first[i]), int(end[i])
            continue
        flags = answers[text]
        if flags.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                yield own[i], int(keys[i]), int(first[i]) + a, int(first[i]) + b


def covers(sent: DataFrame) -> DataFrame:
    """(id, key, first, end): starts of strings that a smaller document has too, from packets of slices."""

    def merges(held: list[tuple[np.ndarray, ...]], texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """Slices by anchor, so many anchors at a time that their bytes make one merge."""
        ids, keys, first, end, place, hashes = (np.concatenate(x) for x in zip(*held))
        whole = b"".join(texts)
        begin = np.cumsum(end - first + (LENGTH - 1)) - (end - first + (LENGTH - 1))
        low, high = halves_in_two_documents(np.frombuffer(whole, np.uint8), begin, first, end, place, hashes, ids)
        at = np.flatnonzero(low < high)
        begin, ids, keys, hashes = begin[at] + (low - first)[at], ids[at], keys[at], hashes[at]
        first, end = low[at], high[at]
        sizes = end - first + (LENGTH - 1)
        order, start = grouped(hashes)
        total = np.cumsum(sizes[order])
        bounds = np.append(start[1:], len(order))
        a = 0
        while a < len(order):
            # whole anchors, as many as MERGE_BYTES hold, one at least
            limit = (total[a - 1] if a else 0) + MERGE_BYTES
            fit = bounds[(bounds > a) & (total[bounds - 1] <= limit)] if len(bounds) < 64 else bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(total[bounds - 1], limit, "right")]
            b = int(fit[-1]) if len(fit) else int(bounds[np.searchsorted(bounds, a, "right")])
            some = order[a:b]
            yield from solve(ids[some], keys[some], first[some], end[some], [whole[x : x + n] for x, n in zip(begin[some].tolist(), sizes[some].tolist())])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, texts = None, [], []
        for batch in batches:
            rows: list[tuple] = []
            for at, *numbers, text in zip(*(batch.column(c).to_pylist() for c, _ in SLICES)):
                ids, keys, first, length, place = (unpacked(x) for x in numbers[:5])
                if text is None:
                    rows.extend(zip(ids.tolist(), keys.tolist(), first.tolist(), (first + length).tolist()))
                    continue
                if at != bucket and texts:
                    rows.extend(merges(held, texts))
                    held, texts = [], []
                bucket = at
                held.append((ids, keys, first, first + length, first + place, unpacked_sorted(numbers[5])))
                texts.append(text)
            if rows:
                yield packets(COVERS, rows)
        if texts and (rows := list(merges(held, texts))):
            yield packets(COVERS, rows)

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "id long, key long, first long, end long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) for each row: bytes covered by a repeated string taken out.

    Without ``with_bytes`` the column ``kept`` is null.

    A byte goes if one of the 50-byte strings over it starts in a document of a smaller identifier too; strings are judged on the
    input. ``kept`` is binary, as a cut may fall inside a character. A null text is empty; texts under 50 bytes stay whole;
    a null identifier is larger than all others; rows of one identifier don't cover each other. An empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = max(16, int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    # texts of one identifier, or of none, are told apart by a hash; where each identifier has one row, the key says nothing and costs nothing
    many = scratch_table(rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("id"), "repeated-ids")
    keyed = rows.join(many.withColumn("_many", F.lit(True)), "id", "left")
    keyed = keyed.select("id", "text", F.when(F.col("_many"), F.xxhash64("text")).otherwise(F.lit(1).cast("long")).alias("key"))
    on = ["id", "key"]
    told = shared_anchors(anchors(keyed, buckets)).groupBy(*on).agg(F.collect_list("hashes").alias("told"))
    # copies of a smaller document are covered as a whole
    prints = keyed.filter(F.octet_length("text") >= LENGTH).select(*on, F.sha2("text", 256).alias("_sha"))
    least = prints.groupBy("_sha").agg(F.min("id").alias("_least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    copies = prints.join(least, "_sha").filter("id > _least").select(*on).distinct().withColumn("copied", F.lit(True))

    texts = keyed.repartition(*on)
    asked = texts.join(told, on).join(copies, on, "left").filter(F.col("copied").isNull())
    found = covers(slices(asked.select("id", "key", "text", "told"), buckets)).groupBy(*on).agg(F.collect_list(F.struct("key", "first", "end")).alias("covers"))
    joined = texts.join(found, on, "left").join(copies, on, "left").select("id", "key", "text", "covers", F.col("copied").isNotNull().alias("copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(batch.column("text"))
            out = []
            for i, (number, key, runs, copy) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "key", "covers", "copy")))):
                text = data[offsets[i] : offsets[i + 1]]
                kept = np.ones(len(text), bool)
                if copy:
                    kept[:] = False
                for x in runs or []:
                    if x["key"] == key:
                        kept[x["first"] : x["end"] + LENGTH - 1] = False
                rest = text[kept].tobytes()
                spans = int((~kept[:1]).sum() + (kept[:-1] & ~kept[1:]).sum())
                out.append((None if number == NO_ID else number, len(text), len(text) - len(rest), spans, rest if with_bytes else None, hashlib.sha256(rest).hexdigest()))
            if out:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    done = joined.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    return done.withColumnRenamed("id", id_col)
