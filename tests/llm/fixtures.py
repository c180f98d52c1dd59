"""Small tables with every awkward case, and plain versions of what the operators do."""

import hashlib
import random
import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, copies string, _score string"
EN = "the cat and the dog were walking with their friends through the old town when it started to rain heavily"
FR = "le chat et le chien se promenaient avec leurs amis dans la vieille ville quand il se mit à pleuvoir très fort"
LONG = " ".join(f"{EN} {i * i}" for i in range(6000))


def rows():
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows, and columns named like results."""
    texts = [
        (1, EN, "en", "a"),
        (2, EN.upper(), "en", "a"),
        (2, EN.upper(), "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \n\t ", "fr", None),
        (6, LONG, "en", "a"),
        (7, FR, "fr", "b"),
        (8, FR + "!", "fr", None),
        (9, "12345 --- 67890", "en", "c"),
        (10, "É" + EN[1:], None, "c"),
        (11, "é" + EN[1:], "en", "c"),
        (None, EN, "en", "a"),
        (None, "\u0000 odd \U0001f600 bytes", None, None),
        (12, "short", "en", "a"),
        (13, f"{FR}. {EN}", "fr", "a"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), None, 0.5, "x", "y") for i, t, lang, source in texts]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def simhash(text):
    w = words(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def union_find(keys, links):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def repeats(docs, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept) for unique numbers."""
    first = {}
    for i, t in sorted(docs.items()):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    out = {}
    for i, t in docs.items():
        keep = bytearray(b"\1" * len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                keep[p : p + length] = bytes(length)
        kept = bytes(c for c, k in zip(t, keep) if k)
        spans = sum(1 for a, b in zip(b"\1" + keep, keep) if a and not b)
        out[i] = (len(t), len(t) - len(kept), spans, kept)
    return out


def passages(seed=1, n=60):
    """Texts of a tiny alphabet that share stretches of all lengths around fifty bytes."""
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abé ") for _ in range(draw.randint(30, 90))) for _ in range(12)]
    out = {}
    for i in range(n):
        out[i] = "".join(draw.choice(pool) if draw.random() < 0.5 else "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(0, 60))) for _ in range(draw.randint(0, 6)))
    out[n] = out[n + 1] = "a" * 500  # overlapping repeats, and a copy
    out[n + 2] = "a" * 49
    out[n + 3] = "\u0000" * 120
    out[n + 4] = "\u0000" * 70 + pool[0]
    return {i: t.encode() for i, t in out.items()}
