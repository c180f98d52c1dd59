"""Nucleotide expressions: all plain Catalyst, no Python per row."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from juncture.functions.columns import as_col

# fixed values: the standard genetic code, bases in the order T, C, A, G
CODE_BASES = "TCAG"
CODE_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table(stop: str = "X") -> dict[str, str]:
    codons = ("".join(c) for c in product(CODE_BASES, repeat=3))
    return {c: (stop if a == "*" else a) for c, a in zip(codons, CODE_AMINO)}


def amino_acid(codon: Column | str, stop: str = "X") -> Column:
    """One-letter amino acid of a codon; null for anything that is not three known bases."""
    pairs = [F.lit(x) for kv in codon_table(stop).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.upper(as_col(codon)))


def complement(seq: Column | str) -> Column:
    """Swap each base for its partner; order is kept."""
    return F.translate(as_col(seq), "ACGTNacgtn", "TGCANtgcan")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def rna_to_dna(seq: Column | str) -> Column:
    return F.translate(as_col(seq), "Uu", "Tt")


def with_chars(seq: Column | str, body) -> Column:
    """``body(chars)`` over the characters of a text, split once.

    ``substr`` walks a UTF-8 text from its start, so per-position work on a long sequence goes
    through an array.  The array is bound as a lambda variable; spelled out inside another lambda
    it would be split again for every element.
    """
    return F.get(F.transform(F.array(F.split(as_col(seq), "")), body), F.lit(0))


def kmers(seq: Column | str, k: int) -> Column:
    """Every substring of length ``k``; empty when the text is shorter, one null for a null text.

    One pass over the text: at each character the pattern looks ``k`` ahead and moves on by one.
    """
    s = as_col(seq)
    cut = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))
    none = F.array().cast("array<string>")
    return F.when(s.isNull(), F.array(F.lit(None).cast("string"))).when(F.length(s) < k, none).otherwise(cut)


def window_kmers(window: Column | str, k: int) -> Column:
    """The ``k`` k-mers that overlap the middle of a window of exactly ``2k-1`` bases."""
    w = as_col(window)
    return F.when(F.length(w) == 2 * k - 1, kmers(w, k)).otherwise(
        F.raise_error(F.concat(F.lit(f"window must have {2 * k - 1} bases: "), w)).cast("array<string>")
    )


def apply_variant(seq: Column | str, pos: Column | str, ref: Column | str, alt: Column | str) -> Column:
    """Replace ``ref`` at 1-based ``pos`` by ``alt``; an error when the sequence has another base there."""
    s, p, r, a = as_col(seq), as_col(pos), as_col(ref), as_col(alt)
    here = F.upper(F.substr(s, p, F.length(r)))
    changed = F.concat(F.substr(s, F.lit(1), p - 1), a, F.substr(s, p + F.length(r)))
    return F.when(here == F.upper(r), changed).otherwise(F.raise_error(F.concat(F.lit("reference mismatch: "), here)))


def motif_positions(seq: Column | str, motif: str, offset: int) -> Column:
    """0/1 track of a two-base motif.

    A positive offset marks the base that many places after the motif start (first exonic base
    of an acceptor); a negative one the base before it (last exonic base of a donor).
    """
    first, second = motif.upper()

    def track(chars: Column) -> Column:
        return F.transform(
            F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 1, F.lit(0))),
            lambda c, i: F.when((c == first) & (F.get(chars, i + 1) == second), 1).otherwise(0),
        )

    hits = with_chars(F.upper(as_col(seq)), track)
    pad = F.array_repeat(F.lit(0), abs(offset))
    if offset > 0:
        return F.concat(pad, F.slice(hits, F.lit(1), F.greatest(F.size(hits) - (offset - 1), F.lit(0))))
    return F.concat(F.slice(hits, F.lit(1 - offset), F.greatest(F.size(hits) + offset, F.lit(0))), pad)


def translate_sequence(seq: Column | str, stop: str = "_") -> Column:
    """Protein of the codons that end before the last base."""
    s = as_col(seq)
    n = F.floor((F.length(s) - 1) / 3).cast("int")

    def protein(chars: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: amino_acid(F.array_join(F.slice(chars, i * 3 + 1, F.lit(3)), ""), stop)
        )

    return F.when(n < 1, F.lit("")).otherwise(F.array_join(with_chars(s, protein), ""))
