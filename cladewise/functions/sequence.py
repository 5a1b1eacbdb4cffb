"""Codons and sequences as Column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code in the order TCAG, and how other codes differ from it.
BASES = "TCAG"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CHANGES = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    10: {"TGA": "C"},
    11: {},
    12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    15: {"TAG": "Q"},
    16: {"TAG": "L"},
    21: {"AAA": "N", "AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    22: {"TAG": "L", "TCA": "*"},
    23: {"TTA": "*"},
    24: {"AGA": "S", "AGG": "K", "TGA": "W"},
    25: {"TGA": "G"},
    26: {"CTG": "A"},
}
#: IUPAC ambiguity codes, and X for any nucleotide.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "GATC", "X": "GATC"}


def genetic_code(ncbi_id: int = 1) -> dict[str, str]:
    """Codon to amino acid ('*' for stop) of an NCBI translation table."""
    if ncbi_id not in CHANGES:
        raise ValueError(f"unknown genetic code {ncbi_id}")
    return {"".join(c): aa for c, aa in zip(product(BASES, repeat=3), STANDARD, strict=True)} | CHANGES[ncbi_id]


def compatible_codons(codon: str, ncbi_id: int = 1) -> list[str]:
    """Sense codons an ambiguous codon can stand for; none for gaps, unknown letters and NNN."""
    codon = codon.upper().replace("U", "T")
    if len(codon) != 3 or codon == "NNN" or any(c not in IUPAC for c in codon):
        return []
    code = genetic_code(ncbi_id)
    return [c for c in map("".join, product(*(IUPAC[x] for x in codon))) if code[c] != "*"]


def codons(sequence: Column) -> Column:
    """The complete codons of a sequence, upper-case."""
    n = F.floor(F.length(sequence) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.upper(sequence), i * 3 + 1, 3))).otherwise(F.array().cast("array<string>"))


def translate_aligned(sequence: Column, ncbi_id: int = 1) -> Column:
    """Amino acids of an aligned coding sequence: '---' is '-', stops, partial gaps and ambiguous codons are 'X'."""
    code = F.create_map(*[F.lit(x) for c, aa in genetic_code(ncbi_id).items() if aa != "*" for x in (c, aa)])
    one = lambda c: F.when(c == "---", "-").otherwise(F.coalesce(F.try_element_at(code, c), F.lit("X")))
    return F.array_join(F.transform(codons(sequence), one), "")


def identity(x: Column, y: Column) -> Column:
    """Share of equal characters among the places where neither sequence has a gap ('-' or '.'); null without such places.

    Fails on empty sequences and on unequal lengths when the rows are used.
    """
    pair = F.zip_with(F.split(x, ""), F.split(y, ""), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = F.filter(pair, lambda p: ~p.a.isin("-", ".") & ~p.b.isin("-", "."))
    share = F.size(F.filter(both, lambda p: p.a == p.b)) / F.nullif(F.size(both), F.lit(0))
    wrong = F.when(F.length(x) != F.length(y), "sequences must be of one length").when(F.length(x) == 0, "sequences must not be empty")
    return F.when(wrong.isNotNull(), F.raise_error(wrong).cast("double")).otherwise(share)


def standard_name(name: Column) -> Column:
    """Node names without quotes, bracketed comments and what follows a slash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\[.*", ""), "/.*", ""), "['\"]", "")


def state_change(before: Column, after: Column, site: Column, match: Column | None = None) -> Column:
    """'A12G'; a side that is 'any' or null is left out, 'dif' is written as it is.

    With the class of a change in ``match`` a side of it that is no single state
    is left out, whatever it is, and '12:any2dif' is written where neither is.
    """
    if match is not None:
        one = lambda c, part: F.when(F.split(match, "2")[part] == "spe", c).otherwise("")
        text = F.concat(one(before, 0), site.cast("string"), one(after, 1))
        return F.when(match.contains("spe"), text).otherwise(F.concat(site.cast("string"), F.lit(":"), match))
    side = lambda c: F.when(c.isNull() | (c == "any"), "").otherwise(c)
    return F.concat(side(before), site.cast("string"), side(after))


def translate_ungapped(sequence: Column, ncbi_id: int = 1) -> Column:
    """Amino acids of a coding sequence without gaps; fails on a length that isn't a multiple of three and on unknown codons when the rows are used."""
    code = F.create_map(*[F.lit(x) for kv in genetic_code(ncbi_id).items() for x in kv])
    one = lambda c: F.coalesce(F.try_element_at(code, F.regexp_replace(c, "U", "T")), F.raise_error(F.concat(F.lit("unknown codon "), c)).cast("string"))
    text = F.array_join(F.transform(codons(sequence), one), "")
    return F.when(F.length(sequence) % 3 == 0, text).otherwise(F.raise_error(F.lit("a coding sequence's length must be a multiple of three")).cast("string"))
