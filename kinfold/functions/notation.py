"""Substitution notation and sequence expressions (all plain columns, so they also run on streams)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.hashing import as_col

# Three-letter to one-letter residue names.
RESIDUES = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E",
    "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F",
    "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}
LETTERS = "ACDEFGHIKLMNPQRSTVWY"

_LONG = r"p\.([A-Z][a-z]{2})(\d+)([A-Z][a-z]{2})"
_TAGGED = r"p\.([A-Z])(\d+)([A-Z*])"
_BARE = r"^([A-Z])(\d+)([A-Z*])$"


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """The mapped value, or null for a key that is not declared."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def parse_substitution(text: str | Column) -> Column:
    """``struct(wt, pos, mut)`` from ``p.Arg123Cys`` or ``p.R123C`` anywhere in the text, or from a bare ``R123C``; null for stops and synonyms."""
    t = as_col(text)
    long = t.rlike(_LONG)

    def part(i: int) -> Column:
        short = F.when(t.rlike(_TAGGED), F.regexp_extract(t, _TAGGED, i)).when(t.rlike(_BARE), F.regexp_extract(t, _BARE, i))
        return F.when(long, F.regexp_extract(t, _LONG, i)).otherwise(short)

    def letter(i: int) -> Column:
        return F.when(long, lookup(RESIDUES, part(i))).otherwise(part(i))

    wt, mut, pos = letter(1), letter(3), part(2).cast("int")
    ok = wt.isNotNull() & mut.isNotNull() & (wt != mut) & (mut != "*") & (wt != "*")
    return F.when(ok, F.struct(wt.alias("wt"), pos.alias("pos"), mut.alias("mut")))


def row_key(*parts: str | Column) -> Column:
    """``gene_pos_wt_mut``."""
    return F.concat_ws("_", *[as_col(p).cast("string") for p in parts])


def class_of(label: str | Column, mapping: Mapping[str, str], unexpected: str = "raise") -> Column:
    """Map a label to its declared class. An undeclared label raises, or is null when ``unexpected='drop'``."""
    source = as_col(label)
    mapped = F.lit(None).cast("string")
    for name, cls in mapping.items():
        mapped = F.when(source == name, F.lit(cls)).otherwise(mapped)
    if unexpected == "drop":
        return mapped
    return F.when(mapped.isNotNull(), mapped).otherwise(
        F.raise_error(F.concat(F.lit("undeclared label: "), F.coalesce(source, F.lit("null")))).cast("string")
    )


def reject_reason(rules: Mapping[str, Column]) -> Column:
    """The name of the first failing rule in declared order; null when every rule passes."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(list(rules.items())):
        reason = F.when(F.coalesce(failed, F.lit(True)), F.lit(name)).otherwise(reason)
    return reason


def apply_substitution(sequence, pos, wt, mut) -> Column:
    """The sequence with one letter replaced; null when out of bounds or the letter differs."""
    s, p = as_col(sequence), as_col(pos)
    ok = (p >= 1) & (p <= F.length(s)) & (F.substring(s, p, F.lit(1)) == as_col(wt))
    return F.when(ok, F.concat(F.substring(s, F.lit(1), p - 1), as_col(mut), F.substring(s, p + 1, F.length(s))))


def sequence_window(sequence, pos, half: int = 511, max_len: int = 1022) -> Column:
    """``struct(window, pos, start)``: at most ``max_len`` letters around ``pos``; short input unchanged."""
    s, p = as_col(sequence), as_col(pos).cast("int")
    n = F.length(s)
    index = p - 1
    start = F.greatest(F.lit(0), index - half)
    end = F.least(n, index + half)
    wide = (end - start) > max_len
    start = F.when(wide, F.greatest(F.lit(0), index - max_len // 2)).otherwise(start)
    end = F.when(wide, F.least(n, start + max_len)).otherwise(end)
    short = n <= max_len
    start = F.when(short, F.lit(0)).otherwise(start)
    text = F.when(short, s).otherwise(F.substring(s, start + 1, end - start))
    return F.struct(text.alias("window"), (index - start + 1).alias("pos"), start.alias("start"))


def windowed_pair(sequence, pos, wt, mut, half: int = 511, max_len: int = 1022) -> Column:
    """``struct(wt_window, mut_window, pos)``; null on a letter mismatch."""
    w = sequence_window(sequence, pos, half, max_len)
    text, at = w.getField("window"), w.getField("pos")
    changed = apply_substitution(text, at, wt, mut)
    return F.when(
        changed.isNotNull(),
        F.struct(text.alias("wt_window"), changed.alias("mut_window"), at.alias("pos")),
    )


def pair_onehot(wt, mut, letters: str = LETTERS) -> Column:
    """Two one-hot blocks side by side; an undeclared letter is a zero block."""

    def block(letter) -> Column:
        x = F.upper(as_col(letter))
        return F.transform(
            F.split(F.lit(letters), ""), lambda a: F.coalesce((a == x).cast("int"), F.lit(0))
        )

    return F.concat(block(wt), block(mut))
