"""Sequence expressions that stay inside one row: counts by string arithmetic, no explode.

A dinucleotide of two different letters cannot overlap itself, so its count is
the length lost when it is removed. A doubled letter starts at every occurrence
of the letter that is not followed by another letter and is not the last base.
All results are integers computed by generated code in the scan stage: no
shuffle, whatever the sequence length.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanframe.functions.constants import BASES, DINUCLEOTIDES, STEP_SCALE


def replace_each(text: Column, pairs: dict[str, str]) -> Column:
    """Plain replacements one after the other; much faster than a per-character translation."""
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalise(sequence: Column) -> Column:
    """Upper case, white space removed, ambiguity codes as N. Text that needs no change is only scanned."""
    upper = F.upper(sequence)
    return F.when(upper.rlike("[^ACGTN]"), F.translate(upper, "RYSWKMBDHVU \n\r\t", "NNNNNNNNNNN")).otherwise(upper)


def gc_count(sequence: Column) -> Column:
    return F.length(sequence) - F.length(replace_each(sequence, {"G": "", "C": ""}))


def clean(sequence: Column) -> Column:
    """Without N."""
    return F.replace(sequence, F.lit("N"), F.lit(""))


def base_count(sequence: Column, base: str) -> Column:
    return F.length(sequence) - F.length(F.replace(sequence, F.lit(base), F.lit("")))


def pair_count(sequence: Column, pair: str) -> Column:
    """Occurrences of two different letters in a row."""
    return ((F.length(sequence) - F.length(F.replace(sequence, F.lit(pair), F.lit("")))) / 2).cast("int")


def gc_fraction(sequence: Column) -> Column:
    """G+C over known bases; 0 without any."""
    known = F.length(sequence) - base_count(sequence, "N")
    return F.when(known > 0, gc_count(sequence) / known).otherwise(0.0)


def with_step_counts(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Add ``c_AA`` .. ``c_TT``: how often each dinucleotide step occurs."""
    seq = F.col(sequence)
    mixed = {
        a + b: pair_count(seq, a + b) for a in (*BASES, "N") for b in (*BASES, "N") if a != b and a != "N"
    }
    staged = df.withColumns({f"c_{k}": v for k, v in mixed.items()}).withColumns(
        {f"_n_{b}": base_count(seq, b) for b in BASES}
    )
    doubled = {
        f"c_{b}{b}": F.greatest(
            F.lit(0),
            F.col(f"_n_{b}")
            - F.when(seq.endswith(b), 1).otherwise(0)
            - reduce(add, [F.col(f"c_{b}{o}") for o in (*BASES, "N") if o != b]),
        )
        for b in BASES
    }
    return staged.withColumns(doubled).drop(*[f"_n_{b}" for b in BASES], *[f"c_{b}N" for b in BASES])


def step_total() -> Column:
    """Number of known steps."""
    return reduce(add, [F.col(f"c_{d}") for d in DINUCLEOTIDES])


def step_sum(table: dict[str, float], power: int = 1) -> Column:
    """Exact sum of a step property (to a power) over all steps, from integer arithmetic."""
    terms = [F.col(f"c_{d}") * F.lit(round(table[d] * STEP_SCALE) ** power).cast("long") for d in DINUCLEOTIDES]
    return reduce(add, terms) / F.lit(float(STEP_SCALE**power))


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.upper(replace_each(sequence, {"A": "t", "T": "a", "C": "g", "G": "c"})))
