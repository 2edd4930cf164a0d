"""Sequence, identifier and annotation-text functions as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Modification codes and their names.
MOD_NAMES = {"a": "m6A", "17596": "inosine", "69426": "2OmeA", "m": "5mC", "h": "5hmC"}


def window(seq: Column, pos: Column, before: int, after: int) -> Column:
    """Bases [pos-before, pos+after) of a 0-based position, clipped to the sequence."""
    start = F.greatest(pos - before, F.lit(0))
    return F.substring(seq, (start + 1).cast("int"), F.greatest(pos + after - start, F.lit(0)).cast("int"))


def capital(bases: Column) -> Column:
    """ASCII letters as capitals; one base stays one character."""
    return F.translate(bases, string.ascii_lowercase, string.ascii_uppercase)


def gc_content(seq: Column, pos: Column, half: int = 25) -> Column:
    """Share of G and C around a position; null for an empty window."""
    w = capital(window(seq, pos, half, half))
    n = F.length(w)
    return (n - F.length(F.translate(w, "GC", ""))) / F.nullif(n, F.lit(0))


def is_drach(seq: Column, pos: Column) -> Column:
    """The DRACH motif in the five bases around a position; U reads as T, the strand is ignored."""
    return F.coalesce(F.translate(capital(window(seq, pos, 2, 3)), "U", "T").rlike("[AGT][AG]AC[ACT]"), F.lit(False))


def kmer(seq: Column, pos: Column) -> Column:
    """The eleven bases around a position; empty for an unknown sequence."""
    return F.coalesce(capital(window(seq, pos, 5, 6)), F.lit(""))


def transcript_id(reference: Column) -> Column:
    return F.split_part(reference, F.lit("|"), F.lit(1))


def gene_of_reference(reference: Column) -> Column:
    """The sixth field of a piped name, else the whole name."""
    parts = F.split(reference, r"\|")
    return F.when(F.size(parts) > 5, F.get(parts, F.lit(5))).otherwise(reference)


def gtf_attribute(attributes: Column, name: str) -> Column:
    """A quoted attribute of a GTF line; the last one where it repeats, null where it is absent or empty."""
    found = F.regexp_extract_all(attributes, F.lit(rf'(?:^|[^\w]){name}\s+"([^"]+)"'), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def mod_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in MOD_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, code), F.concat(F.lit("mod_"), code))


def condition_of_sample(sample: Column) -> Column:
    """The treatment that a sample's name states."""
    return F.when(F.lower(sample).contains("plasma"), "plasma_treated").otherwise("untreated")


def oxygen_of_sample(sample: Column) -> Column:
    return F.when(F.lower(sample).contains("hypoxia"), "hypoxia").when(F.lower(sample).contains("normoxia"), "normoxia").otherwise("?")


def minus_log10(x: Column) -> Column:
    return -F.log10(F.greatest(x, F.lit(1e-300)))
