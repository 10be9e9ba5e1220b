"""Registrations one edit apart, by deletion neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_edit_apart(a: Column, b: Column, strict_reference: bool = False) -> Column:
    """Whether one insertion, deletion, substitution or swap of neighbours turns a into b.

    ``strict_reference`` gives the looser, asymmetric test of swaps that looks at one half of the
    swap only; it is meant for a < b.
    """
    i = F.sequence(F.lit(2), F.length(a))
    swap = lambda k: (
        (F.substring(a, F.lit(1), k - 2) == F.substring(b, F.lit(1), k - 2))
        & (F.substring(a, k, F.lit(1)) == F.substring(b, k - 1, F.lit(1)))
        & (F.substring(a, k + 1, F.length(a)) == F.substring(b, k + 1, F.length(b)))
        & (F.lit(True) if strict_reference else F.substring(a, k - 1, F.lit(1)) == F.substring(b, k, F.lit(1)))
    )
    swapped = (F.length(a) == F.length(b)) & (F.length(a) >= 2) & F.exists(i, swap)
    return (F.levenshtein(a, b, 1) == 1) | ((a != b) & F.when(F.length(a) >= 2, swapped).otherwise(False))


def lookalikes(domains: DataFrame) -> DataFrame:
    """(a, b): registrations (column domain) with the same suffix and labels one edit apart, a < b.

    Two labels one edit apart share a string that lacks one character of either, so an equi-join on
    suffix and such variants finds all pairs without comparing all registrations.  The join is on
    the hash of a variant's text.  Null domains are left out; a domain without a dot has no suffix.
    """
    d = domains.where(F.col("domain").isNotNull()).select("domain").distinct()
    label, suffix = F.substring_index("domain", ".", 1), F.when(F.contains("domain", F.lit(".")), F.expr("substring(domain, instr(domain, '.') + 1)")).otherwise("")
    n = F.length(label)
    shorter = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(label, F.lit(1), i - 1), F.substring(label, i + 1, n)))).otherwise(F.array().cast("array<string>"))
    keyed = d.select("domain", label.alias("label"), F.explode(F.array_distinct(F.concat(F.array(label), shorter))).alias("variant"), suffix.alias("suffix"))
    left = keyed.select(F.col("domain").alias("a"), F.col("label").alias("la"), "variant", "suffix")
    right = keyed.select(F.col("domain").alias("b"), F.col("label").alias("lb"), "variant", "suffix")
    pairs = left.join(right, ["suffix", "variant"]).where("a < b").select("a", "b", "la", "lb").distinct()
    return pairs.where(one_edit_apart(F.col("la"), F.col("lb"))).select("a", "b")
