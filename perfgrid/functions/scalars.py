"""Scalar expressions used by several operators."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str) -> Column:
    """Round to six places; the addition turns -0.0 into 0.0."""
    return F.round(as_col(c).cast("double"), 6) + F.lit(0.0)


def first_integer(c: Column | str) -> Column:
    """First run of digits in a file name or address, NULL without one."""
    return F.nullif(F.regexp_extract(as_col(c), r"(\d+)", 1), F.lit("")).try_cast("bigint")


def padded_id(c: Column | str, width: int = 5) -> Column:
    """Zero-padded id; ids longer than the width stay whole."""
    text = as_col(c).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def stem(c: Column | str) -> Column:
    """Part of a name before its first dot."""
    return F.split_part(as_col(c), F.lit("."), F.lit(1))


def percent(c: Column | str) -> Column:
    """'25%' -> 0.25."""
    return F.rtrim(as_col(c), F.lit("%")).try_cast("double") / 100


def int_text(c: Column | str) -> Column:
    """Number as text, integral values (to 1e-9 relative) without a fraction."""
    v = as_col(c).cast("double")
    nearest = F.round(v)
    integral = F.abs(v - nearest) <= F.lit(1e-9) * F.greatest(F.abs(v), F.abs(nearest))
    return F.when(integral, nearest.cast("bigint").cast("string")).otherwise(v.cast("string"))


def poly_terms(columns: list[Column], degree: int = 3) -> list[Column]:
    """All monomials up to the degree, bias first, in graded lexicographic order."""
    terms = [F.lit(1.0)]
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(range(len(columns)), d):
            term = columns[combo[0]]
            for i in combo[1:]:
                term = term * columns[i]
            terms.append(term)
    return terms


def size_terms(n_rows: Column | str, n_features: Column | str) -> list[Column]:
    """Twenty cost features of a dataset shape: monomials of n, d and ln n."""
    n, d = as_col(n_rows).cast("double"), as_col(n_features).cast("double")
    return poly_terms([n, d, F.log(n)], 3)


def minkowski(a: Column | str, b: Column | str, p: int) -> Column:
    """Minkowski distance of two numeric arrays for p = 1 or 2."""
    if p == 1:
        return F.aggregate(
            F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v
        )
    gap = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda s, v: s + v))


def weighted_gap(n1: Column, d1: Column, n2: Column, d2: Column) -> Column:
    """Squared distance of two dataset shapes, features weighted 100 times rows."""
    return (n1 - n2) * (n1 - n2) * 1.0 + (d1 - d2) * (d1 - d2) * 100.0


def floor_pow2(c: Column | str) -> Column:
    """Largest power of two not above the value."""
    return F.pow(F.lit(2.0), F.floor(F.log2(as_col(c))))


def hash_order(seed: int, *keys: Column | str) -> Column:
    """Seeded, engine-independent order key: hex md5 of seed and integer keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_col(k).cast("string") for k in keys]))
