"""Probability vectors, bands and permutations as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def unit_sum(p: Column) -> Column:
    """The vector scaled to sum 1; null components without mass."""
    return F.transform(p, lambda x: F.try_divide(x, total(p)))


def unit_sum_or_fail(p: Column) -> Column:
    """The vector scaled to sum 1; a vector without positive mass fails the job."""
    return F.when(total(p) > 0, unit_sum(p)).otherwise(F.raise_error(F.lit("a probability vector has no mass")))


def entropy(p: Column) -> Column:
    """Entropy in nats over the positive components."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, -x * F.ln(x)).otherwise(0.0))


def half_l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) * 0.5


def top_two_margin(p: Column) -> Column:
    s = F.sort_array(p, asc=False)
    return F.get(s, F.lit(0)) - F.coalesce(F.get(s, F.lit(1)), F.lit(0.0))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    return unit_sum(F.transform(logits, lambda x: F.exp((x - top) / F.lit(temperature))))


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    z = F.transform(logits, lambda x: (x - F.array_max(logits)) / F.lit(temperature))
    return F.transform(z, lambda x: x - F.ln(total(F.transform(z, F.exp))))


def keyed(p: Column, lower: bool = False) -> Column:
    """A vector as a map by letter key: a, b, ... or A, B, ..."""
    from optika.functions.text import letter

    key = (lambda i: F.lower(letter(i))) if lower else letter
    return F.map_from_arrays(F.transform(p, lambda _, i: key(i)), p)


def first_max(p: Column) -> Column:
    """The position of the first maximum."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(0.0)))


def bisect_right(cuts: list[float], x: Column) -> Column:
    """The number of cuts at or below x."""
    return F.size(F.filter(F.array(*(F.lit(float(c)) for c in cuts)), lambda c: c <= x))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x.cast("int")))


def remap(probs: Column, perm: Column, k: Column | int) -> Column:
    """out[perm[i]] = probs[i], zero elsewhere."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.coalesce(F.get(probs, (F.array_position(perm, c) - 1).cast("int")), F.lit(0.0)))


def dense_rank_of(ranks: Column, position: Column) -> Column:
    """The order of the shown option at a position among all shown options."""
    return (F.array_position(F.sort_array(ranks), F.get(ranks, position)) - 1).cast("int")


def keyed_probabilities(m: Column, k: Column | int) -> Column:
    """Values of a letter-keyed map in the order A..Z, any case, unknown keys last; the first k."""
    key = lambda e: F.when(F.upper(e.key).rlike("^[A-Z]$"), F.upper(e.key)).otherwise(F.concat(F.lit("~"), e.key))
    ordered = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(key(e).alias("k"), e.value.cast("double").alias("v"))))
    return F.slice(F.transform(ordered, lambda e: e.v), F.lit(1), F.lit(k) if isinstance(k, int) else k)


def valid_probabilities(p: Column, tolerance: float = 0.02) -> Column:
    """Finite, within [0, 1], summing to 1 within the tolerance."""
    return F.coalesce(F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= 1)) & (F.abs(total(p) - 1) <= tolerance), F.lit(False))


def request_options(choices: Column) -> Column:
    """Choices keyed by letter, the form in which a model is asked; the answer is not part of it."""
    from optika.functions.text import letter

    return F.map_from_arrays(F.transform(choices, lambda _, i: letter(i)), choices)


def letter_keys(k: Column | int, lower: bool = False) -> Column:
    """The first k option keys."""
    letters = F.array(*(F.lit(x) for x in ("abcdefghijklmnopqrstuvwxyz" if lower else "ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    return F.slice(letters, F.lit(1), F.lit(k) if isinstance(k, int) else k)


def complete_probabilities(m: Column, k: Column | int, tolerance: float = 0.02, lower: bool = False) -> Column:
    """Whether a keyed map has exactly the first k keys and valid probabilities."""
    keys = letter_keys(k, lower)
    return F.coalesce((F.array_sort(F.map_keys(m)) == keys) & valid_probabilities(F.map_values(m), tolerance), F.lit(False))


def valid_teacher(m: Column, tolerance: float = 1e-4) -> Column:
    """Whether a map holds a distribution: not empty, finite, nothing negative, sum 1 within the tolerance."""
    v = F.map_values(m)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x >= 0))
    return F.coalesce((F.size(v) > 0) & fine & (F.abs(total(v) - 1) <= tolerance), F.lit(False))


def subset(a: Column, b: Column) -> Column:
    """Whether all elements of a are in b."""
    return F.size(F.array_except(a, b)) == 0


def disjoint(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(a, b)


def rounded(x: Column, places: int) -> Column:
    """x to so many places (at most 8), ties of the binary value to the even digit.

    Decimal rounding goes by the printed digits, where 0.12345 is a tie; its binary value lies above.  The product with the
    power of ten is therefore formed without error, from the two halves of x."""
    scale, size = float(10**places), F.abs(x)
    big = size * 134217729.0
    high = big - (big - size)
    low = size - high
    q = F.floor(size * scale).cast("double")
    over = (high * scale - (q + 0.5)) + low * scale
    up = F.when(over > 0, q + 1).when(over < 0, q).otherwise(q + F.pmod(q, F.lit(2.0)))
    return F.when(size < float(1 << 52) / scale, F.signum(x) * up / scale).otherwise(x)
