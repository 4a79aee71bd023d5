"""List, set, map and array algebra as column expressions; members compare by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def list_union(a: Column, b: Column) -> Column:
    """(b - a) before a; repeated members of one side stay."""
    return F.concat(list_difference(b, a), a)


def list_intersection(a: Column, b: Column) -> Column:
    """Members of a that b has, in a's order, repeats kept."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def list_difference(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: ~F.array_contains(b, x))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def intersects(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def same_set(a: Column, b: Column) -> Column:
    """Equality of the members whatever their order."""
    return F.sort_array(a) == F.sort_array(b)


def sublist_at(a: Column, part: Column) -> Column:
    """The first place where part stands contiguously in a, or -1."""
    n = F.size(part)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(a) - n + 1, F.lit(1))), lambda i: F.slice(a, i, n) == part)
    return F.when(n == 0, 0).when(n > F.size(a), -1).otherwise(F.coalesce(F.get(places, F.lit(0)) - 1, F.lit(-1)))


def position(a: Column, x: Column) -> Column:
    """The first index of x, or -1."""
    return F.array_position(a, x) - 1


def last_position(a: Column, x: Column) -> Column:
    at = F.array_position(F.reverse(a), x)
    return F.when(at == 0, -1).otherwise(F.size(a) - at)


def nth(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def between(a: Column, start: int, stop: int) -> Column:
    """Members start to stop, both included."""
    return F.slice(a, start + 1, stop - start + 1)


def rest(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def last(a: Column) -> Column:
    return F.element_at(a, -1)


def without_span(a: Column, start: int, stop: int) -> Column:
    """a without members start to stop, both included."""
    return F.concat(F.slice(a, 1, start), F.slice(a, F.lit(stop + 2), F.greatest(F.size(a) - stop - 1, F.lit(0))))


def insert_at(a: Column, i: int, x: Column) -> Column:
    return F.array_insert(a, i + 1, x)


def map_each(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, f)


def flat_map(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(a, f))


def flatten_compact(a: Column) -> Column:
    """One level flattened, nulls dropped."""
    return F.array_compact(F.flatten(a))


def push_if_new(a: Column, x: Column) -> Column:
    return F.when(F.array_contains(a, x), a).otherwise(F.array_append(a, x))


def association(keys: Column, values: Column, key: Column) -> Column:
    """The value at the first place of key."""
    return F.get(values, F.array_position(keys, key).cast("int") - 1)


def gap_filled(sparse: Column, default: Column) -> Column:
    """A map of int to value as an array over its whole key range."""
    keys = F.map_keys(sparse)
    return F.transform(F.sequence(F.array_min(keys), F.array_max(keys)), lambda i: F.coalesce(F.element_at(sparse, i), default))


# bit vectors on LONG columns


def bit_algebra(a: Column, b: Column) -> dict[str, Column]:
    """Union, intersection, difference and negation of two bit vectors and their bit counts."""
    union, both, less = a.bitwiseOR(b), a.bitwiseAND(b), a.bitwiseAND(F.bitwise_not(b))
    return {
        "bits_union": union, "bits_both": both, "bits_less": less, "bits_not": F.bitwise_not(a),
        "n_union": F.bit_count(union), "n_both": F.bit_count(both), "n_less": F.bit_count(less),
    }
