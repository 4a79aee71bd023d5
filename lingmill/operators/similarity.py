"""Vector similarity measures as column expressions over two arrays of doubles.

Distances are given as 1 - d. Empty vectors are alike (1.0), a missing one gives -1.0. Ratios
that lack a denominator follow the definition noted at each measure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(ZERO), lambda s, x: s + x)


def _zip(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return _sum(F.zip_with(a, b, f))


def _ratio(top: Column, bottom: Column, otherwise: float) -> Column:
    return F.when(bottom == 0, F.lit(otherwise)).otherwise(top / bottom)


def _if(cond: Column, value: Column) -> Column:
    return F.when(cond, value).otherwise(ZERO)


class Pair:
    """The sums that measures share, each an expression over the two arrays."""

    def __init__(self, a: Column, b: Column, normalise: bool = False) -> None:
        if normalise:
            na, nb = F.sqrt(_sum(F.transform(a, lambda x: x * x))), F.sqrt(_sum(F.transform(b, lambda x: x * x)))
            a, b = F.transform(a, lambda x: F.when(na == 0, x).otherwise(x / na)), F.transform(b, lambda x: F.when(nb == 0, x).otherwise(x / nb))
        self.a, self.b = a, b
        on = lambda x, y: (x != 0) & (y != 0)
        self.total_a, self.total_b = _sum(a), _sum(b)
        self.dot = _zip(a, b, lambda x, y: x * y)
        self.low, self.high = _zip(a, b, lambda x, y: F.least(x, y)), _zip(a, b, lambda x, y: F.greatest(x, y))
        self.both = _zip(a, b, lambda x, y: _if(on(x, y), F.lit(1.0)))
        self.only_a = _zip(a, b, lambda x, y: _if((x != 0) & (y == 0), F.lit(1.0)))
        self.only_b = _zip(a, b, lambda x, y: _if((x == 0) & (y != 0), F.lit(1.0)))
        self.neither = _zip(a, b, lambda x, y: _if((x == 0) & (y == 0), F.lit(1.0)))
        self.match_a = _zip(a, b, lambda x, y: _if(on(x, y), x))
        self.match_b = _zip(a, b, lambda x, y: _if(on(x, y), y))
        self.n = F.size(a)


def measures(a: Column, b: Column) -> dict[str, Callable[[], Column]]:
    """What builds each dense measure, by name; guarded for missing and empty vectors by similarity()."""
    p = Pair(a, b)
    A, B, m1, m2, both, o1, o2 = p.total_a, p.total_b, p.match_a, p.match_b, p.both, p.only_a, p.only_b
    u1, u2 = A - m1, B - m2
    norm_a, norm_b = F.sqrt(_sum(F.transform(a, lambda x: x * x))), F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    mid = (m1 + m2) / 2
    spread = _zip(a, b, lambda x, y: F.abs(_share(x, A) - _share(y, B)))
    n = p.n.cast("double")
    big_a, big_b = F.array_max(a), F.array_max(b)
    ca = _zip(a, b, lambda x, y: _if((x != 0) & (y != 0), F.least(_share(x, big_a), _share(y, big_b))))
    cb = _zip(a, b, lambda x, y: _if((x != 0) & (y == 0), _share(x, big_a)))
    cc = _zip(a, b, lambda x, y: _if((x == 0) & (y != 0), _share(y, big_b)))
    pos, neg = _ratio(both * p.neither, n * n, 0.0), _ratio(o1 * o2, n * n, 0.0)
    kl = lambda x, m: _if(x > 0, x * F.log2(x / m))
    lo, hi = F.least(cb, cc), F.greatest(cb, cc)
    log2 = lambda x: F.log2(x)
    return {
        "cosine": lambda: _ratio(p.dot, norm_a * norm_b, float("nan")),
        "euclidean": lambda: 1 - F.sqrt(_zip(a, b, lambda x, y: (x - y) * (x - y))),
        "manhattan": lambda: 1 - _zip(a, b, lambda x, y: F.abs(x - y)),
        "jaccard": lambda: _ratio(both, both + o1 + o2, 1.0),
        "simpson": lambda: _ratio(both, F.least(both + o1, both + o2), 0.0),
        "extended_simpson": lambda: _ratio(p.low, F.least(A, B), 0.0),
        "braun_blanquet": lambda: _ratio(p.low, F.greatest(A, B), 0.0),
        "dice": lambda: _ratio(2 * p.dot, A + B, 1.0),
        "anti_dice": lambda: _ratio(p.dot, _zip(a, b, lambda x, y: _if((x != 0) & (y != 0), F.least(x, y))) + 2 * (u1 + u2), 1.0),
        "tanimoto": lambda: F.when(p.high > p.low, p.low / (p.high - p.low)).otherwise(1.0),
        "kulczynski1": lambda: F.when(u1 + u2 == 0, 2 * mid).otherwise(mid / (u1 + u2)),
        "kulczynski2": lambda: (_ratio(m1, A, 0.0) + _ratio(m2, B, 0.0)) / 2,
        "ochiai": lambda: _ratio(mid, F.sqrt(A * B), 0.0),
        "sokal_sneath": lambda: _ratio(mid, mid + 2 * u1 + 2 * u2, 1.0),
        "mcconnaughey": lambda: (_ratio(m1 * m2 - u1 * u2, A * B, 0.0) + 1) / 2,
        "lance_williams": lambda: 1 - _ratio(u1 + u2, A + B, 0.0),
        "bray_curtis": lambda: 1 - _ratio(_zip(a, b, lambda x, y: F.abs(x - y)), A + B, 0.0),
        "canberra": lambda: 1 - _ratio(_zip(a, b, lambda x, y: _if(x + y > 0, F.abs((x - y) / F.nullif(x + y, F.lit(0.0))))), n, 1.0),
        "circle_product": lambda: _ratio(p.low, n, 0.0),
        "czekanowski": lambda: _ratio(2 * p.low, A + B, 1.0),
        "robinson": lambda: (2 - spread) / 2,
        "drennan": lambda: 1 - spread / 2,
        "similarity_ratio": lambda: F.when(a == b, F.lit(1.7976931348623157e308)).otherwise(_ratio(p.dot, norm_a * norm_a + norm_b * norm_b - p.dot, 0.0)),
        "jensen_shannon": lambda: 1 - (_zip(a, b, lambda x, y: kl(_share(x, A), (_share(x, A) + _share(y, B)) / 2)) + _zip(a, b, lambda x, y: kl(_share(y, B), (_share(x, A) + _share(y, B)) / 2))) / 2,
        "mountford": lambda: _ratio(2 * ca, 2 * cb * cc + ca * cb + ca * cc, 1.0),
        "fager_mcgowan": lambda: _ratio(ca, F.sqrt((ca + cb) * (ca + cc)), 0.0) - hi / 2,
        "tripartite": lambda: F.sqrt(
            log2(1 + (lo + ca) / F.nullif(hi + ca, F.lit(0.0))) * F.pow(log2(2 + lo / (ca + 1)), F.lit(-0.5)) * log2(1 + ca / F.nullif(ca + cb, F.lit(0.0))) * log2(1 + ca / F.nullif(ca + cc, F.lit(0.0)))
        ),
        "binary_dice": lambda: _ratio(2 * both, 2 * both + o1 + o2, 1.0),
        "binary_anti_dice": lambda: _ratio(both, both + 2 * (o1 + o2), 1.0),
        "binary_gamma": lambda: _ratio(pos - neg, pos + neg, 1.0),
    }


def _share(x: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(ZERO)).otherwise(x / total)


def similarity(name: str, a: Column, b: Column) -> Column:
    """A measure with the common guards: -1 for a missing vector, 1 for two empty ones, 0 for one."""
    value = measures(a, b)[name]()
    return F.when(a.isNull() | b.isNull(), F.lit(-1.0)).when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(value)
