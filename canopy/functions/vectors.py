"""Vector kernels as Column expressions; an empty array means "no vector". All stay on the JVM side."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SIBLINGS = 2.0


def empty() -> Column:
    return F.array().cast("array<double>")


def is_empty(v: Column) -> Column:
    return F.coalesce(F.size(v), F.lit(0)) == 0


def rounded(a: Column, digits: int = 6) -> Column:
    """a with each component rounded as SQL rounds doubles: half away from zero, what is no number as it is, and the sign of zeros kept."""
    scale = F.lit(10.0**digits)

    def one(x: Column) -> Column:
        return F.when(F.abs(x * scale) < float("inf"), F.signum(x) * F.round(F.abs(x * scale)) / scale).otherwise(x)

    return F.transform(a, one)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """a at length one, so that a cosine is one dot product; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 if either vector is empty or zero."""
    scale = norm(a) * norm(b)
    raw = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale))
    return F.when(is_empty(a) | is_empty(b) | (scale == 0), F.lit(0.0)).otherwise(raw)


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine of vectors that unit() has scaled already."""
    return F.when(is_empty(a) | is_empty(b), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def blend(a: Column, b: Column, weight_a: float, weight_b: float) -> Column:
    """Weighted sum; the other side alone where one is empty."""
    both = F.zip_with(a, b, lambda x, y: x * F.lit(weight_a) + y * F.lit(weight_b))
    return F.when(is_empty(a), F.coalesce(b, empty())).when(is_empty(b), a).otherwise(both)


def signature_signals(signature: Column, causes: Column, calls: Column) -> Column:
    """A signature vector with what its causes and calls add."""
    one = F.when(is_empty(causes), blend(signature, calls, 0.7, 0.3)).otherwise(blend(signature, causes, 0.7, 0.3))
    three = F.zip_with(F.zip_with(signature, causes, lambda x, y: x * 0.6 + y * 0.25), calls, lambda s, y: s + y * 0.15)
    return F.when(is_empty(causes) & is_empty(calls), signature).when(is_empty(causes) | is_empty(calls), one).otherwise(three)


def with_parent(signature: Column, parent: Column) -> Column:
    return blend(signature, parent, 0.7, 0.3)


def identity(name: Column, path: Column, description: Column) -> Column:
    return blend(blend(name, path, 0.7, 0.3), description, 0.5, 0.5)


def routing(leaf: Column, own_identity: Column) -> Column:
    return F.when(is_empty(leaf), own_identity).otherwise(blend(leaf, own_identity, 0.75, 0.25))


def unitize_cosine(x: Column) -> Column:
    return (x + 1) / 2


def unitize_distance(x: Column) -> Column:
    return x / 2


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(2 * a * b / (a + b))


def mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def centroid(v: Column) -> Column:
    """Aggregate: mean of the non-empty vectors of a group, summed before the shuffle; filter empty ones out first."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def evenness(distance: Column) -> Column:
    """Aggregate: 1 / (1 + deviation / mean) of distances; 0 if their mean is 0."""
    mu = F.avg(distance)
    return F.when(mu == 0, F.lit(0.0)).otherwise(1 / (1 + F.coalesce(F.stddev_samp(distance), F.lit(0.0)) / mu))
