"""Array and vector scalars."""
from pyspark.sql import functions as F


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a):
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b):
    """0 for a zero vector, clamped to [-1, 1]; different sizes are an error."""
    same = F.assert_true(F.size(a) == F.size(b), "vectors differ in dimension")
    sim = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sim))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(same.cast("double"), value))


def cosine_distance01(a, b):
    return (1.0 - cosine(a, b)) / 2.0


def cosine_similarity01(a, b):
    return (1.0 + cosine(a, b)) / 2.0


def unit_vector(a):
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def at(a, i):
    """NULL past the end."""
    return F.get(a, F.lit(i) if isinstance(i, int) else i)
