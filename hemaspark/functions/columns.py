"""Column expressions. Null means missing; NaN is never stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Added before a logarithm or logit. The inverse doesn't take it off again, so a round trip is 1e-7 too high.
LOG_SHIFT = 1e-7
#: Texts that count as missing in source tables.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def c(name: str) -> Column:
    """A column by its exact name: dots and back quotes in it are no syntax."""
    return F.col("`" + name.replace("`", "``") + "`")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def is_true(condition: Column) -> Column:
    """Null conditions are false."""
    return F.coalesce(condition, F.lit(False))


def number(col: Column) -> Column:
    """A column as double; what is no number, and NaN, is null. Suffixes that only Spark takes for numbers are not."""
    text = F.trim(col.cast("string"))
    plain = ~any_of([text.contains(letter) for letter in "dDfF"])  # most are, and need no regular expression
    return F.nullif(F.when(plain | ~text.rlike("[dDfF]$") | text.rlike("(?i)inf$"), text.try_cast("double")), F.lit(float("nan")))


def num(df: DataFrame, name: str) -> Column:
    """A column of df as double: numbers as they are (NaN null), text by number()."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nullif(c(name).cast("double"), F.lit(float("nan")))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c(name).cast("double")
    return number(c(name))


def na_to_null(col: Column) -> Column:
    return F.when(~col.isin(NA_TOKENS), col)


def hash_uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the keys and the seed only, so not on partitions or order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def digest_uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the seed and the keys as text, which other engines have as well. Nulls count as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def clip(col: Column, low: float = 0.0, high: float = 255.0) -> Column:
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def forward(col: Column, kind: str) -> Column:
    """log, logit or none; null where it isn't defined."""
    x = col + F.lit(LOG_SHIFT)
    if kind == "log":
        return F.when(x > 0, F.log(x))
    if kind == "logit":
        return F.when((x > 0) & (x < 1), F.log(x / (1 - x)))
    if kind == "none":
        return col
    raise ValueError(f"unknown transformation {kind!r}")


def inverse(col: Column, kind: str) -> Column:
    if kind == "log":
        return F.exp(col)
    if kind == "logit":
        return 1 / (1 + F.exp(-col))
    if kind == "none":
        return col
    raise ValueError(f"unknown transformation {kind!r}")


def rescaled(col: Column, med_s: float, med_t: float, mad_s: float, mad_t: float) -> Column:
    """Location and scale of a source distribution to those of a target; a source without spread counts as 1e-10 wide."""
    return (col - F.lit(float(med_s))) / F.lit(float(mad_s) or 1e-10) * F.lit(float(mad_t)) + F.lit(float(med_t))


def robust_score(col: Column, median: float, mad: float) -> Column:
    return (col - F.lit(float(median))) / F.lit(float(mad) or 1e-10)


def fsc_log(col: Column) -> Column:
    """Forward scatter on a logarithmic scale of 0 to 255."""
    return F.log10(col + 1) * F.lit(255.0) / F.log10(F.lit(255.0))


def inside(x: Column, y: Column, polygon: list[list[float]]) -> Column:
    """Whether a point is in a polygon: even number of edges to its right or not, edges half open upwards."""
    crossings = []
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
        if y1 != y2:
            a, b = F.lit(float(y1)) <= y, F.lit(float(y2)) <= y
            at = F.lit(float(x1)) + (y - F.lit(float(y1))) * F.lit((float(x2) - float(x1)) / (float(y2) - float(y1)))
            crossings.append(F.when((a != b) & (x < at), 1).otherwise(0))
    return F.when(x.isNotNull() & y.isNotNull(), reduce(lambda p, q: p + q, crossings, F.lit(0)) % 2 == 1).otherwise(False)


def gate_first(x: Column, y: Column, gates: dict[str, list]) -> Column:
    """Name of the first gate that holds the point; null outside all. Polygons of fewer than three vertices hold nothing."""
    fits = [F.when(inside(x, y, p), F.lit(name)) for name, p in gates.items() if len(p) >= 3]
    return F.coalesce(*fits) if fits else F.lit(None).cast("string")


def gate_last(x: Column, y: Column, gates: dict[str, list]) -> Column:
    """Number of the last gate that holds the point, in the gates' order; -1 outside all."""
    fits = [F.when(inside(x, y, p), F.lit(i)) for i, p in enumerate(gates.values()) if len(p) >= 3]
    return F.coalesce(*fits[::-1], F.lit(-1))


def weekday(hours: Column) -> Column:
    return (F.floor(hours / 24) % 7).cast("int")


def time_of_day(delay: Column) -> Column:
    return F.pmod(delay, F.lit(24.0))


def bucket(col: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bins of [low, high], closed on the right, numbered from 0; the lowest edge belongs to the first."""
    width = (float(high) - float(low)) / bins
    if width == 0:
        return F.when(col == low, 0)
    k = F.ceil((col - F.lit(float(low))) / F.lit(width)).cast("int") - 1
    return F.when(col.between(low, high), F.greatest(F.least(k, F.lit(bins - 1)), F.lit(0)))


def cut(col: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """Bins between edges, closed on the right; labels or numbers from 0; null outside."""
    out = F.lit(None)
    for i, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        out = F.when((col > a) & (col <= b), F.lit(labels[i] if labels else i)).otherwise(out)
    return out


def entropy(probabilities: list[Column]) -> Column:
    """Entropy (natural) of predicted probabilities."""
    return reduce(lambda a, b: a + b, [F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in probabilities], F.lit(0.0))


def affine(columns: list[Column], mean_s, mean_t, matrix) -> list[Column]:
    """matrix (x - mean_s) + mean_t, as arithmetic."""
    out = []
    for i in range(len(matrix)):
        terms = [F.lit(float(matrix[i][j])) * (columns[j] - F.lit(float(mean_s[j]))) for j in range(len(columns))]
        out.append(reduce(lambda a, b: a + b, terms) + F.lit(float(mean_t[i])))
    return out


def gaussian_log_density(columns: list[Column], mean, covariance) -> Column:
    """Log-density of a normal distribution, as arithmetic."""
    import numpy as np

    cov = np.asarray(covariance, float)
    precision, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
    d = [x - F.lit(float(m)) for x, m in zip(columns, mean, strict=True)]
    quad = reduce(lambda a, b: a + b, [F.lit(float(precision[i][j] * (1 if i == j else 2))) * d[i] * d[j] for i in range(len(d)) for j in range(i, len(d))])
    return F.lit(-0.5 * (len(d) * float(np.log(2 * np.pi)) + float(logdet))) - 0.5 * quad


def argmax(values: list[Column]) -> Column:
    """Position of the greatest value, the first of equal ones."""
    most = F.greatest(*values) if len(values) > 1 else values[0]
    return F.coalesce(*[F.when(v == most, F.lit(i)) for i, v in enumerate(values)])
