"""Column builders for matrices kept as a row-major array<double> of decibels.

A lambda must not refer to an aggregate of the array it walks over: the aggregate would be computed again
for each element. `let` binds such values once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import matrices

cloudpickle.register_pickle_by_value(matrices)  # so Python workers need not have this package

DB_FLOOR = 1e-30


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body(s), where s.name is each given value, computed once."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def median_of(cells: Column) -> Column:
    """The mean of the middle two values of a sorted array (the middle one for odd sizes)."""
    n = F.size(cells)
    return let(lambda s: (F.element_at(s["a"], F.floor((s["n"] + 1) / 2).cast("int")) + F.element_at(s["a"], F.floor(s["n"] / 2 + 1).cast("int"))) / 2, a=F.array_sort(cells), n=n)


def quantile_of(cells: Column, p: float) -> Column:
    """The linearly interpolated quantile of an array."""
    at = (F.size(cells) - 1) * F.lit(p)
    lo, hi = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return let(lambda s: F.element_at(s["a"], s["lo"] + 1) + (F.element_at(s["a"], s["hi"] + 1) - F.element_at(s["a"], s["lo"] + 1)) * (s["at"] - s["lo"]), a=F.array_sort(cells), at=at, lo=lo, hi=hi)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def peak_relative(cells: Column) -> Column:
    """Linear power relative to the peak."""
    return F.zip_with(cells, F.array_repeat(F.array_max(cells), F.size(cells)), lambda x, p: F.pow(F.lit(10.0), (x - p) / 10))


def normalise(cells: Column, scheme: str, mean: Column | None = None, sd: Column | None = None) -> Column:
    """peak: (x - peak)/60; offset: (x + 60)/60; global: (x - mean)/(sd + 1e-6); peak_level: peak, then a plane of (peak + 60)/60."""
    peak = F.array_repeat(F.array_max(cells), F.size(cells))
    if scheme == "peak":
        return F.zip_with(cells, peak, lambda x, p: (x - p) / 60)
    if scheme == "offset":
        return F.transform(cells, lambda x: (x + 60) / 60)
    if scheme == "global":
        return F.transform(cells, lambda x: (x - mean) / (sd + F.lit(1e-6)))
    if scheme == "peak_level":
        return F.concat(normalise(cells, "peak"), F.transform(peak, lambda p: (p + 60) / 60))
    raise ValueError(f"no such scheme: {scheme}")


def reduce_columns(cells: Column, rows: int, cols: int, factor: int) -> Column:
    """Sums linear power over `factor` adjacent columns of each row; back to decibels. Columns left over fall away."""
    if factor == 1:
        return cells
    kept = cols // factor
    linear = F.transform(cells, lambda x: F.pow(F.lit(10.0), x / 10))
    start = lambda i: F.floor(i / kept).cast("int") * cols + (i % kept) * factor + 1
    return let(lambda s: F.transform(F.sequence(F.lit(0), F.lit(rows * kept - 1)), lambda i: 10 * F.log10(F.greatest(total(F.slice(s["a"], start(i), factor)), F.lit(DB_FLOOR)))), a=linear)


def quantise(cells: Column, bits: int, low: Column, high: Column) -> Column:
    """Clips to [low, high], rounds half to even onto 2^bits levels, and back. No change from 32 bits on, or for an empty range."""
    if bits >= 32:
        return cells
    step = (high - low) / (2**bits - 1)
    rounded = F.transform(cells, lambda x: F.rint((F.least(F.greatest(x, low), high) - low) / step) * step + low)
    return F.when(high > low, rounded).otherwise(cells)


def shift_columns(cells: Column, rows: int, cols: int, by: Column) -> Column:
    """Moves each row by `by` columns; vacated cells take the matrix's median; nothing wraps around."""
    index = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    from_col = lambda i, s: i % cols - s["by"]
    return let(lambda s: F.transform(index, lambda i: F.when((from_col(i, s) >= 0) & (from_col(i, s) < cols), F.get(s["a"], (i - s["by"]).cast("int"))).otherwise(s["m"])), a=cells, by=by, m=median_of(cells))


def draw(seed: str | int, identity: Column, n: int | Column) -> Column:
    """An integer in [0, n) from md5 of seed and identity, alike in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), identity.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(n))


def features(cells: Column, cols: int, names: tuple[str, ...] | None = None) -> Column:
    """A struct of twelve properties of a matrix of decibels, from its linear power above the median floor; of `names` only, if given.

    Matrices of a batch go through numpy together. Null for a null or empty matrix and for one with a null cell."""
    wanted = names or tuple(matrices.PROPERTIES)
    kinds = ", ".join(f"{k} {matrices.PROPERTIES[k]}" for k in wanted)
    return F.arrow_udf(lambda a: matrices.structs(a, lambda x: matrices.properties(x, cols, wanted), kinds), f"struct<{kinds.replace(' ', ':')}>".replace(",:", ","))(cells)


def top_cells(cells: Column, k: int) -> Column:
    """The k largest cells as value - peak (ties: earlier cell), others 0; then centred; then of unit length."""
    indexed = F.transform(cells, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    kept = F.transform(F.slice(F.array_sort(indexed), 1, k), lambda s: s["i"])
    peak = F.array_repeat(F.array_max(cells), F.size(cells))
    raw = let(lambda s: F.transform(F.zip_with(cells, peak, lambda x, p: x - p), lambda d, i: F.when(F.array_contains(s["k"], i), d).otherwise(0.0)), k=kept)
    return unit(centre(raw))


def centre(a: Column) -> Column:
    return let(lambda s: F.zip_with(s["a"], F.array_repeat(total(s["a"]) / F.greatest(F.size(s["a"]), F.lit(1)), F.size(s["a"])), lambda x, m: x - m), a=a)


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero array stays."""
    return let(lambda s: F.zip_with(s["a"], F.array_repeat(F.when(s["n"] > 0, s["n"]).otherwise(1.0), F.size(s["a"])), lambda x, n: x / n), a=a, n=F.sqrt(dot(a, a)))


def concentration(cells: Column, share: float = 0.9) -> Column:
    """How many of the strongest cells hold `share` of the power above the median floor; null without such power."""
    return F.arrow_udf(lambda a: matrices.numbers(a, lambda x: matrices.concentration(x, share)), "int")(cells)


def masked_unit(cells: Column, mask_db: float | None = None) -> Column:
    """A unit vector of the cells within mask_db of the peak: these are centred on their own mean, all others are 0.

    Without a mask every cell is kept. What leaves nothing after centring (one kept cell, equal cells) gives zeros."""
    return F.arrow_udf(lambda a: matrices.arrays(a, lambda x: matrices.masked_unit(x, mask_db)), "array<double>")(cells)


def kept_cells(cells: Column, mask_db: float) -> Column:
    """How many cells lie within mask_db of the peak."""
    return F.arrow_udf(lambda a: matrices.numbers(a, lambda x: matrices.kept(x, mask_db).sum(1), 0), "int")(cells)


def packed(cells: Column) -> Column:
    """An array as binary, exactly; short where most cells share the least value."""
    return F.arrow_udf(matrices.packed, "binary")(cells)


def values(cells: Column) -> Column:
    """The distinct values of an array with how often each occurs."""
    return F.arrow_udf(matrices.values, "array<struct<value:double,n:bigint>>")(cells)


def sample_stats(cells: Column) -> Column:
    """A struct over the finite cells: peak, floor (10th percentile), range, mean, population sd, cells within 3, 6 and 10 of the
    peak and at least 6, 12 and 20 above the floor, and their number. Null without a finite cell."""
    finite = F.filter(cells, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def count(a: Column, low: Column) -> Column:
        return F.size(F.filter(F.zip_with(a, F.array_repeat(low, F.size(a)), lambda x, y: x >= y), lambda k: k)).cast("long")

    def stats(s: Column) -> Column:
        a, peak, floor, n = s["a"], s["peak"], s["floor"], s["n"]
        mean = total(a) / n
        near = [count(a, peak - db).alias(f"within_{db}") for db in (3, 6, 10)] + [count(a, floor + db).alias(f"above_{db}") for db in (6, 12, 20)]
        centred = centre(a)
        return F.struct(peak.alias("peak"), floor.alias("floor"), (peak - floor).alias("range"), mean.alias("mean"), F.sqrt(dot(centred, centred) / n).alias("sd"), *near, n.cast("long").alias("n"))

    return let(lambda s: F.when(F.size(s["a"]) > 0, let(stats, a=s["a"], peak=F.array_max(s["a"]), floor=quantile_of(s["a"], 0.1), n=F.size(s["a"]))), a=finite)


def above_floor(cells: Column, times: float = 2.0) -> Column:
    """The share of cells whose linear power exceeds `times` the median."""
    return F.arrow_udf(lambda a: matrices.numbers(a, lambda x: matrices.above_floor(x, times)), "double")(cells)
