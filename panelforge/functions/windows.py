"""Window specs and null-safe numeric helpers.  Missing is NULL everywhere."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Axes:
    """Columns of a panel: its time, its symbol, and the session windows must not leave."""

    time: str = "dt"
    symbol: str = "sym"
    session: str | None = None

    @property
    def keys(self) -> list[str]:
        return [*([self.session] if self.session else []), self.time, self.symbol]

    def series(self, rows: int | None = None) -> WindowSpec:
        """Of one symbol by time: the last ``rows`` rows, or all so far."""
        w = self.whole_series().orderBy(self.time)
        return w.rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0)

    def ordered(self) -> WindowSpec:
        return self.whole_series().orderBy(self.time)

    def whole_series(self) -> WindowSpec:
        return Window.partitionBy(*([self.session] if self.session else []), self.symbol)

    def cross(self) -> WindowSpec:
        return Window.partitionBy(*([self.session] if self.session else []), self.time)


def num(c: Column) -> Column:
    """NaN and infinities as NULL: done once, where data come in."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def both(x: Column, y: Column) -> tuple[Column, Column]:
    """Each side where neither is missing."""
    ok = x.isNotNull() & y.isNotNull()
    return F.when(ok, x), F.when(ok, y)


def avg_rank(x: Column, part: list[str] | WindowSpec, frame_order: Column | None = None) -> Column:
    """Rank with ties averaged among the non-missing values of a partition."""
    spec = Window.partitionBy(*part) if isinstance(part, list) else part
    rank = F.rank().over(spec.orderBy(x.asc_nulls_last()))
    return rank


def pearson(x: Column, y: Column, spec: WindowSpec | None = None) -> Column:
    """Correlation of complete pairs, NULL for fewer than two or no variance."""
    x, y = both(x, y)
    parts = [F.covar_samp(x, y), F.stddev_samp(x), F.stddev_samp(y), F.avg(x * x), F.avg(y * y)]
    if spec is not None:
        parts = [p.over(spec) for p in parts]
    cov, sx, sy, mx, my = parts
    # No variance but for the rounding of the values' own size.
    return F.when((sx > 1e-12 * F.sqrt(mx)) & (sy > 1e-12 * F.sqrt(my)), F.try_divide(cov, sx * sy))
