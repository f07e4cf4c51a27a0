"""Column expressions (all JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# A plain decimal/scientific number with optional sign and surrounding blanks.
# Java would also accept '1d' / '1f' / hex; pandas does not, so we guard first.
NUMERIC_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c) -> Column:
    """String -> double, anything that is not a plain number -> null."""
    s = col(c).cast("string")
    return F.when(s.rlike(NUMERIC_PATTERN), F.trim(s).try_cast("double"))


def clip(c, lo: float | None, hi: float | None) -> Column:
    x = col(c)
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return x


def flag(cond: Column) -> Column:
    """boolean -> 0/1 int, null -> 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def round_half_even(c, digits: int) -> Column:
    """numpy-style rounding: rint(x * 10^d) / 10^d."""
    scale = float(10 ** digits)
    return F.rint(col(c) * scale) / scale


def strip(c) -> Column:
    """Python-style strip: remove leading/trailing whitespace of any kind."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def label_m1(status) -> Column:
    """Stripped status; 'M<int>' with int >= 1 -> 1, everything else 0."""
    num = F.regexp_extract(strip(status), r"^M\s*([+-]?[0-9]+)$", 1)
    return flag(num.try_cast("int") >= 1)


def label_buckets(status, buckets: Sequence[str] = C.DEFAULT_BUCKETS) -> Column:
    """Label by an explicit bucket list."""
    return flag(col(status).isin(list(buckets)))


def payment_progress(paid, term) -> Column:
    """clip(paid/term, 0, 1); x/0 -> 1 if x > 0 else 0; null -> 0."""
    p, t = col(paid).cast("double"), col(term).cast("double")
    ratio = F.when(t == 0, F.when(p > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.least(F.greatest(p / t, F.lit(0.0)), F.lit(1.0)))
    return F.coalesce(ratio, F.lit(0.0))


def safe_clip(c, lo: float, hi: float) -> Column:
    """Numeric coercion, bad/null/NaN -> 0, then clip."""
    x = (parse_number(c) if not isinstance(c, Column) else c).cast("double")
    x = F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0))
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def total(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])


def count_positive(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(c) > 0).cast("int") for c in cols])


def mean(cols: Sequence[str]) -> Column:
    return total(cols) / float(len(cols))


def sample_std(cols: Sequence[str]) -> Column:
    """Two-pass sample standard deviation (ddof 1) across columns; n < 2 -> 0."""
    n = len(cols)
    if n < 2:
        return F.lit(0.0)
    m = mean(cols)
    ss = reduce(lambda a, b: a + b, [(F.col(c) - m) * (F.col(c) - m) for c in cols])
    return F.sqrt(ss / float(n - 1))


def longest_positive_run(cols: Sequence[str]) -> Column:
    """Longest run of consecutive positive values, left to right (pure arithmetic)."""
    runs = []
    prev = None
    for c in cols:
        pos = F.col(c) > 0
        cur = F.when(pos, F.lit(1) if prev is None else prev + 1).otherwise(F.lit(0))
        runs.append(cur)
        prev = cur
    return F.greatest(*runs) if len(runs) > 1 else runs[0]


def ema(cols: Sequence[str], alpha: float = C.EMA_ALPHA) -> Column:
    """EMA seeded with the first value: e = alpha * x + (1 - alpha) * e."""
    keep = 1 - alpha
    e = F.col(cols[0]).cast("double")
    for c in cols[1:]:
        e = F.lit(alpha) * F.col(c) + F.lit(keep) * e
    return e


def acceleration(cols: Sequence[str]) -> Column:
    """Mean of second differences; telescopes to ((x[n-1]-x[n-2]) - (x1-x0)) / (n-2)."""
    n = len(cols)
    if n < 3:
        return F.lit(0.0)
    x = [F.col(c) for c in cols]
    return ((x[n - 1] - x[n - 2]) - (x[1] - x[0])) / float(n - 2)
