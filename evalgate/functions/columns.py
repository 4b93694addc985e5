"""Column builders shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL; the keys appear once in the output."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__r_{key}")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


#: Rows of a table that is sent to every executor; larger ones are joined as the planner sees fit.
BROADCAST_ROWS = 100_000


def is_few(df: DataFrame) -> bool:
    """Whether a table that is already computed is small enough to be sent to every executor."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join with a table that is already computed (checkpointed or read): broadcast once its rows are counted to be few."""
    return null_safe_join(left, F.broadcast(right) if is_few(right) else right, keys, how)


def grouped(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """Give a global evaluation a constant group so every operator has at least one key."""
    if by:
        return df, list(by)
    return df.withColumn("scope", F.lit("all")), ["scope"]


def number_of(text: Column) -> Column:
    """Double or NULL of a text. Words are told by their characters first: each cast that fails costs an exception."""
    return F.when(text.rlike("(?i)[0-9]|inf|nan"), text).try_cast("double")


def safe_double(col: Column) -> Column:
    """Finite double or NULL; booleans and unparsable strings give NULL."""
    value = col.cast("string").try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def safe_ratio(num: Column, den: Column, floor: float = 1e-9) -> Column:
    """num/den, NULL when either side is missing or the denominator is about zero."""
    a, b = safe_double(num), safe_double(den)
    return F.when(F.abs(b) >= floor, a / b)


def floored_ratio(num: Column, den: Column, floor: float) -> Column:
    """num / max(den, floor)."""
    return num / F.greatest(den, F.lit(floor))


def falsy_zero(*cols: Column) -> Column:
    """First value that is neither NULL nor 0, else 0.0."""
    return F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in cols], F.lit(0.0))


def clip01(col: Column) -> Column:
    return F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0))


def reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the labels whose condition holds, in rule order."""
    items = [F.when(cond, lab if isinstance(lab, Column) else F.lit(lab)) for cond, lab in pairs]
    return F.array_compact(F.array(*items))


def first_reason(*pairs: tuple[Column, Column | str], default: Column | str | None = None) -> Column:
    """Label of the first condition that holds."""
    labelled = [(c, lab if isinstance(lab, Column) else F.lit(lab)) for c, lab in pairs]
    out = F.when(*labelled[0])
    for cond, lab in labelled[1:]:
        out = out.when(cond, lab)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def fixed_text(value: Column, digits: int = 6) -> Column:
    """Text with so many decimals as C's printf gives it, NULL of NULL: the exact binary value is rounded, ties go to the even digit.

    `format_string` alone rounds the shortest decimal half up. Two products without rounding error tell on which side of a tie
    a value lies; values of a billion and more are left to it.
    """
    scale = F.lit(float(10**digits))
    high = value.cast("float").cast("double")
    a, b = high * scale, (value - high) * scale
    # minus zero stays what it is
    n, rest = F.when(F.rint(b) == 0, F.rint(a)).otherwise(F.rint(a) + F.rint(b)), b - F.rint(b)
    up, down = 0.5 - (a - F.rint(a)), -0.5 - (a - F.rint(a))
    odd = n % 2 != 0
    exact = F.when((rest > up) | ((rest == up) & odd), n + 1.0).when((rest < down) | ((rest == down) & odd), n - 1.0).otherwise(n) / scale
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.when(F.abs(value) < 1e9, exact).otherwise(value)))


def steady_mean(value: Column) -> Column:
    """Aggregate: mean that doesn't depend on the order of rows, summed from the smallest value up.

    `avg` adds in the order rows arrive, and its last bit then decides between means that tie. For short groups (a row a seed or fold).
    """
    values = F.sort_array(F.collect_list(value))
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(values), F.lit(0))


def same_tail(a: Column, b: Column) -> Column:
    """Paths are equal up to a leading part: either one ends with the other."""
    x, y = F.regexp_replace(a, r"^(\./)+", ""), F.regexp_replace(b, r"^(\./)+", "")
    return (x != "") & (y != "") & (x.endswith(y) | y.endswith(x))


def hash_order(seed: int | str, *ids: Column) -> Column:
    """Sampling order: md5 of seed and id; the same on every engine and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_uniform(seed: int | str, *ids: Column) -> Column:
    """Uniform in (0, 1) from the first 32 bits of the sampling hash."""
    return (F.conv(F.substring(hash_order(seed, *ids), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
