"""Column-level building blocks. All are built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefix lengths of the hierarchical place code.
LEVEL_WIDTHS = {"state": 2, "county": 5, "tract": 11}

# State codes kept in the study sample, and the codes of each census division.
SAMPLE_STATES = ["10", "11", "12", "13", "17", "18", "24", "26", "37", "39", "45", "51", "54", "55"]
DIVISION_STATES = {
    "div_ne": ["09", "23", "25", "33", "44", "50"],
    "div_ma": ["34", "36", "42"],
    "div_enc": ["17", "18", "26", "39", "55"],
    "div_wnc": ["19", "20", "27", "29", "31", "38", "46"],
    "div_sa": ["10", "11", "12", "13", "24", "37", "45", "51", "54"],
    "div_esc": ["01", "21", "28", "47"],
    "div_wsc": ["05", "22", "40", "48"],
    "div_mnt": ["04", "08", "16", "30", "32", "35", "49", "56"],
    "div_pac": ["02", "06", "15", "41", "53"],
}


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def prefix_keys(code: str | Column, widths: Mapping[str, int] = LEVEL_WIDTHS) -> list[Column]:
    """One aliased prefix column per level of a fixed-width hierarchical code."""
    return [F.substring(col(code), 1, n).alias(level) for level, n in widths.items()]


def padded_key(c: str | Column, width: int) -> Column:
    """Integer key as text with its leading zeros."""
    return F.lpad(col(c).cast("string"), width, "0")


def code_slices(c: str | Column, slices: Sequence[tuple[int, int]]) -> Column:
    """Join half-open, zero-based character slices of a code."""
    return F.concat(*[F.substring(col(c), a + 1, b - a) for a, b in slices])


def to_number(c: str | Column) -> Column:
    """Text to double; anything unparsable becomes null."""
    return col(c).try_cast("double")


def finite_or_null(c: str | Column) -> Column:
    """NaN and infinities become null."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def null_sum(cols: Sequence[str | Column]) -> Column:
    """Row sum that is null when any term is null."""
    total = col(cols[0])
    for c in cols[1:]:
        total = total + col(c)
    return total


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Row sum of column times weight, null when any column is null."""
    return null_sum([F.col(name) * F.lit(w) for name, w in weights.items()])


def capped_ratio(num: str | Column, den: str | Column, cap: float) -> Column:
    """num / den, with x/0 and anything above the cap set to the cap; 0/0 is null."""
    a, b = col(num).cast("double"), col(den).cast("double")
    ratio = F.try_divide(a, b)
    return (
        F.when((b == 0) & (a > 0), F.lit(float(cap)))
        .when(ratio > cap, F.lit(float(cap)))
        .otherwise(ratio)
    )


def conversion_rate(part: str | Column, base: str | Column) -> Column:
    """part / base; a zero base gives 0, a null base gives null."""
    a, b = col(part).cast("double"), col(base).cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(b == 0, F.lit(0.0))


def conversion_rate_or_zero(part: str | Column, base: str | Column) -> Column:
    """part / base; a zero or null base gives 0."""
    a, b = col(part).cast("double"), col(base).cast("double")
    return F.when(b.isNotNull() & (b != 0), F.try_divide(a, b)).otherwise(F.lit(0.0))


def per_thousand(num: str | Column, den: str | Column) -> Column:
    return F.try_divide(col(num).cast("double"), col(den).cast("double")) * 1000


def year_start(year: str | Column) -> Column:
    return F.make_date(col(year).cast("int"), F.lit(1), F.lit(1))


def year_in_date_text(c: str | Column) -> Column:
    """Year of the first date in the text form of a date tuple."""
    return F.regexp_extract(col(c), r"datetime\((\d{4})", 1)


def shift_date(c: str | Column, months: int = 0, days: int = 0) -> Column:
    return F.date_add(F.add_months(col(c).cast("date"), months), days)


def division_flags(state: str | Column, divisions: Mapping[str, Sequence] = DIVISION_STATES) -> list[Column]:
    """0/1 column per division; an unknown state is 0 everywhere."""
    return [
        F.coalesce(col(state).isin(list(codes)), F.lit(False)).cast("int").alias(name)
        for name, codes in divisions.items()
    ]


def category_of(c: str | Column, categories: Mapping[str, Sequence]) -> Column:
    """Category whose member list holds the value; null when none does."""
    out = None
    for name, members in categories.items():
        hit = col(c).isin(list(members))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def hash_uniform(cols: Sequence[str | Column], seed: int | str | Column) -> Column:
    """Repeatable number in [0, 1) from row keys and a seed; survives task retries."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws("|", *[col(c).cast("string") for c in cols], seed_col.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(16**12)
