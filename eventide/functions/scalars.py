"""Column functions: parsing, predicates, labels and transforms. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tick durations in minutes and their labels (fixed values).
DURATION_LABELS = ((60, "1 h"), (120, "2 h"), (240, "4 h"), (360, "6 h"), (720, "12 h"), (1440, "24 h / 1 d"), (2880, "48 h / 2 d"), (4320, "72 h / 3 d"), (10080, "1 wk"), (20160, "2 wk"), (43200, "30 d"), (86400, "60 d"), (129600, "90 d"), (262800, "6 mo"), (525600, "1 yr"))
#: The bounds of national-grid coordinates in metres (fixed values).
EASTING, NORTHING = (0.0, 700_000.0), (0.0, 1_300_000.0)


def number(c: Column) -> Column:
    """The value as a double; text that is no number, and NaN, become null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def squeeze(c: Column) -> Column:
    """White space collapsed and trimmed; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")), F.lit(""))


def lenient_bool(c: Column) -> Column:
    """true/1 and false/0; anything else is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def strict_bool(c: Column) -> Column:
    """true/1 and false/0; anything else is null, which a gate reports."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False)


def wordy_bool(c: Column) -> Column:
    """TRUE, T, YES, Y and 1 in either case."""
    return F.upper(squeeze(c)).isin("TRUE", "T", "YES", "Y", "1")


def numeric_bool(c: Column) -> Column:
    """The number 1, or true/yes."""
    return F.coalesce(number(c) == 1, F.lit(False)) | F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "yes"), F.lit(False))


def permit_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(c.cast("string"), r"\s+", ""))


def permit_letters(c: Column) -> Column:
    return F.regexp_replace(permit_key(c), "[^A-Z0-9]", "")


def inside_grid(x: Column, y: Column, inclusive: bool) -> Column:
    """Whether a coordinate pair lies in the national grid's bounds, with or without the bounds themselves."""
    (x0, x1), (y0, y1) = EASTING, NORTHING
    ok = x.between(x0, x1) & y.between(y0, y1) if inclusive else (x > x0) & (x < x1) & (y > y0) & (y < y1)
    return F.coalesce(finite(x) & finite(y) & ok, F.lit(False))


def minutes_between(start: Column, stop: Column) -> Column:
    """Minutes with their fraction."""
    return (F.unix_micros(stop.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(60_000_000.0)


def round_up_15(c: Column) -> Column:
    return F.ceil(c / 15.0) * 15.0


def plain_number(c: Column) -> Column:
    """A number with six significant digits and no trailing zeros, for labels."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-6))))).cast("int")
    out = F.lit(None).cast("string")
    for k in range(12):
        out = F.when(digits == k, F.format_string(f"%.{k}f", c)).otherwise(out)
    return F.when(out.contains("."), F.regexp_replace(F.regexp_replace(out, "0+$", ""), r"\.$", "")).otherwise(out)


def duration_label(minutes: Column) -> Column:
    """A short label: the tick's own within 1e-9, else hours, days, weeks, months or years."""
    h, d = minutes / 60.0, minutes / 1440.0
    label = F.when(h < 24, F.concat(plain_number(h), F.lit(" h"))).when(d < 7, F.concat(plain_number(d), F.lit(" d"))).when(d < 60, F.concat(plain_number(d / 7.0), F.lit(" wk")))
    label = label.when(d < 365, F.concat(plain_number(d / 30.0), F.lit(" mo"))).otherwise(F.concat(plain_number(d / 365.0), F.lit(" yr")))
    for tick, text in DURATION_LABELS:
        label = F.when(F.abs(minutes - float(tick)) <= 1e-9, F.lit(text)).otherwise(label)
    return label


def file_token(c: Column, most: int = 80) -> Column:
    t = F.regexp_replace(F.lower(F.trim(c.cast("string"))), "[^a-z0-9]+", "_")
    t = F.regexp_replace(F.substring(F.regexp_replace(t, "^_+|_+$", ""), 1, most), "_+$", "")
    return F.when(t == "", F.lit("unknown")).otherwise(F.coalesce(t, F.lit("unknown")))


def year_in_name(c: Column) -> Column:
    """The only four-digit year in a file's name, '' where there are none or several."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), 1))
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise("")


def hours_since_1800(c: Column) -> Column:
    return F.expr("timestamp'1800-01-01 00:00:00'") + F.make_dt_interval(hours=c.cast("int"))


def log2_positive(c: Column) -> Column:
    return F.when(c > 0, F.log2(c))


def guarded_ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def tail_density(x: Column, threshold: float, beta: Column, rate: Column) -> Column:
    """The fitted conditional density at x, its logarithm clipped to [-745, 700]."""
    at = F.ln(rate) + F.ln(x)
    log_pdf = F.ln(beta) + F.ln(rate) + (beta - 1.0) * at - F.exp(beta * at) + F.exp(beta * (F.ln(rate) + F.ln(F.lit(threshold))))
    return F.exp(F.least(F.greatest(log_pdf, F.lit(-745.0)), F.lit(700.0)))


def null_safe_key(*cs: Column) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("<NULL>")) for c in cs))


def sorted_pipe(c: Column, split: bool = False) -> Column:
    """An aggregate: the distinct non-blank values, sorted, joined by '|'; split: values are cut at '|' first."""
    t = F.trim(c.cast("string"))
    values = F.flatten(F.collect_set(F.split(t, r"\|"))) if split else F.collect_set(t)
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))), "|")


def issues(*cases: tuple[Column, str]) -> Column:
    """The texts of the cases that hold, in their order, as an array."""
    return F.array_compact(F.array(*(F.when(when, F.lit(text)) for when, text in cases)))


def let(c: Column, f) -> Column:
    """f of a value that is computed once, however often f's text names it."""
    return F.transform(F.array(c), lambda v: f(v))[0]


def erfc_p(z: Column) -> Column:
    """The two-sided normal p-value erfc(|z| / sqrt 2): a series below 2 and a continued fraction above, to about 1e-13."""

    def of(x: Column) -> Column:
        return F.when(x < 2.0, 1.0 - x * let(x * x, series) * (2.0 / math.pi**0.5)).otherwise(F.exp(-(x * x)) / (fraction(x) * math.pi**0.5))

    def series(square: Column) -> Column:
        out = F.lit(0.0)
        for n in range(45, -1, -1):
            out = out * square + F.lit((-1.0) ** n / (math.factorial(n) * (2 * n + 1)))
        return out

    def fraction(x: Column) -> Column:
        out = x
        for k in range(60, 0, -1):
            out = x + (k / 2.0) / out
        return out

    return let(F.abs(z) / F.lit(2.0**0.5), of)
