"""Column-expression helpers.

Everything here builds a ``Column`` from built-in functions only; nothing calls
back into Python per row.  (Higher-order functions such as ``transform`` and
``aggregate`` are evaluated in the JVM but outside generated code.)
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------- flags and bins

def threshold_labels(value: str | Column, cutoffs: Sequence[float], labels: Sequence[str]) -> list[Column]:
    """One nullable label column per cut-off, strict ``>``.  Tiers nest:
    a value above 0.75 also carries every lower tier label."""
    v = col(value)
    return [F.when(v > F.lit(t), F.lit(lab)) for t, lab in zip(cutoffs, labels)]


def two_sided_bin(value: str | Column, high: float, low: float, high_label: str,
                  low_label: str) -> Column:
    """``> high`` -> high label, ``< low`` -> low label, the gap -> null."""
    v = col(value)
    return F.when(v > high, F.lit(high_label)).otherwise(F.when(v < low, F.lit(low_label)))


# Breaks and labels of the neighbour count bins.
DEGREE_BREAKS = [1, 11, 21]
DEGREE_LABELS = ["from1to10", "from11to20", "greaterThan20"]


def degree_bin(count: str | Column, breaks: Sequence[float] = tuple(DEGREE_BREAKS),
               labels: Sequence[str] = tuple(DEGREE_LABELS), none: str = "none") -> Column:
    """Bins of a neighbour count; below the first break or unknown -> ``none``."""
    return F.coalesce(left_closed_bins(count, breaks, labels), F.lit(none))


def keep_if_in(value: str | Column, allowed: Iterable[str]) -> Column:
    """The value itself when in the set, else null."""
    v = col(value)
    return F.when(v.isin(list(allowed)), v)


def label_if_in(value: str | Column, allowed: Iterable[str], label: str) -> Column:
    """A constant label when the value is in the set, else null."""
    return F.when(col(value).isin(list(allowed)), F.lit(label))


def at_least_labels(value: str | Column, rules: Sequence[tuple[str, float, str]]) -> list[Column]:
    """Cumulative flags; each rule is (op, bound, label) with op in
    ``==``, ``>=``, ``>``."""
    v = col(value)
    ops = {"==": lambda b: v == b, ">=": lambda b: v >= b, ">": lambda b: v > b}
    return [F.when(ops[op](b), F.lit(lab)) for op, b, lab in rules]


def collapse_to_default(value: str | Column, keep: Iterable[str], default: str) -> Column:
    """Keep listed classes, everything else (null included) -> default."""
    v = col(value)
    return F.when(v.isin(list(keep)), v).otherwise(F.lit(default))


def fill_default(value: str | Column, default) -> Column:
    """Null -> default."""
    return F.coalesce(col(value), F.lit(default))


def empty_to_null(value: str | Column) -> Column:
    """Empty string -> null."""
    return F.nullif(col(value), F.lit(""))


def extract_group(value: str | Column, pattern: str, group: int) -> Column:
    """Regex capture; no match gives null instead of ''."""
    return empty_to_null(F.regexp_extract(col(value), pattern, group))


def left_closed_bins(value: str | Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """``[b_i, b_{i+1})`` bins; the last bin is open-ended, values below
    the first break and nulls give null."""
    v = col(value)
    expr = None
    for i, lab in enumerate(labels):
        lo = breaks[i]
        hi = breaks[i + 1] if i + 1 < len(breaks) else math.inf
        cond = (v >= lo) if math.isinf(hi) else ((v >= lo) & (v < hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def year_or_other(value: str | Column, first: int, last: int, other: str = "Other") -> Column:
    """The year as text when inside [first, last], else ``Other``."""
    y = F.year(col(value))
    return F.when(y.between(first, last), y.cast("string")).otherwise(F.lit(other))


def recode(value: str | Column, mapping: dict[str, str]) -> Column:
    """Dictionary recode; unmapped values pass through unchanged."""
    v = col(value)
    if not mapping:
        return v
    lut = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(lut, v), v)


def lump_other(value: str | Column, keep: Iterable[str], other: str = "Other") -> Column:
    """Values outside the keep-list -> ``Other``; null stays null."""
    v = col(value)
    return F.when(v.isNull(), v).when(v.isin(list(keep)), v).otherwise(F.lit(other))


def parse_date_any(value: str | Column, formats: Sequence[str]) -> Column:
    """First format that parses wins; unparseable -> null."""
    v = col(value)
    return F.coalesce(*[F.try_to_date(v, f) for f in formats])


# --------------------------------------------------------------------------- text

def sentence_case(value: str | Column) -> Column:
    """First character upper case, the rest lower case."""
    v = col(value)
    return F.concat(F.upper(F.substring(v, 1, 1)), F.lower(F.substring(v, 2, 1 << 30)))


def replace_first(value: str | Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match: the text before the match is kept
    by a lazy prefix anchored at the start."""
    return F.regexp_replace(col(value), f"^(.*?){pattern}", f"$1{replacement}")


# Whitespace as Python's ``str`` regex sees it: Java's Unicode class plus the
# four information separators U+001C..U+001F.
PY_WHITESPACE_JAVA = r"[\s\x{1C}-\x{1F}]"

# The ordered replacement rules of the reference's text
# normalisation (applied after lower-casing, then whitespace runs collapse to
# one space and the ends are trimmed).  The pattern "'scuse" can never fire
# because "'s" is replaced earlier; it is kept for parity.
TEXT_RULES = [
    ("what's", "what is "),
    ("won't", "will not "),
    ("'s", " "),
    ("'ve", " have "),
    ("can't", "can not "),
    ("n't", " not "),
    ("i'm", "i am "),
    ("'re", " are "),
    ("'d", " would "),
    ("'ll", " will "),
    ("'scuse", " excuse "),
    ("'\n", " "),
    ("-", " "),
    ("'\u00a0", " "),
    ("(@.*?)[\\s]", " "),
    ("&amp;", "&"),
]


def _java_rule(pattern: str) -> str:
    # Python's '.' stops only at '\n' and its '\s' is Unicode: spell both out.
    return (pattern.replace(".*?", "[^\n]*?").replace("[\\s]", PY_WHITESPACE_JAVA)
            .replace("\n", "\\n").replace("\u00a0", "\\x{A0}"))


def clean_text(value: str | Column) -> Column:
    """Lower case, the ordered rules, collapse whitespace, trim."""
    out = F.lower(col(value))
    for pattern, repl in TEXT_RULES:
        out = F.regexp_replace(out, "(?U)" + _java_rule(pattern), repl.replace("$", "\\$"))
    out = F.regexp_replace(out, "(?U)" + PY_WHITESPACE_JAVA + "+", " ")
    return F.trim(out)


# --------------------------------------------------------------------------- numbers

def sigmoid(x: str | Column) -> Column:
    """B34."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(x)))


def softmax(arr: str | Column) -> Column:
    """Softmax of an array column, max-shifted for stability."""
    a = col(arr).cast("array<double>")
    m = F.array_max(a)
    ex = F.transform(a, lambda x: F.exp(x - m))
    tot = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / tot)


_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)
_LF_SMALL = 16
# log(n!) for n < 16, computed here from the definition.
_LF_TABLE = [math.lgamma(n + 1.0) for n in range(_LF_SMALL)]


def log_factorial(n: str | Column) -> Column:
    """log(n!) = lgamma(n + 1) for n >= 0 as a column expression (Spark has no
    lgamma): a small literal table below 16, else the Stirling series to the
    z^-7 term (truncation error below 1e-14 there)."""
    x = col(n).cast("double")
    z = x + F.lit(1.0)
    zi = F.lit(1.0) / z
    zi2 = zi * zi
    series = zi * (F.lit(1.0 / 12) + zi2 * (F.lit(-1.0 / 360) + zi2 * (
        F.lit(1.0 / 1260) + zi2 * F.lit(-1.0 / 1680))))
    stirling = (z - F.lit(0.5)) * F.log(z) - z + F.lit(_HALF_LOG_2PI) + series
    small = F.try_element_at(F.array(*[F.lit(v) for v in _LF_TABLE]), col(n).cast("int") + 1)
    return F.when(x < 0, F.lit(None).cast("double")).when(x < _LF_SMALL, small).otherwise(stirling)


def md5_unit_hash(*cols: str | Column) -> Column:
    """A repeatable 32-bit hash in [0, 2^32): the first 8 hex digits of
    md5 of the '|'-joined key.  The same value is reachable from SQL engines
    (md5 + hex parse), which keeps samples checkable by an oracle."""
    key = F.concat_ws("|", *[col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def r_number_text(x: str | Column, digits: int) -> Column:
    """Round and print without trailing zeros (``1.50`` -> ``1.5``,
    ``2.00`` -> ``2``)."""
    s = F.format_string(f"%.{digits}f", F.round(col(x), digits))
    text = F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(col(x).isNotNull(), text)


def effect_text(or_col: str | Column, lo_col: str | Column, hi_col: str | Column,
                digits: int = 2) -> Column:
    """``OR (lo-hi)`` with each number rounded."""
    return F.concat(r_number_text(or_col, digits), F.lit(" ("), r_number_text(lo_col, digits),
                    F.lit("-"), r_number_text(hi_col, digits), F.lit(")"))


def pvalue_text(p: str | Column, floor: float = 1e-40) -> Column:
    """P-value with two significant digits; below ``floor`` the text
    ``<1e-40``; below 1e-3 scientific (``2.8e-05``)."""
    v = col(p)
    fixed = None
    for k, bound in ((2, 0.1), (3, 0.01), (4, 0.001)):
        cond = v >= bound
        fixed = F.when(cond, r_number_text(v, k)) if fixed is None else fixed.when(cond, r_number_text(v, k))
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(v < floor, F.lit("<" + format(floor, ".0e").replace("e-", "e-")))
            .when(v < 0.001, F.format_string("%.1e", v))
            .otherwise(fixed))


def thousands(n: str | Column) -> Column:
    """Integer with thousands separators."""
    return F.format_number(col(n).cast("long"), 0)


def significance_change(p: str | Column, q: str | Column, alpha: float = 0.05) -> Column:
    """Four-way label from the raw and the corrected p-value; null when either is unknown."""
    before, after = col(p) < alpha, col(q) < alpha
    return (F.when(before & ~after, F.lit("No Longer Significant"))
            .when(~before & after, F.lit("Now Significant"))
            .when(~before & ~after, F.lit("Never Significant"))
            .when(before & after, F.lit("Remains Significant")))
