"""Column functions: cleaning, casting, identifiers, vectors, grids. All run inside Spark's own engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no value.
NULL_TOKENS = ("", "nan", "none", "null", "na", "n/a")
TRUE_TOKENS = ("true", "1", "yes", "y", "t")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Trimmed text; tokens that mean "no value" become the empty string."""
    t = F.trim(F.coalesce(col(c).cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(*NULL_TOKENS), F.lit("")).otherwise(t)


def or_missing(c: Column | str, token: str = "<MISSING>") -> Column:
    return F.coalesce(F.nullif(F.trim(col(c).cast("string")), F.lit("")), F.lit(token))


def truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin(*TRUE_TOKENS), F.lit(False))


def lenient(c: Column | str, kind: str = "double") -> Column:
    """A cast that gives null where the strict one raises."""
    return col(c).try_cast(kind)


def finite(c: Column | str) -> Column:
    """The value if it is a number, else null; also the guard against NaN comparing as largest."""
    x = col(c)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def is_finite(c: Column | str) -> Column:
    return finite(c).isNotNull()


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def bin_label(c: Column | str, edges: Sequence[float]) -> Column:
    """Intervals open on the left and closed on the right; the first also takes its left edge."""
    x, out = col(c), None
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (x <= high) & ((x >= low) if i == 0 else (x > low))
        label = F.lit(f"({low:g},{high:g}]")
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def integer_id(c: Column | str) -> Column:
    """"0514" and "514.0" are both "514"; anything but a whole number from 0 is null."""
    x = col(c).try_cast("double")
    return F.when((x >= 0) & (x == F.floor(x)), F.floor(x).cast("bigint").cast("string"))


def trial_id(c: Column | str, prefix: str = "COTC", study: int = 3, subject: int = 4) -> Column:
    """Study and subject numbers, padded: "cotc22-514" is "COTC022-0514"; longer numbers stay whole; null if they aren't there."""
    pad = lambda x, n: F.lpad(x, F.greatest(F.length(x), F.lit(n)), F.lit("0"))
    t = F.upper(col(c))
    a, b = (F.regexp_extract(t, rf"{prefix}\D*(\d+)\D+(\d+)", i) for i in (1, 2))
    return F.when(a != "", F.concat(F.lit(prefix), pad(a, study), F.lit("-"), pad(b, subject)))


def symbols(c: Column | str) -> Column:
    """Distinct upper-case symbols of a cell that lists them with ``///``, ``;`` or ``,``."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"///|;|,"), lambda x: F.upper(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: ~x.isin("", "---", "NA")))


def symbol_status(c: Column | str) -> Column:
    n = F.size(symbols(c))
    first = F.get(symbols(c), F.lit(0))
    return F.when(n == 0, "EMPTY").when(n > 1, "MULTI").when(first.rlike(r"^[A-Z0-9.-]+$"), "UNIQUE").otherwise("NONSTANDARD")


def strip_copy_suffix(c: Column | str) -> Column:
    """"ABC_2" to "_9..." is "ABC"; other text stays."""
    base = F.regexp_extract(col(c), r"^(.+)_([2-9][0-9]*)$", 1)
    return F.when(base != "", base).otherwise(col(c))


def header(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def keyword_hits(c: Column | str, terms: Sequence[str]) -> Column:
    text = F.lower(col(c))
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def int_list(c: Column | str) -> Column:
    return F.transform(F.split(col(c), ","), lambda x: F.trim(x).cast("int"))


def grid(low: Column, high: Column, n: int) -> Column:
    """n values from low to high, evenly spaced."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (high - low) * i / F.lit(float(n - 1)))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def orthogonal_fraction(a: Column | str, onto: Column | str) -> Column:
    """The part of a's squared length that is not along ``onto``."""
    c = cosine(a, onto)
    return 1 - c * c


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def logit(p: Column | str, edge: float = 1e-6) -> Column:
    q = clip(p, edge, 1 - edge)
    return F.ln(q / (1 - q))


def seed_from(c: Column | str) -> Column:
    """A seed from a text's digest: its first 8 hex digits modulo 2**31 - 1."""
    return F.pmod(F.conv(F.substring(F.sha2(col(c), 256), 1, 8), 16, 10).cast("bigint"), F.lit(2**31 - 1))


def draw_key(*parts: Column | str) -> Column:
    """A number from 0 to 2**32 - 1 for each combination of parts: the repository's only random source."""
    text = F.concat_ws("|", *(col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def close(a: Column | str, b: Column | str, tolerance: float) -> Column:
    return F.abs(col(a) - col(b)) <= tolerance


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; -0.0 becomes 0.0."""
    return F.round(col(c), digits) + F.lit(0.0)
