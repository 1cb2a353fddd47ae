"""Column-level scalar helpers (all JVM-side, no Python UDFs).

O-40 / O-41 account-code grammar, O-74..O-77 parsing, O-64 first-unique,
O-70 / O-84 rounding, O-82 entry suffix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import ENTRY_SUFFIX

# --- fixed values: account-code grammar (a code is e.g. 60, 60.01, 76.ФВ, 94.Н, 000)
ACCOUNT_SHAPE = r"^(000|[0-9]{1,2}|([0-9]{1,2}|\p{L}{1,2})?(\.([0-9]{1,2}|\p{L}{1,2})?)+)$"
ACCOUNT_HAS_DIGITS = r"(^|\.)[0-9]{1,2}(\.|$)|^000$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def apart(col) -> Column:
    """The column as it is, by a lambda: Spark compiles a projection that holds one in pieces, where one fused method would
    be too long for the JVM's compiler."""
    return F.transform(F.array(_c(col)), lambda x: x)[0]


def is_account_code(col) -> Column:
    """O-40: True when the text is an account code; null is not a code."""
    c = _c(col)
    # without a dot a code is short; longer texts need no pattern
    short = (F.length(c) <= 3) | c.contains(".")
    return F.coalesce(short & c.rlike(ACCOUNT_SHAPE) & c.rlike(ACCOUNT_HAS_DIGITS), F.lit(False))


def pad_account(col, *, require_code: bool = True) -> Column:
    """O-41: prefix single-character codes with 0 (7 -> 07); longer text unchanged.

    ``require_code=False`` pads any one-character value (general trial balance).
    """
    c = _c(col)
    cond = F.length(c) == 1
    if require_code:
        cond = cond & is_account_code(c)
    return F.when(cond, F.concat(F.lit("0"), c)).otherwise(c)


def unpad_account(col) -> Column:
    """Inverse of O-41 for two-character codes starting with 0 (07 -> 7)."""
    c = _c(col)
    return F.when((F.length(c) == 2) & c.startswith("0") & is_account_code(c), F.substring(c, 2, 1))


def blank_to_null(col) -> Column:
    """O-77: empty / whitespace-only text becomes null."""
    c = _c(col)
    return F.when(c.rlike(r"^\s*$"), F.lit(None).cast("string")).otherwise(c)


def clean_label(col) -> Column:
    """Trim, and turn a blank result into null (O-24)."""
    return F.nullif(F.trim(_c(col)), F.lit(""))


def parse_timestamp(col) -> Column:
    """O-74: 'dd.MM.yyyy HH:mm:ss' or 'dd.MM.yyyy'; anything else -> null."""
    c = _c(col)
    return F.coalesce(F.try_to_timestamp(c, F.lit("dd.MM.yyyy HH:mm:ss")),
                      F.try_to_timestamp(c, F.lit("dd.MM.yyyy")))


def parse_date(col) -> Column:
    """O-75: 'dd.MM.yyyy' only; anything else -> null."""
    return F.try_to_timestamp(_c(col), F.lit("dd.MM.yyyy"))


def parse_number(col, *, default_zero: bool = True, scale: int = 4) -> Column:
    """O-76: text -> decimal; unparsable -> 0 (or null with ``default_zero=False``)."""
    num = F.trim(_c(col).cast("string")).try_cast(f"decimal(18,{scale})")
    return F.coalesce(num, F.lit(0).cast(f"decimal(18,{scale})")) if default_zero else num


def half_even(col, digits: int = 0) -> Column:
    """O-70 / O-84: round half to even (pandas/numpy rounding)."""
    return F.bround(_c(col), digits)


def strip_entry_suffix(col) -> Column:
    """O-82: remove the occurrence suffix '_end<n>' from an entry id."""
    return F.regexp_replace(_c(col), ENTRY_SUFFIX + r"\d+$", "")


def first_unique(arr) -> Column:
    """O-64: keep the first occurrence of each value in an array, later repeats -> null."""
    a = _c(arr)
    return F.transform(a, lambda x, i: F.when(F.array_position(a, x) == i + 1, x))


def dotted_prefixes(col) -> Column:
    """Every proper dotted prefix of a code: '60.01.02' -> ['60', '60.01'] (O-33)."""
    parts = F.split(_c(col), r"\.")
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda k: F.when(k < n, F.array_join(F.slice(parts, 1, k), ".")),
    )
