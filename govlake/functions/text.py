"""Column expressions shared by operators (all built-in, whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate(c: str | Column, n: int) -> Column:
    """First ``n`` code points (the reference's ``text[:n]``)."""
    return F.left(col(c), F.lit(n))


def shorten(c: str | Column, n: int) -> Column:
    """At most ``n`` code points, ending in "..." when cut."""
    x = col(c)
    return F.when(F.char_length(x) <= n, x).otherwise(
        F.concat(F.left(x, F.lit(n - 3)), F.lit("...")))


def normalise_role(c: str | Column) -> Column:
    """Lower-case; unknown or missing roles become ``user`` (least privilege)."""
    low = F.lower(col(c))
    return F.when(low.isin(*S.ROLES), low).otherwise(F.lit("user"))


def signed_amount(tx_type: str | Column, amount: str | Column) -> Column:
    """Effect on the balance: deposits add, withdrawals and payments take,
    transfer legs carry their own sign."""
    t, a = col(tx_type), col(amount)
    return F.when(t.isin("withdrawal", "payment"), -a).otherwise(a)


# Account or card numbers: a run of 13 or more digits keeps its last four.
LONG_DIGITS = "[0-9]{9,}([0-9]{4})"
LONG_DIGITS_MASK = "****$1"


def mask_long_digits(c: str | Column) -> Column:
    return F.regexp_replace(col(c), LONG_DIGITS, LONG_DIGITS_MASK)


def mask_card_numbers(c: str | Column) -> Column:
    """Long digit runs, 16 digits in groups of four, and 15 digits in groups
    of 4, 6 and 5 keep their last four."""
    four = F.regexp_replace(mask_long_digits(c),
                            "[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -]([0-9]{4})", "****$1")
    return F.regexp_replace(four, "[0-9]{4}[ -][0-9]{6}[ -][0-9]([0-9]{4})", "****$1")


def ts_ntz(value) -> Column:
    """A TIMESTAMP_NTZ literal from a datetime or text, independent of the
    Python process's and the session's time zones."""
    text = value.isoformat(sep=" ") if hasattr(value, "isoformat") else str(value)
    return F.lit(text).cast("timestamp_ntz")
