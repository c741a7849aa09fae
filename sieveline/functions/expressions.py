"""Null-safe arithmetic, name cleaning, hashing and text formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.settings import EPSILON


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(num: str | Column, den: str | Column, default: float = 0.0) -> Column:
    """``num / den``, or ``default`` where either is null or ``den`` is zero."""
    return F.coalesce(F.try_divide(col(num), col(den)), F.lit(float(default)))


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / (den + epsilon)``, 0 when undefined."""
    return safe_divide(num, col(den) + F.lit(EPSILON))


def known(c: str | Column) -> Column:
    """The number, with NaN as null. Spark orders NaN above every number, a rule must not."""
    value = col(c).cast("double")
    return F.when(~F.isnan(value), value)


def to_amount(c: str | Column) -> Column:
    """Parse to double. Unparseable text, NaN and infinities become null."""
    value = col(c).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def zero_filled(c: str | Column) -> Column:
    return F.coalesce(to_amount(c), F.lit(0.0))


def account_year_name(account: str | Column, year: str | Column) -> Column:
    """Account with every non-alphanumeric as ``_``, trimmed of ``_``, plus the year."""
    base = F.regexp_replace(col(account), "[^a-zA-Z0-9]", "_")
    return F.concat_ws("_", F.btrim(base, F.lit("_")), col(year))


def plain_account(account: str | Column) -> Column:
    """Spaces to ``_``, parentheses dropped."""
    return F.translate(col(account), " ()", "_")


def plain_account_py(account: str) -> str:
    return account.replace(" ", "_").replace("(", "").replace(")", "")


def unit_hash(key: str | Column, seed: int = 42) -> Column:
    """A uniform number in [0, 1) that depends only on ``key`` and ``seed``.

    Sampling by this value gives the same rows on every run, after a task is
    retried and in any other engine with md5.
    """
    digest = F.md5(F.concat_ws("|", col(key).cast("string"), F.lit(str(seed))))
    head = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return head / F.lit(float(2**52))


def percent_text(c: str | Column, digits: int = 1) -> Column:
    """``0.521`` as ``52.1%``; null as ``nan%``."""
    text = F.format_string(f"%.{digits}f%%", col(c).cast("double") * F.lit(100.0))
    return F.when(col(c).isNull(), F.lit("nan%")).otherwise(text)


def count_above(value: str | Column, edges: Sequence[float], inclusive: bool = False) -> Column:
    """How many of ``edges`` lie below ``value`` (or at it, when inclusive)."""
    v = col(value)
    hits = [(v >= e if inclusive else v > e).cast("int") for e in edges]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total


def any_of(values: Sequence[str], c: Column) -> Column:
    return c.isin(*values) if values else F.lit(False)
