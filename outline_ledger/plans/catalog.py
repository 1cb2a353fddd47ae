"""Checked queries: each name maps to a Spark implementation built from the
library operators and an equivalent DuckDB SQL text (the oracle).

The Spark side always starts from the driver tables (via the shared builders in
``derived``), so the work grows with the data.  Oracle SQL uses plain window
functions over whole files: it is the straightforward statement of each
operator's semantics.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ACCOUNT_HAS_DIGITS, ACCOUNT_SHAPE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- SQL helpers
def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(sql_str(v) for v in values)


def sql_is_code(x: str) -> str:
    return (f"coalesce(regexp_matches({x}, {sql_str(ACCOUNT_SHAPE)}) "
            f"AND regexp_matches({x}, {sql_str(ACCOUNT_HAS_DIGITS)}), false)")




def _load_checks() -> None:
    """Import the check modules; each registers its queries on import."""
    from . import checks_outline  # noqa: F401
    from . import checks_accounts  # noqa: F401
    from . import checks_journal  # noqa: F401
    from . import checks_analysis  # noqa: F401
    from . import checks_registers  # noqa: F401
    from . import checks_account_analysis  # noqa: F401
    from . import checks_balances  # noqa: F401
    from . import checks_batch  # noqa: F401
    from . import checks_periods  # noqa: F401


_load_checks()
