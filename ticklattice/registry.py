"""Registered queries of the market-data operators, gathered from the modules of ``ticklattice.plans``."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import functions as F

from ticklattice import plans
from ticklattice.plans.doubles import DOUBLES

#: Digits of doubles in registered results, and what is added before: means of short decimals often lie midway between two of
#: as many digits, where the last bit of a double, which the order of its sum decides, would choose one.  It never shows itself.
DIGITS, OFF_TIES = 6, 1e-10


def _modules():
    return [import_module(f"ticklattice.plans.{m.name}") for m in iter_modules(plans.__path__) if m.name.startswith("q_")]


def flagship(spark, sf_dir):
    from ticklattice.plans.q_indicators import latest_signals

    return latest_signals(spark, sf_dir)


def rounded(f):
    """The query with its doubles at ``DIGITS`` digits: sums of doubles depend on their order beyond that."""

    def run(spark, sf_dir):
        out = f(spark, sf_dir)
        # Adding 0 makes a negative zero plain.
        return out.select(*[(F.round(F.col(f"`{c}`") + OFF_TIES, DIGITS) + F.lit(0.0)).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in out.dtypes])

    return run


def rounded_sql(name: str, sql: str) -> str:
    """The SQL with the same columns as doubles of as many digits."""
    columns = DOUBLES.get(name, "").split()
    if not columns:
        return sql
    return "select * replace (" + ", ".join(f'round(cast("{c}" as double) + {OFF_TIES!r}, {DIGITS}) + 0.0 as "{c}"' for c in columns) + f") from ({sql.strip()})"


def queries() -> dict:
    return {name: rounded(f) for m in _modules() for name, f in m.Q.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: rounded_sql(name, sql) for m in _modules() for name, sql in m.Q.sql.items()}
