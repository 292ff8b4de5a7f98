"""Recurrences with branches over long series, by blocks of rows that run at the same time.

A block's outcome depends on the state in which it begins.  Every block first runs from a guess, the state that a few rows
before it lead to from a fresh start: recurrences that forget reach the same state, bit for bit, from wherever they began.
Then each guess is held against the state in which the block before ended; blocks that guessed wrong run again from the right
one, until all states fit together.  The first block is always right, so what comes out equals one loop over the whole series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticklattice.functions import folders, frames

c = F.col
#: Rows of a block, and rows before it from which its state is guessed.
BLOCK, WARM = 1 << 16, 512

#: (state or None, rows) -> (output columns by name, state): one step over a block's rows, in order.
Fold = Callable[[tuple | None, dict[str, list]], tuple[dict[str, list], tuple]]


def relayed(df: DataFrame, fold: Fold, *, inputs: list[str], state: str, out: str, key: str = "symbol", ts: str = "ts", tie: str | None = None,
            block: int = BLOCK, warm: int = WARM) -> DataFrame:
    """``df`` with the columns ``out`` that ``fold`` gives over each key's rows in the order of (ts, tie).

    ``state`` and ``out`` are schemas; ``fold`` sees ``inputs`` as lists (null: None) and the state before, None at the start of
    a series.  Null keys are a series, a null ts comes first, rows that repeat (ts, tie) come in one order throughout.  An empty
    table stays empty.
    """
    if warm > block:
        raise ValueError(f"{warm} rows before a block of {block} rows")
    fields = StructType.fromDDL(state)
    n = c("__n")
    longest, span = frames.measured(df, key=key, ts=ts, rows=block)
    schema = StructType([*df.schema.fields, *StructType.fromDDL(out).fields])

    def columns(pdf) -> dict[str, list]:
        return {x: pdf[x].astype(object).where(pdf[x].notna(), None).tolist() for x in inputs}

    if longest <= block:

        def whole(pdf):
            pdf = pdf.sort_values([ts, *([tie] if tie else [])], na_position="first", kind="stable").reset_index(drop=True)
            return pdf.assign(**fold(None, columns(pdf))[0])

        return df.groupBy(key).applyInPandas(whole, schema)
    # Written, as places of rows that repeat must not change between the passes.
    rows = folders.written(frames.placed(df, span, key=key, ts=ts, tie=tie).drop("__part").withColumn("__block", F.floor(n / block)), "relay")
    given = ["__n", *inputs]
    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, __block long"
    ends = f"{kind}, given struct<{state.replace(' ', ':')}>, left struct<{state.replace(' ', ':')}>".replace(",:", ",")
    names, plain = fields.names, df.columns

    def told(pdf) -> tuple | None:
        one = pdf["__given"].iloc[0]
        return None if one is None else tuple(one[x] for x in names)

    def as_struct(found: tuple | None) -> dict | None:
        return None if found is None else dict(zip(names, found, strict=True))

    def summary(label, pdf, first, last):
        import pandas as pd

        return pd.DataFrame({key: [label[0]], "__block": [label[1]], "given": [as_struct(first)], "left": [as_struct(last)]})

    def guess(label, pdf):
        pdf = pdf.sort_values("__n")
        own = pdf["__n"] >= label[1] * block
        before = None
        if (~own).any():
            _, before = fold(None, columns(pdf[~own]))
        return summary(label, pdf, before, fold(before, columns(pdf[own]))[1])

    def again(label, pdf):
        pdf = pdf.sort_values("__n")
        before = told(pdf)
        return summary(label, pdf, before, fold(before, columns(pdf))[1])

    blocks = F.when(n % block >= block - warm, F.array(c("__block"), c("__block") + 1)).otherwise(F.array("__block"))
    spread = rows.select(key, *given, F.explode(blocks).alias("__block"))
    # A last block that only holds rows of the one before is none.
    mine = rows.groupBy(c(key).alias("__key"), c("__block").alias("__b")).agg(F.max("__n").alias("__last")).filter("__last is not null")
    here = lambda k="__key", b="__b": c(key).eqNullSafe(c(k)) & (c("__block") == c(b))
    first = spread.join(mine, here(), "left_semi").groupBy(key, "__block").applyInPandas(guess, ends)
    states = folders.written(first, "relay-states")
    while True:
        prior = states.select(c(key).alias("__key"), (c("__block") + 1).alias("__b"), c("left").alias("__given"))
        wrong = folders.written(states.join(prior, here()).filter(~c("given").eqNullSafe(c("__given"))).select("__key", "__b", "__given"), "relay-wrong")
        if not wrong.limit(1).count():
            break
        redone = rows.join(wrong, here()).select(key, "__block", *given, "__given").groupBy(key, "__block").applyInPandas(again, ends)
        states = folders.written(states.join(wrong, here(), "left_anti").unionByName(redone), "relay-states")

    def outputs(pdf):
        pdf = pdf.sort_values("__n").reset_index(drop=True)
        found, _ = fold(told(pdf), columns(pdf))
        return pdf[plain].assign(**found)

    starts = states.select(c(key).alias("__key"), c("__block").alias("__b"), c("given").alias("__given"))
    ready = rows.join(starts, here()).select(*df.columns, "__n", "__block", "__given")
    return ready.groupBy(key, "__block").applyInPandas(outputs, schema)
