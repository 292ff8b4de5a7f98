"""Quantiles and ranks over the last n rows of each series: an ordered window that a row enters and another leaves.

The window's values lie in sorted blocks with their counts, so a step costs about the logarithm of the window and the length of
a block, where a percentile over each row's frame would sort it anew.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Values of a block at most; a fuller one is halved.
FULL = 512


class Ordered:
    """Values in order, repeats included."""

    def __init__(self):
        self.blocks: list[list[float]] = []
        self.size = 0

    def _block(self, x: float) -> int:
        """The first block whose last value is not below x."""
        lo, hi = 0, len(self.blocks) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if self.blocks[mid][-1] < x:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def add(self, x: float) -> None:
        self.size += 1
        if not self.blocks:
            self.blocks.append([x])
            return
        k = self._block(x)
        block = self.blocks[k]
        insort(block, x)
        if len(block) > FULL:
            self.blocks[k : k + 1] = [block[: FULL // 2], block[FULL // 2 :]]

    def remove(self, x: float) -> None:
        """Take out one value equal to x, which must be there."""
        k = self._block(x)
        block = self.blocks[k]
        del block[bisect_left(block, x)]
        self.size -= 1
        if not block:
            del self.blocks[k]

    def __getitem__(self, k: int) -> float:
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        raise IndexError(k)

    def quantile(self, p: float) -> float | None:
        """Linear between neighbours; None without values."""
        if not self.size:
            return None
        at = (self.size - 1) * p
        low = int(at)
        a = self[low]
        return a if at == low else a + (self[low + 1] - a) * (at - low)

    def counts(self, x: float) -> tuple[int, int]:
        """How many values are below x, and how many equal it."""
        below = same = 0
        for block in self.blocks:
            if block[-1] < x:
                below += len(block)
                continue
            if block[0] > x:
                break
            left = bisect_left(block, x)
            right = bisect_right(block, x, left)
            below, same = below + left, same + right - left
        return below, same


def ordered(rows: DataFrame, made: dict[str, tuple], *, key: str = "symbol", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Adds, per ``key`` in ``order``: name = ("quantile", x, n, p) over the last n rows, or ("rank", x, n), the mean rank in percent
    of the row's value among the n - 1 rows before it (50 where it stands alone, null for a null).

    Null and NaN values take a place in the window but don't count.  A quantile of no values is null.
    """
    inputs = list(dict.fromkeys(x for _, x, *_ in made.values()))
    columns = rows.columns
    schema = StructType([*rows.schema.fields, *[StructField(name, DoubleType()) for name in made]])
    windows = list(dict.fromkeys((x, n) for _, x, n, *_ in made.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = None
        held: dict[tuple[str, int], tuple[deque, Ordered]] = {}
        for batch in batches:
            keys = batch.column(len(columns) + len(inputs)).to_pylist()
            values = {x: batch.column(len(columns) + k).to_pylist() for k, x in enumerate(inputs)}
            out: dict[str, list] = {name: [] for name in made}
            for i, of in enumerate(keys):
                if of != now or not held:
                    now, held = of, {w: (deque(), Ordered()) for w in windows}
                for (x, n), (last, window) in held.items():
                    v = values[x][i]
                    v = None if v is None or v != v else v
                    last.append(v)
                    if v is not None:
                        window.add(v)
                    if len(last) > n:
                        gone = last.popleft()
                        if gone is not None:
                            window.remove(gone)
                for name, (kind, x, n, *p) in made.items():
                    window = held[x, n][1]
                    v = values[x][i]
                    if kind == "quantile":
                        out[name].append(window.quantile(*p))
                    elif v is None or v != v:
                        out[name].append(None)
                    elif window.size == 1:
                        out[name].append(50.0)
                    else:
                        below, same = window.counts(v)
                        same -= 1
                        out[name].append((2 * below + same + (same > 0)) * 50.0 / (window.size - 1))
            found = [pa.array(v, pa.float64()) for v in out.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *found], names=[*columns, *made])

    named = F.to_json(F.struct(key), {"ignoreNullFields": "false"}).alias("__key")
    given = rows.repartition(key).sortWithinPartitions(key, *order)
    return given.select(*[f"`{x}`" for x in columns], *[F.col(x).cast("double").alias(f"__{k}") for k, x in enumerate(inputs)], named).mapInArrow(run, schema)
