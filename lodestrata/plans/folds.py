"""Ordered folds: state machines over the operations of a key, in order.

Operations are dealt by key and sorted by their order; a worker streams them and holds one key's state, never a key's
operations.  Sequential logic of one key is sequential: a key with a third of all operations is streamed by one task
in constant memory.  What is associative is not folded here but aggregated (``since_reset``, running windows).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.plans import ranged


def fold(ops: DataFrame, key: str, order: tuple[str, ...], columns: tuple[str, ...], start: Callable[[], object], step: Callable[..., object], every: str | None = None, last: str | None = None, finish: Callable[[object], tuple] | None = None) -> DataFrame:
    """Runs ``step(state, *columns) -> (state, results)`` over each key's rows.

    With ``every`` (schema) a row (key, order columns, results) is returned for each operation; with ``last`` (schema)
    one row a key: (key, *finish(state)).
    """
    rows = ops.select(key, *order, *columns)
    kinds = dict(rows.dtypes)
    head = f"`{key}` {kinds[key]}" + ("".join(f", `{o}` {kinds[o]}" for o in order) if every else "")
    schema = f"{head}, {every or last}"
    n = len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, seen = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not seen or row[0] != now:
                    if seen and not every:
                        out.append((now, *finish(state)))
                    now, state, seen = row[0], start(), True
                state, result = step(state, *row[1 + n :])
                if every:
                    out.append((*row[: 1 + n], *result))
            if out:
                yield give(out)
        if seen and not every:
            yield give([(now, *finish(state))])

    def give(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    types, names = [to_arrow_type(f.dataType) for f in parsed], [f.name for f in parsed]
    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def since_reset(ops: DataFrame, keys: list[str], order: str, reset: Column, base: Column, delta: Column) -> DataFrame:
    """keys, base (of the last row where ``reset`` holds, null if none), total (sum of ``delta`` after it), n (rows after it).

    Both passes aggregate map-side, so a hot key sends one row a task.
    """
    marked = ops.withColumns({"_reset": F.coalesce(reset, F.lit(False)), "_base": base, "_delta": delta})
    last = marked.where("_reset").groupBy(*keys).agg(F.max(order).alias("_at"), F.max_by(F.struct("_base"), order).alias("_b"))
    after = marked.where("not _reset").join(last.select(*keys, "_at"), keys, "left").where(F.col("_at").isNull() | (F.col(order) > F.col("_at")))
    sums = after.groupBy(*keys).agg(F.sum("_delta").alias("total"), F.count(F.lit(1)).alias("n"))
    return last.join(sums, keys, "full").select(*keys, F.col("_b._base").alias("base"), F.col("_at").isNotNull().alias("was_reset"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def current(ops: DataFrame, item: list[str], order: str, scope: list[str] | None = None, payload: list[str] = []) -> DataFrame:  # noqa: B006
    """Items (with ``payload``) of a structure after ops(item..., op, order): the last op of an item is ``add``, and no
    later ``clear`` (an op with null item columns beyond ``scope``) has emptied its scope."""
    last = ops.where("op <> 'clear'").groupBy(*item).agg(F.max_by(F.struct("op", *payload), order).alias("s"), F.max(order).alias("_at"))
    kept = last.where("s.op = 'add'").select(*item, *[F.col(f"s.{p}").alias(p) for p in payload], "_at")
    if scope is None:
        return kept.drop("_at")
    cleared = ops.where("op = 'clear'").groupBy(*scope).agg(F.max(order).alias("_clear"))
    return kept.join(cleared, scope, "left").where("_clear is null or _clear < _at").drop("_clear", "_at")


def previous(ops: DataFrame, item: list[str], order: str, value: str) -> DataFrame:
    """``ops`` with ``before``: the ``value`` of the item's previous row."""
    return ranged.lagged(ops, item, order, "before", value)
