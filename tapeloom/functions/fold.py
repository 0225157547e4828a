"""Path-dependent recurrences: one ordered pass over each key with a small state."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold(rows: DataFrame, by: list[str], order: list[str], columns: list[str], start: Callable, step: Callable, schema: str, finish: Callable | None = None) -> DataFrame:
    """by and `schema` columns of what step(state, *values) and finish(state) yield as tuples.

    Keys are dealt to tasks and sorted by Spark; a task streams them and holds one key's state, not
    its rows. start() makes a state."""
    keys = [rows.schema[c] for c in by]
    made = StructType([*keys, *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(made)

    def run(batches):
        key, state, out = None, None, []

        def flush():
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[: len(by)] != key:
                    if key is not None and finish:
                        out.extend((*key, *x) for x in finish(state))
                    key, state = row[: len(by)], start()
                out.extend((*key, *x) for x in step(state, *row[len(by) :]) or ())
                if len(out) >= 10_000:
                    yield flush()
                    out = []
        if key is not None and finish:
            out.extend((*key, *x) for x in finish(state))
        if out:
            yield flush()

    # by a hash of the keys: Spark leaves out a repartition by columns that a join has dealt the rows by, and that join may then read its side undealt
    dealt = rows.select(*by, *dict.fromkeys([*order, *columns])).repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order)
    return dealt.select(*by, *columns).mapInArrow(run, made)
