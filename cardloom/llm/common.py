"""What several operators share: table access, lineage cuts, size-checked joins, Arrow row streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import arrow_ready, new_folder, remove, shared_dir  # noqa: F401  (used by the operators)

#: Ids that may be sent to every executor (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 4_000_000
#: Tables that saved() has written and nobody has removed yet, oldest first.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables saved() has written that are still there: a mark for remove_saved."""
    return len(_written)


def remove_saved(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Removes the tables written after the mark, but for the last `keep`; frames read from them can't be used any more."""
    for path in _written[since : len(_written) - keep]:
        remove(spark, path)
        _written.remove(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with as many _ behind it as no column of df has (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """left_semi or left_anti join on key; ids are broadcast only when counted to be few enough."""
    few = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if few else ids, key, how)


def least_of(df: DataFrame, key: str, order: str, k: int, rows: int = 20_000) -> list[dict]:
    """The rows with the k least values of order (a hash) for each key; of rows with equal key and order, one.

    Every task keeps at most k rows for each key, and the tasks' rows are merged in rounds of ever fewer tasks, so no task
    sees all of a key. What is returned is bounded by k and the number of keys.
    """
    schema = df.schema

    def least(table: pa.Table) -> pa.Table:
        codes = table.column(key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        values = table.column(order).to_numpy()
        at = np.lexsort((values, codes))
        c, v = codes[at], values[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (c[1:] != c[:-1]) | (v[1:] != v[:-1])
        at, c = at[new], c[new]
        rank = np.arange(len(c)) - np.searchsorted(c, c, side="left")
        return table.take(pa.array(at[rank < k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, waiting, n = None, [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n > 50_000:
                kept = least(pa.concat_tables([*([kept] if kept else []), pa.Table.from_batches(waiting)]))
                waiting, n = [], 0
        if waiting:
            kept = least(pa.concat_tables([*([kept] if kept else []), pa.Table.from_batches(waiting)]))
        if kept is not None:
            yield from kept.to_batches()

    mark = written()
    out = saved(arrow_ready(df).mapInArrow(run, schema), "least")
    parts = 1 << 30
    while parts > 1 and (n := out.count()) > rows:
        parts = min(-(-n // rows), max(1, parts // 2))
        out = saved(out.repartition(parts).mapInArrow(run, schema), "least")
    found = [r.asDict() for r in out.collect()]
    remove_saved(df.sparkSession, mark)
    found.sort(key=lambda r: (r[key], r[order]))
    kept, last, n = [], None, 0
    for r in found:
        if last is None or r[key] != last[key]:
            n = 0
        elif r[order] == last[order]:
            continue
        last, n = r, n + 1
        if n <= k:
            kept.append(r)
    return kept


def map_rows(
    df: DataFrame, columns: list[str], make: Callable[[], Callable[..., Iterator[tuple]]], schema: str
) -> DataFrame:
    """Streams the named columns through a function that yields output rows, Arrow batch by batch.

    make runs once in each task and returns the function; that is called with one value for each column.
    """
    fields = spark_schema(df.sparkSession, schema)
    arrow_ready(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            out = [r for values in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in row(*values)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields
                )

    return df.select(*columns).mapInArrow(run, schema)


def spark_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def fold(col: str = "doc_id") -> Column:
    """0..3 from the id's text; fold 2 is held out."""
    return F.pmod(F.crc32(F.col(col).cast("string")), F.lit(4))


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(fold(col) == 2, F.lit(False))
