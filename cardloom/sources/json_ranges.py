"""One huge JSON value read by many tasks: records of an array or object are found in ranges of a file, wherever it is cut.

The text reader cuts a file into byte ranges and hands out what stands between two closing marks (`}` or `]`), each piece as a row and
in the order of the file, so a task holds a piece at a time and any store that Spark reads will do. What a range can't know is where
it starts: within a string or not, and how deep. So

1. each range is read once for both cases, and says in which state it ends and how many levels it goes up or down;
2. these are composed over the ranges of a file, in order, which gives every range its start (a few numbers for a range);
3. each range is read again from its true start and gives its records; what is left at its ends are parts of records, which are
   put together with the parts of the neighbouring ranges.

Records are the elements of the top array (field None), or those of the array or object under one key of the top object; nothing else
in the file is taken for a record. What stands outside of them comes as a record-free JSON value (`header`). A value that is cut off
ends with its last whole record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import arrow_ready

_STRING_END = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*+)("?)(\s*+:)?|[\[\]{}]', re.S)


def _walk(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece ends within a string, and its change of depth, if it starts so."""
    at = 0
    if inside:
        m = _STRING_END.match(text)
        if m is None:
            return True, 0
        at = m.end()
    depth = 0
    for m in _TOKEN.finditer(text, at):
        c = m[0][0]
        if c == '"':
            if not m[2]:
                return True, depth
        else:
            depth += 1 if c in "[{" else -1
    return False, depth


class _Range:
    """Reads the pieces of one range from its start. Text is cut into items: records, and what stands outside of their array or object.

    An item that began in an earlier range ends here as a part (`-end`); the last one goes on in the next range (`open`), or goes through.
    """

    def __init__(self, mark: str, level: int, inside: bool, depth: int, begins: bool):
        self.mark, self.level = mark, level
        self.inside, self.depth, self.key = inside, depth, None
        self.parts: list[str] = []
        self.earlier = not begins

    def end(self, kind: str) -> Iterator[tuple]:
        text, self.parts = "".join(self.parts), []
        if self.earlier:
            yield f"{kind}-end", self.key, text
        elif kind != "space":
            yield kind, self.key, text
        self.earlier = False

    def feed(self, piece: str) -> Iterator[tuple]:
        """(kind, key, text) of the items that end in a piece or with the mark behind it."""
        at = done = 0
        if self.inside:
            m = _STRING_END.match(piece)
            at, self.inside = (m.end(), False) if m else (len(piece), True)
        if not self.inside:
            for m in _TOKEN.finditer(piece, at):
                c = m[0][0]
                if c == '"':
                    if not m[2]:
                        self.inside = True
                        break
                    if m[3] and self.depth == 1 and self.level == 2:
                        self.key = m[1]
                elif c in "[{":
                    self.depth += 1
                    if self.depth == self.level:
                        self.parts.append(piece[done : m.end()])
                        done = m.end()
                        yield from self.end("outer")
                else:
                    self.depth -= 1
                    if self.depth == self.level - 1:
                        yield from self.end("space")
                        done = m.start()
        self.parts.append(piece[done:])
        if not self.inside:
            self.depth -= 1
            if self.depth == self.level - 1:
                yield from self.end("space")
        self.parts.append(self.mark)
        if not self.inside and self.depth == self.level:
            yield from self.end("record")

    def rest(self) -> Iterator[tuple]:
        yield f"{'through' if self.earlier else 'open'}-{'inner' if self.depth >= self.level else 'outer'}", self.key, "".join(self.parts)


def _pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    raw = spark.read.option("lineSep", mark).text(path)
    return arrow_ready(raw).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    for batch in batches:
        files, starts, values = (batch.column(k).to_pylist() for k in range(3))
        first = 0
        for k in range(1, len(values) + 1):
            if k == len(values) or files[k] != files[first] or starts[k] != starts[first]:
                yield (files[first], starts[first]), values[first:k]
                first = k


def range_starts(pieces: DataFrame) -> DataFrame:
    """file, start, inside, depth: where each range of a file starts, from what the ranges before it do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for name, values in _by_range(batches):
            ends = found.setdefault(name, [False, 0, True, 0])
            for value in values:
                for k in (0, 2):
                    inside, depth = _walk(value, ends[k])
                    ends[k], ends[k + 1] = inside, ends[k + 1] + depth - (not inside)  # the mark behind the piece closes a level
        rows = [(*name, *ends) for name, ends in found.items()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["file", "start", "out", "out_depth", "in", "in_depth"])

    ranges = pieces.mapInArrow(run, "file string, start long, out boolean, out_depth long, `in` boolean, in_depth long")
    listed = ranges.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "out", "out_depth", "in", "in_depth"))).alias("ranges"))  # a few numbers for each range
    state = "struct<inside:boolean,depth:bigint,starts:array<struct<start:bigint,inside:boolean,depth:bigint>>>"
    begin = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<struct<start:bigint,inside:boolean,depth:bigint>>").alias("starts")).cast(state)

    def then(s, r):
        here = F.struct(r["start"].alias("start"), s["inside"].alias("inside"), s["depth"].alias("depth"))
        return F.struct(
            F.when(s["inside"], r["in"]).otherwise(r["out"]).alias("inside"), (s["depth"] + F.when(s["inside"], r["in_depth"]).otherwise(r["out_depth"])).alias("depth"),
            F.array_append(s["starts"], here).alias("starts"),
        ).cast(state)

    return listed.select("file", F.explode(F.aggregate("ranges", begin, then)["starts"]).alias("s")).select("file", "s.*")


def read_records(spark: SparkSession, path: str, mark: str = "}", field: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(file, text) of the records of the JSON values at path, one value a file, and (file, header), each value without its records.

    mark: what every record ends with. Of member records ("id": [..]) the text holds the name as well.
    """
    level = 1 if field is None else 2
    pieces = _pieces(spark, path, mark)
    starts = {(r.file, r.start): (r.inside, r.depth) for r in range_starts(pieces).collect()}  # 40 MB for 100 TB in ranges of 128 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader, number = None, None, 0

        def rows(found) -> pa.RecordBatch:
            nonlocal number
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            n = len(columns[0])
            number += n
            return pa.RecordBatch.from_arrays(
                [pa.array([name[0]] * n, pa.string()), pa.array([name[1]] * n, pa.int64()), pa.array(range(number - n, number), pa.int64()), *(pa.array(c, pa.string()) for c in columns)],
                names=["file", "start", "number", "kind", "key", "text"],
            )

        for own, values in _by_range(batches):
            if own != name:
                if name is not None:
                    yield rows(list(reader.rest()))
                inside, depth = starts[own]
                name, number = own, 0
                reader = _Range(mark, level, inside, depth, own[1] == 0)
            yield rows([x for value in values for x in reader.feed(value)])
        if name is not None:
            yield rows(list(reader.rest()))

    found = pieces.mapInArrow(run, "file string, start long, number long, kind string, key string, text string")
    whole = found.where(F.col("kind").isin("record", "outer"))
    # parts: two for each range; one that is open and those that follow it make an item, of the kind that its end says
    parts = found.where(~F.col("kind").isin("record", "outer"))
    opened = F.sum(F.col("kind").startswith("open").cast("long")).over(Window.partitionBy("file").orderBy("start", "number"))
    listed = parts.withColumn("item", opened).groupBy("file", "item").agg(F.array_sort(F.collect_list(F.struct("start", "number", "kind", "key", "text"))).alias("p"))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)["kind"]
    kind = F.when(last == "record-end", "record").when(last.isin("outer-end", "open-outer", "through-outer"), "outer").otherwise("space")
    cut = listed.select("file", first["start"].alias("start"), first["number"].alias("number"), kind.alias("kind"), first["key"].alias("key"), F.array_join("p.text", "").alias("text"))
    items = whole.unionByName(cut)
    records = items.where("kind = 'record'")
    if field is not None:
        # the key that a record stands under is the last one seen before its end, maybe in an earlier range
        seen = found.groupBy("file", "start").agg(F.max_by("key", F.when(F.col("key").isNotNull(), F.col("number"))).alias("last"))
        before = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
        earlier = seen.select("file", "start", before.alias("before"))  # a row for each range
        records = records.join(earlier, ["file", "start"]).where(F.coalesce("key", "before") == field)
    outside = items.where("kind = 'outer'").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "number", "text"))).alias("t"))
    return records.select("file", F.regexp_replace("text", r"^[\s,]+", "").alias("text")), outside.select("file", F.array_join("t.text", "").alias("header"))
