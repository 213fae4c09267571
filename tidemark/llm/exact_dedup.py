"""Exact deduplication by Grace hashing."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SPACES, small_batches, task

#: Content bytes that a table holds before its bucket is partitioned again.
TABLE_BYTES = 16 << 20
FANOUT = 16
_GONE = dict.fromkeys(map(ord, SPACES))


def squeezed(text: str) -> str:
    return text.translate(_GONE)


class OpenTable:
    """Open addressing with linear probing; keys are equal only if their whole contents are, white space apart.

    An entry is [digest, content, points, id, copies, times, row]: the best row (most code points, then smallest id, a
    null id last) of those with the content, how many there are, and how often the best is repeated."""

    def __init__(self, slots: int = 1 << 10):
        self.slots, self.entries, self.bytes = [-1] * slots, [], 0

    def _slot(self, digest: bytes, content: str) -> int:
        last = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "big") & last
        while (e := self.slots[at]) >= 0:
            if (x := self.entries[e])[0] == digest and (x[1] == content or squeezed(x[1]) == squeezed(content)):
                break
            at = (at + 1) & last
        return at

    def add(self, digest: bytes, content: str, points: int, key, copies: int, times: int, row) -> None:
        at = self._slot(digest, content)
        if (e := self.slots[at]) >= 0:
            x = self.entries[e]
            x[4] += copies
            if points == x[2] and key == x[3]:
                x[5] += times
            elif points > x[2] or points == x[2] and key is not None and (x[3] is None or key < x[3]):
                self.bytes += len(content) - len(x[1])
                x[1], x[2], x[3], x[5], x[6] = content, points, key, times, row
            return
        self.slots[at] = len(self.entries)
        self.entries.append([digest, content, points, key, copies, times, row])
        self.bytes += len(content) + 400
        if 2 * len(self.entries) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            last = len(self.slots) - 1
            for i, x in enumerate(self.entries):
                at = int.from_bytes(x[0][8:16], "big") & last
                while self.slots[at] >= 0:
                    at = (at + 1) & last
                self.slots[at] = i


def _rows(batches, step: int = 512):
    """The rows of record batches, a few at a time as Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield from zip(*(c.to_pylist() for c in b.slice(i, step).columns))


def _batches(entries, schema: pa.Schema, limit: int = 4 << 20):
    """Record batches of some MB."""
    held, size = [], 0
    for x in entries:
        held.append(x)
        size += len(x[1] or "") + 100
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class Spill:
    """The files of one partitioning: unlinked when made, so that they go with the task whatever ends it."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.files, self.writers, self.held = schema, [], [], [[] for _ in range(FANOUT)]
        for _ in range(FANOUT):
            self.files.append(tempfile.TemporaryFile())
            self.writers.append(pa.ipc.new_stream(self.files[-1], schema, options=pa.ipc.IpcWriteOptions(compression="zstd")))
        self.sizes = [0] * FANOUT

    def add(self, bucket: int, entry) -> None:
        self.held[bucket].append(entry)
        self.sizes[bucket] += len(entry[1]) + 100
        if self.sizes[bucket] > 1 << 18:
            self._flush(bucket)

    def _flush(self, bucket: int) -> None:
        for b in _batches(self.held[bucket], self.schema):
            self.writers[bucket].write_batch(b)
        self.held[bucket], self.sizes[bucket] = [], 0

    def buckets(self):
        for i in range(FANOUT):
            self._flush(i)
            self.writers[i].close()
        for f in self.files:
            f.seek(0)
            yield (tuple(r) for b in pa.ipc.open_stream(f) for r in zip(*(c.to_pylist() for c in b.columns)))
            f.close()


def grace(entries, limit: int, schema: pa.Schema, depth: int = 0):
    """One entry for each different content of `entries`. While a bucket fits `limit` bytes it is one table; beyond
    that its entries go to FANOUT spill files by the next four bits of the digest, and each file is a bucket."""
    held, spill = OpenTable(), None
    for x in entries:
        if spill is None:
            held.add(*x)
            if held.bytes > limit and len(held.entries) > 1 and depth < 16:
                spill = Spill(schema)
                for y in held.entries:
                    spill.add(_nibble(y[0], depth), y)
                held = None
        else:
            spill.add(_nibble(x[0], depth), x)
    if spill is None:
        yield from held.entries
    else:
        for bucket in spill.buckets():
            yield from grace(bucket, limit, schema, depth + 1)


def _nibble(digest: bytes, depth: int) -> int:
    return digest[16 + depth // 2] >> (4 * (depth % 2)) & 15


def _squeezed(text_col: str):
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACES, "")


def _points(text_col: str):
    return F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")


def classes_of(df: DataFrame, id_col: str, text_col: str, table_bytes: int, others: list[str] | None = None) -> DataFrame:
    """(digest, content, points, keep, copies, times, row) of each different normalised text: content is the original text of the row that
    stays, row whether that is null and a struct of its other columns, where these are asked for; without them content is empty.
    Ids keep their type and are compared as such."""
    row = F.lit(None).cast("struct<none:int>") if others is None else F.struct(F.col(text_col).isNull().alias("none"), F.struct(*others, F.lit(0).alias("_")).alias("own"))
    source = small_batches(df).select(
        F.unhex(F.sha2(_squeezed(text_col), 256)).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("content"), _points(text_col).alias("points"),
        F.col(id_col).alias("keep"), F.lit(1).cast("long").alias("copies"), F.lit(1).cast("long").alias("times"), row.alias("row"),
    )
    schema = to_arrow_schema(source.schema)
    whole = others is not None

    def combine(batches):
        held = OpenTable()
        for x in _rows(batches):
            held.add(*x)
            if held.bytes > table_bytes:
                yield from _batches(held.entries, schema)
                held = OpenTable()
        yield from _batches(held.entries, schema)

    def classes(batches):
        found = grace(_rows(batches), table_bytes, schema)
        yield from _batches(found if whole else ([x[0], "", *x[2:]] for x in found), schema)

    return source.mapInArrow(task(combine), source.schema).repartition(F.col("digest")).mapInArrow(task(classes), source.schema)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every row of `df` with keep_id, group_size, kept_rows, kept and text_sha256, in place of any columns so named.

    Texts are equal when identical after deleting white space (space, tab to carriage return); of equal texts
    the row with the most code points, then the smallest id, stays. A null text counts as empty; a null id sorts
    last and is kept where it is alone; rows that repeat an id and its text share one result, and kept_rows counts them. An empty table
    gives an empty result. Other columns pass through.

    A combiner in each input partition folds its copies, so a text that a third of all rows share reaches its
    bucket once per partition. Buckets are Grace hash partitions: spilled and partitioned again until they fit an
    open-addressing table that compares complete contents. The rows then join their class by digest, a join
    whose skewed partitions Spark may split."""
    made = ("keep_id", "group_size", "kept_rows", "kept", "text_sha256")
    rows = df.drop(*made)
    found = classes_of(df, id_col, text_col, table_bytes).select(
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("keep").alias("keep_id"), F.col("copies").alias("group_size"), F.col("times").alias("kept_rows"), F.col("points").alias("__points")
    )
    # lengths are taken before the join: texts travel only if they are asked for
    joined = rows.withColumns({"text_sha256": F.sha2(_squeezed(text_col), 256), "__own": _points(text_col)}).join(found, "text_sha256")
    stays = F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("__own") == F.col("__points"))
    return joined.select(*rows.columns, "keep_id", "group_size", "kept_rows", stays.alias("kept"), "text_sha256")


def kept_only(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row of each group, with the columns of `df`; of rows that repeat the id that stays, one. The rows that stay come
    out of their buckets, so each text is shuffled once. A null text counts as empty and stays null; a null id sorts last; an empty
    table gives an empty result."""
    others = [c for c in df.columns if c != text_col]
    found = classes_of(df, id_col, text_col, table_bytes, others)
    text = F.when(~F.col("row.none"), F.col("content"))
    return found.select(*(text.alias(c) if c == text_col else F.col("row.own").getField(c).alias(c) for c in df.columns))
