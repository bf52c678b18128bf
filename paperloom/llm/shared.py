"""What the operators share: work folders, Arrow plumbing and skew-safe components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text handled at once by a Python worker; bounds its memory whatever the batch size.
CHUNK_BYTES = 1 << 20


#: Rows of an Arrow batch, where the session says nothing else.
BATCH_OPTION, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000

#: Bits of a table that tells which keys may be wanted, as a power of two: 4 MB of rows.
FILTER_BITS = 24


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Also lets Arrow batches have fewer rows than by default, as rows are texts here: batches are
    held twice on their way to a worker, outside the heap.

    Only in a local session without that setting a temporary folder takes its place; a cluster
    without it has no folder that all could read, which is an error.
    """
    if spark.conf.get(BATCH_OPTION) == "10000":
        spark.conf.set(BATCH_OPTION, str(BATCH_ROWS))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/paperloom-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: lineage ends here."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes intermediate tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the driver forget finished jobs, so that Spark deletes their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` as bytes, null texts empty; no other column is carried."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
        *more,
    )


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` holds about ``most`` bytes a piece; a long row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_buffers(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column without nulls, and its n + 1 offsets into them."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tidy() -> None:
    """Returns the memory that a process no longer needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(function: Callable) -> Callable:
    """``function`` of batches, after which its worker tidies up.

    Workers outlive tasks and serve one operator after another; what each left behind would add up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            tidy()

    return run


def mapped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(tidied(function), schema)


def groups(batches: Iterator[pa.RecordBatch], key: list[str], least_rows: int = 20_000) -> Iterator[pa.Table]:
    """Joins batches that are sorted by ``key`` into tables that hold whole keys only."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = len(table) - 1
        same = np.ones(len(table), bool)
        for name in key:
            same &= table.column(name).to_numpy() == table.column(name)[last].as_py()
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held = table.combine_chunks().to_batches()
        rows = len(table)
        least_rows = max(least_rows, 2 * rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, with the length at the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), n)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member index of each of ``n`` members' component, by min-label hooking and pointer jumping."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, lengthened until no column of the tables is called so in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def flagged(rows: DataFrame, wanted: DataFrame, key: str, bits: int, how: str) -> tuple[DataFrame, Column]:
    """The rows with two more columns, and whether their ``key`` may be among those of ``wanted``.

    A bit table of 2 ** (bits - 6) rows at most, whatever the input, is broadcast.
    """
    word, held = unused("filter_word", rows), unused("filter_set", rows)
    hashed = F.xxhash64(F.col(key))
    place = f"cast(shiftrightunsigned(xxhash64(`{key}`), {64 - bits}) & 63 AS int)"
    table = wanted.groupBy(F.shiftrightunsigned(hashed, 70 - bits).alias(word)).agg(F.bit_or(F.expr(f"shiftleft(1L, {place})")).alias(held))
    met = rows.withColumn(word, F.shiftrightunsigned(hashed, 70 - bits)).join(F.broadcast(table), word, how)
    return met, F.coalesce(F.expr(f"(shiftrightunsigned({held}, {place}) & 1) = 1"), F.lit(False))


def perhaps(rows: DataFrame, wanted: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``key`` may be among those of ``wanted``, by a bit table of fixed size.

    A full table lets more rows pass and loses none.  A join on the key itself has to follow.
    """
    met, hit = flagged(rows, wanted, key, bits, "inner")
    return met.where(hit).select(*named(rows))


def without(rows: DataFrame, unwanted: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose ``key`` is not among those of ``unwanted``; all their columns.

    Rows that a bit table of fixed size clears are not shuffled; the rest are anti-joined.
    """
    met, hit = flagged(rows, unwanted, key, bits, "left")
    some = met.where(hit).select(*named(rows))
    return met.where(~hit).select(*named(rows)).unionByName(some.join(unwanted.select(key).hint("merge"), key, "left_anti").select(*named(rows)))


def named(rows: DataFrame) -> list[Column]:
    """All columns of a table, by names that may hold dots."""
    return [F.col(f"`{c}`") for c in rows.columns]


def rows_mapped(rows: DataFrame, function: Callable, schema: StructType) -> DataFrame:
    """Whole rows through an Arrow function that keeps all columns of ``schema``, the first of ``rows``.

    ``mapInArrow`` can't take names with dots, so such columns go by other names meanwhile.
    """
    plain = [c if c.isidentifier() else unused(f"column_{i}", rows) for i, c in enumerate(rows.columns)]
    kept = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(plain, schema, strict=False)])
    return rows.toDF(*plain).mapInArrow(tidied(function), kept).toDF(*schema.names)


def one_row(docs: DataFrame) -> DataFrame:
    """Whole rows, of those that repeat a doc_id the one with the smallest text; not shuffled where none does.

    Equal texts go by the other columns as JSON, so columns of any type may be there.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.col("text"), F.to_json(F.struct(*others)) if others else F.lit(""))
    rows = docs.select("doc_id", F.struct(*named(docs)).alias("row"), order.alias("order"))
    rows = rows.groupBy("doc_id").agg(F.min_by("row", "order").alias("row"))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def one_each(docs: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id count as one document, that with the smallest text.

    Most tables have none; then the documents are passed on as they are and not shuffled.
    """
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return docs.select("doc_id", "text")
    return docs.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def joined_lows(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``rows (a, b)`` with the ``m`` that ``low (a, m, n)`` has for ``a``; ``n`` counts the rows of ``a``.

    Nodes with over a 256th of all rows are 256 at most: theirs are broadcast, so that no task
    gets all rows of one of them.
    """
    many = F.col("n") > max(total // 256, 10_000)
    hubs = F.broadcast(low.where(many).select("a", F.col("m").alias("hub")))
    met = rows.join(hubs, "a", "left")
    rest = met.where("hub is null").select("a", "b").join(low.where(~many).select("a", "m"), "a")
    return met.where("hub is not null").select("a", "b", F.col("hub").alias("m")).unionByName(rest)


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Connected components of an undirected edge table ``(a, b)`` of longs.

    Alternates large-star and small-star steps, each a shuffle on a node whose rows are
    summed up map-side first; what a hub's neighbours need to know of it is broadcast, so they
    never meet in one task.  Returns ``(node, component)`` for every node on an edge;
    ``component`` is the smallest node reachable.  Stops when a round changes nothing, which
    takes at most the square of the logarithm of the nodes.
    """
    spark = edges.sparkSession

    def size(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, folder, f"{name}-0")
    state, i = size(now), 0
    while True:
        i += 1
        # Large star: each larger neighbour hooks to the smallest of the node and its neighbours.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = joined_lows(both, low, 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: each smaller neighbour, and the node, hook to the smallest one.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = joined_lows(large, low, state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), folder, f"{name}-{i}")
        drop(spark, folder, f"{name}-{i - 1}")
        before, state = state, size(now)
        if state == before:
            lows = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(lows)


def hexed(column: Column) -> Column:
    return F.lower(F.hex(column))
