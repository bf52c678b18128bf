"""Exact dedup over an extendible-hash index on shared files.

Building: each task collapses the equal texts it reads itself (by their bytes) and writes
one entry for each of its distinct texts.  A directory of bucket prefixes is grown from
entry counts: an overfull bucket splits, doubling the directory where its depth is that of
the directory, until buckets fit or hold a single key.  Probing: an owner task reads whole
buckets, walks each key's collision chain and compares bytes.

Cases: a null text counts as empty, very long texts are compared whole, and empty texts are equal to one another; texts are
equal when they are after each run of ASCII white space became one space; ties go to the
smallest doc_id; repeated rows of one doc_id count each in group_size; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Entries of a bucket before it splits.
BUCKET_ENTRIES = 50_000
#: Bytes of texts that a task holds to collapse copies it reads itself.
WINDOW_BYTES = 16 << 20
#: Times that a pass doubles a directory which is too shallow.
PASS_BITS = 10
SPACE = frozenset(b" \t\n\v\f\r")


def normalised(text: bytes) -> bytes:
    """Each run of ASCII white space as one space."""
    inner = b" ".join(text.split())
    if not text:
        return inner
    if not inner:
        return b" "
    return b" " * (text[0] in SPACE) + inner + b" " * (text[-1] in SPACE)


def heap(docs: DataFrame) -> DataFrame:
    """Each document with its text's key and digest, and the entry that stands for it.

    A task gives equal texts that it reads one entry, within a window of some texts held in
    memory, so a text that holds a third of all rows makes an entry a window, not one a row.
    Only the row that opens an entry carries the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window: dict[bytes, int] = {}
        held = made = 0
        task = TaskContext.get().partitionId() << 32
        for batch in shared.chunks(batches):
            keys, entries, digests, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                text = normalised(text)
                entry = window.get(text)
                new = entry is None
                if new:
                    if held > WINDOW_BYTES:
                        window, held = {}, 0
                    entry = window[text] = task + made
                    made += 1
                    held += len(text) + 200
                entries.append(entry)
                keys.append(xxhash.xxh64_intdigest(text))
                digests.append(hashlib.sha256(text).digest())
                kept.append(text if new else None)
            columns = [batch.column("doc_id"), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(entries, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "entry", "digest", "text"])

    return shared.mapped(shared.texts(docs), run, "doc_id long, key long, entry long, digest binary, text binary")


def prefix(depth: int) -> Column:
    """The leading ``depth`` bits of the key."""
    return F.shiftrightunsigned(F.col("key"), 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = BUCKET_ENTRIES) -> list[tuple[int, int]]:
    """The directory's buckets in order, as (prefix, depth).

    The first pass counts entries by as many bits as even keys need; a directory that is still
    too shallow is doubled ``PASS_BITS`` times at once, and the entries of its overfull buckets
    alone are counted again.  It holds some numbers for each ``capacity`` entries, never a key
    or a document.  A bucket of one key alone is left as a collision chain.
    """
    total = entries.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total / capacity)))) + 2)
    fixed, overfull, among, before = [], [(0, 0)], entries, 0
    while overfull:
        if before:
            table = entries.sparkSession.createDataFrame([(p,) for p, _ in overfull], "p long")
            among = entries.withColumn("p", prefix(before)).join(F.broadcast(table), "p")
        seen = among.groupBy(prefix(depth).alias("p")).agg(F.count("*").alias("n"), (F.min("key") == F.max("key")).alias("sole")).orderBy("p").toArrow()
        leaf, sole = seen.column("p").to_numpy(), seen.column("sole").to_numpy()
        upto = np.concatenate([[0], np.cumsum(seen.column("n").to_numpy())])
        todo, overfull = overfull, []
        while todo:
            p, d = todo.pop()
            low, high = np.searchsorted(leaf, [p << (depth - d), (p + 1) << (depth - d)]).tolist()
            if upto[high] - upto[low] <= capacity or (high - low == 1 and sole[low]):
                fixed.append((p, d))
            elif d == depth:
                overfull.append((p, d))
            else:
                todo += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        before, depth = depth, min(depth + PASS_BITS, 63)
        if before == depth:
            fixed += overfull
            break
    return sorted(fixed, key=lambda b: b[0] << (64 - b[1]))


def index(entries: DataFrame, folder: str, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """Writes the entries below the shared folder, bucket by bucket in files of whole ranges, and returns them."""
    starts = np.array([p << (64 - d) for p, d in directory(entries, capacity)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = np.searchsorted(starts, batch.column("key").to_numpy().view(np.uint64), side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket.astype(np.int32))], [*batch.schema.names, "bucket"])

    placed = shared.mapped(entries, run, "key long, entry long, doc_id long, n long, bucket int")
    return shared.written(placed.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), folder, "index")


def chains(crowded: DataFrame) -> DataFrame:
    """Walks each key's chain: every entry with the first entry of the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, chain = None, []
        for batch in shared.chunks(batches):
            firsts = []
            for k, entry, text in zip(*(batch.column(c).to_pylist() for c in ("key", "entry", "text")), strict=True):
                if k != key:
                    key, chain = k, []
                first = next((e for t, e in chain if t == text), None)
                if first is None:
                    chain.append((text, first := entry))
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(firsts, pa.int64())], ["entry", "first"])

    owners = crowded.select("key", "entry", "text").repartitionByRange("key").sortWithinPartitions("key", "entry")
    return shared.mapped(owners, run, "entry long, first long")


def duplicates(docs: DataFrame, capacity: int = BUCKET_ENTRIES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for every document.

    Of equal texts the row with the smallest doc_id stays.
    """
    folder = shared.work_folder(docs.sparkSession)
    rows = shared.written(heap(docs), folder, "heap")
    entries = rows.groupBy("entry").agg(F.first("key").alias("key"), F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    entries = shared.written(entries.select("key", "entry", "doc_id", "n"), folder, "entries")
    placed = index(entries, folder, capacity)
    shared.drop(docs.sparkSession, folder, "entries")
    busy = placed.groupBy("bucket", "key").agg(F.count("*").alias("held")).where("held > 1")
    crowded = shared.written(placed.join(busy, ["bucket", "key"]).select("key", "entry"), folder, "crowded")
    opened = shared.perhaps(rows.where("text is not null").select("entry", "key", "text"), crowded, "key")
    same = shared.written(chains(opened.drop("key").join(crowded.hint("merge"), "entry")), folder, "chains")
    classed = placed.join(same, "entry", "left").select("entry", "doc_id", "n", F.coalesce("first", "entry").alias("first"))
    sizes = classed.groupBy("first").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    found = classed.select("entry", "first").join(sizes, "first").select("entry", "keep_id", "group_size")
    return rows.select("doc_id", "entry", "digest").join(found, "entry").select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "digest")
