"""Substring dedup by level-wise doubling over runs of words.

First level: windows of ``half`` words, half of the length asked for.  A longer window can
only repeat if every shorter one in it does, so one window of the first level speaks for each
long one: its anchor, that with the smallest hash in it.  Anchors that occur once are dropped.
Second level: around the anchors that are left, windows are extended to twice that length, the length asked for; of
equal ones the smallest doc_id is found.  Doubling ends there: each longer repeat is covered
by its windows of this length, so further levels would remove the same words.

Whole copies of an earlier document are told by the digest of their words and go no further.
An anchor with more rows than a task should hold is resolved by sums and joins in which equal
surroundings are one row, and each of their windows another.

Cases: a null text has no words; a window counts where it also starts in a document with a
smaller doc_id, so the first document keeps it, and repeats within one document stay; texts
shorter than a window lose nothing; rows that repeat a doc_id count as one document, that with
the smallest text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, wordhash

WORDS = 13
#: Rows of an anchor that one task compares; anchors with more are dealt out by window.
HOT_ANCHOR = 20_000
SOLID = np.array([b not in b" \t\n\v\f\r" for b in range(256)])


def surveyed(docs: DataFrame, length: int, half: int) -> DataFrame:
    """Each document's number of words, digest of its words, and first-level windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.chunks(batches, most=1 << 20):
            data, offsets = shared.text_buffers(batch.column("text"))
            starts, ends, counts = wordhash.token_spans(data, offsets, SOLID)
            edges = np.concatenate([[0], np.cumsum(counts)])
            owner = first = windows = anchor = np.zeros(0, np.int64)
            if len(starts) >= length:
                word = wordhash.spans(wordhash.prefix_sums(wordhash.BYTES[data]), starts, ends)
                sums = wordhash.prefix_sums(word)
                at = np.arange(len(word) - half + 1)
                hashes = wordhash.spans(sums, at, at + half)
                owner, first, windows, place = wordhash.anchored(hashes, edges, length, half)
                anchor = hashes[place].view(np.int64)
            cuts = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (anchor, (first - edges[owner]).astype(np.int32), windows.astype(np.int32))]
            digests = [hashlib.sha256(b" ".join(t.split())).digest() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(digests, pa.binary()), *lists], ["doc_id", "n_words", "digest", "anchor", "first", "windows"])

    return shared.mapped(shared.texts(docs), run, "doc_id long, n_words long, digest binary, anchor array<long>, first array<int>, windows array<int>")


FOUND = "anchor long, hash long, doc_id long, first int, windows int, bytes binary"


def surroundings(held: DataFrame, length: int) -> DataFrame:
    """The words around each anchor that is left; a task sends equal ones once a window of some.

    ``hash`` tells an anchor's surroundings apart; with the anchor's it has 128 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in shared.chunks(batches, most=1 << 20):
            out: list[list] = [[] for _ in range(6)]
            for doc, text, anchor, first, windows in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "anchor", "first", "windows")), strict=True):
                words = text.split()
                for a, f, w in zip(anchor, first, windows, strict=True):
                    part = b" ".join(words[f : f + w + length - 1])
                    key = (a, xxhash.xxh3_64_intdigest(part) - (1 << 63))
                    new = key not in seen
                    if new:
                        seen.add(key)
                    for column, value in zip(out, (*key, doc, f, w, part if new else None), strict=True):
                        column.append(value)
            if len(seen) > 200_000:
                seen.clear()
            kinds = (*[pa.int64()] * 3, *[pa.int32()] * 2, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", "hash", "doc_id", "first", "windows", "bytes"])

    return shared.mapped(held, run, FOUND)


def resolved(found: DataFrame, length: int) -> DataFrame:
    """``doc_id, starts``: windows that start in a document with a smaller doc_id, a row an anchor.

    An anchor's rows meet in one task; the caller sends those with few rows here alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kinds, rows = None, {}, []
        docs: list[int] = []
        starts: list[list[int]] = []

        def close() -> None:
            low: dict[bytes, int] = {}
            for windows, least in kinds.values():
                for w in windows:
                    if low.setdefault(w, least[0]) > least[0]:
                        low[w] = least[0]
            lows = {h: [low[w] for w in windows] for h, (windows, _) in kinds.items()}
            for h, doc, first in rows:
                gone = [first + i for i, x in enumerate(lows[h]) if x < doc]
                if gone:
                    docs.append(doc)
                    starts.append(gone)
            kinds.clear()
            rows.clear()

        for batch in batches:
            for anchor, h, doc, first, n, part in zip(*(batch.column(c).to_pylist() for c in ("anchor", "hash", "doc_id", "first", "windows", "bytes")), strict=True):
                if anchor != last:
                    close()
                    last = anchor
                rows.append((h, doc, first))
                kind = kinds.get(h)
                if kind is None:  # rows with words come first among equals
                    words = part.split(b" ")
                    kinds[h] = ([b" ".join(words[i : i + length]) for i in range(n)], [doc])
                elif doc < kind[1][0]:
                    kind[1][0] = doc
            if len(docs) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], ["doc_id", "starts"])
                docs, starts = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.list_(pa.int32()))], ["doc_id", "starts"])

    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "hash", F.col("bytes").isNull())
    return shared.mapped(dealt, run, "doc_id long, starts array<int>")


def single_windows(hot: DataFrame, length: int) -> DataFrame:
    """Each window of an anchor with very many rows by itself, once for equal surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.chunks(batches, "bytes", most=1 << 18):
            rows = []
            for a, h, n, d, p in zip(*(batch.column(c).to_pylist() for c in ("anchor", "hash", "windows", "doc_id", "bytes")), strict=True):
                words = p.split(b" ")
                rows += [(a, h, d, i, xxhash.xxh3_128_digest(b" ".join(words[i : i + length]))) for i in range(n)]
            kinds = (*[pa.int64()] * 3, pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["anchor", "hash", "doc_id", "at", "window"])

    return shared.mapped(hot.select("anchor", "hash", "windows", "doc_id", "bytes"), run, "anchor long, hash long, doc_id long, at int, window binary")


def resolved_hot(found: DataFrame, folder: str, length: int) -> DataFrame:
    """As ``resolved`` for anchors of any number of rows: sums and joins that need no group whole."""
    kinds = found.groupBy("anchor", "hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    kinds = shared.written(kinds, folder, "kinds")
    words = found.where("bytes is not null").select("anchor", "hash", "windows", "bytes").dropDuplicates(["anchor", "hash"])
    single = shared.written(single_windows(words.join(kinds.hint("merge"), ["anchor", "hash"]), length), folder, "single")
    lows = single.groupBy("window").agg(F.min("doc_id").alias("low"))
    lone = single.join(lows.hint("merge"), "window").groupBy("anchor", "hash").agg(F.array_sort(F.collect_list(F.struct("at", "low"))).alias("lows"))
    # Surroundings with over a 256th of all rows are 256 at most: broadcast, so that no task gets all rows of one.
    many = F.col("n") > max(found.count() // 256, 1000)
    lone = lone.join(kinds.select("anchor", "hash", "n").hint("merge"), ["anchor", "hash"])
    met = found.select("anchor", "hash", "doc_id", "first").join(F.broadcast(lone.where(many).drop("n")), ["anchor", "hash"], "left")
    rest = met.where("lows is null").drop("lows").join(lone.where(~many).drop("n").hint("merge"), ["anchor", "hash"])
    rows = met.where("lows is not null").unionByName(rest)
    starts = F.filter(F.transform("lows", lambda x: F.when(x["low"] < F.col("doc_id"), F.col("first") + x["at"])), lambda x: x.isNotNull())
    return rows.select("doc_id", starts.alias("starts")).where(F.size("starts") > 0)


def repeats(docs: DataFrame, folder: str, length: int, half: int, hot: int = HOT_ANCHOR) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents' counts and digests; copies of documents; starts of the others' repeated windows.

    A document with all the words of an earlier one, a window at least, loses them all; only the
    first of such goes on.
    """
    spark = docs.sparkSession
    survey = shared.written(surveyed(docs, length, half), folder, "survey")
    counts = shared.written(survey.select("doc_id", "n_words", "digest"), folder, "counts")
    firsts = counts.where(F.col("n_words") >= length).groupBy("digest").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    copies = shared.written(counts.join(firsts.hint("merge"), "digest").where("doc_id > low").select("doc_id"), folder, "copies")
    spots = shared.without(survey.drop("n_words", "digest"), copies, "doc_id")
    spots = spots.select("doc_id", F.explode(F.arrays_zip("anchor", "first", "windows")).alias("s")).select("doc_id", "s.*")
    common = shared.written(spots.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), folder, "common")
    shared.release(spark)
    spots = shared.perhaps(spots, common, "anchor").join(common.hint("merge"), "anchor")

    def found(some: DataFrame) -> DataFrame:
        by_doc = some.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "windows")).alias("spots"))
        by_doc = by_doc.select("doc_id", *[F.col(f"spots.{c}").alias(c) for c in ("anchor", "first", "windows")])
        texts = shared.perhaps(shared.texts(docs), by_doc.select("doc_id"), "doc_id")
        return surroundings(texts.join(by_doc.hint("merge"), "doc_id"), length)

    spots = shared.written(spots, folder, "spots")
    shared.drop(spark, folder, "survey")
    shared.release(spark)
    starts = resolved(found(spots.where(F.col("n") <= hot)), length)
    if not common.where(F.col("n") > hot).isEmpty():
        starts = starts.unionByName(resolved_hot(shared.written(found(spots.where(F.col("n") > hot)), folder, "hot"), folder, length))
    starts = starts.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))
    starts = shared.written(starts, folder, "starts")
    shared.drop(spark, folder, "spots")
    shared.release(spark)
    return counts, copies, starts


def removed(n: int, starts: list[int], length: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.array(starts), 1)
    np.add.at(edge, np.array(starts) + length, -1)
    return np.cumsum(edge[:-1]) > 0


def trimmed(docs: DataFrame, length: int = WORDS, with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, digest`` of every document; digest: of its kept words."""
    docs = shared.one_each(docs)
    folder = shared.work_folder(docs.sparkSession)
    counts, copies, spans = repeats(docs, folder, length, (length + 1) // 2)
    texts = shared.perhaps(shared.texts(docs), spans.select("doc_id"), "doc_id").join(spans.hint("merge"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.chunks(batches):
            gone, kept = [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = text.split()
                out = removed(len(words), starts, length)
                gone.append(int(out.sum()))
                kept.append(b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o]))
            columns = [batch.column("doc_id"), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).digest() for k in kept], pa.binary())]
            columns.append(pa.array(kept if with_text else [None] * len(kept), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_removed", "now", "kept"])

    changed = shared.mapped(texts, run, "doc_id long, n_removed long, now binary, kept binary")
    gone = copies.select("doc_id", F.lit(None).cast("long").alias("n_removed"), F.unhex(F.sha2(F.lit(b""), 256)).alias("now"), F.lit(b"").alias("kept"), F.lit(True).alias("copy"))
    changed = changed.withColumn("copy", F.lit(False)).unionByName(gone)
    found = counts.join(changed.hint("merge"), "doc_id", "left")
    lost = F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    return found.select("doc_id", "n_words", lost.alias("n_removed"), F.coalesce("now", "digest").alias("digest"), *["kept"] * with_text)
