"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training takes a bounded sample of labelled documents, ``positives`` and ``negatives`` rows
at most, chosen by a hash of doc_id; scores stand for the classes as they are among all
labelled documents, whatever share of each class the sample took.  Each coordinate has its own rate, and L1 leaves few
weights above zero; those alone are broadcast.  Scoring reads every whole text.

Cases: a null or empty text scores the bias; words are runs of letters, digits and bytes of
other alphabets, in lower case; a feature counts once a text however often it occurs; labels
that are null are skipped and of repeated labels of a doc_id the larger counts; without any
label every score is 0.5; an empty table gives an empty result; columns besides doc_id and
text never matter to a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, wordhash

#: Bytes of words: ASCII letters and digits, and all of other alphabets.
INSIDE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
LOWERED = wordhash.BYTES[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]


@dataclass(frozen=True)
class Model:
    """The weights that are not zero, of 2 ** bits hashed features."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature of each word, pair of neighbours and pair with one word between."""
    starts, ends, counts = wordhash.token_spans(data, offsets, INSIDE)
    word = wordhash.spans(wordhash.prefix_sums(LOWERED[data]), starts, ends)
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    owners, found = [owner], [word]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = owner[gap:] == owner[:-gap]
        owners.append(owner[gap:][same])
        found.append(wordhash.mix(word[:-gap][same] * np.uint64(salt) + word[gap:][same]))
    return np.concatenate(owners), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def labelled(labels: DataFrame, label: str, learnable: Column) -> DataFrame:
    return labels.where(learnable & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))


def sampled(rows: DataFrame, positives: int, negatives: int) -> DataFrame:
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return rows.where("y > 0").orderBy(*order).limit(positives).union(rows.where("y <= 0").orderBy(*order).limit(negatives))


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    learnable: Column | None = None,
    positives: int = 4000,
    negatives: int = 8000,
    bits: int = 20,
    epochs: int = 8,
    batch: int = 32,
    alpha: float = 3.0,
    beta: float = 1.0,
    l1: float = 10.0,
    l2: float = 1.0,
    most_features: int = 50_000_000,
) -> Model:
    """Learns from the sample in mini-batches; ``alpha`` and ``beta`` set the rate of a coordinate.

    The sample has ``positives`` and ``negatives`` rows at most, and, should its texts be very
    long, those first in an order of hashes that hold ``most_features`` features.
    """
    rows = labelled(labels, label, F.lit(True) if learnable is None else learnable)
    chosen = sampled(rows, positives, negatives)
    bad, fine = rows.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).head()
    # A class that its bound cuts is rarer in the sample than it is; the bias makes up for that.
    shift = float(np.log(max(fine, negatives) / negatives) - np.log(max(bad, positives) / positives))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.chunks(batches):
            data, offsets = shared.text_buffers(part.column("text"))
            owner, feature = features(data, offsets, bits)
            pairs = np.unique((owner << bits) + feature)
            cuts = np.searchsorted(pairs >> bits, np.arange(part.num_rows + 1))
            held = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((pairs & ((1 << bits) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), held], ["doc_id", "y", "features"])

    # The sample is bounded by its two parameters, so it may be broadcast and learnt in one place.
    few = shared.texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "y")
    folder = shared.work_folder(docs.sparkSession)
    few = shared.written(shared.mapped(few, run, "doc_id long, y int, features array<int>"), folder, "sample")
    # A coordinate moves by less than one each time it is seen, so one that is seen in too few rows
    # never passes l1 and its weight is zero whatever else happens: such features are left out.
    seen = few.select(F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))
    useful = np.zeros(1 << bits, bool)
    useful[seen.where(F.col("n") * epochs > l1).select("feature").toArrow().column("feature").to_numpy()] = True

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            held = part.column("features")
            flat, rows = held.flatten(), pc.list_parent_indices(held).to_numpy()
            kept = useful[flat.to_numpy()]
            cuts = np.searchsorted(rows[kept], np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.ListArray.from_arrays(pa.array(cuts), flat.filter(pa.array(kept)))], ["doc_id", "y", "features"])

    few = shared.mapped(few, thinned, "doc_id long, y int, features array<int>")
    sizes = few.select("doc_id", "y", F.size("features").alias("n"), F.xxhash64("doc_id").alias("place")).toArrow().sort_by("place")
    fits = np.cumsum(sizes.column("n").to_numpy()) <= most_features
    if not fits.all():
        had, left = (np.bincount(sizes.column("y").to_numpy()[rows], minlength=2) for rows in (slice(None), fits))
        shift += float(np.log((had[0] + 1) / (left[0] + 1)) - np.log((had[1] + 1) / (left[1] + 1)))
        kept = docs.sparkSession.createDataFrame([(i,) for i in sorted(set(sizes.column("doc_id").to_numpy()[fits].tolist()))], "doc_id long")
        few = few.join(F.broadcast(kept), "doc_id", "left_semi")
    table = few.toArrow()
    shared.drop(docs.sparkSession, folder, "sample")
    shared.tidy()
    y = table.column("y").to_numpy().astype(np.float64)
    rank = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    size = pc.list_value_length(table.column("features")).to_numpy()
    flat = table.column("features").combine_chunks().flatten().to_numpy()
    del table
    if not len(y):
        return Model(bits, np.zeros(0, np.int64), np.zeros(0), 0.0)
    first = np.cumsum(size, dtype=np.int64) - size
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, bias_n = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0

    def weights(i: np.ndarray | slice) -> np.ndarray:
        small = np.abs(z[i]) <= l1
        return np.where(small, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    random = np.random.default_rng(7)
    for _ in range(epochs):
        order = rank[random.permutation(len(y))]
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            held = size[rows]
            place = np.repeat(np.arange(len(rows)), held)
            here = flat[np.arange(held.sum()) + np.repeat(first[rows] - np.cumsum(held) + held, held)]
            used, where = np.unique(here, return_inverse=True)
            w = weights(used)
            score = bias + np.bincount(place, w[where], len(rows))
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]
            g = np.bincount(where, error[place], len(used))
            g2 = np.bincount(where, error[place] ** 2, len(used))
            z[used] += g - (np.sqrt(n[used] + g2) - np.sqrt(n[used])) / alpha * w
            n[used] += g2
            bias_n += float((error**2).sum())
            bias -= alpha / (beta + np.sqrt(bias_n)) * float(error.sum())
    w = weights(slice(None))
    kept = np.flatnonzero(w)
    del flat, z, n
    shared.tidy()
    return Model(bits, kept, w[kept], bias - shift)


def scored_chunk(part: pa.RecordBatch, column: str, model: Model, table: np.ndarray) -> np.ndarray:
    data, offsets = shared.text_buffers(part.column(column))
    owner, feature = features(data, offsets, model.bits)
    used = table[feature] != 0
    pairs = np.unique((owner[used] << model.bits) + feature[used])
    total = np.bincount(pairs >> model.bits, table[pairs & ((1 << model.bits) - 1)], part.num_rows)
    return 1 / (1 + np.exp(-np.clip(model.bias + total, -30, 30)))


def dense(model: Model) -> np.ndarray:
    table = np.zeros(1 << model.bits)
    table[model.index] = model.weight
    return table


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dense(model)
        for part in shared.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scored_chunk(part, "text", model, table))], ["doc_id", "score"])

    return shared.mapped(shared.texts(docs), run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dense(model)
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            whole = pa.RecordBatch.from_arrays([text.cast(pa.binary()), pa.array(np.arange(batch.num_rows))], ["text", "row"])
            for part in shared.chunks(iter([whole])):
                first = part.column("row")[0].as_py()
                yield batch.slice(first, part.num_rows).filter(pa.array(scored_chunk(part, "text", model, table) < threshold))

    return shared.rows_mapped(docs, run, docs.schema)
