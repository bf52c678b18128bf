"""Quality by importance resampling: two generative models of hashed n-grams, and Gumbel top-k.

The target model counts hashed words and word pairs of the target texts, the raw model those
of all texts; both counts cover every document.  The raw model is smoothed by one, the target
model by the raw one.  A document's weight
is the log ratio of its likelihoods.  Adding Gumbel noise and taking the k largest samples k
documents without replacement in proportion to their weights.  The k-th largest key is found
by radix selection, 16 bits a pass, so nothing is sorted in one place.

Cases: a null or empty text has weight 0 and its noise alone; rows that repeat a doc_id get the
same noise and are all rows of their own; ties at the k-th key go to the smallest doc_id and
then to whichever row; k of 0 keeps none, and k beyond the rows keeps all; an empty table gives
an empty result; without target texts every weight is 0; columns besides
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, wordhash

BITS = 16
#: Raw tokens that the target model starts from.
PRIOR = 2000.0
#: 1: letters, digits and bytes of other alphabets; 2: signs; 0: white space.
KIND = np.array([0 if b <= 32 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
LOWERED = wordhash.BYTES[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]


def grams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each token and each pair of neighbours, repeats included."""
    starts, ends, counts = wordhash.class_spans(data, offsets, KIND)
    token = wordhash.spans(wordhash.prefix_sums(LOWERED[data]), starts, ends)
    owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
    same = owner[1:] == owner[:-1]
    pair = wordhash.mix(token[:-1][same] * np.uint64(0x9E3779B97F4A7C15) + token[1:][same])
    return np.concatenate([owner, owner[1:][same]]), (np.concatenate([token, pair]) >> np.uint64(64 - bits)).astype(np.int64)


def bucket_counts(docs: DataFrame, bits: int) -> np.ndarray:
    """How often each bucket occurs in all texts; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for part in shared.chunks(batches, most=1 << 20):
            _, bucket = grams(*shared.text_buffers(part.column("text")), bits)
            total += np.bincount(bucket, minlength=1 << bits)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    sums = shared.mapped(docs, run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log of target over raw probability of each bucket.

    The target model starts from the raw one, as if ``prior`` tokens of it had been seen, so few
    target texts give ratios near one and not near the share of empty buckets.
    """
    base = (raw + 1) / (raw.sum() + len(raw))
    return np.log((target + prior * base) / (target.sum() + prior)) - np.log(base)


def ordered(values: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles."""
    bits = values.view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def keyed(docs: DataFrame, ratio: np.ndarray, bits: int, seed: int) -> DataFrame:
    """``doc_id, log_weight, gumbel_key`` and ``rank_key``, an integer in the order of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.chunks(batches, most=1 << 20):
            owner, bucket = grams(*shared.text_buffers(part.column("text")), bits)
            weight = np.bincount(owner, ratio[bucket], part.num_rows)
            drawn = wordhash.mix(part.column("doc_id").to_numpy().astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
            uniform = ((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            key = weight - np.log(-np.log(uniform))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight), pa.array(key), pa.array(ordered(key))], ["doc_id", "log_weight", "gumbel_key", "rank_key"])

    return shared.mapped(shared.texts(docs), run, "doc_id long, log_weight double, gumbel_key double, rank_key long")


def kth_largest(rows: DataFrame, k: int) -> tuple[int, int, int]:
    """The k-th largest ``rank_key``, how many of its rows belong to the k, and how many there are."""
    lifted = F.col("rank_key").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order
    known, left, held = 0, k, 0
    for step in range(4):
        shift = 48 - 16 * step
        digit = F.shiftrightunsigned(lifted, shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
        among = rows if not step else rows.where(F.shiftrightunsigned(lifted, shift + 16) == known)
        for row in sorted(among.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["d"]):
            if row["n"] >= left:
                known, held = (known << 16) | row["d"], row["n"]
                break
            left -= row["n"]
    return known - (1 << 63), left, held


def resampled(docs: DataFrame, target_ids: DataFrame, fraction: float, bits: int = BITS, seed: int = 1) -> DataFrame:
    """``doc_id, log_weight, gumbel_key, kept`` of every row; ``fraction`` of the rows are kept.

    ``target_ids`` has the doc_id of the target texts.
    """
    folder = shared.work_folder(docs.sparkSession)
    texts = shared.texts(docs)
    wanted = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    target = bucket_counts(shared.perhaps(texts, wanted, "doc_id").join(wanted.hint("merge"), "doc_id").select("doc_id", "text"), bits)
    rows = shared.written(keyed(docs, log_ratio(target, bucket_counts(texts, bits)), bits, seed), folder, "keys")
    k = round(fraction * rows.count())
    if k <= 0:
        return rows.select("doc_id", "log_weight", "gumbel_key", F.lit(False).alias("kept"))
    least, ties, held = kth_largest(rows, k)
    if ties < held:  # equal keys are repeated rows of a doc_id
        order = F.row_number().over(Window.partitionBy("rank_key").orderBy("doc_id"))
        marked = rows.where(F.col("rank_key") == least).withColumn("kept", order <= ties)
        rows = rows.where(F.col("rank_key") != least).withColumn("kept", F.col("rank_key") > least).unionByName(marked)
    else:
        rows = rows.withColumn("kept", F.col("rank_key") >= least)
    return rows.select("doc_id", "log_weight", "gumbel_key", "kept")
