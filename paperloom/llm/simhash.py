"""SimHash near-dedup: fingerprints, a pigeonhole block join and exact Hamming distances.

A fingerprint is cut into ``blocks`` pieces.  Two fingerprints within ``bits`` differing
bits agree on at least ``blocks - bits`` pieces whole, so they meet under the key of one
choice of that many pieces; candidates of a key are verified by Hamming distance.  Wide
fingerprints only tell candidates; links are then told by the shingle sets themselves.

Cases: a null text counts as empty; a text without words has fingerprint zero and links
like any other; fewer words than a shingle give one shingle of them all; equal
fingerprints are one node however many rows share them, so copies cost one row; an empty
table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .wordhash import mix

#: Lane k of entry b is bit k of byte b.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64).ravel()
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: Keys of a wide fingerprint's set, and minima in each.  Sets of likeness 0.8 share none of the
#: keys 3 times in a million: (1 - 0.8 ** 5) ** 32.
BANDS, ROWS = 32, 5
FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)

#: Shingles of one candidate group that a task takes as a part; a tile holds two parts.
SET_PART = 1 << 20

#: A key with more distinct fingerprints than this is dealt out in tiles of pairs of parts.
HOT_KEY = 2048


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of each run of ``words`` words, repeats included."""
    found = text.translate(LOWER).split()
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends[: len(found) - words].tolist()]
    return [digest(line[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def shingle_set(text: bytes, words: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.array(shingle_hashes(text, words, seed), np.uint64))


def digest_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes())


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint for each run of ``counts`` hashes: bits set in over half of a run."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[some]
    sizes = counts[some]
    pieces = -(-sizes // 255)  # byte lanes hold sums up to 255
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    at = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    lanes = LANES[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, at, axis=0).view(np.uint8).reshape(-1, 64)
    sums = np.add.reduceat(sums.astype(np.int64), first, axis=0)
    bits = 2 * sums > sizes[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id`` and the fingerprint, a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.chunks(batches):
            found = [np.array(shingle_hashes(text, words, seed), np.uint64) for text in batch.column("text").to_pylist()]
            prints = majority(np.concatenate(found), np.array([len(f) for f in found], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return shared.mapped(shared.texts(docs), run, "doc_id long, fp long")


def wide_fingerprints(docs: DataFrame, words: int, seed: int, width: int) -> DataFrame:
    """``doc_id``, a fingerprint of ``8 * width`` bytes, the shingle set's digest and its keys.

    Further words of a fingerprint come of the same shingle hashes, mixed anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.chunks(batches):
            sets = [shingle_set(text, words, seed) for text in batch.column("text").to_pylist()]
            hashed, counts = np.concatenate(sets), np.array([len(s) for s in sets], np.int64)
            prints = np.stack([majority(hashed if not k else mix(hashed + np.uint64(k)), counts) for k in range(width)], axis=1)
            keys = minima_keys(hashed, counts)
            cuts = np.append(0, np.cumsum(np.where(counts > 0, BANDS, 0))).astype(np.int32)
            columns = [
                batch.column("doc_id"),
                pa.array([row.tobytes() for row in prints], pa.binary()),
                pa.array(np.array([digest_of(s) for s in sets], np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[counts > 0].ravel().view(np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "digest", "keys"])

    return shared.mapped(shared.texts(docs), run, "doc_id long, fp binary, digest long, keys array<long>")


def block_keys(fp: Column, bits: int, blocks: int) -> Column:
    """An array of one key for each choice of ``blocks - bits`` pieces."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    piece = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(edges, edges[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(i), *[piece[k] for k in chosen]) for i, chosen in enumerate(combinations(range(blocks), blocks - bits))])


def minima_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS keys for each run of ``counts`` hashes, each made of ROWS minima; none of an empty run counts.

    The minimum under a random order is the same in two sets as often as their Jaccard likeness.
    """
    out = np.zeros((len(counts), BANDS), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[some]
        for k, factor in enumerate(FACTORS):
            band = k // ROWS
            least = np.minimum.reduceat(hashes * factor, starts)
            out[some, band] = mix(out[some, band] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(band))
    return out


def close_pairs(prints: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``bits`` bits inside runs that begin at ``starts``; memory stays bounded by tiles.

    ``prints`` has a row of 64-bit words for each fingerprint.
    """
    left, right = [], []
    sizes = np.diff(starts)
    small = sizes <= 64
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(small[owner]) if len(owner) else np.zeros(0, np.int64)
    ends = starts[1:][owner]
    step = 1
    while len(at):
        at = at[at + step < ends[at]]
        near = np.bitwise_count(prints[at] ^ prints[at + step]).sum(axis=1, dtype=np.int32) <= bits
        left.append(at[near])
        right.append(at[near] + step)
        step += 1
    for k in np.flatnonzero(~small):
        own = prints[starts[k] : starts[k + 1]]
        for i in range(0, len(own), 256):
            apart = np.zeros((len(own[i : i + 256]), len(own) - i), np.int16)
            for word in own.T:
                apart += np.bitwise_count(word[i : i + 256, None] ^ word[None, i:])
            a, b = np.nonzero(apart <= bits)
            ahead = b > a
            left.append(a[ahead] + i + starts[k])
            right.append(b[ahead] + i + starts[k])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(nodes: DataFrame, keys: Column, bits: int, hot: int = HOT_KEY) -> DataFrame:
    """Edges ``(a, b)`` that connect whatever nodes ``(node, fp)`` lie within ``bits`` bits.

    A task emits a spanning forest of its key's links, not the pairs.  Fingerprints must
    be distinct.  A key with more than ``hot`` of them is cut into s parts and dealt out
    as tiles of two parts, so a task holds two parts at most.
    """
    keyed = nodes.select("node", "fp", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / hot).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        keyed.join(sizes, "key")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .select("node", "fp", "key", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.least(p, F.col("own")) * F.col("parts") + F.greatest(p, F.col("own"))))).alias("tile"))
        .withColumn("tile", F.xxhash64("key", "tile"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shared.groups(batches, ["tile"]):
            tile, ids = (table.column(c).to_numpy() for c in ("tile", "node"))
            prints = table.column("fp").combine_chunks()
            if pa.types.is_binary(prints.type):
                words = shared.text_buffers(prints)[0].view(np.uint64).reshape(len(ids), -1)
            else:
                words = prints.to_numpy().view(np.uint64)[:, None]
            left, right = close_pairs(words, shared.runs(tile), bits)
            label = shared.forest(len(ids), left, right)
            other = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[label[other]]), pa.array(ids[other])], ["a", "b"])

    return shared.mapped(dealt.select("tile", "fp", "node").repartition("tile").sortWithinPartitions("tile"), run, "a long, b long")


def alike(hashes: np.ndarray, offsets: np.ndarray, likeness: float) -> np.ndarray:
    """Each set's component under links of Jaccard ``likeness`` or more; ``hashes`` of a set are distinct and in order.

    A set is compared with all sets outside its component.  Once those outside the largest
    component have been, every pair is either compared or in one component.
    """
    sizes = np.diff(offsets)
    label = np.arange(len(sizes))
    open_ = np.ones(len(sizes), bool)
    while True:
        largest = np.bincount(label).argmax()
        outside = np.flatnonzero(open_ & (label != largest))
        if not len(outside):
            return label
        i = outside[0]
        open_[i] = False
        fits = np.minimum(sizes, sizes[i]) >= likeness * np.maximum(sizes, sizes[i]) - 1e-9
        others = np.flatnonzero((label != label[i]) & fits & (sizes > 0))
        if not len(others):
            continue
        own = hashes[offsets[i] : offsets[i + 1]]
        taken = hashes if len(others) == len(sizes) else np.concatenate([hashes[offsets[j] : offsets[j + 1]] for j in others])
        at = np.minimum(np.searchsorted(own, taken), len(own) - 1)
        starts = np.cumsum(sizes[others]) - sizes[others]
        common = np.add.reduceat((own[at] == taken).astype(np.int64), starts)
        near = others[common >= likeness * (sizes[i] + sizes[others] - common) - 1e-9]
        if len(near):
            joined = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, joined)] = joined[0]


def alike_links(members: DataFrame, likeness: float, part: int = SET_PART) -> DataFrame:
    """Edges ``(a, b)`` that connect whatever ``(node, group, shingles)`` of one group are alike.

    A group of more than ``part`` shingles is dealt out as ``links`` deals out a hot key.
    """
    sizes = members.groupBy("group").agg(F.ceil(F.sum(F.length("shingles")) / (8 * part)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.least(p, F.col("own")) * F.col("parts") + F.greatest(p, F.col("own")))
    dealt = members.join(sizes.where("parts > 0"), "group").withColumn("own", own).select("node", "shingles", "group", F.explode(each).alias("tile"))
    dealt = dealt.select(F.xxhash64("group", "tile").alias("tile"), "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shared.groups(batches, ["tile"], 1):
            ids = table.column("node").to_numpy()
            data, offsets = shared.text_buffers(table.column("shingles").combine_chunks())
            starts = shared.runs(table.column("tile").to_numpy())
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                here = offsets[a : b + 1] // 8
                label = alike(np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), np.uint64), here - here[0], likeness)
                other = np.flatnonzero(label != np.arange(b - a))
                if len(other):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + label[other]]), pa.array(ids[a + other])], ["a", "b"])

    return shared.mapped(dealt.repartition("tile").sortWithinPartitions("tile"), run, "a long, b long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, seed: int) -> DataFrame:
    """``node, group, shingles`` of ``wanted (node, digest, group)``; a set is the 8-byte hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.chunks(batches):
            sets = [shingle_set(text, words, seed) for text in batch.column("text").to_pylist()]
            # Of rows that repeat a doc_id only those with the node's own set stand for it.
            mine = np.array([digest_of(s) for s in sets], np.uint64).view(np.int64) == batch.column("digest").to_numpy()
            column = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("group"), column], ["node", "group", "shingles"]).filter(pa.array(mine))

    keyed = wanted.withColumnRenamed("node", "doc_id")
    rows = shared.perhaps(shared.texts(docs), keyed, "doc_id").join(keyed, "doc_id")
    return shared.mapped(rows.select("doc_id", "text", "digest", "group"), run, "node long, group long, shingles binary")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, blocks: int = 5, seed: int = 42, width: int = 1, likeness: float = 0.8) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id that links lead to, itself included.

    With 64-bit fingerprints every pair within ``bits`` bits meets (see ``block_keys``).  A
    wide one is for looser likeness, and there a link is a pair of shingle sets of Jaccard
    ``likeness`` or more: sets meet under keys of minima (see ``minima_keys``), those within
    ``bits`` bits form candidate groups, and a group's sets are compared whole.  Two sets of
    Jaccard likeness j differ in about acos(2j / (1 + j)) / pi of their bits, fewer where
    their sizes differ; ``bits`` has to leave room above that.
    """
    folder = shared.work_folder(docs.sparkSession)
    if width == 1:
        prints = shared.written(fingerprints(docs, words, seed), folder, "prints")
        nodes = shared.written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), folder, "nodes")
        found = shared.components(links(nodes, block_keys(F.col("fp"), bits, blocks), bits), folder, "components")
        labelled = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
        return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")
    prints = shared.written(wide_fingerprints(docs, words, seed, width), folder, "prints")
    nodes = prints.groupBy("digest", "fp").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"))
    nodes = shared.written(nodes, folder, "nodes")
    groups = shared.components(links(nodes, F.col("keys"), bits), folder, "groups")
    wanted = shared.written(nodes.select("node", "digest").join(groups.withColumnRenamed("component", "group"), "node"), folder, "wanted")
    members = shared.written(shingle_sets(docs, wanted, words, seed), folder, "sets")
    found = shared.components(alike_links(members, likeness), folder, "components")
    labelled = nodes.join(found, "node", "left").select("digest", "fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(labelled, ["digest", "fp"]).select("doc_id", "fp", "component_id")
