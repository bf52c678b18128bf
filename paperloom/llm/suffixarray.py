"""Suffix arrays by linear grouping, and removal of repeated byte strings with them.

``suffix_array`` sorts suffixes in two phases.  First suffixes are grouped by the Lyndon word
that each starts with: groups are taken in descending order, and each suffix of a group hands
the group's word to its previous smaller suffix, which moves to a group of its own kind; equal
words need no new names, as a group is known by where it starts.  Then the suffixes of each
group are emitted in order, by one ascending pass along the same pointers.

Repeats over a corpus.  Whether a string of ``length`` bytes starts anywhere else needs no
sorting of the whole corpus in one place.  Every such window has one anchor, the window's
``gram`` bytes with the smallest hash (the leftmost of equals), which depends on its bytes
only; equal windows thus share their anchor's bytes and meet in that anchor's group.  A group
with different surroundings of its anchor is sorted by suffix array, each cut to what another
one shares with it; surroundings that occur twice as a whole are repeats as a whole.
A group with very many different surroundings is dealt out by window instead.

Cases: a null text counts as empty; matches never cross documents; texts shorter than
``length`` lose nothing; overlaps count, and repeats inside one document do; rows that repeat a
doc_id count as one document, that with the smallest text; an empty table gives an empty result; columns besides doc_id and text are ignored.
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

LENGTH = 200
GRAM = 48
#: Different surroundings of an anchor that one task sorts; more are dealt out by window.
HOT_ANCHOR = 20_000
#: Documents rewritten at once.
ROWS_AT_ONCE = 250
#: Bytes that one suffix array covers.
SORT_BYTES = 1 << 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an integer array in ascending order."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(first, np.diff(np.append(first, n)))
    position = np.empty(n, np.int64)
    position[order] = np.arange(n)
    suffix, place, group = order.tolist(), position.tolist(), group_of.tolist()
    size = [0] * n
    for start, length in zip(first.tolist(), np.diff(np.append(first, n)).tolist(), strict=True):
        size[start] = length
    smaller = [-1] * n

    # Phase 1: groups in descending order.  ``smaller[s]`` is the nearest suffix to the left
    # whose group is below that of s.
    end = n
    while end > 0:
        start = group[suffix[end - 1]]
        if end - start == 1:
            s = suffix[start]
            p = s - 1
            while p >= 0 and group[p] > start:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                # p alone leaves its group for a group right above what stays.
                below = group[p]
                count = size[below]
                if count > 1:
                    to = below + count - 1
                    at = place[p]
                    q = suffix[to]
                    suffix[at], suffix[to] = q, p
                    place[q], place[p] = at, to
                    size[below] = count - 1
                    size[to] = 1
                    group[p] = to
        else:
            found: dict[int, int] = {}
            for s in sorted(suffix[start:end]):
                p = s - 1
                while p >= 0 and group[p] > start:
                    p = smaller[p]
                if p >= 0 and group[p] == start:
                    p = smaller[p]
                smaller[s] = p
                if p >= 0:
                    found[p] = found.get(p, 0) + 1
            moved: dict[int, list[int]] = {}
            for p in found:
                moved.setdefault(group[p], []).append(p)
            for below, those in moved.items():
                count = size[below]
                if count == 1:
                    continue
                # The more copies of the word follow, the higher the new group.
                levels: dict[int, list[int]] = {}
                for p in those:
                    levels.setdefault(found[p], []).append(p)
                top = below + count
                for copies in sorted(levels, reverse=True):
                    members = levels[copies]
                    fresh = top - len(members)
                    for p in members:
                        top -= 1
                        at = place[p]
                        q = suffix[top]
                        suffix[at], suffix[top] = q, p
                        place[q], place[p] = at, top
                        group[p] = fresh
                    size[fresh] = len(members)
                if top > below:
                    size[below] = top - below
        end = start

    # Phase 2: a suffix whose next smaller suffix is emitted is emitted in its group's next place.
    slot = list(range(n))
    done = bytearray(n)
    out = [-1] * n
    for s in smallest_chain(smaller, n - 1):
        done[s] = 1
        g = group[s]
        out[slot[g]] = s
        slot[g] += 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            done[s] = 1
            g = group[s]
            out[slot[g]] = s
            slot[g] += 1
            s = smaller[s]
    return np.array(out)


def smallest_chain(smaller: list[int], last: int) -> Iterator[int]:
    """The suffixes whose next smaller suffix is the empty one behind the text."""
    while last >= 0:
        yield last
        last = smaller[last]


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first start in ``data``, windows, the anchor's place after that start, its hash."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 5
    sums = wordhash.prefix_sums(wordhash.BYTES[data])
    count = len(data) - gram + 1
    hashes = wordhash.mix((sums[gram:] - sums[:count]) * wordhash.powers(wordhash.inverse(wordhash.BASES[0]), count))
    owner, first, windows, at = wordhash.anchored(hashes, offsets, length, gram)
    return owner, first, windows, at - first, hashes[at].view(np.int64)


def surveyed(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Each document's size and digest, and its anchors with their first window and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.chunks(batches, most=1 << 20):
            data, offsets = shared.text_buffers(batch.column("text"))
            owner, first, windows, ahead, anchor = anchors(data, offsets, length, gram)
            cuts = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (anchor, (first - offsets[owner]).astype(np.int32), windows.astype(np.int32), ahead.astype(np.int32))]
            digests = [hashlib.sha256(memoryview(data[a:b])).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()), *lists], ["doc_id", "n_bytes", "digest", "anchor", "first", "windows", "ahead"])

    return shared.mapped(shared.texts(docs), run, "doc_id long, n_bytes long, digest binary, anchor array<long>, first array<int>, windows array<int>, ahead array<int>")


def surroundings(held: DataFrame, length: int) -> DataFrame:
    """Cuts out the bytes around each repeated anchor; a task sends equal ones once a window of some."""
    schema = "anchor long, hash1 long, hash2 long, doc_id long, first int, windows int, ahead int, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in shared.chunks(batches, most=1 << 20):
            out: list[list] = [[] for _ in range(8)]
            for doc, text, spots in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spots")), strict=True):
                for spot in spots:
                    first, windows = spot["first"], spot["windows"]
                    part = text[first : first + windows + length - 1]
                    digest = xxhash.xxh3_128_digest(part)
                    new = digest not in seen
                    if new:
                        seen.add(digest)
                    for column, value in zip(out, (spot["anchor"], int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), doc, first, windows, spot["ahead"], part if new else None), strict=True):
                        column.append(value)
            if len(seen) > 200_000:
                seen.clear()
            kinds = (*[pa.int64()] * 4, *[pa.int32()] * 3, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", "hash1", "hash2", "doc_id", "first", "windows", "ahead", "bytes"])

    return shared.mapped(held, run, schema)


def covered(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under windows at ascending ``starts``."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > length)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + length


def sorted_windows(parts: list[bytes], windows: list[int], weights: list[int], length: int) -> list[np.ndarray]:
    """For each part, which of its windows start more than once among all; by suffix array."""
    sizes = np.array([len(p) + 1 for p in parts])
    base = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join([*parts, b""]) + b"\0" * length, np.uint8)
    symbols = text[: sizes.sum()].astype(np.int64) + 1
    symbols[base + sizes - 1] = 0
    order = suffix_array(symbols)
    owner = np.repeat(np.arange(len(parts)), sizes)
    inside = np.arange(len(symbols)) - base[owner] < np.array(windows)[owner]
    order = order[inside[order]]
    shown = np.lib.stride_tricks.sliding_window_view(text, length)
    equal = np.zeros(len(order), bool)
    for at in range(0, len(order) - 1, 1 << 14):
        rows = shown[order[at : at + (1 << 14) + 1]]
        equal[at + 1 : at + len(rows)] = (rows[1:] == rows[:-1]).all(axis=1)
    run = np.cumsum(~equal) - 1
    total = np.bincount(run, np.array(weights)[owner[order]])
    repeated = np.zeros(len(symbols), bool)
    repeated[order[total[run] > 1]] = True
    return [np.flatnonzero(repeated[b : b + w]) for b, w in zip(base.tolist(), windows, strict=True)]


SPANS = "anchor long, hash1 long, hash2 long, starts array<int>, ends array<int>"


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def furthest(sides: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with another of the list."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    best = [0] * len(sides)
    for i, j in zip(order, order[1:], strict=False):
        n = common(sides[i], sides[j])
        best[i], best[j] = max(best[i], n), max(best[j], n)
    return best


class Sorting:
    """Gathers anchors' groups until their strings fill a suffix array, then tells the repeats.

    A surrounding is cut to what its neighbours on either side of the anchor share with it:
    no window that reaches beyond can repeat.  Equal cuts are sorted once, with their weight.
    """

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.whole: list[tuple[tuple, int]] = []
        self.cuts: list[tuple[tuple, int, int]] = []  # key, part, window that the part starts with
        self.parts: list[bytes] = []
        self.weights: list[int] = []
        self.held = 0

    def add(self, group: list[tuple[tuple, int, int, int, bytes]]) -> None:
        """Rows of key, windows, place of the anchor, weight, bytes of one anchor."""
        right = furthest([part[at + self.gram :] for _, _, at, _, part in group])
        left = furthest([part[:at][::-1] for _, _, at, _, part in group])
        known: dict[tuple[int, bytes], int] = {}
        for (key, windows, at, weight, part), before, after in zip(group, left, right, strict=True):
            if weight > 1:
                self.whole.append((key, windows))
            first, last = max(0, at - before), min(windows - 1, at + self.gram + after - self.length)
            if first > last:
                continue
            cut = (at - first, part[first : last + self.length])
            if cut not in known:
                known[cut] = len(self.parts)
                self.parts.append(cut[1])
                self.weights.append(0)
                self.held += len(cut[1])
            self.weights[known[cut]] += weight
            if weight == 1:
                self.cuts.append((key, known[cut], first))

    def close(self) -> pa.RecordBatch:
        windows = [len(p) - self.length + 1 for p in self.parts]
        found = [covered(f, self.length) for f in sorted_windows(self.parts, windows, self.weights, self.length)] if self.parts else []
        rows = [(key, [0], [n + self.length - 1]) for key, n in self.whole]
        rows += [(key, (found[part][0] + first).tolist(), (found[part][1] + first).tolist()) for key, part, first in self.cuts if len(found[part][0])]
        columns = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)]
        columns += [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (1, 2)]
        self.__init__(self.length, self.gram)
        return pa.RecordBatch.from_arrays(columns, ["anchor", "hash1", "hash2", "starts", "ends"])


def grouped_spans(mixed: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeats within each anchor's group; rows of a group arrive together, several groups a sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorting, group, last = Sorting(length, gram), [], None
        for batch in shared.chunks(batches, "bytes"):
            for anchor, one, two, windows, ahead, weight, part in zip(*(batch.column(c).to_pylist() for c in ("anchor", "hash1", "hash2", "windows", "ahead", "weight", "bytes")), strict=True):
                key = (anchor, one, two)
                if key == last:
                    continue  # another task sent the same bytes
                if last and anchor != last[0]:
                    sorting.add(group)
                    group = []
                    if sorting.held > SORT_BYTES:
                        yield sorting.close()
                last = key
                group.append((key, windows, ahead, weight, part))
        if group:
            sorting.add(group)
        yield sorting.close()

    dealt = mixed.select("anchor", "hash1", "hash2", "windows", "ahead", "weight", "bytes").repartition("anchor").sortWithinPartitions("anchor", "hash1", "hash2")
    return shared.mapped(dealt, run, SPANS)


def single_windows(hot: DataFrame, length: int) -> DataFrame:
    """Each window of a hot anchor by itself: its hash, for a count that needs no group in one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.chunks(batches, "bytes", most=1 << 17):
            rows = [(a, o, t, w, i, xxhash.xxh3_128_digest(p[i : i + length])) for a, o, t, n, w, p in zip(*(batch.column(c).to_pylist() for c in ("anchor", "hash1", "hash2", "windows", "weight", "bytes")), strict=True) for i in range(n)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["anchor", "hash1", "hash2", "weight", "at", "window"])

    return shared.mapped(hot.select("anchor", "hash1", "hash2", "windows", "weight", "bytes"), run, "anchor long, hash1 long, hash2 long, weight long, at int, window binary")


def repeats(docs: DataFrame, folder: str, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_ANCHOR) -> tuple[DataFrame, DataFrame]:
    """All documents' sizes and digests, and the spans to remove of those that have any.

    Tables and shuffle files go as soon as no later step reads them.
    """
    spark = docs.sparkSession
    survey = shared.written(surveyed(docs, length, gram), folder, "survey")
    spots = survey.select("doc_id", F.explode(F.arrays_zip("anchor", "first", "windows", "ahead")).alias("s")).select("doc_id", "s.*")
    common = shared.written(spots.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), folder, "common")
    spots = shared.perhaps(spots, common, "anchor").join(common.hint("merge"), "anchor")
    by_doc = spots.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "first", "windows", "ahead")).alias("spots"))
    by_doc = shared.written(by_doc, folder, "spots")
    survey = shared.written(survey.select("doc_id", "n_bytes", "digest"), folder, "sizes")
    shared.drop(spark, folder, "survey", "common")
    shared.release(spark)
    some = shared.perhaps(shared.texts(docs), by_doc.select("doc_id"), "doc_id")
    found = shared.written(surroundings(some.join(by_doc.hint("merge"), "doc_id"), length), folder, "surroundings")
    shared.drop(spark, folder, "spots")
    shared.release(spark)
    kinds = found.groupBy("anchor", "hash1", "hash2").agg(F.count("*").alias("weight"), F.first("windows").alias("windows"), F.first("ahead").alias("ahead"))
    kinds = shared.written(kinds, folder, "kinds")
    # A place in two texts can share an anchor's hash with no other of its kind left.
    sizes = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    kinds = shared.written(kinds.join(sizes.hint("merge"), "anchor"), folder, "sized")
    shared.drop(spark, folder, "kinds")
    shared.release(spark)
    alone = kinds.where("kinds = 1 and weight > 1").select("anchor", "hash1", "hash2", F.array(F.lit(0)).alias("starts"), F.array(F.col("windows") + length - 1).alias("ends"))
    bytes_ = found.where("bytes is not null").select("anchor", "hash1", "hash2", "bytes")

    def of(some: DataFrame) -> DataFrame:
        """The kinds with their bytes; bytes of other anchors are not shuffled."""
        return shared.perhaps(bytes_, some.select("anchor"), "anchor").join(some.hint("merge"), ["anchor", "hash1", "hash2"])

    several = of(kinds.where((F.col("kinds") > 1) & (F.col("kinds") <= hot)))
    sorted_ = shared.written(grouped_spans(several, length, gram), folder, "sorted")
    shared.release(spark)
    several = of(kinds.where((F.col("kinds") > 1) & (F.col("kinds") > hot)))
    single = shared.written(single_windows(several.dropDuplicates(["anchor", "hash1", "hash2"]), length), folder, "single")
    shared.release(spark)
    again = single.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window")
    lone = single.join(again.hint("merge"), "window").select("anchor", "hash1", "hash2", F.array(F.col("at")).alias("starts"), F.array(F.col("at") + length).alias("ends"))
    spans = alone.unionByName(sorted_).unionByName(lone)
    spans = found.drop("bytes", "windows", "ahead").join(spans.hint("merge"), ["anchor", "hash1", "hash2"])
    spans = spans.select("doc_id", F.explode(F.arrays_zip((F.transform("starts", lambda x: x + F.col("first"))).alias("start"), (F.transform("ends", lambda x: x + F.col("first"))).alias("end"))).alias("s"))
    spans = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start"), F.col("s.end")))).alias("spans"))
    spans = shared.written(spans, folder, "spans")
    shared.drop(spark, folder, "surroundings", "sized", "sorted", "single")
    shared.release(spark)
    return survey, spans


def kept_bytes(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What stays, how many bytes go and in how many maximal runs; spans sorted by start."""
    parts, at, removed, runs = [], -1, 0, 0
    upto = 0
    for span in spans:
        a, b = span["start"], span["end"]
        if a > at:
            runs += 1
            parts.append(text[upto:a])
            removed += b - a
        elif b > at:
            removed += b - at
        else:
            continue
        at = upto = b
    parts.append(text[upto:])
    return b"".join(parts), removed, runs


def trimmed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, digest`` of every document; digest: of the kept bytes."""
    docs = shared.one_each(docs)
    folder = shared.work_folder(docs.sparkSession)
    survey, spans = repeats(docs, folder, length, gram)
    texts = shared.perhaps(shared.texts(docs), spans.select("doc_id"), "doc_id").join(spans.hint("merge"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.chunks(batches):
            kept = [kept_bytes(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            columns = [batch.column("doc_id"), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()), pa.array([hashlib.sha256(k[0]).digest() for k in kept], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_removed", "n_spans", "now"])

    changed = shared.mapped(texts, run, "doc_id long, n_removed long, n_spans long, now binary")
    zero = F.lit(0).cast("long")
    return survey.join(changed.hint("merge"), "doc_id", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("now", "digest").alias("digest"))


def rewritten(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeats cut out of their texts, all columns and rows kept.

    Bytes of characters that a cut goes through go too, so texts stay valid; ``n_chars``, if
    there is one, follows the text.  Rows that repeat a doc_id are one row first.
    """
    docs = shared.one_row(docs)
    folder = shared.work_folder(docs.sparkSession)
    _, spans = repeats(docs, folder, length, gram)
    same = shared.without(docs, spans, "doc_id")
    cuts = shared.unused("cut_spans", docs)
    some = shared.perhaps(docs, spans.select("doc_id"), "doc_id").join(spans.withColumnRenamed("spans", cuts).hint("merge"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            text = [kept_bytes((t or "").encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(batch.column("text").to_pylist(), batch.column(cuts).to_pylist(), strict=True)]
            columns = {name: batch.column(name) for name in batch.schema.names if name != cuts} | {"text": pa.array(text, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in text], pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_pydict(columns)

    return same.unionByName(shared.rows_mapped(some.select(*shared.named(docs), cuts), run, docs.schema))
