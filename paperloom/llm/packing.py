"""Best-fit packing of token sequences over range-sorted documents and gaps.

Documents are tokenised once into pieces of at most ``size`` tokens.  Pieces are ranked inside
their length, distributedly; a run of equal lengths, or of sequences with equal gaps, is one
record with a count.  Sweeps take the lengths in descending order: a run of pieces looks for its
successor, the smallest gap that holds it; by rank, each sequence of that gap takes as many of
them as fit; gaps are then updated and what is left looks for the next successor.  Where no gap
holds a piece, as many sequences open as the run fills.  Every piece then finds its place by its
length and rank.  This is best-fit decreasing, exactly.

There are at most ``size`` lengths and, between sweeps, some thousands of runs, whatever the data:
the sweeps run where the plan is made, on the driver, and not as tasks.

Cases: a null or empty text is the single id that ends a document; only longer documents are
cut, very long ones into many pieces; of equal lengths the order of reading decides, doc_id does not matter;
repeated rows are packed each; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SIZE = 4096
END_ID = 1
#: Distinct words whose ids a task remembers, and how many are encoded as one line.
WORDS_HELD = 400_000
LINE_WORDS = 64


@cache
def tokenizer_of(path: str):
    """One tokenizer a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of texts by way of their white-space separated words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words in turn; each distinct word is encoded once a worker.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer_of(path)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Encodes words some at a time, as a line; where a token begins tells whose it is."""
        spelled = [w.decode() for w in words]
        lines = self.tokenizer.encode_batch([" ".join(spelled[i : i + LINE_WORDS]) for i in range(0, len(words), LINE_WORDS)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in lines), np.uint32)
        count = np.fromiter((len(e.ids) for e in lines), np.int64, len(lines))
        begins = np.fromiter((o[0] for e in lines for o in e.offsets), np.int64, len(ids))
        # Places in all lines one after another, a place between each two.
        length = np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1
        first = np.cumsum(length) - length
        begins += np.repeat(first[::LINE_WORDS], count)
        sizes = np.bincount(np.searchsorted(first, begins, side="right") - 1, minlength=len(words))
        self.slot.update(zip(words, range(len(self.slot), len(self.slot) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has."""
        solid, starts, lengths = words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(solid)]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.slot) + len(distinct) > WORDS_HELD:
            self.clear()
        if new := [w for w in distinct if w not in self.slot]:
            self.learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        first, count = self.start[slots], self.start[slots + 1] - self.start[slots]
        upto = np.cumsum(count)
        ids = self.ids[np.arange(upto[-1]) + np.repeat(first - upto + count, count)]
        before = np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]
        return ids, np.diff(before)


#: ASCII letters, other signs of ASCII, and bytes in lower case.
LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
SIGN = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without ASCII white space, and where words start and how long they are.

    The tokenizer lower-cases, and parts a letter from a sign behind it, and a sign but an
    apostrophe from a letter behind it; so do words here, which are then fewer.  Where the
    opening of a special token occurs, words are left as they are.
    """
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    if b"<|" not in data.tobytes():
        letter, sign = LETTER[data], SIGN[data]
        begins[1:] |= (letter[:-1] & sign[1:]) | (sign[:-1] & (data[:-1] != 39) & letter[1:])
        data = LOWER[data]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = solid[edge]
    starts = np.flatnonzero(begins)
    inked = np.concatenate([[0], np.cumsum(solid)])
    return data[solid], starts, np.diff(np.append(inked[starts], inked[-1]))


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Cuts each document's ids; ``part`` and ``nth`` number the pieces of a length a task."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, made = WordIds(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in shared.chunks(batches, most=2 << 20):
            ids, counts = coder.encode(*shared.text_buffers(batch.column("text")))
            out = np.full(len(ids) + len(counts), end_id, "<u4")
            out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
            ends = np.cumsum(counts + 1)
            cuts = -(-(counts + 1) // size)
            owner = np.repeat(np.arange(len(cuts)), cuts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * size
            length = np.minimum(size, counts[owner] + 1 - start)
            at = ends[owner] - counts[owner] - 1 + start
            crc = [zlib.crc32(out[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            edges = shared.runs(length[order])
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(edges[:-1], np.diff(edges))
            nth += made[length]
            np.add.at(made, length, 1)
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(owner), part, np.int32)), pa.array(nth)]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(out)).astype(np.int32)), pa.array(out.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * keep_ids])

    return shared.mapped(shared.texts(docs), run, schema)


def sweeps(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Matches runs of pieces with runs of gaps.

    ``counts`` has how many pieces there are of each length.  Returns rows of length, first
    rank, first sequence, offset, pieces a sequence: the pieces of that length from that rank on
    lie side by side from that offset on in consecutive sequences, up to the row's successor.
    """
    sizes: list[int] = []  # of gaps, sorted
    runs: dict[int, list[tuple[int, int]]] = {}  # of each gap: first sequence and how many
    rows, opened = [], 0

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(sizes, gap)
            runs.setdefault(gap, []).append((first, n))

    for length, left in sorted(counts.items(), reverse=True):
        rank = 0
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                n = -(-left // (size // length))
                free(size, opened, n)
                opened += n
                continue
            gap = sizes[at]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], sizes[at]
            most = gap // length
            full, rest = divmod(min(left, n * most), most)
            rows.append((length, rank, first, size - gap, most))
            free(gap - most * length, first, full)
            if rest:
                free(gap - rest * length, first + full, 1)
            free(gap, first + full + (rest > 0), n - full - (rest > 0))
            rank += full * most + rest
            left -= full * most + rest
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def placed(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank; ``plan`` is sorted by both."""
    row = plan[np.searchsorted((plan[:, 0] << 44) + plan[:, 1], (length << 44) + rank, side="right") - 1]
    after, beside = np.divmod(rank - row[:, 1], row[:, 4])
    return row[:, 2] + after, row[:, 3] + beside * length


def packed(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row a piece with its sequence and its offset there."""
    folder = shared.work_folder(docs.sparkSession)
    cut = shared.written(pieces(docs, path, size, end_id, keep_ids), folder, "pieces")
    held = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    held = shared.written(held, folder, "held")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sweeps(counts, size)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = held.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    # As many rows as tasks and lengths make, which grows with the data: never broadcast.
    ranked = cut.join(base.hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "part", "nth")
    more = ", ids array<int>" * keep_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = placed(plan, *(batch.column(c).to_numpy() for c in ("length", "rank")))
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(sequence), pa.array(offset)] + ([batch.column("ids")] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids])

    return shared.mapped(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + more)
