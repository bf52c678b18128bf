"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Four machines are composed with an input: the normaliser (the model's character map, a dummy
space in front, spaces to the mark), the pieces' trie, byte fallback for characters that no
piece covers, and, as the model is of byte pairs, the grammar of neighbours: an arc from piece
a to piece b exists if merging the characters of both gives a and b again.  An arc's weight is
one, a forbidden one's is infinite; the shortest path in the tropical semiring is the text's
encoding.  Its inverse maps ids back to bytes.

No piece has the mark behind another character, which is checked on loading, so a path is in
one state where a mark follows one, and between characters that stand side by side in no piece,
such as line feeds: texts are cut there, a chunk of texts at a time, and each different stretch
is composed once a worker.

Cases: a null or empty text has no ids; bytes of unknown characters become byte pieces; very
long texts and stretches are composed whole; control pieces are never made and decode to
nothing; ids out of range raise; repeated rows are encoded each; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

MARK = "▁"
#: Different stretches and pairs of neighbours that a worker remembers.
STRETCHES_HELD = 400_000
PAIRS_HELD = 1_000_000
PARTS_HELD = 100_000
#: Wider than the range of states, so that two of them make one number.
STATES = 1 << 22
NO_PIECE = (None, {})


def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol-buffer message: number and raw value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class Normaliser:
    """The machine in front: the character map's longest matches, then spaces.

    A character map is a double-array trie of byte strings, whose leaves say where in a list of
    strings the replacement begins.
    """

    def __init__(self, spec: dict):
        self.dummy, self.squeeze, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        if not self.escape:
            raise ValueError("pieces without the mark for spaces are not supported")
        blob = spec.get(2) or b""
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]
        #: Whether texts of a chunk can be normalised as bytes at once.
        self.plain = not self.units and not self.squeeze

    def replaced(self, data: bytes) -> bytes:
        """Each longest match of the map by its replacement; other characters as they are."""
        units, out, at = self.units, [], 0
        while at < len(data):
            node, found, upto = (units[0] >> 10) << ((units[0] & 512) >> 6), None, at
            for i in range(at, len(data)):
                node ^= data[i]
                unit = units[node] if node < len(units) else 0
                if unit & 0x800000FF != data[i]:
                    break
                node ^= (unit >> 10) << ((unit & 512) >> 6)
                if unit & 256:
                    found, upto = units[node] & 0x7FFFFFFF, i + 1
            if found is None:
                upto = at + 1
                while upto < len(data) and data[upto] & 192 == 128:
                    upto += 1
                out.append(data[at:upto])
            else:
                out.append(self.strings[found : self.strings.index(b"\0", found)])
            at = upto
        return b"".join(out)

    def __call__(self, text: str) -> str:
        if self.units:
            text = self.replaced(text.encode()).decode()
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.dummy else "") + text.replace(" ", MARK)


class Transducer:
    """The composed machine of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(fields(file.read()))
        self.text: list[str] = []
        kinds, scores = [], []
        for _, value in (f for f in message if f[0] == 1):
            piece = dict(fields(value))
            self.text.append(piece[1].decode())
            scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(piece.get(3, 1))
        trainer = dict(fields(next((v for n, v in message if n == 2), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("the neighbour grammar is of byte-pair models")
        self.normalised = Normaliser(dict(fields(next((v for n, v in message if n == 3), b""))))
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k in (1, 4)}
        self.score = {t: scores[i] for t, i in self.ids.items()}
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds, strict=True)) if k == 6}
        self.out = [t.replace(MARK, " ").encode() if k in (1, 4) else bytes([int(t[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" for t, k in zip(self.text, kinds, strict=True)]
        self.out_size = np.array([len(o) for o in self.out], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out_data = np.frombuffer(b"".join(self.out), np.uint8)
        self.unknown = kinds.index(2)
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece spans a mark")
        # A node is the piece that ends there, if any, and the nodes behind it.
        self.trie: dict = {}
        for piece, i in self.ids.items():
            kids = self.trie
            for character in piece:
                node = kids.setdefault(character, [None, {}])
                kids = node[1]
            node[0] = i
        # Characters that stand side by side in a piece; no arc crosses two that never do.
        self.adjacent = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        # The same of bytes, the mark as a space: where texts are cut before anything else.
        self.apart = np.zeros((256, 256), bool)
        for a in range(128):
            for b in range(128):
                self.apart[a, b] = (chr(a) + chr(b)).replace(" ", MARK) not in self.adjacent
        self.apart[128:, 32] = True
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forgets the stretches composed so far."""
        self.slot: dict[bytes, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.held = np.zeros(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def spelled(self, state: int) -> str:
        """The characters of a piece, or of a state below -1 the one that no piece has alone."""
        return self.text[state] if state >= 0 else chr(-2 - state)

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the grammar has an arc from piece ``a`` to piece ``b``.

        Merges the best-scored pair first, then the leftmost, until one spans both pieces.
        """
        if len(self.pairs) > PAIRS_HELD:
            self.pairs.clear()
        left, right = self.spelled(a), self.spelled(b)
        score, parts, border = self.score, list(left + right), len(left)
        joined = [score.get(x + y) for x, y in zip(parts, parts[1:], strict=False)]
        fine = True
        while fine:
            best, at = None, -1
            for i, value in enumerate(joined):
                if value is not None and (best is None or value > best):
                    best, at = value, i
            if best is None:
                break
            fine = at + 1 != border
            border -= at < border
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at:
                joined[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(joined):
                joined[at] = score.get(parts[at] + parts[at + 1])
        found = self.pairs[a * STATES + b] = fine and border == 1 and len(parts) == 2
        return found

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """Where the arcs from a place end and their pieces, shorter ones first."""
        piece, kids = self.trie.get(text[at], NO_PIECE)
        found = [(at + 1, -2 - ord(text[at]) if piece is None else piece)]
        for end in range(at + 2, len(text) + 1):
            node = kids.get(text[end - 1])
            if node is None:
                break
            piece, kids = node
            if piece is not None:
                found.append((end, piece))
        return found

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path through ``text``, which is normalised.

        The machines are composed as far as the search gets.  Merging is deterministic, so at most
        one path of finite weight reaches a place: the first that arrives at the end, longer arcs
        tried first, is the shortest, and a place that led nowhere is not entered again.
        """
        size, pairs = len(text), self.pairs
        path: list[tuple[int, int]] = [(0, -1)]
        options, spent = [self.arcs(text, 0)], set()
        while path[-1][0] < size:
            at, last = path[-1]
            ways = options[-1]
            while ways:
                end, arc = ways.pop()
                if end in spent:
                    continue
                fine = last == -1 or pairs.get(last * STATES + arc)
                if fine or (fine is None and self.neighbours(last, arc)):
                    path.append((end, arc))
                    if end < size:
                        options.append(self.arcs(text, end))
                    break
            else:
                spent.add(at)
                options.pop()
                path.pop()
        ids: list[int] = []
        for _, arc in path[1:]:
            if arc >= 0:
                ids.append(arc)
            else:
                ids += self.fallback(chr(-2 - arc))
        return ids

    def composed(self, stretch: str) -> list[int]:
        """Ids of a stretch, by those of its parts that no arc joins."""
        if stretch.isascii() or stretch[1:].isascii():
            return self.shortest(stretch)
        cuts = [0, *[i for i in range(1, len(stretch)) if stretch[i - 1 : i + 1] not in self.adjacent], len(stretch)]
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = stretch[a:b]
            found = self.parts.get(part)
            if found is None:
                found = self.shortest(part)
                if len(self.parts) < PARTS_HELD:
                    self.parts[part] = found
            ids += found
        return ids

    def fallback(self, character: str) -> list[int]:
        if not self.byte:
            return [self.unknown]
        return [self.byte[b] for b in character.encode()]

    def spaced(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes of many texts, the mark as a space, and where each begins."""
        if not self.normalised.plain or "\u2581".encode() in data.tobytes():
            texts = [self.normalised(data[a:b].tobytes().decode()).replace(MARK, " ").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not self.normalised.dummy:
            return data, offsets
        some = np.diff(offsets) > 0
        return np.insert(data, offsets[:-1][some], 32), offsets + np.concatenate([[0], np.cumsum(some)])

    def encode_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised texts, one after another, and how many each text has."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        begins = np.ones(len(data), bool)
        begins[1:] = self.apart[data[:-1], data[1:]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.slot) + len(distinct) > STRETCHES_HELD:
            self.clear()
        if new := [w for w in distinct if w not in self.slot]:
            found = [self.composed(w.decode().replace(" ", MARK)) for w in new]
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.held = np.concatenate([self.held, np.fromiter(chain.from_iterable(found), np.uint32, sizes.sum())])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        slots = np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        first, count = self.start[slots], self.start[slots + 1] - self.start[slots]
        upto = np.cumsum(count)
        ids = self.held[np.arange(upto[-1]) + np.repeat(first - upto + count, count)]
        return ids, np.diff(np.concatenate([[0], upto])[np.searchsorted(starts, offsets)])

    def spelled_out(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the inverse machine maps ids to, the dummy space included."""
        sizes = self.out_size[ids]
        upto = np.cumsum(sizes)
        if not len(ids):
            return np.zeros(0, np.uint8)
        return self.out_data[np.arange(upto[-1]) + np.repeat(self.out_start[ids] - upto + sizes, sizes)]

    def encode(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(*self.spaced(data, np.array([0, len(data)])))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        out = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.normalised.dummy and out.startswith(" ") else out


@cache
def machine_of(path: str) -> Transducer:
    """One machine a worker, which keeps what it learns from task to task."""
    return Transducer(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path)
        for part in shared.chunks(batches):
            ids, counts = machine.encode_all(*machine.spaced(*shared.text_buffers(part.column("text"))))
            cuts = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(cuts, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return shared.mapped(shared.texts(docs), run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of rows of ``doc_id, ids``; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path)
        for batch in batches:
            texts = [machine.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return shared.mapped(rows.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_ids, ids_crc32, n_chars, restored``: encodes and decodes every text in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path)
        for part in shared.chunks(batches):
            data, offsets = shared.text_buffers(part.column("text"))
            spaced, begins = machine.spaced(data, offsets)
            ids, counts = machine.encode_all(spaced, begins)
            edges = np.concatenate([[0], np.cumsum(counts)])
            raw = memoryview(ids.astype("<u4").tobytes())
            cuts = (4 * edges).tolist()
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            heads = np.concatenate([[0], np.cumsum(data & 192 != 128)])[offsets]
            same = np.ones(part.num_rows, bool)
            dummies = np.cumsum(np.diff(offsets) > 0) if machine.normalised.dummy else np.zeros(part.num_rows, np.int64)
            # What the inverse gives is the text behind its dummy space, all texts at once; else one by one.
            whole = np.array_equal(begins[1:], offsets[1:] + dummies) and np.array_equal(machine.spelled_out(ids), spaced) and "\u2581".encode() not in data.tobytes()
            if not whole:
                for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                    same[i] = machine.decode(ids[a:b].tolist()).encode() == data[offsets[i] : offsets[i + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(np.diff(heads).astype(np.int64)), pa.array(same)], ["doc_id", "n_ids", "ids_crc32", "n_chars", "restored"])

    return shared.mapped(shared.texts(docs), run, "doc_id long, n_ids long, ids_crc32 long, n_chars long, restored boolean")
