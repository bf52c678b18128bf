"""Embedding near-dedup: a subspace pigeonhole join with exact verification.

Unit vectors with cosine c or more lie within squared distance 2 - 2c.  A fixed rotation
spreads that distance over all coordinates, which are split into blocks; each block gets the
part of the budget that its share of the coordinates is.  A pair within the whole budget is
within some block's, so a range join a block finds it: slabs of the block's first coordinate,
as wide as the block's radius, are compared with themselves and the next slab.  Candidates of
any block are verified by their cosine in double precision, and a link counts in the first
block whose budget it keeps, so once.  A slab with many vectors is dealt out in tiles of two
parts, so memory is bounded whatever the slab holds.  At cosine 0.9 in 64 even dimensions a slab is wider
than most of the data, and no index of fewer coordinates tells more: compared are about 2 in 5 of all pairs
in each block.  One product of matrices compares a strip, so a pair costs about a nanosecond.

Equal vectors are one node that knows how many they are.  Tiles return each node's number of
links and a spanning forest, never the pairs.

Cases: vectors that are null, empty, zero, or that hold null or non-finite components, and rows
without a vec_id, link with nothing and stay; vectors of different lengths never link, those of
each length do; very long vectors make smaller tiles; ties go to the smallest vec_id; repeated rows of one vec_id are other vectors to
one another, but share a component; doubles are compared as doubles; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

BLOCKS = 4
#: Components of one slab's vectors that a task takes as a part; a tile holds two parts.
PART = 24_000 * 64
#: Rows and columns of a strip that is compared at once.
ROWS, COLUMNS = 256, 2048


def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(20).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """``unit @ turn`` summed in one order, so that a vector's result is the same in every task."""
    out = np.zeros_like(unit)
    for k in range(len(turn)):
        out += unit[:, k, None] * turn[k]
    return out


def unit_rows(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy().astype(np.float64).reshape(n, -1)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def kind(vectors: DataFrame) -> str:
    """Floats stay floats, so that they are shuffled as such; all else becomes double."""
    return "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"


def edges_of(dim: int, blocks: int) -> list[int]:
    return [dim * i // blocks for i in range(blocks + 1)]


def limits(dim: int, blocks: int, cosine: float) -> list[float]:
    """Each block's squared distance, with room for rounding."""
    edges = edges_of(dim, blocks)
    return [(2 - 2 * cosine) * (b - a) / dim * (1 + 1e-9) + 1e-12 for a, b in zip(edges, edges[1:], strict=False)]


@cache
def shape(dim: int, blocks: int, cosine: float) -> tuple[np.ndarray, list[int], list[float]]:
    """Rotation, edges and limits for one length; no block is empty."""
    blocks = min(blocks, dim)
    return rotation(dim), edges_of(dim, blocks), limits(dim, blocks, cosine)


def slabs(nodes: DataFrame, blocks: int, cosine: float) -> DataFrame:
    """Each vector at home in its slab of every block, and as a guest in the slab before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = pc.list_value_length(whole.column("embedding")).to_numpy()
            for dim in np.unique(dims).tolist():
                batch = whole.filter(pa.array(dims == dim))
                turn, edges, most = shape(dim, blocks, cosine)
                firsts, widths = turn[:, edges[:-1]], np.sqrt(most) * 1.000001
                at = np.floor(rotated_to(unit_rows(batch.column("embedding"), batch.num_rows), firsts) / widths).astype(np.int32)
                cuts = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(most))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "low", "n", "embedding")), pa.ListArray.from_arrays(cuts, pa.array(at.ravel()))], ["node", "low", "n", "embedding", "slab"])

    homes = shared.mapped(nodes.select("node", "low", "n", "embedding"), run, f"node long, low long, n long, embedding array<{kind(nodes)}>, slab array<int>")
    placed = homes.select("node", "low", "n", "embedding", F.size("embedding").alias("dim"), F.posexplode("slab").alias("block", "home"))
    return placed.select("node", "low", "n", "embedding", "dim", "block", "home", F.explode(F.array("home", F.col("home") - 1)).alias("slab"))


def rotated_to(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(unit), axes.shape[1]))
    for k in range(len(axes)):
        out += unit[:, k, None] * axes[k]
    return out


def tiles(placed: DataFrame, part: int) -> DataFrame:
    """Deals a slab's vectors out so that every two of them meet in one tile."""
    sizes = placed.groupBy("dim", "block", "slab").agg(F.ceil(F.count("*") * F.col("dim") / part).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("own")).alias("low"), F.greatest(p, F.col("own")).alias("high")))
    # A row for each slab of each block of each length: a few, whatever the rows, as unit vectors fill [-1, 1].
    dealt = placed.join(F.broadcast(sizes), ["dim", "block", "slab"]).withColumn("own", own)
    return dealt.select("node", "low", "n", "embedding", "block", "own", (F.col("home") == F.col("slab")).alias("home"), F.explode(each).alias("t"), "dim", "slab").select("*", F.xxhash64("dim", "block", "slab", "t.low", "t.high").alias("tile")).drop("t", "dim", "slab")


def between(turned: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances, summed in one order so that every task rounds alike; ``turned`` has a row a coordinate."""
    out = np.zeros(np.broadcast_shapes(i.shape, j.shape))
    for row in turned:
        gap = row[i] - row[j]
        out += gap * gap
    return out


def inner(unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.zeros(np.broadcast_shapes(i.shape, j.shape))
    for row in unit:
        out += row[i] * row[j]
    return out


def tile_links(group: pa.Table, block: int, turn: np.ndarray, edges: list[int], most: list[float], cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with the cosine asked for whose first near block is ``block``, some at a time.

    Rows are sorted by the block's first coordinate, those at home first, so a strip of rows is
    compared only with the others in its reach.  One product gives a strip's distances: half
    squared norms ride along as coordinates.  Pairs near in the block are verified in double
    precision, as one array where much of a strip is near, as in a large group of near copies.
    """
    n = len(group)
    unit = unit_rows(group.column("embedding"), n)
    turned = rotated(unit, turn)
    own, home = group.column("own").to_numpy(), group.column("home").to_numpy().astype(bool)
    whole = own.min() == own.max()
    first, near = turned[:, edges[block]].copy(), turned[:, edges[block] : edges[block + 1]].astype(np.float32)
    half, one = (near * near).sum(axis=1, keepdims=True) / 2, np.ones((n, 1), np.float32)
    sought, target = np.hstack([near, -half, one]), np.hstack([near, one, -half])
    unit, turned = np.ascontiguousarray(unit.T), np.ascontiguousarray(turned.T)
    reach, least = np.sqrt(most[block]) + 1e-6, np.float32(-most[block] / 2 - 5e-5)

    def first_near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        mine = between(turned[edges[block] : edges[block + 1]], i, j) <= most[block]
        for k in range(block):
            mine &= between(turned[edges[k] : edges[k + 1]], i, j) > most[k]
        return mine

    order = np.lexsort((first, ~home))
    # In a tile of two parts, pairs across them only; guests are compared with those at home.
    left, right = (order, order) if whole else (order[own[order] == own.min()], order[own[order] != own.min()])
    target, homes = target[right], int(home[right].sum())
    for at in range(0, len(left), ROWS):
        rows = left[at : at + ROWS]
        low, high = first[rows].min() - reach, first[rows].max() + reach
        for begin, end in ((0, homes), (homes, len(right)))[: 2 if home[rows].any() else 1]:
            lo, hi = begin + np.searchsorted(first[right[begin:end]], [low, high])
            for strip in range(max(int(lo), at if whole else 0), int(hi), COLUMNS):
                columns = right[strip : min(strip + COLUMNS, hi)]
                close = sought[rows] @ target[strip : strip + len(columns)].T >= least
                close &= home[rows][:, None] | home[columns][None, :]
                if whole and strip < at + len(rows):
                    close &= np.arange(at, at + len(rows))[:, None] < np.arange(strip, strip + len(columns))[None, :]
                if 8 * np.count_nonzero(close) > close.size:
                    i, j = rows[:, None], columns[None, :]
                    a, b = np.nonzero(close & (inner(unit, i, j) >= cosine) & first_near(i, j))
                    i, j = rows[a], columns[b]
                else:
                    a, b = np.divmod(np.flatnonzero(close), len(columns))
                    i, j = rows[a], columns[b]
                    linked = inner(unit, i, j) >= cosine
                    i, j = i[linked], j[linked]
                    mine = first_near(i, j)
                    i, j = i[mine], j[mine]
                if len(i):
                    yield i, j


def tile_forest(n: int, count: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each member's number of links and the smallest index that links lead to; holds some pairs at a time."""
    links, label = np.zeros(n, np.int64), np.arange(n)
    held, size = [], 0

    def merge() -> np.ndarray:
        roots = np.flatnonzero(label != np.arange(n))
        return shared.forest(n, np.concatenate([roots, *[i for i, _ in held]]), np.concatenate([label[roots], *[j for _, j in held]]))

    for i, j in pairs:
        np.add.at(links, i, count[j])
        np.add.at(links, j, count[i])
        held.append((i, j))
        size += len(i)
        if size > 1 << 20:
            label, held, size = merge(), [], 0
    return links, merge()


def linked(nodes: DataFrame, cosine: float, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """``node, links, low, root``: links found in a tile, the node's smallest vec_id and that of its root in the tile's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shared.groups(batches, ["tile"]):
            starts = shared.runs(table.column("tile").to_numpy())
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                group = table.slice(a, b - a)
                turn, edges, most = shape(len(group.column("embedding")[0]), blocks, cosine)
                count, ids, lows = (group.column(c).to_numpy() for c in ("n", "node", "low"))
                links, label = tile_forest(len(group), count, tile_links(group, group.column("block")[0].as_py(), turn, edges, most, cosine))
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[some], links[some], lows[some], lows[label[some]])], ["node", "links", "low", "root"])

    dealt = tiles(slabs(nodes, blocks, cosine), part)
    return shared.mapped(dealt.repartition("tile").sortWithinPartitions("tile"), run, "node long, links long, low long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    folder = shared.work_folder(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind(vectors)}>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    fine = F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False))
    # A node is a distinct vector; its number is its own even where vec_ids repeat.
    nodes = rows.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    nodes = shared.written(nodes.withColumn("node", F.monotonically_increasing_id()), folder, "nodes")
    found = shared.written(linked(nodes, cosine, blocks, part), folder, "links")
    classes = shared.components(found.select(F.col("low").alias("a"), F.col("root").alias("b")), folder, "components").withColumnRenamed("node", "low")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = nodes.join(counts, "node", "left").join(classes, "low", "left")
    nodes = nodes.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "low").alias("component_id"))
    joined = rows.withColumn("key", F.when(fine, F.col("embedding"))).join(nodes.withColumnRenamed("embedding", "key"), "key", "left")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
