"""Rule-based layout: lines to blocks, blocks to regions, reading order.

Blocks are cut by array expressions inside a row.  A page's lines need no explode, window or
shuffle; only results that are rows by nature are exploded at the end.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .survey import HEIGHT, WIDTH


def cut(pages: DataFrame, key: str = "doc_id") -> tuple[DataFrame, Column]:
    """Pages with what is needed to cut them, and the array of a page's block texts.

    The array is an expression, not a column: of a column that is exploded the optimiser infers
    that it isn't empty, and would cut pages once more to filter by that.

    Blank lines end a block; headings and list items are blocks of their own; a sentence's end
    at a line's end ends one.  Lines join with a space, unless a line ends in a hyphen.
    """
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), text.trimmed)
    rows = pages.select(key, lines.alias("lines"))
    kind = lambda x: F.when(x == "", "b").when(text.is_heading(x), "h").when(text.is_list_item(x), "i").otherwise("t")
    rows = rows.select(key, F.transform("lines", lambda x: F.struct(x.alias("line"), kind(x).alias("kind"))).alias("lines"))

    def joint(x, i):
        before = F.get(F.col("lines"), i - 1)
        starts = x["kind"].isin("h", "i") | before.isNull() | (before["kind"] != "t") | before["line"].rlike("[.!?]$")
        piece = F.when(starts | before["line"].endswith("-"), x["line"]).otherwise(F.concat(F.lit(" "), x["line"]))
        return F.struct(x["kind"].alias("kind"), starts.alias("starts"), piece.alias("piece"))

    rows = rows.select(key, F.filter(F.transform("lines", joint), lambda x: x["kind"] != "b").alias("parts"))
    starts = F.filter(F.transform("parts", lambda x, i: F.when(x["starts"], i)), lambda i: i.isNotNull())
    rows = rows.select(key, F.transform("parts", lambda x: x["piece"]).alias("pieces"), starts.alias("starts"))
    texts = F.transform("starts", lambda s, k: F.array_join(F.slice("pieces", s + 1, F.coalesce(F.get(F.col("starts"), k + 1), F.size("pieces")) - s), ""))
    return rows, texts


def block_arrays(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``blocks``, an array of ``kind, text``, of each page; an empty one for a page without text."""
    rows, texts = cut(pages, key)
    return rows.select(key, F.transform(texts, lambda t: F.struct(text.block_kind(t).alias("kind"), t.alias("text"))).alias("blocks"))


def text_blocks(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``ordinal, kind, text`` of each block of a page, a row each."""
    rows, texts = cut(pages, key)
    rows = rows.select(key, F.posexplode(texts).alias("ordinal", "text"))
    return rows.select(key, "ordinal", text.block_kind(F.col("text")).alias("kind"), "text")


def band_geometry(arrays: DataFrame, key: str = "doc_id", width: float = WIDTH, height: float = HEIGHT) -> DataFrame:
    """Full-width bands of equal height for the blocks of ``block_arrays``, the last reaching the page's end."""
    # Bound to a name first, or the optimiser would cut a page into blocks once for each block.
    sized = F.transform(F.array("blocks"), lambda bs: F.transform(bs, lambda b: F.struct(b["kind"].alias("kind"), F.size(bs).alias("n"))))[0]
    rows = arrays.select(key, F.posexplode(sized).alias("ordinal", "b")).select(key, "ordinal", "b.kind", "b.n")
    y = F.col("ordinal") * (F.lit(height) / F.col("n"))
    tall = F.when(F.col("ordinal") == F.col("n") - 1, F.lit(height) - y).otherwise(F.lit(height) / F.col("n"))
    return rows.select(key, "ordinal", "kind", F.lit(0.0).alias("x"), y.alias("y"), F.lit(width).alias("width"), tall.alias("height"))


def reading_edges(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each region and the next."""
    after = F.lead("ordinal").over(Window.partitionBy(key).orderBy("ordinal"))
    return blocks.select(key, F.col("ordinal").alias("before"), after.alias("after")).where("after is not null")


def cyclic_pages(edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages whose edges hold a cycle; a page's edges are few and meet in one task."""
    kind = dict(edges.dtypes)[key]

    def peel(group: pd.DataFrame) -> pd.DataFrame:
        after: dict[int, list[int]] = {}
        ways_in: Counter[int] = Counter()
        for a, b in set(zip(group["before"], group["after"], strict=True)):
            after.setdefault(a, []).append(b)
            ways_in[b] += 1
        free = [a for a in after if not ways_in[a]]
        while free:
            for b in after.pop(free.pop(), []):
                ways_in[b] -= 1
                if not ways_in[b]:
                    free.append(b)
        return pd.DataFrame({key: group[key].iloc[:1] if any(ways_in.values()) else group[key].iloc[:0]})

    return edges.select(key, "before", "after").groupBy(key).applyInPandas(peel, f"{key} {kind}")


def ordered_edges_cycle(edges: DataFrame, key: str = "doc_id") -> DataFrame:
    """Edges that go backwards in an order that is claimed; none makes a cycle if there is none."""
    return edges.where(F.col("after") <= F.col("before")).select(key, "before", "after")
