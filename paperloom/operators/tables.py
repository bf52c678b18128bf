"""Pipe tables and name-description fragments, with spans in bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

MOST_COLUMNS, MOST_ROWS, MOST_CELLS = 256, 4096, 65_536


def row_cells(lines: DataFrame, keys: list[str], column: str = "line") -> DataFrame:
    """Cells of lines that are rows of a pipe table: ``col, text, start, end`` in bytes.

    A row has a pipe and at least two cells, none blank but an outermost one of no width.
    """
    rows = lines.where(F.col(column).contains("|")).select(*keys, F.col(column).alias("whole"), F.split(column, r"\|").alias("raw"))
    n = F.size("raw")
    edge = lambda i: F.when(F.get(F.col("raw"), i) == "", 1).otherwise(0)
    rows = rows.where(n <= MOST_COLUMNS + 2).select(*keys, "whole", "raw", edge(F.lit(0)).alias("left"), edge(n - 1).alias("right"))
    rows = rows.where((n - F.col("left") - F.col("right")).between(2, MOST_COLUMNS))
    # Parts that are blank but for the outermost ones of no width.
    blank = F.size(F.filter("raw", lambda x: ~x.rlike(r"(?U)\S")))
    rows = rows.where(blank == F.col("left") + F.col("right"))
    parts = rows.select(*keys, "whole", "left", "right", n.alias("n"), F.posexplode("raw").alias("i", "raw"))
    parts = parts.where((F.col("i") >= F.col("left")) & (F.col("i") < F.col("n") - F.col("right")))
    # The bytes before a part: those up to its pipe, and the pipe.
    before = F.when(F.col("i") == 0, 0).otherwise(F.octet_length(F.expr("substring_index(whole, '|', i)")) + 1)
    lead = F.octet_length("raw") - F.octet_length(F.regexp_replace("raw", r"(?U)^\s+", ""))
    cells = parts.select(*keys, (F.col("i") - F.col("left")).alias("col"), text.trimmed(F.col("raw")).alias("text"), (before + lead).alias("start"))
    return cells.select(*keys, "col", "text", "start", (F.col("start") + F.octet_length("text")).alias("end"))


def tables(sources: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Texts that are one table as a whole: ``rows, columns`` and its cells as an array.

    Every line that is not blank is a row, at least two of equal width; anything else is none.
    """
    lines = sources.select(key, F.posexplode(F.split(column, "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", "\r$", "")).where(text.trimmed(F.col("line")) != "")
    cells = row_cells(lines, [key, "line_no"])
    widths = cells.groupBy(key, "line_no").agg(F.count("*").alias("width"), F.array_sort(F.collect_list(F.struct("col", "text", "start", "end"))).alias("cells"))
    every = lines.groupBy(key).agg(F.count("*").alias("lines"))
    shape = widths.groupBy(key).agg(F.count("*").alias("rows"), F.min("width").alias("low"), F.max("width").alias("columns"), F.transform(F.array_sort(F.collect_list(F.struct("line_no", "cells"))), lambda r: r["cells"]).alias("cells"))
    fine = (F.col("rows") == F.col("lines")) & (F.col("rows") >= 2) & (F.col("low") == F.col("columns")) & (F.col("columns") >= 2) & (F.col("rows") <= MOST_ROWS) & (F.col("rows") * F.col("columns") <= MOST_CELLS)
    return shape.join(every, key).where(fine).select(key, "rows", "columns", "cells")


def name_description(sources: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Fragments ``Name Description <name> <sentence>``: name and description with byte ends."""
    pattern = r"(?s)^Name Description ([A-Za-z0-9_/-]{1,64}) ([^\r\n|]*?)\s*$"
    rows = sources.where(F.col(column).rlike(pattern) & (F.octet_length(column) <= 17 + 4096) & ~F.col(column).rlike(r"[\r\n|]"))
    rows = rows.select(key, F.regexp_extract(column, pattern, 1).alias("name"), F.regexp_extract(column, pattern, 2).alias("description"))
    rows = rows.where((F.octet_length("description") >= 16) & F.col("description").rlike("[.!?]$"))
    start = F.lit(17) + F.octet_length("name") + 1
    return rows.select(key, "name", "description", start.alias("description_start"), (start + F.octet_length("description")).alias("description_end"))
