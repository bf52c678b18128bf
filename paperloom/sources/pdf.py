"""One-page PDFs of text, made and read with the standard library; a seam for whole PDFs.

No PDF library is at hand, so ``inspect`` reads what ``page_bytes`` and simple writers make:
uncompressed or deflated content streams with text shown by Tj.  Pages that it cannot read
are reported and never guessed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_PAGES, MOST_OBJECTS = 256 << 20, 10_000, 2_000_000


def read(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Files as ``path, content``; one that is too large fails the read, none is cut."""
    files = spark.read.format("binaryFile").load(path)
    fine = F.when(F.col("length") <= most, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("limit_exceeded: "), "path")).cast("string"))
    return files.select(fine.alias("path"), "content")


def page_bytes(lines: list[tuple[float, float, float, str]], width: int = 595, height: int = 842) -> bytes:
    """A page of lines given as x, y, size and text."""
    quoted = [(x, y, size, re.sub(r"([\\()])", r"\\\1", text).encode("latin-1", "replace").decode("latin-1")) for x, y, size, text in lines]
    content = "".join(f"BT /F1 {size:g} Tf {x:g} {y:g} Td ({text}) Tj ET\n" for x, y, size, text in quoted).encode("latin-1")
    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Resources << /Font << /F1 4 0 R >> >> /Contents 5 0 R >>".encode(),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content),
    ]
    out, places = b"%PDF-1.4\n", []
    for number, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, table, len(bodies) + 1, len(out))


def shown_text(stream: bytes) -> str:
    lines = re.findall(rb"\(((?:[^\\()]|\\.)*)\)\s*Tj", stream, re.S)
    return "\n".join(re.sub(rb"\\([\\()])", rb"\1", line).decode("latin-1") for line in lines)


def pages_of(content: bytes) -> list[tuple[int, float | None, float | None, str, int, str]]:
    """Pages as index, width, height, text, pictures and status."""
    if not content.startswith(b"%PDF-"):
        return [(0, None, None, "", 0, "invalid_input")]
    if b"/Encrypt" in content:
        return [(0, None, None, "", 0, "encrypted")]
    objects = {int(n): body for n, body in re.findall(rb"(?<!\d)(\d+) 0 obj\b(.*?)\bendobj", content, re.S)}
    if len(objects) > MOST_OBJECTS:
        return [(0, None, None, "", 0, "limit_exceeded")]

    def inherited(body: bytes, name: bytes, depth: int = 0) -> bytes | None:
        found = re.search(rb"/%s\s*(\[[^\]]*\]|[-\d.]+)" % name, body)
        if found or depth > 128:
            return found and found[1]
        parent = re.search(rb"/Parent\s+(\d+) 0 R", body)
        return inherited(objects.get(int(parent[1]), b""), name, depth + 1) if parent else None

    out = []
    for body in (objects[n] for n in sorted(objects) if re.search(rb"/Type\s*/Page\b", objects[n])):
        box = [float(x) for x in re.findall(rb"[-\d.]+", inherited(body, b"MediaBox") or b"")]
        streams = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+ 0 R)", body)
        data = b""
        for n in re.findall(rb"(\d+) 0 R", streams[1]) if streams else []:
            held = objects.get(int(n), b"")
            raw = held.partition(b"stream")[2].rpartition(b"endstream")[0].lstrip(b"\r\n")
            data += zlib.decompress(raw) if b"/FlateDecode" in held.partition(b"stream")[0] else raw
        turned = int(inherited(body, b"Rotate") or 0) % 360
        status = "fine" if len(box) == 4 and turned in (0, 90, 180, 270) else "unsupported"
        width, height = (box[2] - box[0], box[3] - box[1]) if len(box) == 4 else (None, None)
        if turned in (90, 270):
            width, height = height, width
        out.append((len(out), width, height, shown_text(data), len(re.findall(rb"/\w+\s+Do\b", data)), status))
    return out if len(out) <= MOST_PAGES else [(0, None, None, "", 0, "limit_exceeded")]


def inspect(files: DataFrame) -> DataFrame:
    """Pages of files ``path, content``: native text, size, pictures and whether they could be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, *page) for path, content in zip(batch["path"], batch["content"], strict=True) for page in safely(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "page_index", "width", "height", "text", "xobjects", "status"])

    return files.select("path", "content").mapInPandas(run, "path string, page_index int, width double, height double, text string, xobjects long, status string")


def safely(content: bytes) -> list[tuple]:
    try:
        return pages_of(content)
    except (ValueError, zlib.error, RecursionError):
        return [(0, None, None, "", 0, "malformed")]
