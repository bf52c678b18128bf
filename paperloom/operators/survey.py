"""The survey: cheap features of page texts, found before anything costly runs.

All but the hash sketch are row expressions, so they fuse with the scan and shuffle nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, text

#: A page of the standard size, in points.
WIDTH, HEIGHT = 595.0, 842.0
#: Alphabets by character range.
SCRIPTS = {
    "arabic": r"؀-ۿ",
    "cyrillic": r"Ѐ-ԯ",
    "greek": r"Ͱ-Ͽ",
    "han": r"㐀-鿿",
    "hangul": r"가-힯",
    "hebrew": r"֐-׿",
    "japanese_kana": r"぀-ヿ",
    "latin": r"\x{0}-\x{24F}",
}


def content_hint(characters: Column, xobjects: Column, paths: Column, text_operators: Column) -> Column:
    words, pictures = characters > 0, xobjects > 0
    return F.when(words & pictures, "hybrid").when(words, "born_digital").when(pictures, "scanned").when((paths > 0) | (text_operators > 0), "other_content").otherwise("blank")


def density(count: Column, width: Column, height: Column) -> Column:
    return F.when(width * height > 0, count / (width * height)).otherwise(0.0)


def candidate_kinds(page: Column, xobjects: Column, paths: Column) -> Column:
    found = F.array(
        F.when(xobjects > 0, F.lit("figure")),
        F.when(page.rlike("[=∑∫√]"), F.lit("formula")),
        F.when(page.rlike(r"[|\t]"), F.lit("table")),
        F.when(paths > 0, F.lit("vector_graphic")),
    )
    return F.array_compact(found)


def script_hints(page: Column) -> Column:
    """Alphabets of the letters of a text, in order of name."""
    named = [F.when(page.rlike(rf"[\p{{L}}&&[{span}]]"), F.lit(name)) for name, span in SCRIPTS.items()]
    other = F.when(page.rlike(rf"[\p{{L}}&&[^{''.join(SCRIPTS.values())}]]"), F.lit("other"))
    return F.array_sort(F.array_compact(F.array(*named, other)))


def needs_ocr(characters: Column, hint: Column, adaptive: bool = True) -> Column:
    return characters < text.ENOUGH_CHARACTERS if adaptive else hint != "blank"


def page_features(pages: DataFrame, key: str = "doc_id", xobjects: Column | None = None, paths: Column | None = None, text_operators: Column | None = None) -> DataFrame:
    """One row a page; without counts of its content operators a page has text alone."""
    counts = {"xobjects": xobjects, "paths": paths, "text_operators": text_operators}
    native = text.normalized_native_text(F.coalesce("text", F.lit("")))
    rows = pages.select(key, native.alias("native"), *[(F.lit(0) if c is None else c).cast("long").alias(n) for n, c in counts.items()])
    rows = rows.withColumn("native_characters", text.quality_characters(F.col("native")))
    rows = rows.withColumn("content_hint", content_hint(*[F.col(c) for c in ("native_characters", *counts)]))
    shown = {"characters": "native_characters"} | {n: n for n in counts if counts[n] is not None}
    return rows.select(
        key,
        "native_characters",
        *[density(F.col(c), F.lit(WIDTH), F.lit(HEIGHT)).alias(f"{n}_per_square_point") for n, c in shown.items()],
        "content_hint",
        F.col("content_hint").isin("scanned", "hybrid", "other_content").alias("high_value_candidate"),
        needs_ocr(F.col("native_characters"), F.col("content_hint")).alias("needs_ocr"),
        F.when(F.col("native") != "", F.sha2("native", 256)).alias("native_text_sha256"),
        F.array_join(candidate_kinds(F.col("native"), F.col("xobjects"), F.col("paths")), ",").alias("candidate_kinds"),
        F.array_join(script_hints(F.col("native")), ",").alias("script_hints"),
    )


def stage_plan(features: DataFrame, key: str = "doc_id", ocr_ready: bool = False, ocr_engine: str = "ocr", adaptive: bool = True, threshold: int = text.ENOUGH_CHARACTERS) -> DataFrame:
    """The stages of each page's conversion, each selected, rejected or unavailable, and why.

    Native text is extracted from every page and segmented if there is any; recognition is for
    pages with too little of it, or, in the baseline profile, for all not proven blank.
    """
    stage = lambda n, name, status, why: F.struct(F.lit(n).alias("ordinal"), F.lit(name).alias("stage"), status.alias("status"), why.alias("reason"))
    n = F.col("native_characters")
    poor = n < threshold if adaptive else F.col("content_hint") != "blank"
    wanted = f"native evidence is below the {threshold} character threshold" if adaptive else "baseline profile OCRs every page not proven blank"
    lacking = f"{wanted}; configured OCR engine is not ready" if adaptive else "baseline profile requires OCR, but the configured engine is not ready"
    enough = "native evidence meets the configured threshold" if adaptive else "survey deterministically proved the page blank"
    stages = F.array(
        stage(0, "pdf.inspect", F.lit("selected"), F.lit("bounded parsing is required for this PDF")),
        stage(1, "native.extract", F.lit("selected"), F.concat(F.lit("recovered "), n.cast("string"), F.lit(" non-whitespace characters"))),
        stage(2, "layout.rulebased", F.when(n == 0, "rejected").otherwise("selected"), F.when(n == 0, "no native text is available for rule-based segmentation").otherwise("native text will be segmented deterministically")),
        stage(3, ocr_engine, F.when(~poor, "rejected").otherwise("selected" if ocr_ready else "unavailable"), F.when(~poor, enough).otherwise(wanted if ocr_ready else lacking)),
    )
    return features.select(key, F.explode(stages).alias("s")).select(key, "s.*")


TOKEN = re.compile(r"[^\W_]+")


def token_simhash(pages: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """A 64-bit sketch: sum of token digests' bits, each token as often as it occurs; null without tokens.

    A page's tokens stay in its row: a batch hashes each different token once and sums votes by
    page, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch, slot, owner, which = whole.slice(at, 64), {}, [], []
                for row, page in enumerate(batch.column(column).to_pylist()):
                    found = TOKEN.findall((page or "").lower())
                    which += [slot.setdefault(t, len(slot)) for t in found]
                    owner.append(len(found))
                shown: list[str | None] = [None] * batch.num_rows
                if which:
                    bits = np.unpackbits(np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest()[:8] for t in slot), np.uint8).reshape(-1, 8), axis=1)
                    ends = np.cumsum(owner)
                    for row, (end, n) in enumerate(zip(ends.tolist(), owner, strict=True)):
                        if n:
                            ones = bits[which[end - n : end]].sum(axis=0, dtype=np.int64)
                            shown[row] = np.packbits(2 * ones >= n).tobytes().hex()
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(shown, pa.string())], [key, "simhash"])

    return pages.select(key, column).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, simhash string")


def merged_scripts(features: DataFrame, by: list[str]) -> DataFrame:
    """All alphabets of a document's pages, in order of name."""
    names = features.select(*by, F.explode(F.split("script_hints", ",")).alias("script")).where("script <> ''").distinct()
    return names.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("script")), ",").alias("script_hints"))


def family_features(pages: DataFrame, features: DataFrame, family: str = "source", key: str = "doc_id") -> DataFrame:
    """What the pages of a family have in common, as sorted feature strings."""
    joined = pages.select(family, key).join(features.select(key, "content_hint"), key)
    sums = joined.groupBy(family).agg(F.count("*").alias("pages"), F.collect_set(F.concat(F.lit("content:"), "content_hint")).alias("hints"))
    size = f"page-size:{WIDTH:.0f}x{HEIGHT:.0f}"
    return sums.select(family, F.array_join(F.array_sort(F.concat(F.array(F.lit(size), F.concat(F.lit("pages:"), F.col("pages").cast("string"))), "hints")), ";").alias("features"))


def repeated_margins(pages: DataFrame, family: str = "source", page: str = "doc_id") -> DataFrame:
    """First and last lines that several pages of a family share; a last line equal to the first is none."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), text.trimmed), lambda x: x != "")
    rows = pages.select(family, page, lines.alias("lines")).where("size(lines) > 0")
    first, last = F.element_at("lines", 1), F.element_at("lines", -1)
    ends = F.array_compact(F.array(F.struct(F.lit("first_native_line").alias("position"), first.alias("line")), F.when(first != last, F.struct(F.lit("last_native_line").alias("position"), last.alias("line")))))
    rows = rows.select(family, page, F.explode(ends).alias("e")).select(family, page, "e.*")
    return rows.groupBy(family, "position", "line").agg(F.count("*").alias("pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page")).where("pages > 1").select(family, "position", F.sha2("line", 256).alias("text_sha256"), "pages", "first_page", "last_page")


def exact_duplicates(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests that several pages have."""
    digests = pages.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return digests.groupBy("text_sha256").agg(F.count("*").alias("pages"), F.min(key).alias("first_page")).where("pages > 1")


def stable_ids(pages: DataFrame) -> DataFrame:
    """Document, page and first-evidence identities of one-page documents."""
    body = F.coalesce(F.col("text"), F.lit(""))
    raw = F.unhex(F.sha2(body, 256))
    rows = pages.select("doc_id", body.alias("body"), identity.derived_id("doc", raw).alias("document_id"), raw.alias("raw"))
    page = identity.derived_id("page", F.col("document_id"), identity.big_endian(F.lit(0), 4))
    evidence = identity.derived_id("evidence", F.col("raw"), identity.big_endian(F.lit(0), 4), identity.big_endian(F.lit(0), 8), F.col("body"))
    return rows.select("doc_id", "document_id", page.alias("page_id"), evidence.alias("evidence_id"))


def first_wins(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of rows alike in ``by`` the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
