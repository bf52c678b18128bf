"""Native text, layout and recognised text become one selected view, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def covers(ocr: Column, native: Column) -> Column:
    """Recognised text that holds all the native text."""
    return (native != "") & F.contains(ocr, native)


def selected(native: DataFrame, recognised: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a page: which stages' texts are selected, why, and whether they disagree.

    Native text of quality stands alone.  Else whatever was recognised is selected as well, and
    native text beside it unless the recognised one covers it.  Nothing is overwritten: both
    stay evidence, the choice refers to them.
    """
    n = native.select(key, text.normalized_native_text(F.coalesce("text", F.lit(""))).alias("native"))
    o = recognised.select(key, F.coalesce("text", F.lit("")).alias("ocr"))
    rows = n.join(o, key, "full_outer").select(key, F.coalesce("native", F.lit("")).alias("native"), F.coalesce("ocr", F.lit("")).alias("ocr"))
    n, o = F.col("native"), F.col("ocr")
    enough, read = text.quality_characters(n) >= text.ENOUGH_CHARACTERS, o != ""
    stages = F.when(enough, F.array(F.lit("native"))).otherwise(F.array_compact(F.array(F.when((n != "") & ~covers(o, n), F.lit("native")), F.when(read, F.lit("ocr")))))
    reason = F.when(enough, "native_quality").when((n == "") & read, "native_absent").when(n != "", "reconciled")
    disagree = (n != "") & (text.trimmed(o) != "") & (n != text.trimmed(o))
    shown = F.array_join(F.transform(stages, lambda s: F.when(s == "native", n).otherwise(o)), "\n")
    return rows.select(key, F.array_join(stages, "+").alias("selected_stages"), reason.alias("reason"), disagree.alias("disagree"), F.when(F.size(stages) > 0, shown).alias("text"))


def summary(view: DataFrame, bytes_column: str = "text") -> DataFrame:
    """Pages by stage, how many show text, and bytes a page; a ratio of nothing is null."""
    n = F.count("*")
    has = lambda stage: F.count_if(F.col("selected_stages").contains(stage))
    return view.agg(
        n.alias("pages"),
        F.count_if(F.col("selected_stages") != "").alias("nonblank"),
        has("ocr").alias("ocr"),
        has("native").alias("native"),
        F.count_if(text.trimmed(F.coalesce("text", F.lit(""))) != "").alias("searchable"),
        F.count_if("disagree").alias("disagreeing"),
        F.try_divide(F.sum(F.octet_length(bytes_column)), n).alias("bytes_per_page"),
    )


CAPABILITIES = {"text_extract": "native", "ocr_page": "ocr", "layout_detect": "region", "reading_order_detect": "region"}


def coverage(pages: DataFrame, document: str = "document") -> DataFrame:
    """What is complete of each document, and what a candidate for work, by capability.

    ``pages``: document, page_id, has_native, has_ocr, has_region, blank.  A page proven blank
    is complete in all.  The document itself is open, a row without pages.
    """
    done = F.array(*[F.struct(F.lit(c).alias("capability"), (F.col(f"has_{has}") | F.col("blank")).alias("complete")) for c, has in CAPABILITIES.items()])
    rows = pages.select(document, "page_id", F.explode(done).alias("c")).select(document, "page_id", "c.*")
    found = rows.groupBy(document, "capability", F.when(F.col("complete"), "complete").otherwise("candidate").alias("status")).agg(F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("page_ids"))
    opened = pages.select(document).distinct().select(document, F.lit("document_open").alias("capability"), F.lit("complete").alias("status"), F.lit("").alias("page_ids"))
    return opened.unionByName(found)
