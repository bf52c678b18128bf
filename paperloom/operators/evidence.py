"""The evidence model as tables: conversion of pages, selected text, and what a valid document must not have.

Tables: ``pages`` (doc, page_id, idx, bounds_idx, width, height), ``layers`` and ``artifacts``
(doc, page_id, layer_id or artifact_id), ``regions`` (doc, page_id, region_id, rect), ``evidence``
(doc, page_id, region_id, evidence_id, layer_id, kind, text, rect, quality, space, artifact_id),
``selections`` (doc, page_id, region_id, evidence_ids), ``edges`` (doc, page_id, before, after),
``cells`` (doc, page_id, cell_id, evidence_id, row, col, row_span, col_span, rows, columns, text) and
``spans`` (doc, page_id, cell_id, ordinal, evidence_id, start, stop).

A violation is a row of ``doc, violation, at``; a valid document has none.  Every check is a
filter, a count by key or an anti-join, so it holds at any size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, identity, text
from . import layout

SCHEMA_MAJOR = 1
PRECISE = ("glyph", "word", "line", "region")


def converted(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Regions of one-page documents, each with its native evidence, which is selected.

    Page and region identities derive from the text's digest; a page without blocks has no row.
    """
    raw = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    blocks = layout.text_blocks(pages, key).join(pages.select(key, raw.alias("raw")), key)
    page, place = identity.big_endian(F.lit(0), 4), identity.big_endian(F.col("ordinal"), 8)
    return blocks.select(
        key,
        "ordinal",
        "kind",
        identity.derived_id("region", F.col("raw"), page, place).alias("region_id"),
        identity.derived_id("evidence", F.col("raw"), page, place, F.col("text")).alias("evidence_id"),
        "text",
        F.lit("native_quality").alias("reason"),
    )


def selected_text(selections: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """The texts that a region's selection names, in its order; what is no text is left out."""
    named = selections.select(*by, F.posexplode("evidence_ids").alias("place", "evidence_id"))
    rows = named.join(evidence.where("kind = 'text'").select(*by, "evidence_id", "text"), [*by, "evidence_id"])
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: r["text"]).alias("texts"))


def canonical(document: Column, lists: dict[str, list[str]]) -> Column:
    """A struct whose arrays of structs are sorted by the fields named for each."""
    return reduce(lambda d, item: d.withField(item[0], F.array_sort(d[item[0]], lambda a, b: by_fields(a, b, item[1]))), lists.items(), document)


def by_fields(a: Column, b: Column, names: list[str]) -> Column:
    order = F.lit(0)
    for name in reversed(names):
        order = F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(order)
    return order


def found(rows: DataFrame, violation: str, at: Column | str) -> DataFrame:
    return rows.select("doc", F.lit(violation).alias("violation"), (F.col(at) if isinstance(at, str) else at).cast("string").alias("at"))


def repeated(rows: DataFrame, violation: str, at: str, *within: str) -> DataFrame:
    keys = ["doc", *within, at]
    return found(rows.groupBy(*dict.fromkeys(keys)).agg(F.count("*").alias("n")).where("n > 1"), violation, at)


def absent(rows: DataFrame, owners: DataFrame, keys: list[str], violation: str, at: str) -> DataFrame:
    """Rows whose owner isn't there."""
    return found(rows.join(owners.select(*keys).distinct(), keys, "left_anti"), violation, at)


def page_violations(pages: DataFrame, major: int = SCHEMA_MAJOR) -> DataFrame:
    """Schema version, unique pages and indexes, bounds of the page's own index."""
    old = found(pages.where(F.col("schema_major") != major).select("doc").distinct(), "unsupported_schema", "doc") if "schema_major" in pages.columns else None
    rows = [repeated(pages, "duplicate_page", "page_id"), repeated(pages, "duplicate_page_index", "idx"), found(pages.where("bounds_idx <> idx"), "bounds_of_other_page", "page_id")]
    return reduce(DataFrame.unionByName, [*rows, *([old] if old is not None else [])])


def region_violations(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Unique regions that lie on a page."""
    bounds = pages.select("doc", "page_id", geometry.rect(F.lit(0), F.lit(0), F.col("width"), F.col("height")).alias("bounds"))
    rows = regions.join(bounds, ["doc", "page_id"], "left")
    return repeated(regions, "duplicate_region", "region_id", "page_id").unionByName(found(rows.where("bounds is null"), "region_without_page", "region_id")).unionByName(found(rows.where(~geometry.contains(F.col("bounds"), F.col("rect"))), "region_outside_page", "region_id"))


def quality_violation(quality: Column, rect: Column, bounds: Column) -> Column:
    """What a geometry's claimed quality forbids, or null."""
    return F.when((quality == "page_only") & rect.isNull(), "page_only_without_bounds").when((quality == "page_only") & ~rect.eqNullSafe(bounds), "page_only_differs_from_bounds").when(quality.isin(*PRECISE) & rect.isNull(), "precise_without_geometry")


def evidence_violations(pages: DataFrame, layers: DataFrame, artifacts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unique evidence of known layers and artifacts, its geometry as good as claimed and on the page.

    Page geometry lies inside the bounds, that of pictures inside one of the page's artifacts,
    normalised geometry anywhere.
    """
    bounds = geometry.rect(F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    rows = evidence.join(pages.select("doc", "page_id", bounds.alias("bounds")), ["doc", "page_id"])
    wrong = rows.withColumn("why", quality_violation(F.col("quality"), F.col("rect"), F.col("bounds"))).where("why is not null")
    outside = rows.where((F.col("space") == "pdf") & ~geometry.contains(F.col("bounds"), F.col("rect")))
    pictures = artifacts.where("pixel_width is not null and pixel_height is not null").select("doc", "page_id", geometry.rect(F.lit(0), F.lit(0), F.col("pixel_width"), F.col("pixel_height")).alias("picture"))
    drawn = evidence.where("space = 'image' and rect is not null")
    fits = drawn.join(pictures, ["doc", "page_id"]).where(geometry.contains(F.col("picture"), F.col("rect"))).select("doc", "evidence_id").distinct()
    return reduce(
        DataFrame.unionByName,
        [
            repeated(evidence, "duplicate_evidence", "evidence_id", "page_id"),
            absent(evidence, layers, ["doc", "page_id", "layer_id"], "unknown_layer", "evidence_id"),
            absent(evidence.where("kind = 'image'"), artifacts, ["doc", "page_id", "artifact_id"], "unknown_artifact", "evidence_id"),
            wrong.select("doc", F.col("why").alias("violation"), F.col("evidence_id").cast("string").alias("at")),
            found(outside, "evidence_outside_page", "evidence_id"),
            found(drawn.join(fits, ["doc", "evidence_id"], "left_anti"), "evidence_outside_artifacts", "evidence_id"),
        ],
    )


def selection_violations(selections: DataFrame, evidence: DataFrame) -> DataFrame:
    """A selection names some evidence, all of its own region."""
    keys = ["doc", "page_id", "region_id"]
    named = selections.select(*keys, F.explode("evidence_ids").alias("evidence_id"))
    return found(selections.where("size(evidence_ids) = 0"), "empty_selection", "region_id").unionByName(absent(named, evidence, [*keys, "evidence_id"], "selected_evidence_missing", "region_id"))


def edge_violations(regions: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges join two different regions of the page."""
    named = edges.select("doc", "page_id", F.explode(F.array("before", "after")).alias("region_id"))
    own = found(edges.where(F.col("before") == F.col("after")), "edge_to_itself", "before")
    return own.unionByName(absent(named.distinct(), regions, ["doc", "page_id", "region_id"], "edge_to_unknown_region", "region_id"))


def cell_violations(cells: DataFrame, spans: DataFrame, evidence: DataFrame, evidence_grade: bool = False) -> DataFrame:
    """Cells lie in their grid, and their text is what their spans of bytes hold of text evidence.

    In evidence grade every cell has a span.
    """
    keys = ["doc", "page_id", "cell_id"]
    outside = cells.where("row_span = 0 or col_span = 0 or row + row_span > rows or col + col_span > columns")
    sources = evidence.select("doc", "page_id", "evidence_id", F.col("kind").alias("source_kind"), F.col("text").cast("binary").alias("source"))
    cut = spans.join(sources, ["doc", "page_id", "evidence_id"], "left")
    reversed_ = cut.where(F.col("source_kind").isNull() | (F.col("start") > F.col("stop")))
    other = cut.where("source_kind <> 'text'")
    piece = F.expr("substring(source, cast(start as int) + 1, cast(stop - start as int))")
    # A span that ends beyond its source, or inside a character, holds no text.
    whole = F.col("stop") <= F.octet_length("source")
    fine = F.coalesce((F.col("source_kind") == "text") & (F.col("start") <= F.col("stop")), F.lit(False))
    pieces = F.struct("ordinal", F.when(fine, piece).alias("piece"), whole.alias("whole"))
    rebuilt = cut.groupBy(*keys).agg(F.bool_and(fine).alias("fine"), F.array_sort(F.collect_list(pieces)).alias("p")).where("fine")
    rebuilt = rebuilt.select(*keys, F.forall("p", lambda x: x["whole"]).alias("whole"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["piece"])).alias("bytes"))
    differing = cells.join(rebuilt, keys).where(~F.col("whole") | (F.col("bytes") != F.col("text").cast("binary")))
    rows = [found(outside, "cell_outside_grid", "cell_id"), found(reversed_, "span_missing_or_reversed", "cell_id"), found(other, "span_of_no_text", "cell_id"), found(differing, "cell_differs_from_spans", "cell_id")]
    if evidence_grade:
        rows.append(found(cells.join(spans.select(*keys).distinct(), keys, "left_anti"), "cell_without_span", "cell_id"))
    return reduce(DataFrame.unionByName, rows)


def envelope_violations(deltas: DataFrame, schema: str) -> DataFrame:
    """Deltas of the known schema, from named producers, that add to a page once."""
    named = F.coalesce(text.trimmed(F.col("producer")) != "", F.lit(False)) & F.coalesce(text.trimmed(F.col("stage")) != "", F.lit(False))
    return reduce(
        DataFrame.unionByName,
        [
            found(deltas.where(F.col("delta_schema") != schema), "unsupported_delta_schema", "delta_id"),
            found(deltas.where(~named), "blank_producer_or_stage", "delta_id"),
            found(deltas.where(F.size("page_ids") != F.size(F.array_distinct("page_ids"))), "duplicate_page_addition", "delta_id"),
        ],
    )


def pin_violations(pins: DataFrame, states: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pins name a document's present state and evidence that it has."""
    named = pins.select("doc", "pin_id", F.explode("evidence_ids").alias("evidence_id"))
    return absent(pins, states, ["doc", "state_id"], "pin_of_other_state", "pin_id").unionByName(absent(named, evidence, ["doc", "evidence_id"], "pinned_evidence_missing", "pin_id").distinct())


def refinement_violations(targets: DataFrame, states: DataFrame, regions: DataFrame) -> DataFrame:
    """Targets of a refinement name the present state, and a region that is there."""
    return absent(targets, states, ["doc", "state_id"], "stale_base_state", "region_id").unionByName(absent(targets, regions, ["doc", "page_id", "region_id"], "target_missing", "region_id"))


def refused(violations: DataFrame) -> DataFrame:
    """The violations, none; raises on the first where there is one."""
    why = F.concat_ws(" ", F.lit("invalid document:"), "doc", "violation", "at")
    return violations.select("doc", F.raise_error(why).cast("string").alias("violation"), "at")


def atomic_scopes(scopes: DataFrame, by: list[str]) -> DataFrame:
    """Scopes of a document, of several pages or of regions as a row each; a document's has neither."""
    pages = scopes.where("kind = 'pages'").select(*by, F.explode("page_ids").alias("page"), F.lit(None).cast("string").alias("region"))
    regions = scopes.where("kind = 'regions'").select(*by, F.explode("regions").alias("r")).select(*by, F.col("r.page").alias("page"), F.col("r.region").alias("region"))
    whole = scopes.where("kind = 'document'").select(*by, F.lit(None).cast("string").alias("page"), F.lit(None).cast("string").alias("region"))
    return whole.unionByName(pages).unionByName(regions).distinct()


def scope_label(page: Column, region: Column) -> Column:
    return F.when(page.isNull(), "document").when(region.isNull(), F.concat(F.lit("page "), page)).otherwise(F.concat(F.lit("region "), region, F.lit(" on page "), page))


def bounded_sources(evidence: DataFrame, by: list[str], most_records: int = 4096, most_bytes: int = 4 << 20) -> DataFrame:
    """Invocations whose source text exceeds what a request may carry."""
    sums = evidence.groupBy(*by).agg(F.count("*").alias("records"), F.sum(F.octet_length("text")).alias("bytes"))
    return sums.where((F.col("records") > most_records) | (F.col("bytes") > most_bytes))


def first_model(evidence: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The model digest of the first evidence that has one."""
    has = F.col("model_digest").isNotNull()
    return evidence.groupBy(*by).agg(F.min_by("model_digest", F.when(has, F.struct(*order))).alias("model_digest"))


def indexes(pages: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Pages numbered from 0 inside their document."""
    return pages.withColumn("idx", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
