"""Markdown, HTML and JSON of a selected view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def markdown(arrays: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages of ``layout.block_arrays`` as Markdown; one without blocks is a line feed."""

    def shown(b: Column) -> Column:
        body = text.trimmed(b["text"])
        code = F.concat(F.lit("```text\n"), F.regexp_replace(b["text"], r"\s+$", ""), F.lit("\n```"))
        return F.when(b["kind"] == "heading", F.concat(F.lit("# "), body)).when(b["kind"] == "list_item", F.concat(F.lit("- "), body)).when(b["kind"] == "code", code).otherwise(body)

    return arrays.select(key, F.concat(F.regexp_replace(F.array_join(F.transform("blocks", shown), "\n\n"), r"\s+$", ""), F.lit("\n")).alias("markdown"))


def html(arrays: DataFrame, key: str = "doc_id", page: int = 0) -> DataFrame:
    """Pages of ``layout.block_arrays`` as HTML; one without blocks is an empty section."""

    def shown(b: Column) -> Column:
        body = text.escaped_html(b["text"])
        wrap = lambda x, y: F.concat(F.lit(x), body, F.lit(y + "\n"))
        return F.when(b["kind"] == "heading", wrap("<h1>", "</h1>")).when(b["kind"] == "list_item", wrap("<li>", "</li>")).when(b["kind"] == "code", wrap("<pre><code>", "</code></pre>")).otherwise(wrap("<p>", "</p>"))

    head, tail = f'<!doctype html>\n<html><body>\n<section data-page="{page + 1}">\n', "</section>\n</body></html>\n"
    return arrays.select(key, F.concat(F.lit(head), F.array_join(F.transform("blocks", shown), ""), F.lit(tail)).alias("html"))


def joined_pages(pages: DataFrame, key: str, index: str, column: str) -> DataFrame:
    """Pages' Markdown as one document's, with rules between."""
    gathered = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(index, column))).alias("p"))
    return gathered.select(key, F.array_join(F.transform("p", lambda x: x[column]), "\n---\n\n").alias("markdown"))


def evidence_json(arrays: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages as JSON; regions keep their order as ``ordinal``."""
    regions = F.transform("blocks", lambda b, i: F.struct(i.alias("ordinal"), b["kind"].alias("kind"), b["text"].alias("text")))
    return arrays.select(key, F.to_json(F.struct(F.col(key), regions.alias("regions"))).alias("json"))


def render(arrays: DataFrame, form: str, key: str = "doc_id") -> DataFrame:
    forms = {"markdown": markdown, "html": html, "evidence_json": evidence_json}
    if form not in forms:
        raise ValueError(f"no such form: {form}")
    return forms[form](arrays, key)
