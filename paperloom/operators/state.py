"""Append-only deltas, states as sets of deltas, checkpoints with a tail, coverage, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity


def delta_ids(deltas: DataFrame, parts: list[str]) -> DataFrame:
    """Deltas with the identity of their content; when and where they were stored doesn't matter."""
    return deltas.withColumn("delta_id", identity.derived_id("delta", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]))


def state_id(members: DataFrame, by: list[str]) -> DataFrame:
    """The identity of a set of deltas: their order and repeats don't matter."""
    gathered = members.select(*by, "delta_id").distinct().groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("delta_id")), "\n").alias("ids"), F.count("*").alias("deltas"))
    return gathered.select(*by, "deltas", identity.derived_id("state", F.col("ids")).alias("state_id"))


def conflicts(deltas: DataFrame, by: list[str]) -> DataFrame:
    """Regions for which one replay has different selections."""
    hints = deltas.where("selected is not null").groupBy(*by).agg(F.count_distinct("selected").alias("selections"))
    return hints.where("selections > 1")


def materialized(initial: DataFrame, deltas: DataFrame, by: list[str], order: str) -> DataFrame:
    """The document that deltas add up to: evidence counted, the last selection kept."""
    rows = initial.select(*by, F.lit(0).cast("long").alias("seq"), "evidence", "selected").unionByName(deltas.select(*by, F.col(order).cast("long").alias("seq"), "evidence", "selected"))
    return rows.groupBy(*by).agg(F.count("evidence").alias("evidence_count"), F.max_by("selected", F.when(F.col("selected").isNotNull(), F.struct("seq", "selected"))).alias("selected"))


def from_checkpoint(checkpoint: DataFrame, tail: DataFrame, by: list[str], order: str) -> DataFrame:
    """A checkpoint's document with later deltas added: equal to a replay of all."""
    added = tail.groupBy(*by).agg(F.count("evidence").alias("added"), F.max_by("selected", F.when(F.col("selected").isNotNull(), F.struct(F.col(order).cast("long"), "selected"))).alias("newer"))
    rows = checkpoint.join(added, by, "full_outer")
    return rows.select(*by, (F.coalesce("evidence_count", F.lit(0)) + F.coalesce("added", F.lit(0))).cast("long").alias("evidence_count"), F.coalesce("newer", "selected").alias("selected"))


def checkpoint_due(policy: Column, deltas: Column, every: Column) -> Column:
    return F.when(policy == "always", True).when(policy == "every", deltas >= every).otherwise(False)


def missing_goals(goals: DataFrame, coverage: DataFrame) -> DataFrame:
    """Goals that no complete coverage meets; a document covers its pages, a page its regions."""
    c = coverage.where("status = 'complete'").select(F.col("doc").alias("c_doc"), F.col("capability").alias("c_capability"), F.col("page").alias("c_page"), F.col("region").alias("c_region"))
    covers = (F.col("doc") == F.col("c_doc")) & (F.col("capability") == F.col("c_capability")) & (F.col("c_page").isNull() | ((F.col("page") == F.col("c_page")) & (F.col("c_region").isNull() | (F.col("region") == F.col("c_region")))))
    return goals.join(c, covers, "left_anti")


def subsumed(invocations: DataFrame) -> DataFrame:
    """Invocations without those that a whole-document one of the same capability makes needless."""
    whole = invocations.where("page is null").select("doc", "capability").distinct()
    return invocations.where("page is null").unionByName(invocations.where("page is not null").join(whole, ["doc", "capability"], "left_anti"))


def orphans(rows: DataFrame, owners: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose owner isn't there: a violated reference."""
    return rows.join(owners.select(*on).distinct(), on, "left_anti")


def cached(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests with the stored value of their key; a value whose digest is wrong is no hit."""
    fine = store.where(F.sha2("value", 256) == F.col("digest")).select("key", "value")
    return requests.join(fine, "key", "left").withColumn("hit", F.col("value").isNotNull())


def cache_conflicts(store: DataFrame) -> DataFrame:
    return store.groupBy("key").agg(F.count_distinct("digest").alias("values")).where("values > 1")


def garbage(blobs: DataFrame, referenced: DataFrame, leased: DataFrame) -> DataFrame:
    """Blobs that nothing refers to and no lease holds."""
    live = referenced.select("digest").union(leased.select("digest")).distinct()
    return blobs.join(live, "digest", "left_anti")


def evidence_sets(evidence: DataFrame, by: list[str]) -> DataFrame:
    return evidence.groupBy(*by).agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing from a manifest's folder or differ from it: none if all is well."""
    found = files.select("path", F.sha2("content", 256).alias("found"), F.length("content").cast("long").alias("found_bytes"))
    rows = manifest.join(found, "path", "full_outer")
    why = F.when(F.col("found").isNull(), "missing").when(F.col("digest").isNull(), "unlisted").when(F.col("found") != F.col("digest"), "digest_differs").when(F.col("found_bytes") != F.col("bytes"), "size_differs")
    return rows.withColumn("violation", why).where("violation is not null").select("path", "violation")


def put(store: DataFrame, values: DataFrame) -> DataFrame:
    """A store with values added: what is there stays, of several new ones for a key the smallest wins."""
    new = values.groupBy("key").agg(F.min("value").alias("value")).withColumn("digest", F.sha2("value", 256))
    return store.select("key", "value", "digest").unionByName(new.join(store.select("key"), "key", "left_anti").select("key", "value", "digest"))


def sizes(artifacts: DataFrame, sources: DataFrame, by: list[str]) -> DataFrame:
    """Bytes of a document's evidence and checkpoints, and their ratio to its source; null without one."""
    sums = artifacts.groupBy(*by).agg(F.sum("bytes").alias("evidence_bytes"), F.sum(F.when(F.col("kind") == "checkpoint", F.col("bytes")).otherwise(0)).alias("checkpoint_bytes"))
    return sums.join(sources, by).withColumn("ratio", F.try_divide(F.col("evidence_bytes"), F.col("source_bytes"))).drop("source_bytes")


def cacheability(deterministic: Column, seed: Column) -> Column:
    return F.when(deterministic, "deterministic").when(seed.isNotNull(), "seeded").otherwise("uncacheable")


def replayed(initial: DataFrame, deltas: DataFrame, by: list[str], order: str) -> DataFrame:
    """As ``materialized``, but a region with different selections raises instead of the last one winning."""
    why = F.concat(F.lit("conflicting selections: "), F.concat_ws("/", *[F.col(b).cast("string") for b in by]))
    found = conflicts(deltas, by).select(*by, F.raise_error(why).cast("string").alias("conflict"))
    return materialized(initial, deltas, by, order).join(found, by, "left").where("conflict is null").drop("conflict")


def collected(blobs: DataFrame, referenced: DataFrame, leased: DataFrame) -> DataFrame:
    """How many blobs are garbage and their bytes."""
    return garbage(blobs, referenced, leased).agg(F.count("*").alias("removed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("removed_bytes"))


def resolved_blobs(references: DataFrame, blobs: DataFrame, most_bytes: int) -> DataFrame:
    """References with their bytes; one that is missing, too large, or of another digest says so instead."""
    rows = references.join(blobs.select("blob_id", "content"), "blob_id", "left")
    why = F.when(F.col("content").isNull(), "missing").when(F.octet_length("content") > most_bytes, "too_large").when(F.sha2("content", 256) != F.col("digest"), "digest_differs")
    return rows.withColumn("violation", why).withColumn("content", F.when(why.isNull(), F.col("content")))


def physical_cores(processors: DataFrame, by: list[str]) -> DataFrame:
    """Different cores among logical processors."""
    return processors.groupBy(*by).agg(F.count_distinct("package", "core").alias("cores"))
