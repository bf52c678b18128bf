"""Typed JSON and delta tables in and out, manifests, and a seeded corpus of cases."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from . import pdf

PARTITIONS = ("train", "tuning", "regression", "held_out")
TRUTH = "case_id string, partition string, text string, regions array<struct<id:string,kind:string,text:string,rect:struct<x:double,y:double,width:double,height:double>>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents of a known form; one that isn't fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def generated(spark: SparkSession, cases: int, seed: int) -> DataFrame:
    """Cases with their truth, the same for a seed wherever they are made."""
    rows = spark.range(cases).select(F.col("id").alias("case_no"))
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(seed), "case_no", F.lit(k)), F.lit(n))
    case = F.concat(F.lit("case_"), F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("case_no").cast("string")), 256), 1, 16))
    part = F.get(F.array(*[F.lit(p) for p in PARTITIONS]), draw(0, 4).cast("int"))
    word = lambda k: F.get(F.array(*[F.lit(w) for w in ("amber", "birch", "cedar", "delta", "ember", "fjord")]), draw(k, 6).cast("int"))
    blocks = [F.struct(F.concat(F.lit("r"), F.lit(str(i))).alias("id"), F.lit(kind).alias("kind"), F.upper(F.concat_ws(" ", word(i), word(i + 9))).alias("text") if kind == "heading" else F.concat(F.concat_ws(" ", *[word(i * 7 + j) for j in range(6)]), F.lit(".")).alias("text"), F.struct(F.lit(72.0).alias("x"), F.lit(760.0 - 60 * i).alias("y"), F.lit(400.0).alias("width"), F.lit(20.0).alias("height")).alias("rect")) for i, kind in enumerate(("heading", "paragraph", "paragraph"))]
    regions = F.array(*blocks)
    return rows.select(case.alias("case_id"), part.alias("partition"), regions.alias("regions"), F.array_join(F.transform(regions, lambda r: r["text"]), "\n").alias("text"))


def as_pdfs(cases: DataFrame) -> DataFrame:
    """``path, content, digest, bytes`` of each case as a one-page PDF."""

    def run(batches):
        for batch in batches:
            made = [pdf.page_bytes([(r["rect"]["x"], r["rect"]["y"], 12.0, r["text"]) for r in regions]) for regions in batch["regions"]]
            yield pd.DataFrame({"path": batch["case_id"] + ".pdf", "content": made, "digest": [hashlib.sha256(c).hexdigest() for c in made], "bytes": [len(c) for c in made]})

    return cases.select("case_id", "regions").mapInPandas(run, "path string, content binary, digest string, bytes long")


def corpus_digest(manifest: DataFrame) -> DataFrame:
    """One digest of a manifest's paths and digests, whatever their order."""
    line = F.concat_ws(" ", "path", "digest")
    return manifest.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("corpus_digest"))


def manifest_violations(files: DataFrame) -> DataFrame:
    """Entries of a model or corpus manifest that are not allowed."""
    again = files.groupBy("path").agg(F.count("*").alias("n"))
    why = F.when(~identity.is_relative_path(F.col("path")), "path_not_relative").when(~identity.is_digest(F.col("digest")), "digest_malformed").when(F.col("bytes") < 0, "bytes_negative").when(F.col("n") > 1, "path_repeated")
    return files.join(again, "path").withColumn("violation", why).where("violation is not null").select("path", "violation")


def noisy(pixels: bytes, seed: int, per_mille: int) -> bytes:
    """Bytes of a picture with some moved, by a shift-register sequence from a seed."""
    state, out = seed or 1, bytearray(pixels)
    for i in range(len(out)):
        state ^= (state << 13) & (1 << 64) - 1
        state ^= state >> 7
        state ^= (state << 17) & (1 << 64) - 1
        if state % 1000 < per_mille:
            out[i] = (out[i] + 1 + (state >> 32) % 17) % 256
    return bytes(out)
