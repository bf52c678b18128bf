"""Inputs of the catalogue: the tables read, and those derived from them by integer rules.

A derived input is the same rule in the DataFrame API and, beside its query, in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def boxes(spark: SparkSession, sf_dir: str, predicted: bool) -> DataFrame:
    """Regions of an order's lines; predictions are shifted, and every eleventh has another kind."""
    rows = read(spark, sf_dir, "lineitem")
    x, y = (F.col("l_partkey") % 12) * 8, (F.col("l_suppkey") % 5) * 12
    width, height = 20 + F.col("l_quantity").cast("int") % 20, 15 + F.col("l_linenumber") * 3
    if predicted:
        x, y = x + F.col("l_partkey") % 5, y + F.col("l_suppkey") % 3
    kind = F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "N", "paragraph").otherwise("heading")
    if predicted:
        kind = F.when((F.col("l_partkey") + F.col("l_linenumber")) % 11 == 0, "formula").otherwise(kind)
    return rows.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("idx"), kind.alias("kind"), geometry.rect(x, y, width, height).alias("rect"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as engines' candidates: a brand is a request; measures are unknown now and then."""
    p = F.col("p_partkey")
    device = F.when(p % 4 == 0, "cuda:0").when(p % 4 == 1, "cuda:1").otherwise("cpu")
    known = lambda every, value: F.when(p % every != 0, value)
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("request"),
        F.concat(F.lit("engine-"), p.cast("string")).alias("engine_id"),
        F.concat(F.lit("engine-"), F.when(p % 29 == 0, p + 1).otherwise(p).cast("string")).alias("descriptor_id"),
        F.when(p % 3 == 0, "onnx").otherwise("native").alias("backend"),
        device.alias("device"),
        F.split(device, ":")[0].alias("device_kind"),
        F.when(p % 5 == 0, F.array(F.lit("ocr"))).otherwise(F.array(F.lit("layout"), F.lit("ocr"))).alias("capabilities"),
        F.array(F.struct(F.lit("native").alias("backend"), F.when(p % 7 == 0, F.array(F.lit("cpu"))).otherwise(F.array(F.lit("cpu"), F.lit("cuda"))).alias("devices")), F.struct(F.when(p % 11 == 0, "other").otherwise("onnx").alias("backend"), F.array(F.lit("cpu"), F.lit("cuda")).alias("devices"))).alias("compatibility"),
        (p % 13 != 0).alias("installed"),
        F.when(p % 6 == 0, "required").otherwise("none").alias("network_use"),
        known(17, F.col("p_size").cast("long") * 100).alias("ram"),
        known(19, (p % 50) * 10).alias("vram"),
        known(23, p % 90).alias("cost"),
        known(31, p % 400).alias("latency"),
        known(37, (p % 101) / 100.0).alias("quality"),
    )


#: The same candidates in SQL.
CANDIDATES_SQL = """SELECT p_brand AS request, 'engine-' || p_partkey AS engine_id, 'engine-' || (CASE WHEN p_partkey % 29 = 0 THEN p_partkey + 1 ELSE p_partkey END) AS descriptor_id,
    CASE WHEN p_partkey % 3 = 0 THEN 'onnx' ELSE 'native' END AS backend, CASE p_partkey % 4 WHEN 0 THEN 'cuda:0' WHEN 1 THEN 'cuda:1' ELSE 'cpu' END AS device,
    CASE WHEN p_partkey % 4 < 2 THEN 'cuda' ELSE 'cpu' END AS device_kind, p_partkey % 5 <> 0 AS has_layout, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 11 <> 0 ELSE p_partkey % 4 > 1 OR p_partkey % 7 <> 0 END AS compatible, p_partkey % 13 <> 0 AS installed, p_partkey % 6 = 0 AS online,
    CASE WHEN p_partkey % 17 <> 0 THEN p_size * 100 END AS ram, CASE WHEN p_partkey % 19 <> 0 THEN p_partkey % 50 * 10 END AS vram, CASE WHEN p_partkey % 23 <> 0 THEN p_partkey % 90 END AS cost,
    CASE WHEN p_partkey % 31 <> 0 THEN p_partkey % 400 END AS latency, CASE WHEN p_partkey % 37 <> 0 THEN (p_partkey % 101) / 100.0 END AS quality FROM part"""

POLICY = {"capability": "layout", "max_ram": 4000, "max_vram": 400, "max_cost": 80, "deadline": 350, "offline": True, "placement": "auto"}
INVENTORY = {"ram_available": 4500, "vram_available": 450, "devices": ["cpu", "cuda:0"]}


def cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as cases, and labels as predictions: toxic ones failed, every tenth was skipped."""
    documents = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "lang")
    status = F.when(F.col("doc_id") % 10 == 0, "skipped").when(F.col("toxic") == 1, "failure").otherwise("success")
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), status.alias("status"), (F.lit(0.25) + F.col("quality") * 0.5).alias("quality"))
    return documents, labels


CASES_SQL = """SELECT d.doc_id AS case_id, d.lang, coalesce(CASE WHEN l.doc_id % 10 = 0 THEN 'skipped' WHEN l.toxic = 1 THEN 'failure' WHEN l.doc_id IS NOT NULL THEN 'success' END, 'failure') AS status,
    CASE WHEN l.doc_id IS NULL THEN 'missing_prediction' END AS reason, CASE WHEN l.doc_id IS NULL THEN 0.0 WHEN l.doc_id % 10 = 0 THEN NULL WHEN l.toxic = 1 THEN 0.0 ELSE 0.25 + l.quality * 0.5 END::DOUBLE AS quality
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as deltas of customers' documents: each adds evidence, some select."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("evidence"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("e"), F.col("o_orderkey").cast("string"))).alias("selected"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as routing records: native text is right for quality, recognition for length."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars"))
    rows = d.join(read(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    return rows.select(
        "doc_id",
        F.when(F.col("doc_id") % 17 != 0, n).alias("characters"),
        F.when(F.col("doc_id") % 5 == 0, "held_out").otherwise("train").alias("partition"),
        (F.col("quality") * 0.5 + F.when(n >= 300, 0.5).otherwise(0.0)).alias("native_quality"),
        F.when(n < 100, 1.0).otherwise(0.0).alias("native_failed"),
        (n % 50 + 1).cast("double").alias("native_millis"),
        (F.lit(0.75) - F.col("toxic") * 0.25).alias("ocr_quality"),
        F.when(F.col("doc_id") % 19 == 0, 1.0).otherwise(0.0).alias("ocr_failed"),
        (n % 90 + 100).cast("double").alias("ocr_millis"),
    )


RECORDS_SQL = """SELECT d.doc_id, CASE WHEN d.doc_id % 17 <> 0 THEN d.n_chars END AS characters, CASE WHEN d.doc_id % 5 = 0 THEN 'held_out' ELSE 'train' END AS part,
    l.quality * 0.5::DOUBLE + CASE WHEN n_chars >= 300 THEN 0.5::DOUBLE ELSE 0 END AS native_quality, CASE WHEN n_chars < 100 THEN 1.0::DOUBLE ELSE 0 END AS native_failed, (n_chars % 50 + 1)::DOUBLE AS native_millis,
    0.75::DOUBLE - l.toxic * 0.25::DOUBLE AS ocr_quality, CASE WHEN d.doc_id % 19 = 0 THEN 1.0::DOUBLE ELSE 0 END AS ocr_failed, (n_chars % 90 + 100)::DOUBLE AS ocr_millis
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
