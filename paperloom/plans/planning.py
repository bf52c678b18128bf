"""Queries of the planner, of state, routing and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, identity
from ..operators import evaluate, planner, routing, state
from .tables import CANDIDATES_SQL, INVENTORY, POLICY, RECORDS_SQL, candidates, deltas, read, records

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


DECIDED = f"""SELECT *, array_to_string(list_filter([
    CASE WHEN NOT has_layout THEN 'capability_unsupported' END, CASE WHEN descriptor_id <> engine_id THEN 'descriptor_mismatch' END, CASE WHEN NOT compatible THEN 'device_incompatible' END,
    CASE WHEN device = 'cuda:1' THEN 'device_incompatible' END, CASE WHEN NOT installed THEN 'model_unavailable' END, CASE WHEN online THEN 'offline_violation' END,
    CASE WHEN ram IS NULL THEN 'ram_unknown' WHEN ram > 4000 THEN 'ram_budget_exceeded' END, CASE WHEN vram IS NULL THEN 'vram_unknown' WHEN vram > 400 THEN 'vram_budget_exceeded' END,
    CASE WHEN cost IS NULL THEN 'cost_unknown' WHEN cost > 80 THEN 'cost_budget_exceeded' END, CASE WHEN latency IS NULL THEN 'latency_unknown' WHEN latency > 350 THEN 'deadline_exceeded' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM ({CANDIDATES_SQL})"""


@query(f"SELECT engine_id, reasons, reasons = '' AS accepted FROM ({DECIDED})")
def planner_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.decisions(candidates(spark, sf_dir), POLICY, INVENTORY).select("engine_id", F.array_join("reasons", ",").alias("reasons"), "accepted")


ORDERS = {"fast": "latency NULLS LAST", "accurate": "quality DESC NULLS LAST", "cheap": "cost NULLS LAST", "balanced": "quality DESC NULLS LAST, latency NULLS LAST, cost NULLS LAST"}


def _selected(profile: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        decided = planner.decisions(candidates(spark, sf_dir), POLICY, INVENTORY)
        return planner.selected(decided, profile, ["request"], "cuda:0").select("request", "engine_id", "backend", "device")

    return run


for _profile, _order in ORDERS.items():
    QUERIES[f"planner_selected_{_profile}"] = _selected(_profile)
    SQL[f"planner_selected_{_profile}"] = f"SELECT request, engine_id, backend, device FROM ({DECIDED}) WHERE reasons = '' QUALIFY row_number() OVER (PARTITION BY request ORDER BY CASE WHEN device = 'cuda:0' THEN 0 ELSE 1 END, {_order}, engine_id, backend, device) = 1"


@query("""SELECT a.n_name AS choice_0, b.n_name AS choice_1 FROM nation a, nation b WHERE a.n_regionkey = 0 AND b.n_regionkey = 1""")
def candidate_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("goal"), F.col("n_name").alias("choice"))
    return planner.combinations(choices, [0, 1])


@query("""WITH p AS (SELECT l_orderkey AS plan_id, l_partkey % 50 AS cost, CASE WHEN l_suppkey % 40 <> 0 THEN l_quantity::BIGINT END AS latency, l_partkey % 900 AS ram FROM lineitem),
    s AS (SELECT plan_id, sum(cost)::BIGINT AS cost, CASE WHEN count(latency) = count(*) THEN sum(latency) END::BIGINT AS latency, max(ram) AS ram FROM p GROUP BY plan_id)
    SELECT *, array_to_string(list_filter([CASE WHEN cost > 120 THEN 'cost_budget_exceeded' END, CASE WHEN latency IS NULL THEN 'latency_unknown' WHEN latency > 100 THEN 'deadline_exceeded' END], lambda x: x IS NOT NULL), ',') AS reasons,
        cost <= 120 AND latency IS NOT NULL AND coalesce(latency <= 100, false) AS admitted FROM s""")
def aggregate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    parts = l.select(F.col("l_orderkey").alias("plan_id"), (F.col("l_partkey") % 50).alias("cost"), F.when(F.col("l_suppkey") % 40 != 0, F.col("l_quantity").cast("long")).alias("latency"), (F.col("l_partkey") % 900).alias("ram"))
    return planner.admission(parts, ["plan_id"], 120, 100)


@query("""WITH p AS (SELECT l_orderkey AS plan_id, l_linenumber AS no, CASE WHEN l_partkey % 30 <> 0 THEN l_partkey % 900 END AS point, ['measured', 'estimated', 'assumed', 'unknown'][l_suppkey % 4 + 1] AS confidence, 'd' || l_partkey % 2 AS digest FROM lineitem)
    SELECT plan_id, CASE WHEN count(point) = count(*) THEN least(sum(point), 10000) END::BIGINT AS lower, CASE WHEN count(point) = count(*) THEN least(sum(point + 10), 10000) END::BIGINT AS point, CASE WHEN count(point) = count(*) THEN least(sum(point + 25), 10000) END::BIGINT AS upper,
        arg_min(confidence, (CASE confidence WHEN 'measured' THEN 3 WHEN 'estimated' THEN 2 WHEN 'assumed' THEN 1 ELSE 0 END) * 100 + no) AS confidence, CASE WHEN min(digest) = max(digest) THEN min(digest) END AS digest FROM p GROUP BY plan_id""")
def estimate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.when(F.col("l_partkey") % 30 != 0, F.col("l_partkey") % 900)
    levels = F.array(*[F.lit(c) for c in planner.CONFIDENCE])
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("no"), point.alias("lower"), (point + 10).alias("point"), (point + 25).alias("upper"), F.get(levels, (F.col("l_suppkey") % 4).cast("int")).alias("confidence"), F.concat(F.lit("d"), (F.col("l_partkey") % 2).cast("string")).alias("digest"))
    return planner.interval(rows, ["plan_id"], "sum_capped", "no")


@query(f"SELECT request, device_kind, CASE WHEN count(latency) = count(*) THEN sum(latency) END::BIGINT AS millis, count(*) AS invocations FROM ({CANDIDATES_SQL}) WHERE device_kind <> 'cpu' GROUP BY request, device_kind")
def accelerator_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planner.device_millis(candidates(spark, sf_dir), ["request"])


STAGES_SQL = """
    WITH g AS (SELECT n_nationkey AS doc, unnest(['ocr', 'table', 'formula']) AS capability, n_nationkey % 3 AS p FROM nation UNION ALL SELECT n_nationkey, 'ocr', NULL FROM nation WHERE n_nationkey % 6 = 0),
    goal AS (SELECT DISTINCT doc, capability, p::VARCHAR AS page FROM g WHERE NOT (capability = 'formula' AND doc % 8 <> 0)),
    cov AS (SELECT n_nationkey AS doc, 'text' AS capability, NULL::VARCHAR AS page FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, 'ocr', (n_nationkey % 3)::VARCHAR FROM nation WHERE n_nationkey % 4 = 0),
    stage AS (SELECT * FROM (VALUES ('read', 'ocr', false, 1), ('read.whole', 'ocr', true, 2), ('grid', 'table', false, 3), ('grid.text', 'table', false, 4)) s(stage_id, capability, whole_document, engine)),
    need AS (SELECT * FROM (VALUES ('grid.text', 'text'), ('grid', 'ocr')) n(stage_id, needed)),
    cand AS (SELECT * FROM (VALUES (1, 'cpu', 5, 40, 100, true), (1, 'cuda:0', 9, 4, 300, true), (2, 'cpu', 7, NULL, 50, true), (3, 'cpu', 1, 10, 80, true), (4, 'cpu', 2, 20, 70, true), (4, 'cuda:0', 3, 2, 400, false)) c(engine, device, cost, latency, ram, accepted)),
    open_ AS (SELECT * FROM goal g WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.doc = g.doc AND c.capability = g.capability AND (c.page IS NULL OR c.page = g.page))),
    tried AS (SELECT o.*, s.stage_id, s.engine, CASE WHEN NOT whole_document THEN o.page END AS scope FROM open_ o JOIN stage s USING (capability)),
    lack AS (SELECT DISTINCT t.doc, t.stage_id, t.scope, n.needed FROM tried t JOIN need n USING (stage_id) WHERE NOT EXISTS (SELECT 1 FROM cov c WHERE c.doc = t.doc AND c.capability = n.needed AND (c.page IS NULL OR c.page = t.scope))),
    free AS (SELECT * FROM tried t WHERE NOT EXISTS (SELECT 1 FROM lack l WHERE l.doc = t.doc AND l.stage_id = t.stage_id AND l.scope IS NOT DISTINCT FROM t.scope)),
    choice AS (SELECT DISTINCT doc, capability, page, stage_id, scope, 'engine-' || engine AS engine_id, 'native' AS backend, device, cost::BIGINT AS cost, latency::BIGINT AS latency, ram::BIGINT AS ram FROM free JOIN cand USING (engine) WHERE accepted)"""


def enrichment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as documents with goals on a page or the whole, and four stages to meet them."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc"))
    page = (F.col("doc") % 3).cast("string")
    goals = n.select("doc", F.explode(F.array(*[F.lit(c) for c in ("ocr", "table", "formula")])).alias("capability"), page.alias("page")).where("capability <> 'formula' or doc % 8 = 0")
    goals = goals.unionByName(n.where("doc % 6 = 0").select("doc", F.lit("ocr").alias("capability"), F.lit(None).cast("string").alias("page")))
    coverage = n.where("doc % 5 <> 0").select("doc", F.lit("text").alias("capability"), F.lit(None).cast("string").alias("page")).unionByName(n.where("doc % 4 = 0").select("doc", F.lit("ocr").alias("capability"), page.alias("page")))
    stages = spark.createDataFrame([("read", "ocr", False, "engine-1"), ("read.whole", "ocr", True, "engine-2"), ("grid", "table", False, "engine-3"), ("grid.text", "table", False, "engine-4")], "stage_id string, produces string, whole_document boolean, engine_id string")
    requires = spark.createDataFrame([("grid.text", "text"), ("grid", "ocr")], "stage_id string, capability string")
    rows = [("engine-1", "cpu", 5, 40, 100, True), ("engine-1", "cuda:0", 9, 4, 300, True), ("engine-2", "cpu", 7, None, 50, True), ("engine-3", "cpu", 1, 10, 80, True), ("engine-4", "cpu", 2, 20, 70, True), ("engine-4", "cuda:0", 3, 2, 400, False)]
    decided = spark.createDataFrame(rows, "engine_id string, device string, cost long, latency long, ram long, accepted boolean").withColumn("backend", F.lit("native")).withColumn("reasons", F.when(~F.col("accepted"), F.array(F.lit("ram_budget_exceeded"))).otherwise(F.array().cast("array<string>")))
    return planner.goal_choices(goals, stages, requires, coverage, decided)


@query(STAGES_SQL + " SELECT * FROM choice")
def enrichment_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment(spark, sf_dir)[0]


@query(STAGES_SQL + """ SELECT doc, 'stage ' || stage_id || ' requires ' || needed AS reason FROM lack UNION SELECT doc, 'stage ' || stage_id || ': ram_budget_exceeded' FROM free JOIN cand USING (engine) WHERE NOT accepted
    UNION SELECT doc, 'no registered stage produces ' || capability FROM open_ WHERE capability = 'formula'""")
def enrichment_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment(spark, sf_dir)[1]


#: Goals are three at most: the whole document's recognition, a page's, and a page's tables.
PLANS_SQL = STAGES_SQL + """, w AS (SELECT *, concat_ws('/', stage_id, capability, coalesce(scope, '*'), engine_id, backend, device) AS shown FROM choice),
    way AS (SELECT d.doc, a.shown AS a, b.shown AS b, c.shown AS c FROM (SELECT DISTINCT doc FROM w) d LEFT JOIN w a ON a.doc = d.doc AND a.capability = 'ocr' AND a.page IS NULL LEFT JOIN w b ON b.doc = d.doc AND b.capability = 'ocr' AND b.page IS NOT NULL LEFT JOIN w c ON c.doc = d.doc AND c.capability = 'table'),
    part AS (SELECT doc, list_distinct(list_filter([a, b, c], lambda x: x IS NOT NULL)) AS part FROM way),
    kept AS (SELECT doc, list_filter(part, lambda x: NOT (contains(x, '/ocr/') AND NOT contains(x, '/ocr/*/') AND len(list_filter(part, lambda y: contains(y, '/ocr/*/'))) > 0)) AS part FROM part),
    plan AS (SELECT DISTINCT doc, list_sort(part) AS part FROM kept),
    inv AS (SELECT doc, part, unnest(part) AS shown FROM plan), cost AS (SELECT DISTINCT doc, shown, cost, latency, ram FROM w),
    tot AS (SELECT doc, array_to_string(part, chr(10)) AS plan, count(*) AS invocations, sum(cost)::BIGINT AS cost, CASE WHEN count(latency) = count(*) THEN sum(latency) END::BIGINT AS latency, max(ram)::BIGINT AS ram FROM inv JOIN cost USING (doc, shown) GROUP BY doc, part)"""


@query(PLANS_SQL + " SELECT doc, sha256(plan) AS plan_id, invocations, cost, latency, ram FROM tot")
def enrichment_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = planner.plan_totals(planner.document_plans(enrichment(spark, sf_dir)[0]))
    return plans.select("doc", "plan_id", F.size("plan").cast("long").alias("invocations"), "cost", "latency", "ram")


@query(PLANS_SQL + " SELECT doc, sha256(plan) AS plan_id, cost, latency, ram FROM tot r WHERE NOT EXISTS (SELECT 1 FROM tot o WHERE o.doc = r.doc AND o.cost <= r.cost AND o.latency <= r.latency AND o.ram <= r.ram AND (o.cost < r.cost OR o.latency < r.latency OR o.ram < r.ram))")
def enrichment_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = planner.plan_totals(planner.document_plans(enrichment(spark, sf_dir)[0])).drop("plan")
    return planner.frontier(plans, ["doc"], ["cost", "latency", "ram"], [], "plan_id")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_size, p_retailprice AS price, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 100 END AS quality FROM part)
    SELECT p_partkey, p_brand, p_size, price, quality FROM p r WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.p_brand = r.p_brand AND o.p_size <= r.p_size AND o.price <= r.price AND o.quality >= r.quality AND (o.p_size < r.p_size OR o.price < r.price OR o.quality > r.quality))""")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 9 != 0, F.col("p_partkey") % 100).alias("quality"))
    return planner.frontier(p, ["p_brand"], ["price", "p_size"], ["quality"], "p_partkey")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, s_suppkey % 60 AS lo, s_suppkey % 60 + s_suppkey % 7 AS hi FROM supplier)
    SELECT s_suppkey, s_nationkey FROM s r WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.s_nationkey = r.s_nationkey AND o.hi < r.lo)""")
def pareto_interval_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation whose cost interval no other lies wholly below."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 60).alias("cost_lower"), (F.col("s_suppkey") % 60 + F.col("s_suppkey") % 7).alias("cost_upper"))
    # The nation's least upper bound dominates whatever any other does, so no pairs are needed.
    least = s.groupBy("s_nationkey").agg(F.min("cost_upper").alias("cost_upper"), F.min("cost_upper").alias("cost_lower"))
    return s.alias("r").join(least.alias("o"), (F.col("o.s_nationkey") == F.col("r.s_nationkey")) & planner.dominated_by_interval("o", "r", ["cost"], []), "left_anti").select("s_suppkey", "s_nationkey")


@query(f"""WITH c AS ({CANDIDATES_SQL}) SELECT engine_id AS plan_id, unnest(list_filter([CASE WHEN request LIKE '%1' THEN 'whole_document' END, CASE WHEN device <> 'cpu' THEN 'accelerator' END, CASE WHEN online THEN 'network' END, CASE WHEN NOT installed THEN 'cold_cache' END,
    CASE WHEN has_layout THEN 'prerequisites' END, CASE WHEN cost IS NULL OR latency IS NULL THEN 'unknown_estimate' END, CASE WHEN quality IS NULL THEN 'low_confidence' END], lambda x: x IS NOT NULL)) AS escalation FROM c""")
def plan_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    needs = F.filter("capabilities", lambda x: x == "layout")
    rows = c.select(F.col("engine_id").alias("plan_id"), F.when(F.col("request").endswith("1"), "document").otherwise("page").alias("scope"), "device", "network_use", F.col("installed").alias("cached"), needs.alias("requires"), "cost", "latency", F.when(F.col("quality").isNull(), "unknown").otherwise("measured").alias("confidence"))
    return planner.escalations(rows)


@query("""SELECT o_custkey AS doc, count(*) AS evidence_count, max_by('e' || o_orderkey, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS selected FROM orders GROUP BY o_custkey""")
def delta_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deltas(spark, sf_dir)
    return state.materialized(d.limit(0), d, ["doc"], "seq")


@query(SQL["delta_materialize"])
def delta_from_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint of the first orders, and the rest as its tail: the same as a replay of all."""
    d = deltas(spark, sf_dir)
    checkpoint = state.materialized(d.limit(0), d.where("seq <= 4000"), ["doc"], "seq")
    return state.from_checkpoint(checkpoint, d.where("seq > 4000"), ["doc"], "seq")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS doc, 'delta_' || sha256(encode('delta') || unhex('00') || unhex(lpad(printf('%x', strlen(o_custkey::VARCHAR)), 16, '0')) || encode(o_custkey::VARCHAR) || unhex(lpad(printf('%x', strlen('e' || o_orderkey)), 16, '0')) || encode('e' || o_orderkey)) AS id FROM orders),
    s AS (SELECT doc, count(*) AS deltas, string_agg(id, e'\\n' ORDER BY id) AS ids FROM d GROUP BY doc)
    SELECT doc, deltas, 'state_' || sha256(encode('state') || unhex('00') || unhex(lpad(printf('%x', strlen(ids)), 16, '0')) || encode(ids)) AS state_id FROM s""")
def state_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.state_id(state.delta_ids(deltas(spark, sf_dir), ["doc", "evidence"]), ["doc"])


@query("SELECT o_custkey AS doc, count(DISTINCT o_orderkey) AS selections FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1 HAVING count(DISTINCT o_orderkey) > 1")
def selection_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.conflicts(deltas(spark, sf_dir), ["doc"])


@query("""WITH g AS (SELECT n_regionkey AS doc, 'ocr' AS capability, n_nationkey % 4 AS page, n_nationkey AS region FROM nation)
    SELECT * FROM g WHERE NOT (doc = 0) AND NOT (doc = 1 AND page = 2) AND NOT (doc = 2 AND page = 1 AND region % 3 = 0)""")
def coverage_missing_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region 0 is covered as a whole, a page of region 1, and some parts of a page of region 2; candidates don't count."""
    goals = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), F.lit("ocr").alias("capability"), (F.col("n_nationkey") % 4).alias("page"), F.col("n_nationkey").alias("region"))
    parts = [(2, "ocr", 1, n, "complete") for n in range(0, 25, 3)]
    coverage = spark.createDataFrame([(0, "ocr", None, None, "complete"), (1, "ocr", 2, None, "complete"), (3, "ocr", None, None, "candidate"), *parts], "doc int, capability string, page int, region int, status string")
    return state.missing_goals(goals, coverage)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey * 2 NOT IN (SELECT s_suppkey FROM supplier)")
def validation_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") * 2).alias("s_suppkey"))
    return state.orphans(lines, read(spark, sf_dir, "supplier"), ["s_suppkey"]).select("l_orderkey", "l_linenumber")


@query("""WITH live AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 UNION SELECT l_partkey FROM lineitem WHERE l_linenumber = 7 AND l_quantity > 40)
    SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT k FROM live)""")
def blob_garbage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    blobs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("digest"), "p_size")
    found = state.garbage(blobs, lines.where("l_returnflag = 'R' and l_quantity > 48").select(F.col("l_partkey").alias("digest")), lines.where("l_linenumber = 7 and l_quantity > 40").select(F.col("l_partkey").alias("digest")))
    return found.withColumnRenamed("digest", "p_partkey")


@query(f"""SELECT doc_id, 'native' AS always_native, CASE WHEN characters >= 32 THEN 'native' ELSE 'ocr' END AS native_threshold, CASE WHEN characters >= 32 AND NOT doc_id % 8 >= 4 THEN 'native' ELSE 'ocr' END AS page_type_rules,
    CASE WHEN doc_id % 10 >= 5 THEN 'ocr' ELSE 'native' END AS profile_accurate, CASE WHEN characters > 0 THEN 'native' ELSE 'ocr' END AS profile_fast, CASE WHEN characters >= 32 THEN 'native' ELSE 'ocr' END AS profile_balanced FROM ({RECORDS_SQL})""")
def baseline_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    routes = routing.baseline_routes(F.col("characters"), (F.col("doc_id") % 8) / 8.0, (F.col("doc_id") % 10) / 10.0)
    return rows.select("doc_id", *[c.alias(n) for n, c in routes.items()])


STUMPS = f"""WITH r AS (SELECT * FROM ({RECORDS_SQL}) WHERE part = 'train'), t AS (SELECT DISTINCT characters AS threshold FROM r WHERE characters IS NOT NULL UNION SELECT 0), f AS (SELECT unnest([false, true]) AS flag),
    d AS (SELECT threshold, flag, characters IS NULL OR (characters >= threshold) = flag AS nat, r.* FROM t, f, r)
    SELECT threshold, flag AS native_if_at_least, round(avg(CASE WHEN nat THEN native_quality ELSE ocr_quality END) - avg(CASE WHEN nat THEN native_failed ELSE ocr_failed END) - avg(CASE WHEN nat THEN native_millis ELSE ocr_millis END) / 1000 * 0.001, 9) AS objective FROM d GROUP BY 1, 2"""


@query(STUMPS)
def stump_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.stump_objectives(records(spark, sf_dir).where("partition = 'train'")).withColumn("objective", F.round("objective", 9))


@query(f"SELECT * FROM ({STUMPS}) ORDER BY objective DESC, threshold, native_if_at_least LIMIT 1")
def stump_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.best_stump(routing.stump_objectives(records(spark, sf_dir).where("partition = 'train'")))


@query(f"""SELECT doc_id, CASE WHEN ok THEN rec WHEN doc_id % 3 = 0 THEN 'a' ELSE 'b' END AS route, CASE WHEN ok THEN 'model' ELSE 'fallback' END AS "by" FROM (
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS rec, doc_id % 10 / 10.0 >= 0.3 AND characters IS NOT NULL AND (doc_id % 3 = 0 OR doc_id % 2 = 1) AS ok FROM ({RECORDS_SQL}))""")
def guarded_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))
    rows = records(spark, sf_dir).select("doc_id", "characters", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("recommended"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"), F.lit(0.3).alias("floor"), F.lit(True).alias("qualified"), accepted.alias("accepted"), F.array(F.lit("a"), F.lit("b")).alias("fallback"))
    return routing.guarded(rows).select("doc_id", "route", "by")


QUALIFIED = f"""WITH best AS (SELECT * FROM ({STUMPS}) ORDER BY objective DESC, threshold, native_if_at_least LIMIT 1),
    h AS (SELECT * FROM ({RECORDS_SQL}) WHERE part = 'held_out'),
    route AS (SELECT 'stump' AS policy, characters IS NULL OR (characters >= threshold) = native_if_at_least AS nat, h.* FROM h, best UNION ALL SELECT 'always_native', true, h.* FROM h UNION ALL SELECT 'native_threshold', coalesce(characters >= 32, false), h.* FROM h
        UNION ALL SELECT 'page_type_rules', coalesce(characters >= 32, false) AND doc_id % 8 < 4, h.* FROM h UNION ALL SELECT 'profile_balanced', coalesce(characters >= 32, false), h.* FROM h),
    e AS (SELECT policy, count(*) AS cases, avg(CASE WHEN nat THEN native_quality ELSE ocr_quality END) AS quality, avg(CASE WHEN nat THEN native_failed ELSE ocr_failed END) AS failure_rate, avg(CASE WHEN nat THEN native_millis ELSE ocr_millis END) AS millis FROM route GROUP BY policy),
    o AS (SELECT *, quality - failure_rate - millis / 1000 * 0.001 AS objective FROM e)"""


def qualification(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = records(spark, sf_dir)
    features = {"scanned": (F.col("doc_id") % 8) / 8.0, "images": (F.col("doc_id") % 10) / 10.0}
    return routing.qualified(rows, features)


@query(QUALIFIED + " SELECT policy, cases, round(quality, 9) AS quality, round(failure_rate, 9) AS failure_rate, round(millis, 9) AS millis, round(objective, 9) AS objective FROM o")
def held_out_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stump learnt on training records and the baselines, all on the held-out ones."""
    found, _ = qualification(spark, sf_dir)
    return found.select("policy", "cases", *[F.round(c, 9).alias(c) for c in ("quality", "failure_rate", "millis", "objective")])


@query(QUALIFIED + f""", c AS (SELECT count(characters)::DOUBLE / count(*) AS confidence FROM ({RECORDS_SQL}) WHERE part = 'train'), b AS (SELECT max(objective) AS best FROM o WHERE policy <> 'stump')
    SELECT round(confidence, 9) AS confidence, round(s.objective, 9) AS objective, round(best, 9) AS best_baseline, confidence >= 0.5 AND s.objective > best + 0.001 AS qualified,
        CASE WHEN confidence < 0.5 THEN 'training feature coverage is below the declared confidence floor' WHEN s.objective <= best + 0.001 THEN 'model did not beat deterministic baselines on identical held-out cases' END AS reason FROM c, b, (SELECT objective FROM o WHERE policy = 'stump') s""")
def stump_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, verdict = qualification(spark, sf_dir)
    return verdict.select(*[F.round(c, 9).alias(c) for c in ("confidence", "objective", "best_baseline")], "qualified", "reason")


@query(f"SELECT part AS partition, count(*) AS records, count(characters) AS observed FROM ({RECORDS_SQL}) GROUP BY part")
def record_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.partition_counts(records(spark, sf_dir))


@query("""WITH r AS (SELECT doc_id AS case_id, quality FROM labels), o AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 23 = 0 THEN 1.5 WHEN doc_id % 31 = 0 THEN quality + 0.25 ELSE quality END::DOUBLE AS quality, CASE WHEN doc_id % 29 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS named FROM labels)
    SELECT case_id, 'outcome_of_other_case' AS violation FROM o WHERE case_id % 29 = 0 UNION ALL SELECT case_id, 'quality_out_of_range' FROM o WHERE case_id % 23 = 0 OR quality > 1
    UNION ALL SELECT o.case_id, 'differs_from_report' FROM o JOIN r ON o.named = r.case_id WHERE o.quality <> r.quality UNION ALL SELECT case_id, 'absent_from_report' FROM o WHERE case_id % 29 = 0""")
def outcome_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes copied from a report, some of them wrong."""
    i, labels = F.col("case_id"), read(spark, sf_dir, "labels")
    report = labels.select(F.col("doc_id").alias("case_id"), F.col("quality").cast("double").alias("quality"))
    copied = report.select("case_id", F.lit("e").alias("engine_id"), F.when(i % 29 == 0, i + 1_000_000_000).otherwise(i).alias("outcome_case_id"), F.when(i % 23 == 0, 1.5).when(i % 31 == 0, F.col("quality") + 0.25).otherwise(F.col("quality")).alias("quality"))
    return routing.outcome_violations(copied, report)


@query("SELECT source AS family_id, count(DISTINCT doc_id % 3) AS partitions FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1")
def family_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.family_conflicts(read(spark, sf_dir, "documents").select(F.col("source").alias("family_id"), (F.col("doc_id") % 3).alias("partition")))


STATUS = "CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'failed' ELSE 'pending' END"


@query(f"""WITH e AS (SELECT event_id, user_id, ts, {STATUS} AS status FROM events), s AS (SELECT *, count(*) FILTER (WHERE status <> 'pending') OVER (PARTITION BY user_id) AS spent, count(*) FILTER (WHERE status = 'pending') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM e)
    SELECT event_id, user_id, spent + nth AS place, spent + nth <= 20 AS admitted FROM s WHERE status = 'pending'""")
def ledger_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return routing.admitted(e.select("event_id", "user_id", "ts", status.alias("status")), ["user_id"], ["ts", "event_id"], 20).select("event_id", "user_id", "place", "admitted")


@query("""SELECT event_id, user_id, sum(CASE WHEN event_type = 'click' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS held,
    sum(CASE WHEN event_type = 'click' THEN -1 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) > 4 AS exceeded FROM events""")
def lease_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("delta", F.when(F.col("event_type") == "click", -1).otherwise(1))
    return routing.leases(e, ["user_id"], ["ts", "event_id"], 4).select("event_id", "user_id", "held", "exceeded")


@query(f"""WITH e AS (SELECT event_id, user_id, ts, value, {STATUS} AS status FROM events), s AS (SELECT *, coalesce(sum(CASE WHEN status <> 'pending' THEN value END) OVER (PARTITION BY user_id), 0) + sum(CASE WHEN status = 'pending' THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS wall FROM e)
    SELECT user_id, count(*) FILTER (WHERE status = 'complete') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'pending' AND wall - value < 500) AS runnable FROM s GROUP BY user_id""")
def ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials by state, and how many pending ones start before the wall budget is spent."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "failed").otherwise("pending")
    trials = e.select("user_id", "ts", "event_id", status.alias("status"), F.col("value").alias("wall_ms"))
    return routing.ledger_counts(trials, ["user_id"], ["ts", "event_id"], 500)


@query("""WITH t AS (SELECT p_brand AS spec, p_name AS trial_id, p_partkey FROM part) SELECT spec, 'duplicate_trial' AS violation, trial_id AS "at" FROM t GROUP BY spec, trial_id HAVING count(*) > 1
    UNION ALL SELECT spec, 'output_aliases_protected', 'out/' || (p_partkey % 50) FROM t WHERE p_partkey % 50 = 7 UNION ALL SELECT spec, 'path_not_relative', '/out' FROM t WHERE p_partkey % 50 = 9 UNION ALL SELECT spec, 'no_such_trial', 'x' || p_partkey FROM t WHERE p_partkey % 40 = 0""")
def experiment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as trials of a brand's experiment, their reports, and a ledger."""
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("spec"), F.col("p_name").alias("trial_id"), F.col("p_partkey").alias("k"))
    k = F.col("k") % 50
    trials = p.select("spec", "trial_id", F.when(k == 9, "/out").otherwise(F.concat(F.lit("out/"), k.cast("string"))).alias("raw_report"))
    protected = p.select("spec").distinct().select("spec", F.lit("out/7").alias("path"), F.lit("benchmark_truth").alias("role")).unionByName(p.select("spec").distinct().select("spec", F.lit("metrics").alias("path"), F.lit("metric_code").alias("role")))
    ledger = p.select("spec", F.when(F.col("k") % 40 == 0, F.concat(F.lit("x"), F.col("k").cast("string"))).otherwise(F.col("trial_id")).alias("trial_id"))
    return routing.experiment_violations(trials, protected, ledger)


@query("""WITH b AS (SELECT o_orderkey AS k, 'b' || (o_orderkey % 700) AS value, o_totalprice FROM orders), s AS (SELECT k % 500 AS key, value FROM b WHERE k % 2 = 0), f AS (SELECT key, min(value) AS value FROM s GROUP BY key),
    q AS (SELECT k, k % 500 AS key FROM b WHERE k % 2 = 1 OR k % 10 = 0) SELECT q.k AS request, q.key, CASE WHEN q.key % 90 = 0 THEN NULL ELSE f.value END AS value, f.value IS NOT NULL AND q.key % 90 <> 0 AS hit FROM q LEFT JOIN f USING (key)""")
def stage_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values put in a cache, first by value wins; some were damaged since and are no hits."""
    k, orders = F.col("o_orderkey"), read(spark, sf_dir, "orders")
    puts = orders.where(k % 2 == 0).select((k % 500).alias("key"), F.concat(F.lit("b"), (k % 700).cast("string")).alias("value"))
    store = state.put(puts.limit(0).withColumn("digest", F.lit("")), puts)
    store = store.withColumn("value", F.when(F.col("key") % 90 == 0, "damaged").otherwise(F.col("value")))
    requests = orders.where((k % 2 == 1) | (k % 10 == 0)).select(k.alias("request"), (k % 500).alias("key"))
    return state.cached(requests, store).select("request", "key", "value", "hit")


@query("""SELECT o_custkey AS doc, sum(o_orderkey)::BIGINT AS evidence_bytes, sum(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey ELSE 0 END)::BIGINT AS checkpoint_bytes, CASE WHEN min(o_custkey) % 10 <> 0 THEN round(sum(o_orderkey)::DOUBLE / min(o_custkey * 100), 9) END AS ratio FROM orders GROUP BY o_custkey""")
def durable_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("doc"), F.when(F.col("o_orderkey") % 4 == 0, "checkpoint").otherwise("delta").alias("kind"), F.col("o_orderkey").alias("bytes"))
    sources = o.select(F.col("o_custkey").alias("doc")).distinct().withColumn("source_bytes", F.when(F.col("doc") % 10 == 0, 0).otherwise(F.col("doc") * 100))
    return state.sizes(rows, sources, ["doc"]).withColumn("ratio", F.round("ratio", 9))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'deterministic' WHEN n_nationkey % 3 = 1 THEN 'seeded' ELSE 'uncacheable' END AS cacheability, CASE WHEN n_regionkey = 1 THEN CASE WHEN n_nationkey % 5 > 2 THEN 'newer_minor' ELSE 'compatible' END ELSE 'incompatible_major' END AS compatibility,
    (299 * (n_nationkey * 7) + 587 * (n_nationkey * 5) + 114 * (n_nationkey * 3)) // 1000 AS luminance, ['heading', 'paragraph', 'table', 'formula', 'paragraph'][n_nationkey % 5 + 1] AS block_kind FROM nation""")
def small_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    kind = F.get(F.array(*[F.lit(k) for k in ("heading", "caption", "table", "formula", "list")]), (n % 5).cast("int"))
    return read(spark, sf_dir, "nation").select(
        "n_nationkey", state.cacheability(n % 3 == 0, F.when(n % 3 == 1, n)).alias("cacheability"), identity.compatibility(F.col("n_regionkey"), n % 5, 1, 2).alias("compatibility"), geometry.luminance(n * 7, n * 5, n * 3).cast("int").alias("luminance"), evaluate.block_kind(kind).alias("block_kind")
    )
