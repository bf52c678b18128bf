"""The planner: hard limits decide, then a profile orders, then plans that are dominated go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More combinations of choices than this are an error, not cut off.
MOST_PLANS = 64
CONFIDENCE = {"measured": 3, "estimated": 2, "assumed": 1, "unknown": 0}


def over_limit(value: Column, limit: Column, unknown: str, exceeded: str, allow_unknown: bool = False) -> Column:
    """A reason code, or null: no limit passes, an unknown value fails unless allowed."""
    lenient = F.lit(None).cast("string") if allow_unknown else F.lit(unknown)
    return F.when(limit.isNotNull() & value.isNull(), lenient).when(value > limit, F.lit(exceeded))


def effective_limit(policy: Column, available: Column) -> Column:
    """The smaller of those that are known."""
    return F.least(policy, available)


def placement_matches(placement: Column, required: Column, device: Column) -> Column:
    return F.when(placement == "cpu_only", device == "cpu").when(placement == "require", device == required).otherwise(True)


def decisions(candidates: DataFrame, policy: dict, inventory: dict) -> DataFrame:
    """Every candidate with its reasons; without one it is accepted.

    ``candidates``: engine_id, descriptor_id, backend, device, device_kind, capabilities (an
    array), compatibility (an array of backend and its devices), installed, network_use, ram, vram,
    cost, latency, quality.  A device that its backend isn't declared for, and one that isn't
    there, are a reason each of the same code.
    """
    lit = lambda name, source=policy: F.lit(source.get(name)).cast("long")
    online = F.col("network_use") != "none"
    never = F.lit(False)
    ram = effective_limit(lit("max_ram"), lit("ram_available", inventory))
    vram = F.when(F.col("device_kind") != "cpu", effective_limit(lit("max_vram"), lit("vram_available", inventory))).otherwise(lit("max_vram"))
    known = policy.get("allow_unknown", False)
    present = F.array(*[F.lit(d) for d in inventory.get("devices", ["cpu"])])
    allowed = policy.get("allowed_engines") or []
    reasons = F.array(
        F.when(~F.array_contains("capabilities", policy["capability"]), F.lit("capability_unsupported")),
        F.when(F.col("descriptor_id") != F.col("engine_id"), F.lit("descriptor_mismatch")),
        F.when(~F.exists("compatibility", lambda c: (c["backend"] == F.col("backend")) & F.array_contains(c["devices"], F.col("device_kind"))), F.lit("device_incompatible")),
        F.when((F.col("device_kind") != "cpu") & ~F.array_contains(present, F.col("device")), F.lit("device_incompatible")),
        F.when(~placement_matches(F.lit(policy.get("placement", "auto")), F.lit(policy.get("device")), F.col("device")), F.lit("placement_rejected")),
        F.when(~F.col("engine_id").isin(allowed) if allowed else never, F.lit("engine_not_allowed")),
        F.when(~F.col("installed"), F.lit("model_unavailable")),
        F.when(online if policy.get("offline") else never, F.lit("offline_violation")),
        F.when(online if policy.get("private") else never, F.lit("privacy_violation")),
        over_limit(F.col("ram"), ram, "ram_unknown", "ram_budget_exceeded", known),
        over_limit(F.col("vram"), vram, "vram_unknown", "vram_budget_exceeded", known),
        over_limit(F.col("cost"), lit("max_cost"), "cost_unknown", "cost_budget_exceeded", known),
        over_limit(F.col("latency"), lit("deadline"), "latency_unknown", "deadline_exceeded", known),
    )
    rows = candidates.withColumn("reasons", F.array_compact(reasons))
    return rows.withColumn("accepted", F.size("reasons") == 0)


#: What a profile sets beside the order of candidates.
PROFILES = {"cpu": {"placement": "cpu_only"}, "low_vram": {"max_vram": 2 << 30}, "offline": {"offline": True}, "private": {"private": True}, "fast": {}, "balanced": {}, "accurate": {}, "cheap": {}}


def policy_for(profile: str, capability: str) -> dict:
    """The policy of a profile: no limit but its own, unknown estimates not allowed."""
    if profile not in PROFILES:
        raise ValueError(f"no such profile: {profile}")
    return {"capability": capability, "placement": "auto", "offline": False, "private": False, "allow_unknown": False} | PROFILES[profile]


def profile_order(profile: str, preferred: str | None = None) -> list[Column]:
    """Sort keys: the preferred device, the profile's measures with unknown last, then identity."""
    quality, latency, cost = F.col("quality").desc_nulls_last(), F.col("latency").asc_nulls_last(), F.col("cost").asc_nulls_last()
    by = {"fast": [latency], "accurate": [quality], "cheap": [cost]}.get(profile, [quality, latency, cost])
    first = [F.when(F.col("device") == preferred, 0).otherwise(1).asc()] if preferred else []
    return [*first, *by, F.col("engine_id"), F.col("backend"), F.col("device")]


def selected(decided: DataFrame, profile: str, by: list[str], preferred: str | None = None) -> DataFrame:
    """The best accepted candidate of each request."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*profile_order(profile, preferred)))
    return decided.where("accepted").withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def combinations(choices: DataFrame, goals: list[str], goal: str = "goal", choice: str = "choice", most: int = MOST_PLANS) -> DataFrame:
    """One choice a goal in every way.  Choices are first counted: too many ways are an error.

    The product is bounded by that count, so it is small whatever the input.
    """
    counts = {r[goal]: r["n"] for r in choices.where(F.col(goal).isin(goals)).groupBy(goal).agg(F.count("*").alias("n")).collect()}
    ways = reduce(lambda a, g: a * counts.get(g, 0), goals, 1)
    if ways > most:
        raise ValueError(f"{ways} plans; {most} are the most")
    rows = None
    for g in goals:
        side = choices.where(F.col(goal) == g).select(F.col(choice).alias(f"choice_{g}"))
        rows = side if rows is None else rows.crossJoin(F.broadcast(side))
    return rows


def device_millis(invocations: DataFrame, by: list[str], kind: str = "device_kind", millis: str = "latency") -> DataFrame:
    """Time on accelerators by kind of device; unknown where any part is."""
    value = F.col(millis)
    return invocations.where(F.col(kind) != "cpu").groupBy(*by, kind).agg(F.when(F.count(value) == F.count("*"), F.sum(value)).alias("millis"), F.count("*").alias("invocations"))


def goal_choices(goals: DataFrame, stages: DataFrame, requires: DataFrame, coverage: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The admissible choices of every goal that is open, and why stages or goals have none.

    ``goals``: doc, capability, page (null for the whole document); ``stages``: stage_id,
    produces, whole_document, engine_id; ``requires``: stage_id, capability; ``coverage``: doc,
    capability, page, complete ones only; ``decided``: candidates of engines with their reasons.
    Choices that are alike in meaning are one; they are sorted by that key.
    """
    whole = coverage.where("page is null").select("doc", "capability").distinct()
    covered = coverage.where("page is not null").select("doc", "capability", "page").distinct()
    open_ = goals.distinct().join(whole, ["doc", "capability"], "left_anti").join(covered, ["doc", "capability", "page"], "left_anti")
    tried = open_.join(stages.withColumnRenamed("produces", "capability"), "capability").withColumn("scope", F.when(~F.col("whole_document"), F.col("page")))
    needs = tried.select("doc", "stage_id", "scope").distinct().join(requires.withColumnRenamed("capability", "needed"), "stage_id")
    needs = needs.join(whole.withColumnRenamed("capability", "needed"), ["doc", "needed"], "left_anti")
    missing = needs.join(covered.select("doc", F.col("capability").alias("needed"), F.col("page").alias("scope")), ["doc", "needed", "scope"], "left_anti")
    blocked = missing.select("doc", "stage_id", F.coalesce("scope", F.lit("")).alias("at")).distinct()
    tried = tried.withColumn("at", F.coalesce("scope", F.lit("")))
    free = tried.join(blocked, ["doc", "stage_id", "at"], "left_anti").join(decided, "engine_id")
    choices = free.where("accepted").select("doc", "capability", "page", "stage_id", "scope", "engine_id", "backend", "device", "cost", "latency", "ram").distinct()
    why = missing.select("doc", F.concat(F.lit("stage "), "stage_id", F.lit(" requires "), "needed").alias("reason"))
    refused = free.where(~F.col("accepted")).select("doc", "stage_id", F.explode("reasons").alias("r"))
    why = why.unionByName(refused.select("doc", F.concat(F.lit("stage "), "stage_id", F.lit(": "), "r").alias("reason")))
    nobody = open_.join(stages.select(F.col("produces").alias("capability")).distinct(), "capability", "left_anti")
    why = why.unionByName(nobody.select("doc", F.concat(F.lit("no registered stage produces "), "capability").alias("reason")))
    return choices, why.distinct()


def document_plans(choices: DataFrame, most: int = MOST_PLANS) -> DataFrame:
    """Every way of choosing once for each goal of a document: plans of invocations, each plan once.

    Ways are counted before they are made: a document with over ``most`` raises.  An invocation
    on the whole document makes others of its capability needless.  A plan's identity is that of
    its invocations, whatever their order.
    """
    invocation = F.struct("stage_id", "capability", "scope", "engine_id", "backend", "device", "cost", "latency", "ram")
    goals = choices.groupBy("doc", "capability", "page").agg(F.array_sort(F.collect_set(invocation)).alias("ways"))
    goals = goals.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("capability", "page", "ways"))).alias("goals"))
    count = F.aggregate("goals", F.lit(1).cast("long"), lambda n, g: F.least(n * F.size(g["ways"]), F.lit(most + 1).cast("long")))
    fine = F.when(count > most, F.raise_error(F.concat(F.lit(f"candidate frontier exceeds the explicit {most}-plan bound: "), F.col("doc").cast("string"))).cast("boolean")).otherwise(True)
    kind = choices.select(invocation.alias("i")).schema["i"].dataType.simpleString()
    empty = F.array(F.array().cast(f"array<{kind}>"))
    plans = F.aggregate(F.when(fine, F.col("goals")), empty, lambda done, g: F.flatten(F.transform(done, lambda plan: F.transform(g["ways"], lambda w: F.array_union(plan, F.array(w))))))
    rows = goals.select("doc", F.explode(plans).alias("plan"))
    whole = F.transform(F.filter("plan", lambda i: i["scope"].isNull()), lambda i: i["capability"])
    kept = F.array_sort(F.filter("plan", lambda i: i["scope"].isNull() | ~F.array_contains(whole, i["capability"])))
    rows = rows.select("doc", kept.alias("plan"))
    named = F.transform("plan", lambda i: F.concat_ws("/", i["stage_id"], i["capability"], F.coalesce(i["scope"], F.lit("*")), i["engine_id"], i["backend"], i["device"]))
    shown = F.array_join(F.array_sort(named), "\n")
    return rows.select("doc", F.sha2(shown, 256).alias("plan_id"), "plan").dropDuplicates(["doc", "plan_id"])


def plan_totals(plans: DataFrame) -> DataFrame:
    """Cost and latency as sums, memory as most; unknown where any part is."""

    def total(name: str, start: Column, merge) -> Column:
        parts = F.transform("plan", lambda i: i[name])
        return F.when(~F.exists(parts, lambda x: x.isNull()), F.aggregate(parts, start, merge))

    zero = F.lit(0).cast("long")
    return plans.withColumns({"cost": total("cost", zero, lambda a, x: a + x), "latency": total("latency", zero, lambda a, x: a + x), "ram": total("ram", zero, lambda a, x: F.greatest(a, x))})


def known(kind: str, value: Column) -> Column:
    made = {"sum": F.sum(value), "sum_capped": F.least(F.sum(value), F.lit(10_000)), "min": F.min(value), "max": F.max(value)}[kind]
    return F.when(F.count(value) == F.count("*"), made)


def interval(rows: DataFrame, by: list[str], kind: str, order: str) -> DataFrame:
    """Lower, point and upper of a plan from its parts, the weakest confidence, and the digest if all share one."""
    rank = F.coalesce(*[F.when(F.col("confidence") == c, F.lit(r)) for c, r in CONFIDENCE.items()])
    return rows.groupBy(*by).agg(
        *[known(kind, F.col(c)).alias(c) for c in ("lower", "point", "upper")],
        F.min_by("confidence", F.struct(rank, F.col(order))).alias("confidence"),
        F.when((F.count("digest") == F.count("*")) & (F.min("digest") == F.max("digest")), F.min("digest")).alias("digest"),
    )


def admission(plans: DataFrame, by: list[str], max_cost: int | None, deadline: int | None) -> DataFrame:
    """A plan's summed cost and latency against the limits."""
    rows = plans.groupBy(*by).agg(known("sum", F.col("cost")).alias("cost"), known("sum", F.col("latency")).alias("latency"), known("max", F.col("ram")).alias("ram"))
    lit = lambda x: F.lit(x).cast("long")
    reasons = F.array_compact(F.array(over_limit(F.col("cost"), lit(max_cost), "cost_unknown", "cost_budget_exceeded"), over_limit(F.col("latency"), lit(deadline), "latency_unknown", "deadline_exceeded")))
    return rows.withColumn("reasons", F.array_join(reasons, ",")).withColumn("admitted", F.size(reasons) == 0)


def no_worse(a: str, b: str, low: list[str], high: list[str]) -> tuple[Column, Column]:
    """Whether a is known to be nowhere worse than b, and somewhere better."""
    pairs = [(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in low] + [(-F.col(f"{a}.{c}"), -F.col(f"{b}.{c}")) for c in high]
    fine = reduce(lambda x, y: x & y, [p <= q for p, q in pairs])
    better = reduce(lambda x, y: x | y, [p < q for p, q in pairs])
    return F.coalesce(fine, F.lit(False)), F.coalesce(better, F.lit(False))


def frontier(rows: DataFrame, by: list[str], low: list[str], high: list[str], identity: str) -> DataFrame:
    """Rows that no other of their group dominates; a row with an unknown measure neither dominates nor goes.

    Rows alike in every measure keep one another.  The group's rows are first thinned: of those
    with equal values in all but the first measure only the best can stay.
    """
    measures = [*low, *high]
    known_ = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in measures])
    first, rest = low[0], [*low[1:], *high]
    best = rows.where(known_).groupBy(*by, *rest).agg(F.min(first).alias(first))
    fine, better = no_worse("o", "r", low, high)
    same = reduce(lambda x, y: x & y, [F.col(f"o.{c}") == F.col(f"r.{c}") for c in by])
    thin = rows.where(known_).join(best, [*by, *rest, first], "left_semi")
    left = thin.alias("r").join(best.alias("o"), same & fine & better, "left_anti")
    return left.select(*rows.columns).unionByName(rows.where(~known_))


def dominated_by_interval(a: str, b: str, low: list[str], high: list[str]) -> Column:
    """Whether a's intervals are conservatively no worse than b's, and one strictly better."""
    up = [(F.col(f"{a}.{c}_upper"), F.col(f"{b}.{c}_lower")) for c in low] + [(-F.col(f"{a}.{c}_lower"), -F.col(f"{b}.{c}_upper")) for c in high]
    fine = reduce(lambda x, y: x & y, [p <= q for p, q in up])
    better = reduce(lambda x, y: x | y, [p < q for p, q in up])
    return F.coalesce(fine & better, F.lit(False))


def escalations(plans: DataFrame) -> DataFrame:
    """What makes a plan worth a second look: one row each."""
    notes = F.array(
        F.when(F.col("scope") == "document", F.lit("whole_document")),
        F.when(F.col("device") != "cpu", F.lit("accelerator")),
        F.when(F.col("network_use") != "none", F.lit("network")),
        F.when(~F.col("cached"), F.lit("cold_cache")),
        F.when(F.size("requires") > 0, F.lit("prerequisites")),
        F.when(F.col("cost").isNull() | F.col("latency").isNull(), F.lit("unknown_estimate")),
        F.when(F.col("confidence").isin("assumed", "unknown"), F.lit("low_confidence")),
    )
    return plans.select("plan_id", F.explode(F.array_compact(notes)).alias("escalation"))
