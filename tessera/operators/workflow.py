"""Versioned workflow metadata: latest versions, staleness, stage status, usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tables that each kind of change makes stale.
STALE = {
    "direction": ["candidate_sets", "study_plans", "analysis_runs", "proposals"],
    "candidate": ["study_plans", "analysis_runs", "proposals"],
    "plan": ["analysis_runs", "proposals"],
    "data": ["analysis_runs", "proposals"],
}
# States of a stage that ask for something to be done, and those that block others.
OPEN = ["not_started", "awaiting_selection", "draft", "stale", "failed", "ready"]
BLOCKING = ["not_started", "failed", "awaiting_selection", "draft"]
# Stages in order.
STAGES = ["direction", "literature", "candidates", "plan", "data", "proposal"]


def latest(df: DataFrame, parent: str, version: str) -> DataFrame:
    """The row with the largest version of each parent; max_by combines before the shuffle."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(parent).alias("_p")).agg(F.max_by(whole, version).alias("r")).select("r.*")


def next_version(df: DataFrame, parents: DataFrame, parent: str, version: str) -> DataFrame:
    """parent, next_version: one more than the largest, 1 for parents without any."""
    top = df.groupBy(parent).agg(F.max(version).alias("_v"))
    return parents.select(parent).distinct().join(top, parent, "left").select(parent, (F.coalesce("_v", F.lit(0)) + 1).cast("long").alias("next_version"))


def cascade(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities (table, project_id, stale, ...) with stale set where an event (project_id, event)
    of their project reaches their table."""
    reach = [F.struct(F.lit(e).alias("event"), F.lit(t).alias("table")) for e, ts in STALE.items() for t in ts]
    hit = events.select("project_id", F.explode(F.filter(F.array(*reach), lambda r: r["event"] == F.col("event"))).alias("r")).select("project_id", "r.table").distinct().withColumn("_hit", F.lit(True))
    return entities.join(hit, ["project_id", "table"], "left").withColumn("stale", F.col("stale") | F.coalesce("_hit", F.lit(False))).drop("_hit").select(*entities.columns)


def _stages() -> Column:
    """seq, stage, status of a project's stages, from the columns of its row."""
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    active = lambda *kinds: F.coalesce(F.arrays_overlap("active", F.array(*[F.lit(k) for k in kinds])), F.lit(False))
    some = lambda c: F.col(c).isNotNull()
    states = {
        "direction": F.when(F.trim(F.coalesce("direction", F.lit(""))) != "", "completed"),
        "literature": F.when(is_("search_status", "running"), "running").when(F.coalesce("n_included", F.lit(0)) > 0, "completed").when(is_("search_status", "failed"), "failed"),
        "candidates": F.when(yes("selected_stale") | yes("set_stale"), "stale").when(is_("set_status", "generating"), "running").when(is_("set_status", "ready") & yes("selected"), "completed").when(is_("set_status", "ready"), "awaiting_selection").when(some("set_status"), "failed"),
        "plan": F.when(yes("plan_stale"), "stale").when(active("plan"), "running").when(is_("plan_status", "confirmed"), "completed").when(some("plan_status"), "draft"),
        "data": F.when(yes("run_stale"), "stale").when(active("analysis", "dataset"), "running").when(is_("run_status", "failed") | yes("step_failed"), "failed").when(is_("run_status", "succeeded"), "completed").when(yes("binding_confirmed"), "ready"),
        "proposal": F.when(active("proposal"), "running").when(yes("proposal_stale"), "stale").when(yes("proposal_confirmed"), "confirmed").when(yes("proposal"), "completed"),
    }
    return F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(s).alias("stage"), F.coalesce(states[s], F.lit("not_started")).alias("status")) for i, s in enumerate(STAGES)])


def stage_status(p: DataFrame) -> DataFrame:
    """project_id, stage, status from one row for each project of what its latest entities are:
    direction, n_included, search_status, set_status, set_stale, selected, selected_stale,
    plan_status, plan_stale, run_status, run_stale, step_failed, binding_confirmed, proposal,
    proposal_stale, proposal_confirmed, active (kinds of running jobs)."""
    return p.select("project_id", F.explode(_stages()).alias("r")).select("project_id", "r.*")


def project_flow(p: DataFrame) -> DataFrame:
    """What ``flow`` gives of the ``stage_status`` of the projects. Stages are counted in the row that
    they are made of, so three numbers a row are dealt by project."""
    each = p.select("project_id", _stages().alias("r"))
    done = F.size(F.filter("r", lambda x: x["status"].isin("completed", "confirmed")))
    first = F.get(F.filter("r", lambda x: x["status"].isin(OPEN)), F.lit(0))["seq"]
    dealt = each.select("project_id", done.cast("long").alias("_n"), first.alias("_f")).repartition("project_id")
    return dealt.groupBy("project_id").agg(F.sum("_n").alias("n_done"), F.min("_f").alias("_f")).select("project_id", "n_done", F.get(F.array(*[F.lit(s) for s in STAGES]), F.col("_f")).alias("next_stage"))


def flow(status: DataFrame) -> DataFrame:
    """project_id, n_done (completed or confirmed stages), next_stage (the first that asks for
    something to be done)."""
    done = F.col("status").isin("completed", "confirmed")
    each = status.groupBy("project_id").agg(F.count_if(done).alias("n_done"), F.min(F.when(F.col("status").isin(OPEN), F.struct("seq", "stage"))).alias("f"))
    return each.select("project_id", "n_done", F.col("f.stage").alias("next_stage"))


def lock_reasons(status: DataFrame) -> DataFrame:
    """project_id, stage, blocker, blocker_status of stages not started that an earlier stage
    blocks."""
    earlier = Window.partitionBy("project_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("status").isin(BLOCKING), F.struct("seq", "stage", "status"))).over(earlier)
    return status.withColumn("b", first).where("status = 'not_started' and b is not null").select("project_id", "stage", F.col("b.stage").alias("blocker"), F.col("b.status").alias("blocker_status"))


def derive_flow(status: DataFrame) -> DataFrame:
    """project_id, seq, stage, flow, downstream from statuses (project_id, seq, stage, status,
    confirmed_version, editing, local_stale, data_ok).

    A stage is open while all before it are passed. An edited one is active, a stale one stale,
    one that is done and confirmed (here, or by later work) confirmed; others are active if open,
    else locked. Locked and active stages close what follows, but for data whose main model is
    done. downstream: how many later stages are confirmed or stale."""
    later = Window.partitionBy("project_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    began = F.max((F.col("status") != "not_started").cast("int")).over(later)
    rows = status.withColumn("later", F.coalesce(began, F.lit(0)) == 1)
    listed = rows.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("seq", "stage", "status", "confirmed_version", "editing", "local_stale", "data_ok", "later"))).alias("all"))

    def turn(acc, s):
        lenient = (s["stage"] == "data") & s["data_ok"]
        done = (s["status"] == "completed") | (lenient & (s["status"] == "failed"))
        closed = F.when(acc["open"], "active").otherwise("locked")
        state = F.when(s["editing"], "active").when((s["status"] == "stale") | s["local_stale"], F.when(acc["open"], "stale").otherwise("locked")).when((s["status"] == "confirmed") | (done & ((s["confirmed_version"] > 0) | s["later"])), "confirmed").otherwise(closed)
        still = acc["open"] & (state != "locked") & ~((state == "active") & ~lenient)
        return F.struct(still.alias("open"), F.concat(acc["out"], F.array(F.struct(s["seq"].alias("seq"), s["stage"].alias("stage"), state.alias("flow")))).alias("out"))

    start = F.struct(F.lit(True).alias("open"), F.array().cast("array<struct<seq:int,stage:string,flow:string>>").alias("out"))
    flat = listed.select("project_id", F.explode(F.aggregate("all", start, turn, lambda a: a["out"])).alias("r")).select("project_id", "r.*")
    return flat.withColumn("downstream", F.count_if(F.col("flow").isin("confirmed", "stale")).over(later))


def supersede(plans: DataFrame, parent: str, version: str) -> DataFrame:
    """Only the newest confirmed plan of a parent stays confirmed."""
    top = F.max(F.when(F.col("status") == "confirmed", F.col(version))).over(Window.partitionBy(parent))
    return plans.withColumn("status", F.when((F.col("status") == "confirmed") & (F.col(version) < top), "superseded").otherwise(F.col("status")))


def edited_copy(plans: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Plans after edits (key, names: variables that are left): a draft changes in place, any
    other gets a new version, unconfirmed, whose binding keeps only what is left."""
    joined = plans.join(changes, key)
    kept = joined.withColumn("binding", F.map_filter("binding", lambda k, v: F.array_contains("names", k))).drop("names")
    draft = F.col("status") == "draft"
    new = kept.withColumn("version", F.when(draft, F.col("version")).otherwise(F.col("version") + 1)).withColumn("status", F.lit("draft")).withColumn("confirmed", F.lit(False))
    gone = joined.where(draft).select(key, "version")
    return plans.join(gone, [key, "version"], "left_anti").unionByName(new.select(*plans.columns))


def recover(jobs: DataFrame) -> DataFrame:
    """After a restart no job is under way."""
    return jobs.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def delete_cascade(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return child.join(gone.select(key).distinct(), key, "left_anti")


def add_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds what is absent; doing it again changes nothing."""
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def affected(events: DataFrame, entities: DataFrame) -> DataFrame:
    """project_id, tables: names of the tables that events of a project have made stale."""
    hit = cascade(events, entities.withColumn("stale", F.lit(False))).where("stale")
    return hit.groupBy("project_id").agg(F.array_sort(F.collect_set("table")).alias("tables"))


def evidence_changed(before: DataFrame, after: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate sets (project_id, stale, ...), stale where the included evidence of the project
    (project_id, id, included, ...) is not what it was. Plans and runs stay."""
    whole = F.struct(*[F.col(c) for c in before.columns if c not in ("project_id", "included")])
    seen = lambda d: d.where("included").groupBy("project_id").agg(F.array_sort(F.collect_list(whole)).alias("all"))
    none = F.array()
    both = seen(before).withColumnRenamed("all", "old").join(seen(after), "project_id", "full")
    moved = both.where(~F.coalesce("old", none).eqNullSafe(F.coalesce("all", none))).select("project_id", F.lit(True).alias("_moved"))
    return sets.join(moved, "project_id", "left").withColumn("stale", F.col("stale") | F.coalesce("_moved", F.lit(False))).select(*sets.columns)


def dataset_changed(changed: DataFrame, bindings: DataFrame, runs: DataFrame, owners: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities stale where a dataset (dataset_id) that their project refers to has changed."""
    events = dataset_projects(bindings, runs, owners).join(changed.select("dataset_id").distinct(), "dataset_id", "left_semi").select("project_id", F.lit("data").alias("event")).distinct()
    return cascade(events, entities)


def completed(projects: DataFrame, proposals: DataFrame) -> DataFrame:
    """project_id, completed: whether the newest proposal (project_id, version, confirmed_at, stale)
    is confirmed and not stale."""
    newest = latest(proposals, "project_id", "version").select("project_id", (F.col("confirmed_at").isNotNull() & ~F.col("stale")).alias("completed"))
    return projects.select("project_id").join(newest, "project_id", "left").select("project_id", F.coalesce("completed", F.lit(False)).alias("completed"))


def stale_at_write(runs: DataFrame, plans: DataFrame, bindings: DataFrame) -> DataFrame:
    """Runs (id, plan_id, stale, snapshot) as they are written: stale if the plan (plan_id, status,
    stale) went stale or is not confirmed, or its binding (plan_id, binding) is not the snapshot."""
    now = runs.join(plans.select("plan_id", "status", F.col("stale").alias("_plan")), "plan_id", "left").join(bindings.select("plan_id", "binding"), "plan_id", "left")
    gone = F.coalesce(F.col("_plan"), F.lit(True)) | F.coalesce(F.col("status") != "confirmed", F.lit(True)) | ~F.col("snapshot").eqNullSafe(F.col("binding"))
    return now.withColumn("stale", F.col("stale") | gone).select(*runs.columns)


def plan_dataset(plans: DataFrame, bindings: DataFrame, datasets: DataFrame) -> DataFrame:
    """project_id, version, dataset_id and the dataset's columns for the newest plan of each project
    that is bound to a dataset."""
    bound = plans.select("project_id", "plan_id", "version").join(bindings.select("plan_id", "dataset_id"), "plan_id").join(datasets, "dataset_id")
    return latest(bound, "project_id", "version").drop("plan_id")


def bound_datasets(plans: DataFrame, bindings: DataFrame, datasets: DataFrame) -> DataFrame:
    """project_id and datasets that any of its plans is bound to."""
    pairs = plans.select("project_id", "plan_id").join(bindings.select("plan_id", "dataset_id"), "plan_id").select("project_id", "dataset_id").distinct()
    return pairs.join(datasets, "dataset_id")


def newest_with(sets: DataFrame, members: DataFrame, parent: str, key: str, name: str) -> DataFrame:
    """The newest set (parent, key, version) of each parent with its members, in order of seq, as an
    array called ``name``."""
    fields = [c for c in members.columns if c != key]
    nested = members.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", *[c for c in fields if c != "seq"]))).alias(name))
    return latest(sets, parent, "version").join(nested, key, "left").withColumn(name, F.coalesce(name, F.array()))


def public(df: DataFrame, private: Sequence[str] = ("file_path",)) -> DataFrame:
    """Without columns that don't leave the house."""
    return df.drop(*private)


def identified(df: DataFrame, prefix: str, key: str = "id", created: str = "created_at") -> DataFrame:
    """With a new identifier and the time for rows that have none. Write the result before it is
    used twice, as identifiers are drawn anew."""
    new = F.concat(F.lit(prefix + "_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
    have = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return df.withColumns({key: F.coalesce(have(key).cast("string"), new), created: F.coalesce(have(created).cast("timestamp"), F.current_timestamp())})


def included_counts(projects: DataFrame, evidence: DataFrame) -> DataFrame:
    """project_id, n_included, also of projects without evidence."""
    n = evidence.groupBy("project_id").agg(F.count_if("included").alias("n_included"))
    return projects.select("project_id").join(n, "project_id", "left").select("project_id", F.coalesce("n_included", F.lit(0)).cast("long").alias("n_included"))


def usage(calls: DataFrame, by: list[str] = ()) -> DataFrame:
    """n_calls, input_tokens, output_tokens."""
    facts = [F.count("*").alias("n_calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens")]
    return calls.groupBy(*by).agg(*facts) if by else calls.agg(*facts)


def recent(df: DataFrame, created: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(created)).limit(n)


def dataset_projects(bindings: DataFrame, runs: DataFrame, owners: DataFrame) -> DataFrame:
    """dataset_id, project_id of all that refer to a dataset: by binding, by run, or as owner."""
    pick = lambda d: d.select("dataset_id", "project_id")
    return pick(bindings).unionByName(pick(runs)).unionByName(pick(owners)).where("project_id is not null").distinct()


def citations(cited: DataFrame, evidence: DataFrame, key: str, ids: str) -> DataFrame:
    """key, n_valid, n_invalid: references of each row that are, and are not, known evidence."""
    each = cited.select(key, F.explode_outer(F.array_distinct(ids)).alias("ref"))
    known = each.join(evidence.select(F.col("id").alias("ref")).distinct().withColumn("_k", F.lit(True)), "ref", "left")
    return known.groupBy(key).agg(F.count_if(F.col("_k")).alias("n_valid"), F.count_if(F.col("_k").isNull() & F.col("ref").isNotNull()).alias("n_invalid"))
