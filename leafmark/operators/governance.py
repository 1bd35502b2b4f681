"""Sources, revisions, generations, jobs and events as tables: what is current, what may be seen, what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

RETRY_CAP, RETRY_BASE = 300, 5


def _first(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("__first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__first = 1").drop("__first")


def latest_revision(sources: DataFrame, revisions: DataFrame, parses: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each source with its latest document revision, that revision's latest succeeded parse, and its latest job; nulls where there is none.

    ``revisions``: source_id, revision_id, created; ``parses``: revision_id, parse_id, status, created; ``jobs``: source_id, job_id, status, created.
    """
    rev = _first(revisions, ["source_id"], F.col("created").desc(), F.col("revision_id").desc()).select("source_id", "revision_id")
    parse = _first(parses.where("status = 'succeeded'"), ["revision_id"], F.col("created").desc(), F.col("parse_id").desc()).select("revision_id", "parse_id")
    job = _first(jobs, ["source_id"], F.col("created").desc(), F.col("job_id").desc()).select("source_id", "job_id", F.col("status").alias("job_status"))
    return sources.join(rev, "source_id", "left").join(parse, "revision_id", "left").join(job, "source_id", "left")


def scope_snapshot(requested: DataFrame, sources: DataFrame, generations: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """``(scope, rejected)``: the newest active generation of one profile for every live, ready source of a request; what is missing or unindexed by name.

    ``requested``: workspace_id, source_id (an empty table: all of the workspace's); ``sources``: workspace_id, source_id, status, deleted_at;
    ``generations``: source_id, generation_id, profile, state, created.
    """
    wanted = sources.select("workspace_id", "source_id") if requested.isEmpty() else requested.select("workspace_id", "source_id").distinct()
    live = sources.where("deleted_at is null and status in ('ready', 'ready_limited')").select("workspace_id", "source_id", F.lit(True).alias("live"))
    newest = _first(generations.where((F.col("state") == "active") & (F.col("profile") == profile)), ["source_id"], F.col("created").desc(), F.col("generation_id").desc()).select("source_id", "generation_id")
    j = wanted.join(live, ["workspace_id", "source_id"], "left").join(newest, "source_id", "left")
    bad = F.when(F.col("live").isNull(), "missing").when(F.col("generation_id").isNull(), "unindexed")
    return j.where(bad.isNull()).select("workspace_id", "source_id", "generation_id"), j.withColumn("reason", bad).where("reason is not null").select("workspace_id", "source_id", "reason")


def evidence_view(evidence: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence rows with alias and place, in the order of roles; what a deleted source said and where is blank, its row stays.

    ``evidence``: claim_id, node_id, role, quote; ``nodes``: node_id, source_id, page_start, page_end; ``sources``: source_id, alias, deleted_at.
    """
    j = evidence.join(nodes, "node_id", "left").join(sources.withColumn("__there", F.lit(True)), "source_id", "left")
    gone = F.col("deleted_at").isNotNull() | F.col("__there").isNull()
    order = F.array_position(F.array(F.lit("primary"), F.lit("corroborating"), F.lit("contradicting")), F.col("role"))
    return j.select("claim_id", "node_id", "role", order.cast("int").alias("role_order"), "alias", F.when(gone, "").otherwise(F.col("quote")).alias("quote"), *[F.when(~gone, F.col(c)).alias(c) for c in ("page_start", "page_end")], gone.alias("source_deleted"))


def context_view(blocks: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Context blocks with their sources, texts of deleted ones blank. ``blocks``: run_id, context_id, node_id, text."""
    j = blocks.join(nodes.select("node_id", "source_id"), "node_id", "left").join(sources.withColumn("__there", F.lit(True)), "source_id", "left")
    gone = F.col("deleted_at").isNotNull() | F.col("__there").isNull()
    return j.select("run_id", "context_id", "node_id", "alias", F.when(gone, "").otherwise(F.col("text")).alias("text"), gone.alias("source_deleted"))


def run_summaries(runs: DataFrame, claims: DataFrame) -> DataFrame:
    """Top-level runs with their claims and the accepted ones. ``runs``: workspace_id, run_id, parent_run_id; ``claims``: run_id, status."""
    c = claims.groupBy("run_id").agg(F.count("*").alias("claims"), F.count_if(F.col("status") != "rejected").alias("accepted"))
    return runs.where("parent_run_id is null").join(c, "run_id", "left").na.fill(0, ["claims", "accepted"]).select("workspace_id", "run_id", "claims", "accepted")


def retention_sweep(tables: dict[str, DataFrame], rules: dict[str, Column]) -> DataFrame:
    """``table, due``: rows of each table that its rule lets go; the rules read the tables' own columns."""
    out = None
    for name, rows in tables.items():
        one = rows.agg(F.count_if(rules[name]).alias("due")).select(F.lit(name).alias("table"), "due")
        out = one if out is None else out.unionByName(one)
    return out


def job_attempt_report(jobs: DataFrame, now: Column) -> DataFrame:
    """``job_id, state, retry_seconds``: leases that ran out, attempts that are used up (cancelled if that was asked for), and when a failed one is tried again.

    ``jobs``: job_id, status, lease_until, attempts, max_attempts, cancel_requested. Waits double from five seconds up to five minutes.
    """
    expired = (F.col("status") == "running") & (F.col("lease_until") < now)
    over = F.col("attempts") >= F.col("max_attempts")
    stopped = expired | (F.col("status") == "failed")
    state = F.when(stopped & F.col("cancel_requested"), "cancelled").when(stopped & over, "attempts_exhausted").when(stopped, "retry").otherwise(F.col("status"))
    wait = F.least(F.lit(float(RETRY_CAP)), RETRY_BASE * F.pow(F.lit(2.0), F.col("attempts")))
    return jobs.withColumn("state", state).select("job_id", "state", F.when(F.col("state") == "retry", wait).alias("retry_seconds"))


def publish_generation(generations: DataFrame, built: DataFrame, vectors: DataFrame, live_sources: DataFrame, quota: int) -> DataFrame:
    """The generations' table after a build is published: checked by its count and the quota, active in the place of the active one of the same profile, or orphaned if its source died.

    ``generations``: source_id, generation_id, profile, state; ``built``: source_id, generation_id, profile, workspace_id, expected; ``vectors``:
    generation_id, node_id; ``live_sources``: source_id. The quota counts different leaves of the workspace once the build stands.
    """
    n = vectors.groupBy("generation_id").agg(F.count("*").alias("rows"))
    held = built.join(n, "generation_id", "left").join(live_sources.select("source_id", F.lit(True).alias("live")), "source_id", "left")
    leaves = vectors.join(built.select("generation_id", "workspace_id"), "generation_id").groupBy("workspace_id").agg(F.count_distinct("node_id").alias("leaves"))
    judged = held.join(leaves, "workspace_id", "left")
    state = F.when(F.col("live").isNull(), "orphaned").when(F.coalesce("rows", F.lit(0)) != F.col("expected"), "failed").when(F.col("leaves") > quota, "failed").otherwise("active")
    new = judged.select("source_id", "generation_id", "profile", state.alias("state"))
    replaced = new.where("state = 'active'").select("source_id", "profile", F.lit(True).alias("replaced")).distinct()
    old = generations.join(new.select("generation_id"), "generation_id", "left_anti").join(replaced, ["source_id", "profile"], "left")
    return old.select("source_id", "generation_id", "profile", F.when((F.col("state") == "active") & F.col("replaced"), "retired").otherwise(F.col("state")).alias("state")).unionByName(new)


def translate_missing(leaves: DataFrame, stored: DataFrame, translator=None) -> tuple[DataFrame, DataFrame]:
    """``(new segments, progress)``: only leaves without a stored segment go to the translator (a function of a column); progress counts what was there before.

    ``leaves``: translation_id, node_id, text; ``stored``: translation_id, node_id, flags.
    """
    todo = leaves.join(stored.select("translation_id", "node_id"), ["translation_id", "node_id"], "left_anti")
    made = todo.select("translation_id", "node_id", (translator or (lambda c: c))(F.col("text")).alias("text"))
    done = stored.groupBy("translation_id").agg(F.count("*").alias("done"), F.count_if(F.size("flags") > 0).alias("flagged"))
    progress = leaves.groupBy("translation_id").agg(F.count("*").alias("total")).join(done, "translation_id", "left").na.fill(0, ["done", "flagged"])
    return made, progress.withColumn("progress", F.col("done") / F.greatest(F.lit(1), "total"))


def scrub_source(tombstones: DataFrame, nodes: DataFrame, evidence: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(nodes, evidence, vectors)`` after sources are gone: texts blank, vectors removed, ids and rows for the audit kept.

    ``tombstones``: source_id; ``nodes``: node_id, source_id, text; ``evidence``: claim_id, node_id, quote; ``vectors``: node_id, ...
    """
    dead = nodes.join(tombstones.select("source_id").distinct().withColumn("dead", F.lit(True)), "source_id", "left").withColumn("dead", F.coalesce("dead", F.lit(False)))
    ids = dead.where("dead").select("node_id")
    blank = evidence.join(ids.withColumn("gone", F.lit(True)), "node_id", "left")
    return dead.withColumn("text", F.when(F.col("dead"), "").otherwise(F.col("text"))).drop("dead"), blank.withColumn("quote", F.when(F.col("gone"), "").otherwise(F.col("quote"))).drop("gone"), vectors.join(ids, "node_id", "left_anti")


def reindex_profile(nodes: DataFrame, generations: DataFrame, profile: str, encoder) -> tuple[DataFrame, DataFrame]:
    """``(vectors, built)`` of the leaves of all active sources for another profile; the active index stays as it is.

    ``encoder`` is a function of the text's column; new generations are named by source and profile.
    """
    active = generations.where("state = 'active'").select("source_id").distinct()
    ident = F.concat_ws("@", "source_id", F.lit(profile))
    leaves = nodes.where("level = 'child'").join(active, "source_id", "left_semi")
    vectors = leaves.select(ident.alias("generation_id"), "node_id", encoder(F.col("text")).alias("vector"))
    built = leaves.groupBy("source_id").agg(F.count("*").alias("expected")).select("source_id", ident.alias("generation_id"), F.lit(profile).alias("profile"), "expected")
    return vectors, built


def replay_run(events: DataFrame, after: DataFrame) -> DataFrame:
    """``run_id, stages, claims, sections, status, error``: a client's state after the events that it has not seen.

    ``events``: run_id, seq, type, item_id, payload; ``after``: run_id, last_seq. Stages append; a claim keeps its first place and its last payload;
    a section moves to its last place; the final status or error is the last one.
    """
    fresh = events.join(after, "run_id", "left").where(F.col("seq") > F.coalesce("last_seq", F.lit(0)))
    kind = lambda k: F.col("type") == k
    item = fresh.where(kind("claim_verified") | kind("section")).groupBy("run_id", "type", "item_id").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.max_by("payload", "seq").alias("payload"))
    listed = lambda t, place: F.transform(F.array_sort(F.collect_list(F.when(kind(t), F.struct(place, "payload")))), lambda x: x["payload"])
    items = item.groupBy("run_id").agg(listed("claim_verified", "first").alias("claims"), listed("section", "last").alias("sections"))
    stages = F.transform(F.array_sort(F.collect_list(F.when(kind("stage"), F.struct("seq", "payload")))), lambda x: x["payload"])
    ends = F.max_by(F.when(kind("done"), F.col("payload")), F.when(kind("done"), F.col("seq")))
    g = fresh.groupBy("run_id").agg(stages.alias("stages"), ends.alias("status"), F.max_by(F.when(kind("error"), F.col("payload")), F.when(kind("error"), F.col("seq"))).alias("error"))
    none = F.array().cast("array<string>")
    return g.join(items, "run_id", "left").select("run_id", "stages", F.coalesce("claims", none).alias("claims"), F.coalesce("sections", none).alias("sections"), "status", "error")


def rehydrate_events(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Claim events with what the tables say now, so that nothing deleted is replayed; a claim that is gone becomes a neutral stage. Works on a stream of events too.

    ``events``: run_id, seq, type, item_id, payload; ``claims``: claim_id, text (blank where its source is deleted).
    """
    now = claims.select(F.col("claim_id").alias("item_id"), F.col("text").alias("__text"), F.lit(True).alias("__there"))
    j = events.join(now, "item_id", "left")
    claim = F.col("type") == "claim_verified"
    return j.select("run_id", "seq", F.when(claim & F.col("__there").isNull(), "stage").otherwise(F.col("type")).alias("type"), "item_id", F.when(claim, F.coalesce("__text", F.lit(""))).otherwise(F.col("payload")).alias("payload"))


def config_fingerprint(settings: DataFrame, excluded: list[str]) -> DataFrame:
    """``config_id, fingerprint``: SHA-256 of the settings in order of their names, operational ones left out. ``settings``: config_id, name, value."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    return settings.where(~F.col("name").isin(excluded)).groupBy("config_id").agg(F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["value"], F.lit("null")))), "\n"), 256).alias("fingerprint"))


def media_quota(assets: DataFrame, sessions: DataFrame, now: Column, quota: int) -> DataFrame:
    """``workspace_id, used, over``: bytes of ready assets and of open reservations that haven't run out.

    ``assets``: workspace_id, bytes, status; ``sessions``: workspace_id, total_bytes, status, expires_at.
    """
    both = assets.where("status = 'ready'").select("workspace_id", "bytes").unionByName(sessions.where((F.col("status") == "open") & (F.col("expires_at") > now)).select("workspace_id", F.col("total_bytes").alias("bytes")))
    return both.groupBy("workspace_id").agg(F.sum("bytes").alias("used")).withColumn("over", F.col("used") > quota)


# The named limits, hits within a window of so many seconds.
RATE_RULES = {
    "auth_session": (20, 60),
    "qa": (20, 60),
    "qa_daily": (300, 86_400),
    "synthesis": (5, 60),
    "synthesis_daily": (50, 86_400),
    "upload": (60, 3600),
    "media_session": (30, 3600),
    "media_url": (600, 60),
    "transcript_edit": (60, 3600),
    "workspace_create": (30, 3600),
    "source_delete": (120, 3600),
    "settings_write": (60, 3600),
    "export": (60, 3600),
    "translate": (20, 3600),
}


def rule_table(spark: SparkSession, rules: dict[str, tuple[int, int]] = RATE_RULES) -> DataFrame:
    """``rule, window_seconds, rule_limit`` of named limits: one row a rule."""
    return spark.createDataFrame([(name, window, most) for name, (most, window) in rules.items()], "rule string, window_seconds int, rule_limit int")


def micros_left(us: Column, window: Column) -> Column:
    """Microseconds until the window that ``us`` lies in ends, from 1 to the whole window."""
    return window.cast("long") * 1_000_000 - F.pmod(us, window.cast("long") * 1_000_000)


def rate_verdict(counted: DataFrame, scale: float = 1.0) -> DataFrame:
    """``event_id, rule, effective, passes, retry_seconds`` from counts of the current window and the one before; works on a stream too.

    ``counted``: event_id, rule, us, window_seconds, rule_limit, here, before. A scaled limit is a whole number, 1 at least. Who is over the limit may
    come back when the current window ends: whole seconds, 1 at least.
    """
    share = micros_left(F.col("us"), F.col("window_seconds")) / (F.col("window_seconds") * 1e6)
    effective = F.round(F.col("here") + F.col("before") * share, 6)
    passes = F.col("effective") <= F.greatest(F.lit(1), F.floor(F.col("rule_limit") * F.lit(scale)))
    wait = F.greatest(F.lit(1), F.floor(micros_left(F.col("us"), F.col("window_seconds")) / 1_000_000)).cast("long")
    return counted.withColumn("effective", effective).withColumn("passes", passes).select("event_id", "rule", "effective", "passes", F.when(~F.col("passes"), wait).alias("retry_seconds"))


def rate_rules(events: DataFrame, rules: DataFrame, ts: str = "ts", scale: float = 1.0) -> DataFrame:
    """``event_id, rule, effective, passes, retry_seconds`` of events under several rules at once.

    ``events``: event_id, rule, subject, ts; ``rules`` (some rows): rule, window_seconds, rule_limit. The window before counts by the share of it that a
    sliding window would still see. The stream form is ``streaming.events.rate_stream``.
    """
    j = events.select("event_id", "rule", "subject", F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).join(F.broadcast(rules.select("rule", "window_seconds", "rule_limit")), "rule")
    width = F.col("window_seconds").cast("long") * 1_000_000
    j = j.withColumn("bucket", F.round((F.col("us") - F.pmod(F.col("us"), width)) / width).cast("long"))
    before = j.groupBy("rule", "subject", "bucket").agg(F.count("*").alias("before")).withColumn("bucket", F.col("bucket") + 1)
    here = F.row_number().over(Window.partitionBy("rule", "subject", "bucket").orderBy("us", "event_id"))
    counted = j.withColumn("here", here).join(before, ["rule", "subject", "bucket"], "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return rate_verdict(counted, scale)
