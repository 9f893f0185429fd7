"""Statuses, their roll-up, policies, exit codes, reports, and judgement of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses from best to worst, the dimensions, and the codes of each class of error.
STATUSES = ("PASS", "UNKNOWN", "OVERDUE", "DEGRADED", "UNSUPPORTED", "FAIL")
DIMENSIONS = ("durability", "integrity", "recoverability", "searchability", "freshness", "retention_compliance", "key_availability")
UNSUPPORTED = ("UNSUPPORTED_FEATURE", "PROFILE_CHANGE_UNSUPPORTED")
VIOLATIONS = (
    "STORED_INTEGRITY_FAILED", "CONTENT_INTEGRITY_FAILED", "DESCRIPTOR_INVALID", "MALFORMED_FRAME", "TRUNCATED", "FOOTER_INVALID", "ENVELOPE_INVALID",
    "PATH_INVALID", "EXTENT_INVALID", "NAMESPACE_INVALID", "CATALOG_INVALID", "IDENTITY_CONFLICT", "RECORD_INVALID", "NO_VALID_HEAD", "TAIL_UNRESOLVED",
    "CHECKPOINT_MISMATCH", "RETENTION_UNRESOLVED", "REFERENCE_INVALID", "FRESHNESS_FAILED", "PROFILE_VIOLATION",
)
SCHEMA_VERSION = 1


def rank(status: str | Column) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return (F.array_position(F.array(*map(F.lit, STATUSES)), status) - 1).cast("int")


def worst(status: str | Column) -> Column:
    """The worst of a group's statuses; UNKNOWN where there is none."""
    status = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.max_by(status, rank(status)), F.lit("UNKNOWN"))


def worst_of(statuses: str) -> Column:
    """The worst of an array of statuses; UNKNOWN for an empty one."""
    names = ", ".join(f"'{s}'" for s in STATUSES)
    ranks = f"transform({statuses}, s -> coalesce(array_position(array({names}), s), 0L))"
    return F.expr(f"element_at(array({names}), cast(greatest(2L * cast(size({statuses}) = 0 as int), array_max(array_append({ranks}, 1L))) as int))")


def error_class(code: str) -> Column:
    """violation, unsupported or operational: what an error says about the archive."""
    return F.when(F.col(code).isin(*VIOLATIONS), "violation").when(F.col(code).isin(*UNSUPPORTED), "unsupported").otherwise("operational")


def exit_code(worst_status: str, has_error: str) -> Column:
    """1: a failure, 3: an operation went wrong, 4: unsupported, 2: not known good, 0: good."""
    w = F.col(worst_status)
    return F.when(w == "FAIL", 1).when(F.col(has_error), 3).when(w == "UNSUPPORTED", 4).when(w.isin("DEGRADED", "OVERDUE", "UNKNOWN"), 2).otherwise(0).cast("long")


def result_code(overall: str, policy: str, operational: str) -> Column:
    """The exit code of a report: any failure counts whatever the policy; then the run; then the policy's result."""
    p = F.col(policy)
    return F.when(F.col(overall) == "FAIL", 1).when(F.col(operational), 3).when(p == "FAIL", 1).when(p == "UNSUPPORTED", 4).when(p != "PASS", 2).otherwise(0).cast("long")


def requirements(required: str, anchored: str, known: str) -> Column:
    """The dimensions that a policy requires: those named, and freshness wherever an expected head is given
    or the archive is known from before."""
    fresh = F.array(F.lit("freshness"))
    return F.array_sort(F.when(F.col(anchored) | F.col(known), F.array_union(required, fresh)).otherwise(F.array_distinct(required)))


def policy_result(required: str, dimensions: str) -> Column:
    """The roll-up over the required dimensions of a map; one without a status counts as UNKNOWN, and a policy
    that requires nothing is UNKNOWN."""
    return worst_of(f"transform({required}, d -> coalesce(try_element_at({dimensions}, d), 'UNKNOWN'))")


def concluded(reports: DataFrame) -> DataFrame:
    """Reports (dimensions: map, required: array, operational) with overall_status, policy_result and exit_code."""
    rows = reports.withColumns({"overall_status": worst_of("map_values(dimensions)"), "policy_result": policy_result("required", "dimensions")})
    return rows.withColumn("exit_code", result_code("overall_status", "policy_result", "operational"))


def report_violations(reports: DataFrame) -> DataFrame:
    """report_id, violation: every way in which a concluded report (with schema_version, error_findings, skipped,
    expected_head, anchor, anchored, known, requested) breaks its own rules."""
    rows = concluded(reports.withColumnsRenamed({"overall_status": "said_overall", "policy_result": "said_policy", "exit_code": "said_exit"}))
    said, good = F.col("said_overall"), F.col("said_overall") == "PASS"
    statuses = F.map_values("dimensions")
    needed = F.col("anchored") | F.col("known") | F.col("requested")
    broken = {
        "schema_version": F.col("schema_version") != SCHEMA_VERSION,
        "failure_concealed": F.array_contains(statuses, "FAIL") & (said != "FAIL"),
        "pass_hides_dimension": good & F.exists(statuses, lambda s: s != "PASS"),
        "pass_with_error": good & (F.col("error_findings") > 0),
        "pass_with_skipped": good & (F.col("skipped") > 0),
        "fresh_without_head": F.coalesce(F.try_element_at("dimensions", F.lit("freshness")), F.lit("")).eqNullSafe(F.lit("PASS")) & F.col("expected_head").isNull(),
        "anchor_mismatch": F.col("expected_head").isNotNull() != (F.col("anchor") != "none"),
        "rollup_mismatch": said != F.col("overall_status"),
        "requirement_mismatch": F.array_contains("required", "freshness") != needed,
        "policy_mismatch": F.col("said_policy") != F.col("policy_result"),
        "exit_mismatch": F.col("said_exit") != F.col("exit_code"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for name, when in broken.items()]))
    return rows.select("report_id", F.explode(found).alias("violation"))


def freshness(anchors: DataFrame, history: DataFrame, head: int) -> DataFrame:
    """client, status, note of anchors (client, kind, seq, commit_id) against the history (seq, commit_id): a head
    that the user expects must be in it, and the commit that this client saw last must be the same."""
    by_id = history.select(F.col("commit_id").alias("commit_id"), F.col("seq").alias("found_seq"))
    by_seq = history.select("seq", F.col("commit_id").alias("found_id"))
    rows = anchors.join(by_id, "commit_id", "left").join(by_seq, "seq", "left")
    user, local = F.col("kind") == "user", F.col("kind") == "local_history"
    status = F.when(F.col("kind") == "none", "UNKNOWN").when((user & F.col("found_seq").isNull()) | (local & ~F.coalesce(F.col("found_id") == F.col("commit_id"), F.lit(False))), "FAIL").otherwise("PASS")
    note = (
        F.when(user & F.col("found_seq").isNull(), "rolled back or substituted")
        .when(user & (F.col("found_seq") < head), "advanced")
        .when(local & F.col("found_id").isNull(), "rolled back")
        .when(local & (F.col("found_id") != F.col("commit_id")), "substituted")
    )
    return rows.select("client", status.alias("status"), note.alias("note"))


def latest(evidence: DataFrame) -> DataFrame:
    """Per dimension and kind the record completed last; of equal ones the last recorded."""
    own = F.max_by(F.struct("event_id", "seq", "completed", "status"), F.struct("completed", "event_id")).alias("r")
    return evidence.groupBy("dimension", "kind").agg(own).select("dimension", "kind", "r.*")


def applicable(evidence: DataFrame) -> DataFrame:
    """Records that can speak for their dimension: all for recoverability, verifications for integrity too,
    none for anything else; UNKNOWN assesses nothing."""
    speaks = (F.col("dimension") == "recoverability") | ((F.col("dimension") == "integrity") & (F.col("kind") == "verify"))
    return evidence.where(speaks & (F.col("status") != "UNKNOWN"))


def judged(latest_records: DataFrame, failed: DataFrame, now: int, head: int, limit: int) -> DataFrame:
    """dimension, kind, judgement: a failure stands at any age; then other heads, the future, and age count."""
    rows = latest_records.join(failed.select("dimension", "kind").distinct().withColumn("sticks", F.lit(True)), ["dimension", "kind"], "left")
    return rows.select("dimension", "kind", _verdict(now, head, F.lit(limit)).alias("judgement"), F.coalesce("sticks", F.lit(False)).alias("ever_failed"))


def _verdict(now: int, head: int, limit: Column) -> Column:
    return (
        F.when(F.col("status") == "FAIL", "FAIL")
        .when(F.col("seq") != head, "UNKNOWN")
        .when(F.col("completed") > now, "UNKNOWN")
        .when(now - F.col("completed") > limit, "OVERDUE")
        .otherwise(F.col("status"))
    )


def assessed(evidence: DataFrame, now: int, head: int, limits: dict[str, int], unreadable: int = 0, fresh: str | None = None) -> DataFrame:
    """dimension, status, age of every dimension, from the evidence log.

    Of integrity and recoverability each kind that has an age limit (seconds) counts; others only if none of
    the kinds that can speak has one, or by a failure. Lines of the log that cannot be read demote PASS.
    `fresh` is the verdict on the anchor, if there is one; no evidence covers the rest.
    """
    spark = evidence.sparkSession
    feeds = [("integrity", "verify"), ("recoverability", "verify"), ("recoverability", "restore_test")]
    known = spark.createDataFrame([(d, k, limits.get(k), any(k2 in limits for d2, k2 in feeds if d2 == d)) for d, k in feeds], "dimension string, kind string, age_limit long, limited boolean")
    rows = known.join(latest(applicable(evidence)), ["dimension", "kind"], "left")
    verdict = F.when(F.col("status").isNotNull(), _verdict(now, head, F.col("age_limit"))).otherwise("UNKNOWN")
    rows = rows.withColumn("verdict", verdict)
    counts = F.col("age_limit").isNotNull() | (F.col("status").isNotNull() & (~F.col("limited") | (F.col("verdict") == "FAIL")))
    age = F.greatest(F.lit(0), now - F.col("completed"))
    own = rows.groupBy("dimension").agg(worst(F.when(counts, F.col("verdict"))).alias("status"), F.max(F.when(counts, age)).cast("long").alias("age"))
    if unreadable:
        own = own.withColumn("status", F.when(F.col("status") == "PASS", "UNKNOWN").otherwise(F.col("status")))
    fixed = [("freshness", fresh or "UNKNOWN"), ("durability", "UNKNOWN"), ("searchability", "UNSUPPORTED"), ("retention_compliance", "UNSUPPORTED"), ("key_availability", "UNKNOWN")]
    return own.unionByName(spark.createDataFrame([(d, s, None) for d, s in fixed], "dimension string, status string, age long"))
