"""The capture ledger: statuses, evidence rules, reconciliation with the frozen order, roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capture_accepted(stored: Column, selection: Column, qc: Column) -> Column:
    """The stored verdict, or for older records the one inferred from selection and visual check."""
    return F.coalesce(stored, selection & (qc == "pass"))


def capture_decision(selection: Column, qc: Column) -> Column:
    return F.when(selection & (qc == "pass"), "accepted").when(selection, "rejected_visual").otherwise("rejected_numerical")


def with_status(ledger: DataFrame) -> DataFrame:
    """Fills in the verdict and decision that older records lack."""
    selection, qc = F.col("selection_accepted"), F.col("visual_qc")
    decided = capture_decision(selection, qc)
    stored = F.coalesce("capture_decision", decided) if "capture_decision" in ledger.columns else decided
    return ledger.withColumns({"capture_accepted": capture_accepted(F.col("capture_accepted"), selection, qc), "capture_decision": stored})


def evidence_violations(ledger: DataFrame, expected_pairs: int = 12, artifacts: tuple[str, ...] = ("validation_report", "rendered_manifest", "render_protocol", "contact_sheet")) -> DataFrame:
    """Records that contradict themselves.  ledger: capture_id, selection_accepted, selection_pair_count, visual_qc, capture_accepted, artifact_names, validation_passed."""
    c, yes = F.col, F.col("selection_accepted")
    rules = {
        "accepted_pair_count": yes & (c("selection_pair_count") != expected_pairs),
        "rejected_pair_count": ~yes & (c("selection_pair_count") != 0),
        "missing_artifacts": yes & (F.size(F.array_except(F.array(*map(F.lit, artifacts)), F.coalesce("artifact_names", F.array().cast("array<string>")))) > 0),
        "validation_not_passed": yes & ~F.coalesce("validation_passed", F.lit(False)),
        "accepted_without_check": yes & ~F.coalesce(c("visual_qc").isin("pass", "fail"), F.lit(False)),
        "rejected_with_check": ~yes & (c("visual_qc") != "not_applicable"),
        "stored_verdict_differs": c("capture_accepted").isNotNull() & (c("capture_accepted") != (yes & (c("visual_qc") == "pass"))),
    }
    return ledger.select("capture_id", F.explode(F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in rules.items())))).alias("rule"))


def order_violations(ledger: DataFrame, order: DataFrame, complete: bool = False) -> DataFrame:
    """Records that are not the frozen order's beginning (or, if complete, all of it)."""
    a, b = ledger.alias("a"), order.alias("b")
    joined = a.join(b, F.col("a.order_index") == F.col("b.order_index"), "full_outer")
    last = F.broadcast(ledger.agg(F.max("order_index").alias("__last")))  # one row is broadcast
    gap = F.col("a.order_index").isNull() & (F.lit(complete) | (F.col("b.order_index") <= F.col("__last")))
    rule = F.when(F.col("b.order_index").isNull(), "unknown_index").when(gap, "gap").when(F.col("a.capture_id") != F.col("b.capture_id"), "wrong_capture")
    return joined.crossJoin(last).select(F.coalesce("a.order_index", "b.order_index").alias("order_index"), rule.alias("rule")).filter("rule is not null")


def rejection_counts(decisions: DataFrame, unspecified: str = "unspecified_numerical_rejection", visual: str = "visual_qc_failure") -> DataFrame:
    """Rejected captures per reason.

    decisions: accepted, rejection_reasons and, if there is one,
    capture_decision.  A rejection by eye counts under ``visual`` alone, one
    without a reason under ``unspecified``.
    """
    by_eye = F.coalesce(F.col("capture_decision") == "rejected_visual", F.lit(False)) if "capture_decision" in decisions.columns else F.lit(False)
    given = F.when(F.coalesce(F.size("rejection_reasons"), F.lit(0)) > 0, F.col("rejection_reasons")).otherwise(F.array(F.lit(unspecified)))
    reasons = decisions.filter("not accepted").select(F.explode(F.when(by_eye, F.array(F.lit(visual))).otherwise(given)).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def rollup(ledger: DataFrame, target: int | None = None) -> DataFrame:
    """Inspected, accepted and rejected captures and their rates; with the columns for it, the accepted ones' range of distances and relations, and what is lacking to a target."""
    yes, qc = F.col("selection_accepted"), F.col("visual_qc")
    ok = yes & (qc == "pass")
    more = {
        "selected_relations": ("selection_pair_count", F.sum), "global_selected_minimum_m": ("selected_minimum_m", F.min), "global_selected_maximum_m": ("selected_maximum_m", F.max),
    }
    sums = ledger.agg(
        F.count("*").alias("inspected"), F.count_if(ok).alias("accepted"), F.count_if(yes).alias("accepted_numerical"), F.count_if(~yes).alias("rejected_numerical"), F.count_if(yes & (qc != "pass")).alias("rejected_visual"),
        *(f(F.when(ok, F.col(c))).alias(n) for n, (c, f) in more.items() if c in ledger.columns),
    )
    rated = sums.withColumns({"acceptance_rate": F.when(F.col("inspected") > 0, F.col("accepted") / F.col("inspected")), "visual_pass_rate": F.when(F.col("accepted_numerical") > 0, F.col("accepted") / F.col("accepted_numerical"))})
    return rated if target is None else rated.withColumn("target_shortfall", F.lit(target) - F.col("accepted"))


def expectation_violations(counts: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(name, observed, expected) of the counts of a single row that are not what a frozen protocol expects."""
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("observed"), F.lit(v).cast("long").alias("expected")) for n, v in expected.items()))
    return counts.select(F.inline(rows)).filter("not (observed <=> expected)")


def order_counts(records: DataFrame, excluded: DataFrame, key: str = "capture_id") -> DataFrame:
    """One row: records, distinct ones, exclusions, exclusions that no record has, and the pool that is left."""
    known = records.select(key).distinct().withColumn("known", F.lit(1))
    left_out = excluded.select(key).distinct().withColumn("out", F.lit(1))
    n = records.agg(F.count("*").alias("records"))
    both = known.join(left_out, key, "full_outer").agg(F.count("known").alias("unique_records"), F.count("out").alias("exclusions"), F.count_if(F.col("known").isNull()).alias("unknown_exclusions"), F.count_if(F.col("out").isNull()).alias("pool"))
    return n.crossJoin(F.broadcast(both))  # one row is broadcast


def batch_commit(official: DataFrame, snapshot: DataFrame, batch: DataFrame, fields: list[str], position: str = "order_index") -> tuple[DataFrame, DataFrame]:
    """(violations, rows still to record) of a batch that was prepared against a snapshot of the log.

    The log may have grown by rows of this batch, each equal to the prepared
    one in ``fields``; any other difference is a violation: 'prefix' where the
    log and the snapshot differ, 'outside' for a later row of the log that the
    batch does not hold, 'differs' for one that it holds otherwise.
    """
    a, b, c = (x.select(F.col(position).alias(f"{n}_at"), F.struct(*fields).alias(n)) for x, n in ((official, "log"), (snapshot, "snap"), (batch, "new")))
    joined = a.join(b, F.col("log_at") == F.col("snap_at"), "full_outer").withColumn("at", F.coalesce("log_at", "snap_at")).join(c, F.col("at") == F.col("new_at"), "full_outer")
    at = F.coalesce("at", "new_at").alias(position)
    later = F.col("snap_at").isNull() & F.col("log_at").isNotNull()
    rule = F.when(F.col("snap_at").isNotNull() & ~F.col("log").eqNullSafe(F.col("snap")), "prefix").when(later & F.col("new_at").isNull(), "outside").when(later & ~F.col("log").eqNullSafe(F.col("new")), "differs")
    return joined.select(at, rule.alias("rule")).filter("rule is not null"), batch.join(official.select(position), position, "left_anti")


def visual_decisions(decisions: DataFrame, pending: DataFrame) -> DataFrame:
    """Captures whose decision is missing, or that were not pending, or whose verdict does not fit their selection."""
    a, b = decisions.alias("a"), pending.alias("b")
    joined = a.join(b, F.col("a.capture_id") == F.col("b.capture_id"), "full_outer")
    fits = F.when(F.col("b.selection_accepted"), F.col("a.visual_qc").isin("pass", "fail")).otherwise(F.col("a.visual_qc") == "not_applicable")
    rule = F.when(F.col("a.capture_id").isNull(), "missing").when(F.col("b.capture_id").isNull(), "not_pending").when(~F.coalesce(fits, F.lit(False)), "verdict_does_not_fit")
    return joined.select(F.coalesce("a.capture_id", "b.capture_id").alias("capture_id"), rule.alias("rule")).filter("rule is not null")


def artifact_violations(artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded (path, size_bytes, sha256) that no file has."""
    a, b = artifacts.alias("a"), files.alias("b")
    joined = a.join(b, F.col("a.path") == F.col("b.path"), "left")
    rule = F.when(F.col("b.path").isNull(), "missing").when(F.col("a.size_bytes") != F.col("b.size_bytes"), "size").when(F.col("a.sha256") != F.col("b.sha256"), "sha256")
    return joined.select(F.col("a.path").alias("path"), rule.alias("rule")).filter("rule is not null")


def stimulus_violations(manifest: DataFrame, reference: DataFrame, files: DataFrame, key: str = "pair_id", allow_missing: bool = False) -> DataFrame:
    """(key, rule) of the pairs whose stimulus is not the one that a reference run saw; each pair's first rule.

    manifest: key and stimulus, a path; reference: key and stimulus_sha256;
    files: path and sha256 (``files.file_hashes``).  A pair may be
    'not_in_reference', its reference 'without_hash', its file 'missing'
    (unless allowed) or one that 'differs'; a reference to no pair of the
    manifest is 'not_in_manifest'.
    """
    wanted = manifest.select(F.col(key).alias("own"), F.col("stimulus"))
    hashed = reference.select(F.col(key).alias("known"), F.col("stimulus_sha256").alias("expected"))
    both = wanted.join(hashed, F.col("own").eqNullSafe(F.col("known")) & F.col("own").isNotNull(), "full_outer")
    told = both.join(files.select(F.col("path").alias("stimulus"), F.col("sha256").alias("found")), "stimulus", "left")
    c = F.col
    rule = F.when(c("own").isNull() & c("known").isNotNull(), "not_in_manifest").when(c("known").isNull(), "not_in_reference").when(F.coalesce(c("expected"), F.lit("")) == "", "without_hash")
    rule = rule.when(c("found").isNull(), F.lit(None) if allow_missing else "missing").when(c("found") != c("expected"), "differs")
    return told.select(F.coalesce("own", "known").alias(key), rule.alias("rule")).filter("rule is not null")


def until_gate(process: Callable[[int], bool], first: int, last: int) -> int | None:
    """Processes captures in their order until one needs a decision by hand; returns its index, or None when all are done.

    process: takes an order index and tells whether the capture, once processed, waits for a decision.  This is the
    loop around a batch, on the driver: each step reads the ledger that the one before it wrote.
    """
    return next((index for index in range(first, last + 1) if process(index)), None)
