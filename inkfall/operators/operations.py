"""Operational analytics: duplicates, versions, guardrails, quarantine, queue, metrics, alerts, audit."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfall.config import DEFAULTS, Settings
from inkfall.functions.text import chunk_estimate, token_estimate


def latest(rows: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """A row per key: the last one by the given columns, and among equals, or without any, the one with the greatest hash of all columns."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    order = F.struct(*[F.col(c).alias(f"by{i}") for i, c in enumerate(by or [])], F.xxhash64(*rows.columns).alias("hash"))
    return rows.groupBy(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)]).agg(F.max_by(whole, order).alias("row")).select("row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows of new replace those of old with the same keys; of new rows that share their keys only the last one by the given columns stays."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(latest(new, keys, by), allowMissingColumns=True)


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the keys that went; a child table loses its rows in the same way."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose key is not in the parents, as NOT IN has it: none if a parent's key is null, and a null key only where there are no parents.

    The anti-join shuffles like any other; what nulls decide is one row.
    """
    known = parents.agg(F.count("*").alias("all"), F.count(key).alias("keyed"))
    apart = children.join(parents.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").crossJoin(F.broadcast(known))
    return apart.where((F.col("all") == 0) | ((F.col("all") == F.col("keyed")) & F.col(key).isNotNull())).select(*children.columns)


def with_counts(parents: DataFrame, children: DataFrame, key: str, name: str = "n_chunks") -> DataFrame:
    """Adds how many children each parent has, 0 without any."""
    per = children.groupBy(F.col(key).alias("counted")).agg(F.count("*").alias(name))
    return parents.join(per, F.col(key) == F.col("counted"), "left").drop("counted").withColumn(name, F.coalesce(name, F.lit(0)))


def folder_counts(files: DataFrame, folders: list[str], path: str = "path", size: str = "size") -> DataFrame:
    """folder, files, bytes of everything below each of a list of folders, which may lie in one another; 0 for one that is missing."""
    listed = files.sparkSession.createDataFrame([(f,) for f in folders], "folder string")
    below = F.filter(F.array(*map(F.lit, folders)), lambda f: F.startswith(F.col(path), F.concat(F.rtrim(f, F.lit("/")), F.lit("/"))))
    per = files.select(F.explode(below).alias("of"), F.col(size).alias("size")).groupBy("of").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    zero = F.lit(0).cast("long")
    return listed.join(F.broadcast(per), F.col("folder") == F.col("of"), "left").select("folder", F.coalesce("files", zero).alias("files"), F.coalesce("bytes", zero).alias("bytes"))


def file_changes(before: DataFrame, after: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """path, event of two scans of a folder: created, modified or deleted; a file that moved is deleted and created."""
    old, new = before.select(F.col(path).alias("path"), F.col(digest).alias("was")), after.select(F.col(path).alias("path"), F.col(digest).alias("now"))
    both = old.withColumn("there", F.lit(True)).join(new.withColumn("here", F.lit(True)), "path", "full")
    event = F.when(F.col("there").isNull(), "created").when(F.col("here").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return both.select("path", event.alias("event")).where("event IS NOT NULL")


# duplicates and versions


def duplicates(docs: DataFrame, by: str = "hash", path: str = "path", least: int = 2) -> DataFrame:
    """by, paths joined in order, count of values that occur on several paths."""
    paths = F.array_join(F.sort_array(F.collect_list(path)), "|")
    return docs.groupBy(by).agg(paths.alias("paths"), F.count("*").alias("n")).where(F.col("n") >= least)


def occurrences(docs: DataFrame, by: str = "hash", least: int = 2) -> DataFrame:
    """The documents whose value occurs often enough, with n, the most frequent first: a row each, so no list grows with a value's copies."""
    per = docs.groupBy(F.col(by).alias("of")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return docs.join(per, F.col(by) == F.col("of")).drop("of").orderBy(F.desc("n"), *docs.columns)


def duplicate_stats(docs: DataFrame, by: str = "hash") -> DataFrame:
    per = docs.groupBy(by).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count("*").alias("distinct_contents"), F.count_if(F.col("n") > 1).alias("duplicated_contents"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))


def first_owners(chunks: DataFrame, by: str = "chunk_hash") -> DataFrame:
    """Adds first: whether a chunk is the first with its hash, by document and index."""
    first = chunks.groupBy(F.col(by).alias("of")).agg(F.min(F.struct("doc_id", "chunk_index")).alias("owner"))
    return chunks.join(first, F.col(by).eqNullSafe(F.col("of"))).withColumn("first", F.struct("doc_id", "chunk_index") == F.col("owner")).drop("of", "owner")


def versions(changes: DataFrame, path: str = "path", at: str = "ts", content: str | None = None) -> DataFrame:
    """Adds version, counted per path in time, and changed: whether the content differs from the version before."""
    w = Window.partitionBy(path).orderBy(at)
    out = changes.withColumn("version", F.row_number().over(w))
    return out if content is None else out.withColumn("changed", F.coalesce(F.col(content) != F.lag(content).over(w), F.lit(True)))


def registered(known: DataFrame, files: DataFrame, at) -> DataFrame:
    """path, hash, content_hash, version, created_at, updated_at after files (path, hash, content_hash) came in: each counts its path's version up."""
    new = latest(files, ["path"]).select(F.col("path").alias("p"), F.col("hash").alias("h"), F.col("content_hash").alias("c"))
    both = known.join(new, F.col("path") == F.col("p"), "full")
    came = F.col("p").isNotNull()
    return both.select(
        F.coalesce("p", "path").alias("path"), F.when(came, F.col("h")).otherwise(F.col("hash")).alias("hash"), F.when(came, F.col("c")).otherwise(F.col("content_hash")).alias("content_hash"),
        (F.coalesce("version", F.lit(0)) + came.cast("int")).alias("version"), F.coalesce("created_at", at).alias("created_at"), F.when(came, at).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def content_index(known: DataFrame) -> DataFrame:
    """content_hash, paths, occurrence_count of the registered documents. It is worked out anew, so a document that is gone leaves nothing behind."""
    return known.groupBy("content_hash").agg(F.sort_array(F.collect_set("path")).alias("paths")).withColumn("occurrence_count", F.size("paths"))


def removed(known: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registered documents and their chunks without the paths that are gone, and without chunks of documents that are not registered."""
    left = without(known, gone, ["path"])
    return left, chunks.join(left.select("path").distinct(), "path", "left_semi")


def needs_index(files: DataFrame, known: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """The files whose path and digest are not known yet."""
    return files.join(known.select(path, digest), [path, digest], "left_anti")


# guardrails and quarantine


def limits_of(s: Settings = DEFAULTS) -> dict[str, float]:
    """The limits on what only the columns of a table can tell, by the column's name."""
    return {"file_bytes": s.max_file_bytes, "pages": s.max_pages, "seconds": s.max_seconds, "sheets": s.max_sheets, "rows_per_sheet": s.max_rows_per_sheet, "ocr_pages": s.max_ocr_pages, "cost_usd": s.max_cost_usd}


def guardrails(docs: DataFrame, text: str = "text", s: Settings = DEFAULTS, **more: tuple[Column, float]) -> DataFrame:
    """Adds violations: the names of all limits a document breaks, those of limits_of where the column is there. more: name=(measure, limit).

    A measure that is null breaks nothing.
    """
    told = {name: (F.col(name), limit) for name, limit in limits_of(s).items() if name in docs.columns}
    checks = {"chars": (F.length(text), s.max_chars), "tokens": (token_estimate(text), s.max_tokens), "chunks": (chunk_estimate(text), s.max_chunks), **told, **more}
    names = [F.when(measure > limit, F.lit(name)) for name, (measure, limit) in checks.items()]
    return docs.withColumn("violations", F.array_compact(F.array(*names)))


def admitted(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents within the limits, and those for quarantine."""
    return checked.where(F.size("violations") == 0), checked.where(F.size("violations") > 0)


def enforced(checked: DataFrame) -> DataFrame:
    """Stops the job at the first document that breaks a limit."""
    return checked.withColumn("violations", F.when(F.size("violations") > 0, F.raise_error(F.concat(F.lit("guardrail: "), F.array_join("violations", ",")))).otherwise(F.col("violations")))


def quarantine(old: DataFrame, failed: DataFrame, max_retries: int = 3) -> DataFrame:
    """Failures come in with a retry more than before; a fatal exit (a negative code) cannot be retried."""
    before = old.select(F.col("path").alias("p"), F.col("retry_count").alias("tries"))
    new = failed.join(before, F.col("path") == F.col("p"), "left").select(
        "path", "reason", "stage", "ts", F.coalesce(F.col("tries") + 1, F.lit(0)).alias("retry_count"), F.lit(max_retries).alias("max_retries"),
        (F.coalesce(F.col("exit_code"), F.lit(0)) >= 0).alias("recoverable"),
    )
    return upsert(old, new, ["path"])


def retryable(held: DataFrame) -> DataFrame:
    return held.where(F.col("recoverable") & (F.col("retry_count") < F.col("max_retries")))


def quarantined(held: DataFrame, recoverable_only: bool = False, stage: str | None = None, limit: int = 100) -> DataFrame:
    """The documents in quarantine, the earliest first."""
    rows = held.where("recoverable") if recoverable_only else held
    rows = rows if stage is None else rows.where(F.col("stage") == stage)
    return rows.orderBy("ts", "path").limit(limit)


def released(held: DataFrame, paths: DataFrame) -> DataFrame:
    """The quarantine without the documents that are let go."""
    return without(held, paths, ["path"])


def skipped_for_good(held: DataFrame, paths: DataFrame, at) -> DataFrame:
    """Documents that are never tried again; adds skipped_at."""
    hit = paths.select(F.col("path").alias("hit")).distinct()
    rows = held if "skipped_at" in held.columns else held.withColumn("skipped_at", F.lit(None).cast("timestamp"))
    rows = rows.join(hit, F.col("path") == F.col("hit"), "left")
    skip = F.col("hit").isNotNull()
    return rows.withColumns({"recoverable": F.col("recoverable") & ~skip, "skipped_at": F.when(skip, at).otherwise(F.col("skipped_at"))}).drop("hit")


def quarantine_stats(held: DataFrame) -> DataFrame:
    """kind, name, n: total, recoverable, by stage and by the first 50 characters of the reason, in one pass."""
    every = F.lit(True)
    return kinds_counted(held, ("total", every, F.lit("")), ("recoverable", F.col("recoverable"), F.lit("")), ("stage", every, F.col("stage")), ("reason", every, F.substring("reason", 1, 50)))


def resumable(progress: DataFrame, max_retries: int = 3) -> DataFrame:
    """What is unfinished, then what failed and may be tried again."""
    open_ = progress.where(~F.col("stage").isin("completed", "failed"))
    again = progress.where((F.col("stage") == "failed") & (F.col("retry_count") < max_retries))
    return open_.unionByName(again)


def progress_stats(progress: DataFrame, max_retries: int = 3) -> DataFrame:
    """kind, name, n: total, by stage, incomplete, failed and resumable, in one pass."""
    failed, done = F.col("stage") == "failed", F.col("stage") == "completed"
    return kinds_counted(
        progress,
        ("total", F.lit(True), F.lit("")),
        ("stage", F.lit(True), F.col("stage")),
        ("incomplete", ~failed & ~done, F.lit("")),
        ("failed", failed, F.lit("")),
        ("resumable", (~failed & ~done) | (failed & (F.col("retry_count") < max_retries)), F.lit("")),
    )


def kinds_counted(rows: DataFrame, *kinds: tuple[str, Column, Column]) -> DataFrame:
    """kind, name, n over several groupings (kind, which rows, by what), in one pass."""
    told = F.array_compact(F.array(*[F.when(which, F.struct(F.lit(kind).alias("kind"), name.alias("name"))) for kind, which, name in kinds]))
    return rows.select(F.explode(told).alias("k")).groupBy("k.kind", "k.name").agg(F.count("*").alias("n"))


def kept_since(rows: DataFrame, cutoff, ts: str = "ts") -> DataFrame:
    return rows.where(F.col(ts) >= cutoff)


# queue


def next_jobs(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The waiting jobs with tries left, by priority, then age."""
    return jobs.where((F.col("status") == "pending") & (F.col("attempts") < F.col("max_attempts"))).orderBy(F.desc("priority"), "created_at", "id").limit(n)


def job_priority(kind) -> Column:
    return F.when(kind == "delete", 100).when(kind == "reindex", 50).otherwise(0)


def queue_stats(jobs: DataFrame, states=("pending", "processing", "completed", "failed")) -> DataFrame:
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in states], F.count("*").alias("total"))


def finished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs after their runs (id, ok): a failed one waits again while it had tries left before."""
    r = results.select(F.col("id").alias("r"), "ok")
    ran = jobs.join(r, F.col("id") == F.col("r"), "left")
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "completed").when(F.col("attempts") < F.col("max_attempts"), "pending").otherwise("failed")
    return ran.withColumn("status", status).withColumn("attempts", F.col("attempts") + F.col("ok").isNotNull().cast("int")).drop("r", "ok")


# metrics


def window_stats(metrics: DataFrame, since, until, ts: str = "ts") -> DataFrame:
    """Documents, mean time, sums of errors and values in a span; 0 where there is nothing."""
    held = metrics.where((F.col(ts) >= since) & (F.col(ts) < until))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return held.agg(
        F.count("*").alias("documents"), zero(F.avg("total_ms")).alias("avg_ms"), zero(F.sum("errors")).cast("long").alias("errors"),
        zero(F.sum("warnings")).cast("long").alias("warnings"), F.avg("ocr_confidence").alias("avg_ocr_confidence"),
    )


def error_rate(metrics: DataFrame, since, until, ts: str = "ts") -> DataFrame:
    held = metrics.where((F.col(ts) >= since) & (F.col(ts) < until))
    return held.agg(F.coalesce(F.count_if(F.col("errors") > 0) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("error_rate"))


def cost_by_service(costs: DataFrame) -> DataFrame:
    return costs.groupBy("service").agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def session_stats(metrics: DataFrame, ts: str = "ts") -> DataFrame:
    """Documents, successes and documents an hour between the first and the last."""
    hours = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))) / F.lit(3.6e9)
    return metrics.agg(F.count("*").alias("documents"), F.count_if(F.col("errors") == 0).alias("succeeded"), F.when(hours > 0, F.count("*") / hours).otherwise(F.lit(0.0)).alias("docs_per_hour"))


def progress_of(sessions: DataFrame) -> DataFrame:
    """Adds percent, rate and seconds left to sessions (processed, total, seconds)."""
    rate = F.when(F.col("seconds") > 0, F.col("processed") / F.col("seconds")).otherwise(F.lit(0.0))
    return sessions.withColumns({"percent": F.when(F.col("total") > 0, 100.0 * F.col("processed") / F.col("total")).otherwise(F.lit(0.0)), "rate": rate, "eta_s": F.when(rate > 0, (F.col("total") - F.col("processed")) / rate)})


#: Which states a session can be paused, resumed and cancelled from.
MOVES = {"paused": ("running",), "running": ("paused",), "cancelled": ("running", "paused")}


def sessions_moved(sessions: DataFrame, ids: DataFrame, to: str) -> DataFrame:
    """Sessions (id, status) after some were paused, resumed or cancelled; one whose state does not allow it stays as it is."""
    hit = ids.select(F.col("id").alias("hit")).distinct()
    rows = sessions.join(hit, F.col("id") == F.col("hit"), "left")
    moves = F.col("hit").isNotNull() & F.col("status").isin(*MOVES[to])
    return rows.withColumn("status", F.when(moves, to).otherwise(F.col("status"))).drop("hit")


# alerts: fixed limits of the ladder, warning and critical
LADDER = {"error_rate": (0.1, 0.3), "queue": (100, 500), "cost": (10, 50)}
# alerts: fixed limits with one severity
STEPS = {"chunks": (1000, "warning"), "failures": (3, "error")}


def severity(kind: str, measure) -> Column:
    """The severity of a measure by its rule, null where it is within the limits."""
    if kind in STEPS:
        limit, name = STEPS[kind]
        return F.when(measure >= limit, name)
    warning, critical = LADDER[kind]
    return F.when(measure >= critical, "critical").when(measure >= warning, "warning")


def alerts_raised(measures: DataFrame) -> DataFrame:
    """The measures (kind, measure, ...) that break their rule, with their severity."""
    found = F.lit(None).cast("string")
    for kind in (*LADDER, *STEPS):
        found = F.when(F.col("kind") == kind, severity(kind, F.col("measure"))).otherwise(found)
    return measures.withColumn("severity", found).where("severity IS NOT NULL")


def alerts_since(alerts: DataFrame, now, hours: int = 24, resolved: bool | None = None, limit: int = 100, **equal) -> DataFrame:
    """The alerts of the last hours, the latest first."""
    return filtered(alerts, since=now - F.make_dt_interval(hours=F.lit(hours)), limit=limit, resolved=resolved, **equal)


def active_alerts(alerts: DataFrame, now, limit: int = 100) -> DataFrame:
    """What is unresolved of the last week."""
    return alerts_since(alerts, now, 168, False, limit)


def alerts_kept(alerts: DataFrame, cutoff, ts: str = "ts") -> DataFrame:
    """All alerts but those that are resolved and older."""
    return alerts.where(~F.col("resolved") | (F.col(ts) >= cutoff))


def deduplicated_alerts(alerts: DataFrame, key: str = "key", ts: str = "ts", minutes: int = 5) -> DataFrame:
    """An alert is emitted if the last one emitted for its key is at least so long ago.

    Each step hangs on the last one emitted, so a key's alerts are folded in order. Alerts of a key that lie
    over the span apart start a new run whatever came before, so runs and not keys are what a task folds.
    """
    span = minutes * 60 * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("at", *[c for c in alerts.columns if c not in (key, ts)])
    rows = alerts.withColumn("at", at)
    rows = rows.withColumn("new", (F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(span)) >= span).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in ("at", *pdf.columns) if c != ts], kind="stable")
        last, keep = None, []
        for t in pdf["at"]:
            keep.append(last is None or t - last >= span)
            last = t if keep[-1] else last
        return pdf[keep]

    return rows.groupBy(key, "run").applyInPandas(fold, rows.schema).drop("at", "new", "run")


def alert_stats(alerts: DataFrame) -> DataFrame:
    """kind, name, n over severities, types and what is unresolved, in one pass."""
    every = F.lit(True)
    return kinds_counted(alerts, ("severity", every, F.col("severity")), ("type", every, F.col("alert_type")), ("unresolved", ~F.col("resolved"), F.lit("")))


def resolved(alerts: DataFrame, ids: DataFrame, note: str, at) -> DataFrame:
    hit = ids.select(F.col("id").alias("hit")).distinct()
    rows = alerts.join(hit, F.col("id") == F.col("hit"), "left")
    done = F.col("hit").isNotNull()
    return rows.withColumns({"resolved": F.col("resolved") | done, "resolved_at": F.when(done, at).otherwise(F.col("resolved_at")), "note": F.when(done, F.lit(note)).otherwise(F.col("note"))}).drop("hit")


# audit


def with_checksum(log: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the first 16 hex digits of the SHA-256 of a row's values as JSON."""
    return log.withColumn("checksum", F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16))


def audit_stats(log: DataFrame) -> DataFrame:
    """kind, name, n: total, errors and events by action, in one pass."""
    return kinds_counted(log, ("total", F.lit(True), F.lit("")), ("errors", ~F.col("success"), F.lit("")), ("action", F.lit(True), F.col("action")))


def filtered(rows: DataFrame, since=None, until=None, ts: str = "ts", limit: int | None = None, **equal) -> DataFrame:
    """Rows within a span and with the given values, the latest first; conditions that are None are left out."""
    tests = [F.col(ts) >= since] * (since is not None) + [F.col(ts) <= until] * (until is not None) + [F.col(k) == v for k, v in equal.items() if v is not None]
    held = reduce(lambda df, t: df.where(t), tests, rows)
    return held if limit is None else held.orderBy(F.desc(ts), *[c for c in rows.columns if c != ts]).limit(limit)


def header_rows(rows: DataFrame, sheet: str = "sheet", row: str = "row", cells: str = "cells", among: int = 10, most: int = 3) -> DataFrame:
    """sheet, row of the rows among a sheet's first ten, counted from 1, that can be headers: three at most."""
    from inkfall.functions.text import header_like

    found = rows.where((F.col(row) <= among) & header_like(cells)).select(sheet, row)
    place = F.row_number().over(Window.partitionBy(sheet).orderBy(row))  # ten rows a sheet
    return found.withColumn("place", place).where(F.col("place") <= most).drop("place")


def files_failed(known: DataFrame, failed: DataFrame, at) -> DataFrame:
    """The register of files (path, status, error, indexed_at) after some could not be read (path, error)."""
    new = failed.select("path", F.lit("failed").alias("status"), "error", at.alias("indexed_at"))
    return upsert(known, new, ["path"])


def work_off(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], do: Callable[[DataFrame], DataFrame], at_once: int = 1000, rounds: int | None = None) -> int:
    """Takes the waiting jobs in their order, some at a time, until none is left, and returns how many rounds that took.

    do gives (id, ok) of the jobs it got. A round that is lost is done again, as its jobs still wait: at least once each.
    """
    done = 0
    while rounds is None or done < rounds:
        jobs = read()
        some = next_jobs(jobs, at_once)
        if some.isEmpty():
            break
        write(finished(jobs, do(some)))
        done += 1
    return done


def page_count(rows: DataFrame, size: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / F.lit(float(size))).cast("long").alias("pages"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, non_empty, distinct values, kind and the first five distinct values in order of every column, by one pass over an unpivoted table."""
    from inkfall.functions.text import KINDS, value_kind

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value IS NOT NULL")
    per = long.withColumn("kind", value_kind("value")).groupBy("column", "kind").agg(F.count("*").alias("n"))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(-i))])
    kinds = per.groupBy("column").agg(F.sum("n").alias("non_empty"), F.max_by("kind", F.struct("n", rank[F.col("kind")])).alias("kind"))
    values = long.groupBy("column", "value").agg(F.lit(1).alias("one"))
    few = values.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where("rank <= 5").groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    return kinds.join(values.groupBy("column").agg(F.count("*").alias("distinct_values")), "column").join(few, "column")
