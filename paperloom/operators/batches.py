"""Batches of documents: tasks, results, tables of results, queues, event logs, recovery. Latest-wins state is a grouped maximum.

Defined results: repeated rows count once where the docstring says distinct; batches without tasks are empty, not failed; null
results are no results; ties of time go to the greater id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fields import flattened, is_filled

# Fixed values.
CORE_COLUMNS = ["file_name", "status", "document_type", "kie_stage", "kie_production_hit", "kie_fields_count", "validation_passed", "validation_fields_failed", "error"]
DYNAMIC_COLUMNS = 40
TERMINAL = ["completed", "succeeded", "failed", "cancelled", "interrupted", "missing_artifacts"]


def batch_summary(tasks: DataFrame) -> DataFrame:
    """Per batch: distinct tasks by status, progress and success in percent, seconds from first start to last end, final status."""
    t = tasks.groupBy("batch_id", "task_id").agg(F.max_by("status", F.coalesce("completed_at", "started_at")).alias("latest"), F.max("status").alias("any"), F.min("started_at").alias("s"), F.max("completed_at").alias("e"))
    t = t.withColumn("status", F.coalesce("latest", "any"))
    n = {s: F.count_if(F.col("status") == s) for s in ("pending", "processing", "completed", "failed", "skipped", "cancelled")}
    out = t.groupBy("batch_id").agg(F.count("*").alias("total"), *[c.alias(s) for s, c in n.items()], F.timestamp_diff("SECOND", F.min("s"), F.max("e")).alias("seconds"))
    done = F.col("completed") + F.col("failed") + F.col("skipped") + F.col("cancelled")
    return out.withColumns({"progress": F.bround(100 * F.try_divide(done, "total"), 2), "success_rate": F.bround(100 * F.try_divide(F.col("completed"), F.col("completed") + F.col("failed")), 2), "final_status": final_status(F.col("total"), F.col("completed"), F.col("failed"), F.col("cancelled"), F.col("pending") + F.col("processing"))})


def final_status(total: Column, completed: Column, failed: Column, cancelled: Column, left: Column) -> Column:
    """What a batch comes to: still processing, failed if every task failed, cancelled if any was and none is left, else completed."""
    return F.when(left > 0, "processing").when((total > 0) & (failed == total), "failed").when(cancelled > 0, "cancelled").otherwise("completed")


def failures(tasks: DataFrame) -> DataFrame:
    """Distinct failed and skipped tasks with their errors cut to 400 characters."""
    return tasks.filter(F.col("status").isin("failed", "skipped")).select("batch_id", "task_id", "file_name", "status", F.left(F.coalesce("error", F.lit("")), F.lit(400)).alias("error")).distinct()


def summary_rows(summary: DataFrame) -> DataFrame:
    """(batch_id, metric, value): a batch summary as rows."""
    names = ["total", "completed", "failed", "pending", "processing", "skipped", "cancelled", "progress", "success_rate", "seconds"]
    return summary.select("batch_id", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("batch_id", "x.*")


def result_fields(tasks: DataFrame) -> DataFrame:
    """(batch_id, task_id, path, value): the extracted fields of every result under dotted paths."""
    own = tasks.filter("result is not null").select("batch_id", "task_id", F.get_json_object("result", "$.kie_fields").alias("k"))
    return flattened(own, ["batch_id", "task_id"], "k")


def dynamic_columns(fields: DataFrame, most: int = DYNAMIC_COLUMNS) -> DataFrame:
    """(batch_id, path, place): the first ``most`` field paths of each batch in order of their names, over all its tasks."""
    order = Window.partitionBy("batch_id").orderBy("path")
    return fields.select("batch_id", "path").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def kie_table(tasks: DataFrame, passed_only: bool = False) -> DataFrame:
    """Long form of the table of results: (batch_id, task_id, column, value, place) with the core columns first and then the dynamic ones.

    ``passed_only`` leaves out tasks that are not completed or whose validation failed; they still count for the columns.
    """
    j = lambda p: F.get_json_object("result", p)
    t = tasks.dropDuplicates(["batch_id", "task_id"]) if "place" not in tasks.columns else tasks
    valid = F.lower(F.coalesce(j("$.validation.valid"), j("$.quality.validation_passed")))
    core = {
        "file_name": F.col("file_name"), "status": F.col("status"), "document_type": F.coalesce(j("$.document_type"), j("$.quality.document_type"), F.lit("")), "kie_stage": F.coalesce(j("$.quality.kie_stage"), F.lit("")),
        "kie_production_hit": F.initcap(F.coalesce(j("$.quality.kie_production_hit"), F.lit("false"))), "kie_fields_count": F.coalesce(j("$.quality.kie_fields_count"), F.lit("0")), "validation_passed": F.initcap(F.coalesce(valid, F.lit(""))),
        "validation_fields_failed": F.coalesce(j("$.validation.fields_failed"), F.lit("")), "error": F.left(F.coalesce("error", F.lit("")), F.lit(400)),
    }
    kept = t.filter((F.col("status") == "completed") & ~F.coalesce(valid == "false", F.lit(False))) if passed_only else t
    first = kept.select("batch_id", "task_id", F.explode(F.array(*[F.struct(F.lit(n).alias("column"), c.cast("string").alias("value"), F.lit(i).alias("place")) for i, (n, c) in enumerate(core.items())])).alias("x")).select("batch_id", "task_id", "x.*")
    fields = result_fields(t)
    rest = dynamic_columns(fields)
    more = fields.join(rest, ["batch_id", "path"]).join(kept.select("batch_id", "task_id"), ["batch_id", "task_id"], "left_semi")
    return first.unionByName(more.select("batch_id", "task_id", F.col("path").alias("column"), "value", (F.col("place") + len(core) - 1).alias("place")))


def column_order(rows: DataFrame, stamp: list[str] | None = None) -> list[str]:
    """Columns of rows (position, column): as stamped, else in the order they first come. Column names are a schema, so this is a small list."""
    if stamp:
        return stamp
    return [r["column"] for r in rows.groupBy("column").agg(F.min("position").alias("p")).orderBy("p", "column").collect()]


def united_rows(parts: list[DataFrame]) -> DataFrame:
    """Rows of tasks with different columns under all of them, null where a part has none."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def json_bundle(tasks: DataFrame) -> DataFrame:
    """(batch_id, task_id, line): each task as one JSON object, without null members; the result as an object."""
    return tasks.select("batch_id", "task_id", F.to_json(F.struct("task_id", "file_name", "status", "error", F.from_json("result", "map<string,string>").alias("result"))).alias("line")).distinct()


def split_names(tasks: DataFrame) -> DataFrame:
    """(batch_id, task_id, file): one file per completed task, named after its file; equal names get a number that no other name has."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace("file_name", r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", ""), r"[^A-Za-z0-9._-]+", "_")
    t = tasks.filter("status = 'completed'").select("batch_id", "task_id", F.when(F.trim(F.coalesce(stem, F.lit(""))) == "", "order").otherwise(stem).alias("stem")).distinct()
    k = F.row_number().over(Window.partitionBy("batch_id", "stem").orderBy("task_id"))
    named = t.withColumn("k", k).withColumn("name", F.when(F.col("k") == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col("k").cast("string"))))
    again = F.row_number().over(Window.partitionBy("batch_id", "name").orderBy(F.col("k") > 1, "task_id"))
    return named.withColumn("again", again).select("batch_id", "task_id", F.concat(F.when(F.col("again") == 1, F.col("name")).otherwise(F.concat_ws("_", "name", F.left(F.sha2("task_id", 256), F.lit(8)))), F.lit(".csv")).alias("file"))


def upserted_rows(old: DataFrame, new: DataFrame, key: str = "task_id") -> DataFrame:
    """A sheet with the rows of every exported key replaced by its new ones; a sheet with other columns is refused."""
    if old.columns != new.columns:
        raise ValueError(f"the sheet has the columns {old.columns}, not {new.columns}")
    return old.join(new.select(key).distinct(), key, "left_anti").select(old.columns).unionByName(new)


def compacted(log: DataFrame, key: str, order: str, deleted: str | None = None) -> DataFrame:
    """The last row per key of an append-only log; keys whose last row is a deletion are gone."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), F.col(order)).alias("_r")).select("_r.*")
    return last.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else last


def decoded(rows: DataFrame, objects: list[str], lists: list[str]) -> DataFrame:
    """Stored rows with their JSON columns as maps and arrays, empty ones for null, blank and unreadable text."""
    ok = lambda c: F.try_parse_json(F.col(c)).isNotNull()
    m, a = F.create_map().cast("map<string,string>"), F.array().cast("array<string>")
    out = {c: F.coalesce(F.when(ok(c), F.from_json(c, "map<string,string>")), m) for c in objects} | {c: F.coalesce(F.when(ok(c), F.from_json(c, "array<string>")), a) for c in lists}
    return rows.withColumns(out)


def encoded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with nested columns as JSON text."""
    return rows.withColumns({c: F.to_json(c) for c in columns})


def retained(jobs: DataFrame, n: int = 50, group: list[str] | None = None) -> DataFrame:
    """Jobs that stay: every one still going, and of the finished ones the newest n by their end, else their beginning."""
    over = F.col("status").isin(TERMINAL)
    newest = [F.desc(F.coalesce("completed_at", "created_at")), F.desc("record_id")]
    if not group:  # the n newest of all by merging the n newest of each task, never all of them in one
        return jobs.filter(~over).unionByName(jobs.filter(over).orderBy(*newest).limit(n))
    w = Window.partitionBy(*group, over).orderBy(*newest)
    return jobs.withColumn("_n", F.row_number().over(w)).filter(~over | (F.col("_n") <= n)).drop("_n")


def listed(rows: DataFrame, status: str | None, limit: int, offset: int = 0, newest: bool = True, id: str = "record_id") -> DataFrame:
    """A page of rows of a status, newest (or oldest) first."""
    own = rows if status is None else rows.filter(F.col("status") == status)
    order = [F.desc("created_at"), F.desc(id)] if newest else ["created_at", id]
    return own.orderBy(*order).offset(offset).limit(limit)


def retry(tasks: DataFrame) -> DataFrame:
    """Tasks with the failed ones pending again, without error and times."""
    again = F.col("status") == "failed"
    blank = lambda c: F.when(~again, F.col(c))
    return tasks.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "error": blank("error"), "started_at": blank("started_at"), "completed_at": blank("completed_at")})


def recovered(rows: DataFrame, kind: str, has_result: Column | None = None) -> DataFrame:
    """Rows as they are after a crash: batches in work pause, tasks in work wait again, jobs in work are interrupted, finished jobs without their result are missing_artifacts."""
    working = F.col("status").isin("processing", "running")
    to = {"batch": "paused", "task": "pending", "job": "interrupted"}[kind]
    status = F.when(working, to).otherwise(F.col("status"))
    if has_result is not None:
        status = F.when(F.col("status").isin("completed", "succeeded") & ~has_result, "missing_artifacts").otherwise(status)
    return rows.withColumn("status", status)


def reloaded(jobs: DataFrame, has_result: Column) -> DataFrame:
    """(record_id, status, progress, message) of stored jobs as shown after a restart."""
    r = recovered(jobs, "job", has_result)
    done = F.col("status").isin("completed", "succeeded")
    return r.select("record_id", "status", F.when(done, 100).otherwise(0).alias("progress"), F.when(done, "done").when(F.col("status") == "interrupted", "interrupted by restart").when(F.col("status") == "missing_artifacts", "result is missing").otherwise(F.coalesce("error", F.lit(""))).alias("message"))


def without_deleted(rows: DataFrame, deleted: DataFrame, key: str = "task_id") -> DataFrame:
    """Rows of keys that were not deleted (or cancelled)."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def control_state(events: DataFrame) -> DataFrame:
    """(batch_id, state, since): what the control events (batch_id, id, action, ts) of a batch come to: start, pause, resume, cancel; cancel is final."""
    c = F.max(F.when(F.col("action") == "cancel", F.col("ts")))
    last = F.max_by(F.struct("action", "ts"), F.struct("ts", "id"))
    out = events.groupBy("batch_id").agg(c.alias("cancelled"), last.alias("l"))
    return out.select("batch_id", F.when(F.col("cancelled").isNotNull(), "cancelled").when(F.col("l.action") == "pause", "paused").otherwise("running").alias("state"), F.coalesce("cancelled", "l.ts").alias("since"))


def runnable(tasks: DataFrame, control: DataFrame, slots: int) -> DataFrame:
    """Tasks to start next: pending ones of running batches, as many as there are free slots in each batch; those of cancelled batches are skipped."""
    t = tasks.join(control.select("batch_id", "state"), "batch_id", "left")
    busy = F.sum((F.col("status") == "processing").cast("int")).over(Window.partitionBy("batch_id"))
    k = F.row_number().over(Window.partitionBy("batch_id", "status").orderBy("task_id"))
    return t.withColumns({"_b": busy, "_k": k}).filter((F.col("status") == "pending") & (F.coalesce("state", F.lit("running")) == "running") & (F.col("_k") <= slots - F.col("_b"))).drop("_b", "_k")


def review_state(reviews: DataFrame, edits: DataFrame) -> DataFrame:
    """Reviews with the edits (review_id, id, field, value) made to them: the last value per field, as JSON, and resolved where there are any."""
    last = edits.groupBy("review_id", "field").agg(F.max_by("value", "id").alias("value")).groupBy("review_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))).alias("edited"))
    out = reviews.join(last, "review_id", "left")
    return out.withColumn("status", F.when(F.col("edited").isNotNull(), "resolved").otherwise(F.col("status")))


def patched_fields(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """Fields (task, document_type, field, value) with the last edit (task, id, field, value) of each in place, ready to be validated again."""
    last = edits.groupBy("task", "field").agg(F.max_by("value", "id").alias("new"))
    return fields.join(last, ["task", "field"], "left").withColumn("value", F.coalesce("new", "value")).drop("new")


def next_in_queue(queue: DataFrame, current: Column) -> DataFrame:
    """(batch_id, task_id): the current task where it is pending, else the first pending one."""
    p = queue.filter("status = 'pending'")
    return p.groupBy("batch_id").agg(F.min_by("task_id", F.struct((F.col("task_id") != current).cast("int").alias("o"), "place")).alias("task_id"))


def event_tail(events: DataFrame, n: int = 100) -> DataFrame:
    """The last n distinct events of each task."""
    order = Window.partitionBy("task_id").orderBy(F.desc("id"))
    return events.dropDuplicates(["task_id", "id"]).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def replayed(events: DataFrame, since: int) -> DataFrame:
    """Distinct events after an id, in order."""
    return events.filter(F.col("id") > since).dropDuplicates(["task_id", "id"])


def subscribers(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event_id, subscription_id, url): events sent to every active subscription (id, url, events array, active) that names them."""
    s = subscriptions.filter("active").select(F.col("id").alias("subscription_id"), "url", F.explode(F.array_distinct("events")).alias("event"))
    return events.join(s, "event").select("event_id", "subscription_id", "url")


def subscription_list(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions as listed: whether there is a secret, never the secret."""
    return subscriptions.select("id", "url", "events", "active", is_filled(F.col("secret")).alias("has_secret"))


def ruled(rows: DataFrame, rules: list[tuple[str, str, str]], text: str, otherwise: str = "UNMAPPED") -> DataFrame:
    """Rows with ``mapped``: the target of the last rule (mode exact, contains or prefix; word; target) their text meets."""
    t = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    out = F.lit(otherwise)
    for mode, word, target in rules:
        w = F.lit(word.lower())
        out = F.when({"exact": t == w, "contains": F.contains(t, w), "prefix": F.startswith(t, w)}[mode], target).otherwise(out)
    return rows.withColumn("mapped", out)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows equal in the keys the first in order: a grouped minimum, so nothing but the keys is shuffled beside the row."""
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def duplicate_names(rows: DataFrame, name: str) -> DataFrame:
    """(name in lower case, n) of names that come more than once whatever their case."""
    return rows.groupBy(F.lower(F.trim(F.col(name))).alias("name")).agg(F.count("*").alias("n")).filter("n > 1")
