"""Store maintenance as pure folds (state, batch) -> new state; written to new versions of Parquet tables."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of an opportunity that keep their first value.
FIRST_WINS = ("dedup_key", "title", "organizer", "discovered_at")
QUEUE_STATUSES = ("pending", "accepted", "rejected", "deferred")


def upsert(state: DataFrame | None, batch: DataFrame, key: str, order: Column, first_wins: tuple[str, ...] = FIRST_WINS) -> DataFrame:
    """One row for each key: first_wins columns from its first version, all others from its last.

    The state counts as older than the batch. One aggregation, done in part before the shuffle."""
    rows = batch.withColumn("_seq", F.struct(F.lit(1).alias("v"), order.alias("o")))
    if state is not None:
        rows = rows.unionByName(state.withColumn("_seq", F.struct(F.lit(0).alias("v"), F.lit(None).cast(batch.select(order).schema[0].dataType).alias("o"))))
    others = [c for c in batch.columns if c != key and c not in first_wins]
    firsts = [c for c in batch.columns if c in first_wins]
    aggs = [F.max_by(F.struct(*others), "_seq").alias("_l")] if others else []
    aggs += [F.min_by(F.struct(*firsts), "_seq").alias("_f")] if firsts else []
    out = rows.groupBy(key).agg(*aggs)
    return out.select(*(F.col(key) if c == key else F.col(f"_f.{c}") if c in firsts else F.col(f"_l.{c}") for c in batch.columns))


def fold_health(runs: DataFrame, order: Column) -> DataFrame:
    """State of each source from its run log; the last success stays when later runs fail."""
    ok = F.col("status").isin("success", "completed_with_failures", "empty")
    last = lambda c, name: F.max_by(c, order).alias(name)
    counts = [last(c, f"last_{c}") for c in ("document_count", "upserted_count", "parse_failure_count") if c in runs.columns]
    dup = [last(c, c) for c in ("duplicate_group_count", "max_duplicate_group_size", "source_name", "source_kind", "source_tier", "last_error") if c in runs.columns]
    return runs.groupBy("source_id").agg(last("status", "last_status"), last("completed_at", "last_run_completed_at"), F.max_by(F.when(ok, F.col("completed_at")), F.when(ok, order)).alias("last_success_at"), *counts, *dup)


def sync_queue(state: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """Merge a batch of candidates: an operator's status stays unless the item was closed, which reopens it; the first
    detection stays; a worker's items that the batch lacks become inactive."""
    s, b = state.alias("s"), batch.alias("b")
    both = s.join(b, F.col("s.queue_id") == F.col("b.queue_id"), "full_outer")
    here, there = F.col("b.queue_id").isNotNull(), F.col("s.queue_id").isNotNull()
    closed = F.col("s.status").isin("accepted", "rejected")
    gone = ~here & (F.col("s.origin") == "worker_diagnostic")
    out = []
    for c in state.columns:
        old, new = F.col(f"s.{c}"), (F.col(f"b.{c}") if c in batch.columns else F.lit(None))
        if c == "status":
            value = F.when(~here, old).when(there & ~closed, old).otherwise(F.coalesce(new, F.lit("pending")))
        elif c == "is_active":
            value = F.when(here, True).when(gone, False).otherwise(old)
        elif c == "first_detected_at":
            value = F.coalesce(old, new, now)
        elif c == "updated_at":
            value = F.when(here, F.coalesce(new, now)).when(gone, now).otherwise(old)
        else:
            value = F.when(here, new).otherwise(old)
        out.append(value.alias(c))
    return both.select(*out)


def decide(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue with each decided item's last decision as its status."""
    last = decisions.groupBy("queue_id").agg(F.max_by(F.struct("decision", "created_at"), "id").alias("_d"))
    joined = queue.join(last, "queue_id", "left")
    return joined.withColumns({"status": F.coalesce("_d.decision", "status"), "updated_at": F.coalesce("_d.created_at", "updated_at")}).select(*queue.columns)


def undecidable(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions that name no item of the queue or no status."""
    known = decisions.join(queue.select("queue_id"), "queue_id", "left_semi").filter(F.col("decision").isin(*QUEUE_STATUSES))
    return decisions.join(known.select("id"), "id", "left_anti")


def delete(ids: DataFrame, **tables: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Each table (frame, id column) without the rows of the given ids."""
    gone = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    return {name: df.join(gone, F.col(column) == F.col("_id"), "left_anti") for name, (df, column) in tables.items()}


def update(state: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """state with some columns replaced where changes has a value for them."""
    new = changes.select(key, *(F.col(c).alias(f"_n_{c}") for c in columns))
    return state.join(new, key, "left").withColumns({c: F.coalesce(f"_n_{c}", c) for c in columns}).select(*state.columns)


def missing(rows: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't present."""
    return rows.join(present.select(key), key, "left_anti")


def insert_missing(current: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """current with legacy's rows of other keys, absent columns null."""
    return current.unionByName(missing(legacy, current, key), allowMissingColumns=True).select(*current.columns)


def expired(df: DataFrame, today: date, retention_days: int) -> Column:
    """Past the deadline for longer than the retention; without a deadline never."""
    limit = today - timedelta(days=max(retention_days, 0))
    return F.coalesce(F.col("deadline_at") < F.lit(limit), F.lit(False))


def sweep(df: DataFrame, today: date, retention_days: int = 7, most: int = 500) -> DataFrame:
    """Ids to delete in one run, the oldest deadlines first."""
    return df.filter(expired(df, today, retention_days)).orderBy("deadline_at", "id").limit(most).select("id")


def sweep_due(last_run: date | None, today: date) -> bool:
    return last_run is None or last_run < today


def backfill(df: DataFrame, column: str, new: Column, order: list[Column], most: int | None = None) -> DataFrame:
    """(id, column) of the rows that a rule changes; a limit counts changes, not rows looked at."""
    changed = df.withColumn("_new", new).filter(~F.col("_new").eqNullSafe(F.col(column))).orderBy(*order)
    return (changed.limit(most) if most else changed).select("id", F.col("_new").alias(column))


TRACE = "https://pubblicitalegale.anticorruzione.it/"


def trace_candidates(df: DataFrame, organizer: str = "ANAC BDNCP") -> DataFrame:
    """Records of a register whose source isn't one of its public pages yet."""
    public = F.col("source_url").startswith(f"{TRACE}bandi/") | F.col("source_url").startswith(f"{TRACE}esiti/")
    return df.filter((F.col("organizer") == organizer) & F.col("official_notice_id").isNotNull() & ~F.coalesce(public, F.lit(False)))


def status_candidates(df: DataFrame, organizer: str, closed: tuple[str, ...] = ("archived", "discarded")) -> DataFrame:
    return df.filter((F.col("organizer") == organizer) & ~F.col("status").isin(*closed))


def _is_result(code: Column, kind: Column, url: Column, title: Column) -> Column:
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return low(code).startswith("ad") | (low(kind) == "esito") | low(url).contains("/esiti/") | low(title).contains("affidamento diretto")


def trace_url(notice: Column, url: Column, title: Column, code: Column, kind: Column) -> Column:
    """Public page of a notice: results on one route, calls on the other. code and kind are of the notice's detail."""
    clean = F.nullif(F.trim(notice), F.lit(""))
    return F.concat(F.lit(TRACE), F.when(_is_result(code, kind, url, title), "esiti").otherwise("bandi"), F.lit("/"), clean, F.lit("?ricercaArchivio=true"))


def record_status(url: Column, title: Column, code: Column, kind: Column, source_kind: Column) -> Column:
    """archived for award notices, by the detail's code and kinds, the page or the wording; else discovered."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    gone = _is_result(code, kind, url, title) | low(source_kind).isin("aggiudicazione", "esito", "archived", "completed") | low(title).contains("aggiudicazione")
    return F.when(gone, "archived").otherwise("discovered")


def announcement_changes(df: DataFrame, announces: Column, organizer: str, order: list[Column], most: int | None = None) -> DataFrame:
    """(id, status) of a feed's open records that only announce a notice: they are discarded."""
    return backfill(status_candidates(df, organizer), "status", F.when(announces, "discarded").otherwise(F.col("status")), order, most)


def geocode_changes(df: DataFrame, answers: DataFrame, key: str, columns: list[str], order: list[Column], limit: int = 50) -> DataFrame:
    """(key, columns) of the records that answers change: six times as many are looked at as may change."""
    looked = df.orderBy(*order).limit(6 * limit)
    met = looked.join(answers.select(key, *(F.col(c).alias(f"_a_{c}") for c in columns)), key)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_a_{c}"))
    return met.filter(~same).orderBy(*order).limit(limit).select(key, *(F.col(f"_a_{c}").alias(c) for c in columns))


def removed(rows: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, a row with changed: whether any went)."""
    hit = F.coalesce(gone, F.lit(False))
    return rows.filter(~hit), rows.agg((F.count_if(hit) > 0).alias("changed"))


def watched_ids(entries: DataFrame, workspace: str) -> DataFrame:
    """All ids that a workspace watches, in the order of listing()."""
    return entries.filter(F.col("workspace_key") == workspace).orderBy(F.desc("updated_at"), F.desc("opportunity_id")).select("opportunity_id")


def with_watched(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """asked (workspace_key, opportunity_id) with watched: whether the workspace watches it. Blank space around either doesn't count."""
    known = entries.select("workspace_key", "opportunity_id").distinct().withColumn("_there", F.lit(True))
    clean = asked.withColumns({"_w": F.trim("workspace_key"), "_o": F.trim("opportunity_id")})
    met = clean.join(known.withColumnsRenamed({"workspace_key": "_kw", "opportunity_id": "_ko"}), (F.col("_w") == F.col("_kw")) & (F.col("_o") == F.col("_ko")), "left")
    return met.select(*asked.columns, F.coalesce("_there", F.lit(False)).alias("watched"))


def listing(rows: DataFrame, workspace: str, limit: int = 50) -> DataFrame:
    """A workspace's saved searches or watched ids, the last touched first."""
    return rows.filter(F.col("workspace_key") == workspace).orderBy(F.desc("updated_at"), F.desc("id" if "id" in rows.columns else "opportunity_id")).limit(limit)


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions that haven't expired; tokens are held as their hash."""
    return sessions.filter(F.col("expires_at") > now)


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def batch_totals(runs: DataFrame) -> DataFrame:
    """Sources and records of a batch's runs, a failed run counting no records."""
    fine = F.col("status") != "failed"
    return runs.groupBy("batch_id").agg(F.countDistinct("source_id").alias("total_sources"), F.coalesce(F.sum(F.when(fine, F.col("ingested"))), F.lit(0)).alias("total_ingested"), F.count_if(~fine).alias("failed"))


def save_search(saved: DataFrame, workspace: str, name: str, filters_json: str, now: Column) -> DataFrame:
    """Idempotent by workspace, name and filters: a repeat touches updated_at, a new one gets the next id."""
    name = name.strip()[:80]
    if filters_json in ("", "{}"):
        raise ValueError("a saved search needs a filter")
    same = (F.col("workspace_key") == workspace) & (F.col("name") == name) & (F.col("filters_json") == filters_json)
    touched = saved.withColumn("updated_at", F.when(same, now).otherwise(F.col("updated_at")))
    state = saved.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.coalesce(F.max(same), F.lit(False)).alias("there"))
    new = state.filter(~F.col("there")).select((F.col("top") + 1).alias("id"), F.lit(workspace).alias("workspace_key"), F.lit(name).alias("name"), F.lit(filters_json).alias("filters_json"), now.alias("created_at"), now.alias("updated_at"))
    return touched.unionByName(new)


def watch(entries: DataFrame, opportunities: DataFrame, additions: DataFrame, now: Column) -> DataFrame:
    """Watch-list with (workspace_key, opportunity_id) added or touched where the opportunity exists."""
    valid = additions.join(opportunities.select(F.col("id").alias("opportunity_id")), "opportunity_id", "left_semi").dropDuplicates(["workspace_key", "opportunity_id"]).withColumn("_at", now)
    joined = entries.join(valid, ["workspace_key", "opportunity_id"], "full_outer")
    return joined.select("workspace_key", "opportunity_id", F.coalesce("created_at", "_at").alias("created_at"), F.coalesce("_at", "updated_at").alias("updated_at"))


def doctor(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(label, ok, detail) for each check: a frame of offending rows, which should be empty."""
    one = [df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), (F.col("n") == 0).alias("ok"), F.concat(F.col("n").cast("string"), F.lit(" offending rows")).alias("detail")) for label, df in checks]
    return reduce(DataFrame.unionByName, one)
