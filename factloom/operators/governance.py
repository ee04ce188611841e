"""Findings over time: fingerprints, diffs, baselines, trends, retention. Changes to a table are joins of its old state and the change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.severity import SERVER_RANK, mapped
from factloom.functions.text import normalized

RETENTION_DAYS, ARCHIVE_DAYS = 365, 90
#: A change of more than this share, or more than this many files, asks for a full analysis. Fixed values.
FULL_SHARE, FULL_FILES = 0.30, 1000
#: Statuses that a finding can be given. Fixed values.
STATUSES = ("accepted", "wontfix", "false_positive", "active")


def fingerprint(columns: bool = True, paths: bool = True, messages: bool = True, payload: Column | None = None) -> Column:
    """Hash of type (or a whole payload), file, line, column and message; nulls are marked, so that they cannot run together."""
    parts = [payload if payload is not None else F.col("fact_type"), F.lower("file") if paths else F.col("file"), F.col("start_line").cast("string")]
    if columns:
        parts.append(F.col("start_column").cast("string"))
    parts.append(normalized(F.col("message")) if messages else F.col("message"))
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p, F.lit("\u0000")) for p in parts]), 256)


def deduplicated(facts: DataFrame, key: Column, order: list[str], whole: bool = True) -> DataFrame:
    """The first fact of each fingerprint, in an explicit order that tells all facts apart (its last column alone does). The least of the
    order's columns is found first, from these columns alone; whole rows are joined to it if they are asked for."""
    first = facts.groupBy(key.alias("fingerprint")).agg(F.min(F.struct(*order)).alias("row")).select("fingerprint", "row.*")
    rest = [c for c in facts.columns if c not in order]
    if not whole or not rest:
        return first
    return first.join(facts.select(order[-1], *rest), order[-1]).select("fingerprint", *facts.columns)


def bulk_updated(updates: DataFrame, known: DataFrame) -> DataFrame:
    """project, total_processed, success_count, error_count, errors (sorted) of a batch of status updates, item by item: an update fails
    without a fingerprint, with an unknown status, or for a finding that is not known (a row a project and fingerprint)."""
    marked = known.select("project", "fingerprint", F.lit(True).alias("is_known")).distinct()
    rows = updates.join(marked, ["project", "fingerprint"], "left")
    error = F.when(F.coalesce("fingerprint", F.lit("")) == "", "no fingerprint").when(~F.coalesce("status", F.lit("")).isin(*STATUSES), "unknown status").when(F.col("is_known").isNull(), "unknown finding")
    told = F.when(error.isNotNull(), F.concat(F.coalesce("fingerprint", F.lit("")), F.lit(": "), error))
    return rows.groupBy("project").agg(F.count("*").alias("total_processed"), F.count_if(error.isNull()).alias("success_count"), F.count_if(error.isNotNull()).alias("error_count"), F.sort_array(F.collect_set(told)).alias("errors"))


def incremental_statistics(changed: int | Column, total: int | Column) -> list[Column]:
    """changed, change_percent, cache_hit_rate and efficiency (0 to 1; 0 for a full run) of files changed among all."""
    changed, total = (x if isinstance(x, Column) else F.lit(x) for x in (changed, total))
    share = F.when(total > 0, changed / total).otherwise(0.0)
    full = (share > FULL_SHARE) | (changed > FULL_FILES)
    hits = F.when(full, 0.0).otherwise(1 - share)
    return [changed.alias("changed"), F.round(share * 100, 4).alias("change_percent"), F.round(hits, 6).alias("cache_hit_rate"), F.round(F.when(full, 0.0).otherwise(hits * (1 - share)), 6).alias("efficiency")]


def dedup_statistics(facts: DataFrame, key: Column) -> DataFrame:
    counts = facts.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("n"))
    total, kept = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return counts.agg(total.alias("before"), kept.alias("after"), (total - kept).alias("removed"), F.round(F.when(total > 0, (total - kept) / total).otherwise(0.0), 6).alias("ratio"))


def branch_findings(analyses: DataFrame, findings: DataFrame, project: str, branch: str) -> DataFrame:
    """Findings of the latest analysis of a branch; none where there is no analysis."""
    last = analyses.where((F.col("project") == project) & (F.col("branch") == branch)).orderBy(F.desc("ts"), F.desc("analysis_id")).limit(1)
    return findings.join(F.broadcast(last.select("analysis_id")), "analysis_id", "left_semi")  # one row


def new_findings(base: DataFrame, head: DataFrame) -> DataFrame:
    return head.join(base.select("fingerprint").distinct(), "fingerprint", "left_anti")


def resolved_findings(base: DataFrame, head: DataFrame) -> DataFrame:
    return new_findings(head, base)


def severity_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Head findings whose rank differs from the base's last finding of that fingerprint; duplicates in head stay."""
    last = base.groupBy("fingerprint").agg(F.max_by("severity", "seq").alias("old"))
    up = mapped("severity", SERVER_RANK, 0) - mapped("old", SERVER_RANK, 0)
    out = head.join(last, "fingerprint").withColumn("steps", up).where(F.col("steps") != 0)
    return out.select("fingerprint", "file", "line", "old", "severity", F.when(F.col("steps") > 0, "increased").otherwise("decreased").alias("change"), "steps")


def compared(base: DataFrame, head: DataFrame) -> DataFrame:
    """change, fingerprint, file, line, severity, steps: findings of head that base lacks (new), of base that head lacks (resolved), and those
    of head whose rank differs from the base's last finding of that fingerprint. A null fingerprint equals none. Both sides are read
    twice: to learn what is known of each fingerprint, which combines before its shuffle, and for the one join with that. A fingerprint
    with many findings is a row of the known side, so the join can be split where it is hot."""
    names = ("fingerprint", "file", "line", "severity")
    known = (
        base.select("fingerprint", "severity", "seq", F.lit(False).alias("is_head"))
        .union(head.select("fingerprint", F.lit(None), F.lit(None), F.lit(True)))
        .where(F.col("fingerprint").isNotNull())
        .groupBy("fingerprint")
        .agg(F.max_by("severity", "seq").alias("old"), F.bool_or(~F.col("is_head")).alias("in_base"), F.bool_or("is_head").alias("in_head"))
    )
    rows = base.select(F.lit(False).alias("is_head"), *names).union(head.select(F.lit(True), *names)).join(known, "fingerprint", "left")
    there = F.coalesce(F.when(F.col("is_head"), F.col("in_base")).otherwise(F.col("in_head")), F.lit(False))
    steps = F.when(F.col("is_head") & there, mapped("severity", SERVER_RANK, 0) - mapped("old", SERVER_RANK, 0))
    change = F.when(~there, F.when(F.col("is_head"), "new").otherwise("resolved")).when(F.col("steps") > 0, "increased").when(F.col("steps") < 0, "decreased")
    return rows.withColumn("steps", steps).select(change.alias("change"), *names, "steps").where("change IS NOT NULL")


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """change, fingerprint, file, line, severity: new, resolved and changed findings in one table."""
    return compared(base, head).drop("steps")


def diff_summary(base: DataFrame, head: DataFrame) -> DataFrame:
    """Counts, net change, severity score and trend."""
    level = mapped("severity", SERVER_RANK, 0)
    score = F.when(F.col("steps") > 0, level).when(F.col("steps") < 0, -level)
    n = lambda c: F.count_if(F.col("change") == c)
    net = n("new") - n("resolved")
    return compared(base, head).agg(n("new").alias("new"), n("resolved").alias("resolved"), n("increased").alias("increased"), n("decreased").alias("decreased"), net.alias("net_change"), F.coalesce(F.sum(score), F.lit(0)).alias("severity_score"), trend(n("new"), n("resolved")).alias("trend"))


def trend(new: Column, resolved: Column) -> Column:
    return F.when(new > resolved, "Degrading").when(new < resolved, "Improving").otherwise("Stable")


def summary_text(summary: DataFrame) -> DataFrame:
    return summary.select(F.format_string("%d new, %d resolved, %d more severe, %d less severe: %s", "new", "resolved", "increased", "decreased", "trend").alias("text"))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(SERVER_RANK)])


def unexpired(status: DataFrame, now: Column) -> DataFrame:
    """Rows without an expiry or with one not before now, of any status."""
    return status.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def without_baseline(findings: DataFrame, status: DataFrame, project: str, now: Column) -> DataFrame:
    hidden = unexpired(status.where(F.col("project") == project), now).select("fingerprint").distinct()
    return findings.join(hidden, "fingerprint", "left_anti")


def in_baseline(findings: DataFrame, status: DataFrame, project: str, now: Column) -> DataFrame:
    """Findings with a status that expires strictly later, or never."""
    held = status.where((F.col("project") == project) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))).select("fingerprint").distinct()
    return findings.join(held, "fingerprint", "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The new state of a table: rows of `new` replace those with their key; of several in one batch the last by `order` counts."""
    rest = [c for c in old.columns if c not in keys]
    if order:
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in rest])
    o = old.withColumn("_o", F.lit(1)).withColumnsRenamed({c: f"o_{c}" for c in rest})
    n = new.withColumn("_n", F.lit(1)).withColumnsRenamed({c: f"n_{c}" for c in rest})
    return o.join(n, keys, "full_outer").select(*keys, *[F.when(F.col("_n") == 1, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in rest])


def removed(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def baseline_actions(findings: DataFrame, status: DataFrame, project: str, now: Column) -> DataFrame:
    """fingerprint, action of an analysis' findings: accept where there is no status, expire or refresh those that are not active."""
    own = status.where(F.col("project") == project).select("fingerprint", "status", "expires_at", F.lit(True).alias("known"))
    joined = findings.select("fingerprint").distinct().join(own, "fingerprint", "left")
    action = F.when(F.col("known").isNull(), "accept").when(F.col("expires_at") < now, "expired").when(F.col("status") != "active", "refresh").otherwise("none")
    return joined.select("fingerprint", action.alias("action"))


def action_counts(actions: DataFrame) -> DataFrame:
    n = lambda a: F.count_if(F.col("action") == a)
    return actions.agg(n("accept").alias("accepted"), n("refresh").alias("refreshed"), n("expired").alias("expired"))


def restored(status: DataFrame, source: DataFrame, target: DataFrame, project: str, now: Column) -> DataFrame:
    """The baseline of another analysis: its fingerprints are accepted, those of the target alone lose their status."""
    gone = target.select("fingerprint").distinct().join(source.select("fingerprint").distinct(), "fingerprint", "left_anti").withColumn("project", F.lit(project))
    accepted = source.select("fingerprint").distinct().select(F.lit(project).alias("project"), "fingerprint", F.lit("accepted").alias("status"), F.lit(None).cast("timestamp_ntz").alias("expires_at"), now.alias("updated_at"))
    return upsert(removed(status, gone, ["project", "fingerprint"]), accepted, ["project", "fingerprint"])


def trend_metrics(analyses: DataFrame, findings: DataFrame, project: str, start: Column, end: Column) -> DataFrame:
    """Totals by severity between two times, both included."""
    near = analyses.where((F.col("project") == project) & F.col("ts").between(start, end)).select("analysis_id")
    return findings.join(near, "analysis_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(SERVER_RANK)])


def daily(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """day, project, branch, severity, fact_type, n."""
    joined = findings.join(analyses.select("analysis_id", "project", "branch", "ts"), "analysis_id")
    return joined.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "project", "branch", "severity", "fact_type").agg(F.count("*").alias("n"))


def project_summary(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """A row a project. Findings are counted by analysis first, so that no analysis is counted twice."""
    by_analysis = findings.groupBy("analysis_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(SERVER_RANK)])
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    joined = analyses.join(by_analysis, "analysis_id", "left")
    return joined.groupBy("project").agg(F.count_distinct("analysis_id").alias("analyses"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), *[zero(s.lower()) for s in reversed(SERVER_RANK)], F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change of files by content hash; without old rows all are added."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "Added").when(F.col("new_hash").isNull(), "Deleted").when(F.col("old_hash") != F.col("new_hash"), "Modified")
    return o.join(n, "path", "full_outer").select("path", change.alias("change")).where(F.col("change").isNotNull())


def scan_mode(changed: DataFrame, total: Column | int) -> DataFrame:
    """n_changed, share, mode: full beyond a share or number of changed files."""
    n = F.count("*")
    share = F.when(F.lit(total) > 0, n / F.lit(total)).otherwise(0.0)
    return changed.agg(n.alias("n_changed"), F.round(share, 6).alias("share"), F.when((share > FULL_SHARE) | (n > FULL_FILES), "full").otherwise("incremental").alias("mode"))


def retention(analyses: DataFrame, now: Column, days: int = RETENTION_DAYS, archive: int = ARCHIVE_DAYS) -> DataFrame:
    """analysis_id, decision: delete beyond `days`, archive beyond `archive` or at a quarter's first day, else keep."""
    age = F.datediff(now, "ts")
    quarter = F.to_date("ts") == F.to_date(F.date_trunc("quarter", "ts"))
    return analyses.select("analysis_id", F.when(age > days, "delete").when((age > archive) | quarter, "archive").otherwise("keep").alias("decision"))


def publish_violations() -> Column:
    """Messages about an analysis row that may not be published."""
    rules = [(F.length("project") == 0, "project is empty"), (F.length("branch") == 0, "branch is empty"), (F.length("commit_id") == 0, "commit is empty"), (F.length("project") > 100, "project is too long"), (F.length("branch") > 100, "branch is too long"), (F.col("findings") > 100_000, "too many findings")]
    return F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules]))


def migrated(version: Column | str) -> Column:
    """The version after migration: 3.2.x becomes 3.3.0, 3.3.x stays; any other is an error."""
    v = F.col(version) if isinstance(version, str) else version
    return F.when(v.startswith("3.2."), "3.3.0").when(v.startswith("3.3."), v).otherwise(F.raise_error(F.concat(F.lit("unknown schema version "), F.coalesce(v, F.lit("none")))).cast("string"))
