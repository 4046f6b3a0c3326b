"""Job analytics: listings, counters, cost and share reports, settings."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.functions.text import display_name
from doctables.operators.scan import floored_running_sums

# The job type of schema inference, the filter token for "no template", token prices.
SCHEMA_JOB = "schema-generation"
NO_TEMPLATE = "__none__"
PRICE_IN_PER_M, PRICE_OUT_PER_M = 0.15, 0.60
TERMINAL = ("done", "error")


def jobs_with_users(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Left join of the owner's name columns."""
    owners = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"),
                          F.col("first_name").alias("user_first_name"), F.col("last_name").alias("user_last_name"))
    return jobs.join(owners, "user_id", "left")


def user_display(jobs: DataFrame, default: str | None = "System") -> DataFrame:
    """Add ``user_name``: first and last name, else e-mail, else the default."""
    name = display_name(F.col("user_first_name"), F.col("user_last_name"), F.col("user_email"),
                        F.lit(default) if default is not None else None)
    return jobs.withColumn("user_name", name)


def visible_jobs(jobs: DataFrame, user: str, is_admin: bool = False) -> DataFrame:
    """All jobs for an administrator, else the user's own and those of the system."""
    return jobs if is_admin else jobs.where(F.col("user_id").isin(user, "system"))


def job_filter(tab: str | None = None, q: str | None = None, status: str | None = None,
               templates: Sequence[str] = (), created_from: int | None = None,
               created_to: int | None = None) -> Column:
    """Listing filter as one predicate; a search text also looks at the joined owner columns."""
    cond = F.lit(True)
    if tab == "schema":
        cond = cond & (F.col("template_name") == SCHEMA_JOB)
    elif tab == "extraction":
        cond = cond & (F.col("template_name").isNull() | (F.col("template_name") != SCHEMA_JOB))
    if q:
        # a backslash that escapes nothing is dropped; % and _ in the text stay wildcards
        pattern = "%" + re.sub(r"\\([^%_\\])", r"\1", q) + "%"
        full = F.concat(F.coalesce("user_first_name", F.lit("")), F.lit(" "), F.coalesce("user_last_name", F.lit("")))
        texts = [F.col("file_name"), F.col("id"), F.col("template_name"), F.col("user_email"), full]
        cond = cond & F.coalesce(F.exists(F.array(*texts), lambda x: x.ilike(pattern)), F.lit(False))
    if status:
        cond = cond & (F.col("status") == status)
    chosen = [x for x in templates if x]
    if chosen:
        named = [x for x in chosen if x != NO_TEMPLATE]
        pick = F.col("template_name").isin(named) if named else F.lit(False)
        if NO_TEMPLATE in chosen:
            pick = pick | F.col("template_name").isNull()
        cond = cond & pick
    if created_from:
        cond = cond & (F.col("created_at") >= int(created_from))
    if created_to:
        cond = cond & (F.col("created_at") <= int(created_to))
    return cond


def filter_jobs(jobs: DataFrame, users: DataFrame | None = None, **criteria) -> DataFrame:
    """Jobs under a listing filter; the owner join happens only when the search needs it."""
    if criteria.get("q") and "user_email" not in jobs.columns:
        if users is None:
            raise ValueError("a search text needs the users table")
        joined = jobs_with_users(jobs, users).where(job_filter(**criteria))
        return joined.select(*jobs.columns)
    return jobs.where(job_filter(**criteria))


CARD_COLUMNS = ("id", "file_name", "pages", "status", "total_ms", "cost_total", "calls", "template_name", "created_at")


def job_cards(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Narrow listing columns with the owner's name, without any payload."""
    return user_display(jobs_with_users(jobs.select(*CARD_COLUMNS, "user_id"), users)).select(*CARD_COLUMNS, "user_name")


# widths of the ranges of created_at (milliseconds) that are counted one after another: 19 hours, 8 seconds, one
RANGE_BITS = (26, 13, 0)


def skip_newest(jobs: DataFrame, offset: int, limit: int) -> tuple[DataFrame, int]:
    """The rows among which the page begins and ends, and how many of them come before it.

    Rows are counted by ranges of their time, first wide ones, then narrow ones inside the range in which the page begins. What is
    newer or older than the page is filtered out by its time, so only a page and the rows of one millisecond are sorted.
    """
    inside, within = F.lit(True), F.lit(True)
    for bits in RANGE_BITS:
        span = F.shiftright("created_at", bits)
        # one row per range: those of the data's years, then at most 8,192
        counted = jobs.where(within).groupBy(span.alias("r")).agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last("r")).collect()
        seen = 0
        for found in counted:
            if seen + found.n > offset:
                break
            seen += found.n
        else:
            return jobs.limit(0), 0
        offset -= seen
        if found.r is None:
            return jobs.where(F.col("created_at").isNull()), offset
        within = F.col("created_at").between(found.r << bits, (found.r + 1 << bits) - 1)
        inside = inside & (F.col("created_at").isNull() | (F.col("created_at") < (found.r + 1 << bits)))
        if bits == RANGE_BITS[0]:
            left = offset + limit
            for older in counted[counted.index(found):]:
                left -= older.n
                if left <= 0 and older.r is not None:
                    inside = inside & (F.col("created_at") >= (older.r << bits))
                    break
    return jobs.where(inside), offset


def page_jobs(jobs: DataFrame, limit: int = 0, offset: int = 0) -> DataFrame:
    """Newest jobs first, one page of them; an offset counts only together with a limit.

    ``created_at`` is in milliseconds; null comes last. An offset starts three counts when it is called (see :func:`skip_newest`).
    """
    if limit and offset:
        jobs, offset = skip_newest(jobs, offset, limit)
    newest = jobs.orderBy(F.desc("created_at"), F.asc("id"))
    if not limit:
        return newest
    return newest.offset(offset).limit(limit) if offset else newest.limit(limit)


def recent_jobs(jobs: DataFrame, n: int) -> DataFrame:
    return page_jobs(jobs, n)


def list_templates(templates: DataFrame) -> DataFrame:
    return templates.orderBy("created_at", "id")


def job_counts(jobs: DataFrame, users: DataFrame | None = None, offset: int = 0, limit: int = 0, **criteria) -> DataFrame:
    """Total, schema-job total and filtered total in one pass, and whether another page follows."""
    if criteria.get("q"):
        jobs = jobs_with_users(jobs, users)
    counts = jobs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("template_name") == SCHEMA_JOB).alias("schema_count"),
        F.count_if(job_filter(**criteria)).alias("filtered_total"))
    left = F.greatest(F.col("filtered_total") - offset, F.lit(0))
    shown = F.least(left, F.lit(limit)) if limit else left
    return counts.withColumn("has_more", (shown + offset) < F.col("filtered_total"))


def job_stats(jobs: DataFrame) -> DataFrame:
    """Totals by status, cost and calls over all jobs."""
    return jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("status") == "done").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(F.col("status") == "in-progress").alias("in_progress"),
        money_sum(F.col("cost_total")).alias("total_cost"),
        F.coalesce(F.sum("calls"), F.lit(0)).cast("bigint").alias("total_calls"))


def money_sum(c: Column, scale: int = 6) -> Column:
    """Sum in decimals, so the result does not depend on the order of the rows."""
    return F.coalesce(F.sum(c.cast(f"decimal(28,{scale})")), F.lit(0)).cast("double")


def resolve_template(df: DataFrame, templates: DataFrame, ref: str = "template_name",
                     columns: Sequence[str] = ("id", "name")) -> DataFrame:
    """Add ``tpl_<column>`` of the template named by id or by name; the first in template order wins.

    Two equality joins instead of one on a disjunction.
    """
    packed = F.struct("created_at", "id", *[F.col(c).alias(f"tpl_{c}") for c in columns])
    by_id = templates.groupBy(F.col("id").alias(ref)).agg(F.min(packed).alias("_by_id"))
    by_name = templates.groupBy(F.col("name").alias(ref)).agg(F.min(packed).alias("_by_name"))
    both = df.join(by_id, ref, "left").join(by_name, ref, "left")
    first = F.least("_by_id", "_by_name")
    return both.select(*df.columns, *[first[f"tpl_{c}"].alias(f"tpl_{c}") for c in columns])


def job_labels(jobs: DataFrame, templates: DataFrame) -> DataFrame:
    """Add ``label``: template name by id, else the raw name, else what kind of job it was."""
    names = templates.select(F.col("id").alias("template_name"), F.col("name").alias("_tpl"))
    raw = F.when(F.col("template_name") != "", F.col("template_name"))
    kind = F.when(F.col("schema").isNotNull(), "Custom Schema").otherwise("Raw Markdown")
    return jobs.join(names, "template_name", "left").withColumn(
        "label", F.coalesce(F.nullif("_tpl", F.lit("")), raw, kind)).drop("_tpl")


def template_stats(jobs: DataFrame, templates: DataFrame) -> DataFrame:
    """Count and cost of finished jobs per label.

    Jobs are aggregated on their raw name first, so the join sees one row per name.
    """
    partial = jobs.where(F.col("status") == "done").groupBy(
        "template_name", F.when(F.col("schema").isNotNull(), "x").alias("schema")).agg(
        F.count("*").alias("_n"), F.sum(F.col("cost_total").cast("decimal(28,6)")).alias("_cost"))
    return job_labels(partial, templates).groupBy(F.col("label").alias("name")).agg(
        F.sum("_n").alias("count"), F.coalesce(F.sum("_cost"), F.lit(0)).cast("double").alias("cost"))


def template_shares(stats: DataFrame) -> DataFrame:
    """Share of all jobs in %, and cost relative to the dearest label, with the bar's minimum width."""
    total = stats.select(F.sum("count")).scalar()
    dearest = stats.select(F.greatest(F.max("cost"), F.lit(0.0001))).scalar()
    return stats.withColumn("share_pct", F.floor(F.col("count") / total * 100 + 0.5)).withColumn(
        "cost_bar_pct", F.round(F.greatest(F.col("cost") / dearest * 100, F.lit(0.5)), 4))


def rank_stats(stats: DataFrame, by: str) -> DataFrame:
    return stats.orderBy(F.desc(by), F.asc("name"))


def success_rate(stats: DataFrame) -> DataFrame:
    rate = F.floor(F.try_divide(F.col("successful"), F.col("total_jobs")) * 100 + 0.5)
    return stats.withColumn("success_rate_pct", rate)


def token_cost(jobs: DataFrame, price_in: float = PRICE_IN_PER_M, price_out: float = PRICE_OUT_PER_M) -> DataFrame:
    """Total tokens and their cost, six decimals."""
    total_in = F.coalesce("conversion_input", F.lit(0)) + F.coalesce("extraction_input", F.lit(0))
    total_out = F.coalesce("conversion_output", F.lit(0)) + F.coalesce("extraction_output", F.lit(0))
    cost = F.round(total_in * (price_in / 1e6) + total_out * (price_out / 1e6), 6)
    return jobs.withColumn("total_input", total_in).withColumn("total_output", total_out).withColumn("cost", cost)


def usage_rollup(calls: DataFrame, key: str = "job_id") -> DataFrame:
    """Tokens per key by phase and in total, from one row per call."""
    def sums(phase: str | None, prefix: str) -> list[Column]:
        hit = F.lit(True) if phase is None else F.col("phase") == phase
        return [F.coalesce(F.sum(F.when(hit, F.col(f"{side}_tokens"))), F.lit(0)).cast("bigint").alias(f"{prefix}_{side}")
                for side in ("input", "output")]
    return calls.groupBy(key).agg(*sums("conversion", "conversion"), *sums("extraction", "extraction"), *sums(None, "total"))


def call_count(docs: DataFrame) -> DataFrame:
    """Model calls of a job: extraction calls on the text path, else pages plus extraction calls."""
    asked = F.coalesce("extraction_calls", F.lit(0))
    charged = F.when(asked == 0, 1).otherwise(asked)
    calls = (
        F.when((F.col("source") == "text") & F.col("has_schema"), asked)
        .when(F.col("source") == "text", 0)
        .when(F.col("has_schema"), F.col("n_pages") + charged)
        .otherwise(F.col("n_pages"))
    )
    return docs.withColumn("calls", calls.cast("bigint"))


def key_owner(keys: DataFrame, users: DataFrame, companies: DataFrame) -> DataFrame:
    """API key → user → company; a key without a user is dropped, a missing company is blank."""
    owners = users.select(F.col("id").alias("user_id"), "email", "role", "company_id")
    firms = companies.select(F.col("id").alias("company_id"), F.col("name").alias("_company"))
    return keys.select(F.col("id").alias("key_id"), F.col("name").alias("key_name"), "user_id").join(
        owners, "user_id").join(firms, "company_id", "left").select(
        "key_id", "key_name", "user_id", "email", "role", "company_id",
        F.coalesce("_company", F.lit("")).alias("company_name"))


def counters(deltas: DataFrame, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Lifetime counters after every add or delete, never below zero."""
    return floored_running_sums(deltas, order, columns)


# Fixed value: the error of a job that was cut off.
ORPHAN = "Server restarted before this task completed"


def mark_orphans(jobs: DataFrame, cutoff: int, now: int | None = None) -> DataFrame:
    """In-progress jobs created before the cutoff become errors."""
    orphan = (F.col("status") == "in-progress") & (F.col("created_at") < cutoff)
    stamp = F.lit(now if now is not None else cutoff).cast("bigint")
    out = jobs.withColumn("_orphan", orphan).withColumn(
        "error", F.when(F.col("_orphan"), ORPHAN).otherwise(
            F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")))
    done = F.col("completed_at") if "completed_at" in jobs.columns else F.lit(None).cast("bigint")
    out = out.withColumn("completed_at", F.when(F.col("_orphan"), stamp).otherwise(done))
    return out.withColumn("status", F.when(F.col("_orphan"), "error").otherwise(F.col("status"))).drop("_orphan")


def resolve_settings(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Effective settings of a request over its template.

    A schema in the request leaves the template out altogether. A template switches coverage and
    per-page on but never off, and the totals check off but never on.
    """
    def text(name: str) -> Column:
        return F.nullif(F.trim(name), F.lit(""))

    def on(name: str) -> Column:
        return F.coalesce(F.col(name).isin("1", "true"), F.lit(False))

    own_schema = text("schema")
    # an own schema switches the template off before the join
    asked = requests.withColumn("_ref", F.when(own_schema.isNull(), text("template")))
    tpl = ("schema", "filter", "verify_coverage", "verify_totals", "per_page", "date_format", "date_input_format", "domain")
    full = resolve_template(asked, templates, "_ref", tpl)
    used = F.coalesce(F.nullif("tpl_schema", F.lit("")).isNotNull(), F.lit(False))

    def from_tpl(name: str) -> Column:
        return F.when(used, F.nullif(f"tpl_{name}", F.lit("")))

    def flag(name: str, value: int) -> Column:
        return used & F.coalesce(F.col(f"tpl_{name}") == value, F.lit(False))

    totals = ~F.coalesce(F.col("verify_totals").isin("0", "false"), F.lit(False))
    return full.select(
        "request_id",
        F.coalesce(own_schema, from_tpl("schema")).alias("schema_used"),
        F.coalesce(F.nullif("filter", F.lit("")), from_tpl("filter")).alias("filter_used"),
        (on("verify_coverage") | flag("verify_coverage", 1)).alias("verify_coverage"),
        (totals & ~flag("verify_totals", 0)).alias("verify_totals"),
        (on("per_page") | flag("per_page", 1)).alias("per_page"),
        F.coalesce(text("date_format"), from_tpl("date_format")).alias("date_format"),
        F.coalesce(text("date_input_format"), from_tpl("date_input_format")).alias("date_input_format"),
        from_tpl("domain").alias("domain"))


def rerun_jobs(jobs: DataFrame, templates: DataFrame) -> DataFrame:
    """Jobs that can run again, bound to the current template or else to their own snapshot."""
    able = jobs.where(F.col("stored_file").isNotNull() & (
        F.col("template_name").isNull() | (F.col("template_name") != SCHEMA_JOB)))
    full = resolve_template(able, templates)
    bound = F.col("tpl_id").isNotNull()
    return full.select(
        F.col("id").alias("rerun_of"), "stored_file",
        F.when(bound, F.col("template_name")).alias("template_id"),
        F.when(~bound, F.col("schema")).alias("schema"),
        F.when(~bound, F.coalesce("filter", F.lit(""))).alias("filter"))
