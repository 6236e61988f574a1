"""Runs: coverage, metrics, latest and previous run, page history, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def run_metrics(pages: DataFrame) -> DataFrame:
    """L1: words, sentences, pages measured and mean reading age of ok pages, documents included."""
    ok = pages.where("render_status = 'ok'")
    return ok.groupBy("scan_id").agg(
        F.sum("word_count").alias("words"), F.sum("sentence_count").alias("sentences"), F.count("reading_age").alias("pages_measured"), F.round(F.avg(F.col("reading_age").cast("decimal(18,6)")), 1).cast("double").alias("reading_age")
    )


def run_coverage(pages: DataFrame) -> DataFrame:
    """L2: pages by status, with documents and error pages counted."""
    n = lambda c: F.count_if(c)
    return pages.groupBy("scan_id").agg(
        F.count("*").alias("pages"), n(F.col("render_status") == "ok").alias("ok"), n(F.col("render_status") != "ok").alias("failed"), n(F.col("is_document")).alias("documents"), n(F.col("is_error_page")).alias("error_pages")
    )


def sample_failures(pages: DataFrame, n: int = 20) -> DataFrame:
    """L2: the first n failed URLs of each run, in order."""
    w = W.partitionBy("scan_id").orderBy("url")
    return pages.where("render_status <> 'ok'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("scan_id", "rank", "url")


def coverage_verdict(coverage: DataFrame) -> DataFrame:
    """L3: a run without any ok page has failed, others are done; with a message."""
    n = lambda c: F.col(c).cast("string")
    message = F.when(F.col("pages") == 0, "No pages were found").when(F.col("ok") == 0, F.concat(F.lit("None of "), n("pages"), F.lit(" pages could be read"))).when(F.col("failed") > 0, F.concat(n("failed"), F.lit(" of "), n("pages"), F.lit(" pages could not be read")))
    return coverage.select("scan_id", "pages", "failed", F.when(F.col("ok") == 0, "failed").otherwise("done").alias("verdict"), message.alias("message"))


def scores_of_done(scores: DataFrame, verdicts: DataFrame, columns: list[str]) -> DataFrame:
    """L3: scores with those of failed runs null."""
    done = verdicts.select("scan_id", (F.col("verdict") == "done").alias("_done"))
    return scores.join(done, "scan_id").select("scan_id", *[F.when(F.col("_done"), F.col(c)).alias(c) for c in columns])


def stalled_runs(runs: DataFrame, now: Column, grace_minutes: int = 35) -> DataFrame:
    """L4: running or queued runs whose last sign of life is older than the grace period."""
    sign = F.coalesce("last_progress_at", "started_at", "created_at")
    return runs.where(F.col("status").isin("running", "queued") & (sign < now - F.expr(f"INTERVAL {grace_minutes} MINUTES")))


def latest_done(runs: DataFrame) -> DataFrame:
    """The newest done run of each site."""
    return runs.where("status = 'done'").groupBy("site_id").agg(F.max(F.struct("created_at", "scan_id")).alias("r")).select("site_id", "r.scan_id", "r.created_at")


def previous_done(runs: DataFrame) -> DataFrame:
    """For each run the newest done run of its site strictly before it (a site's runs are few)."""
    done = F.when(F.col("status") == "done", F.struct("created_at", "scan_id"))
    before = W.partitionBy("site_id").orderBy("created_at", "scan_id").rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("_p", F.max(done).over(before)).select("site_id", "scan_id", "created_at", F.when(F.col("_p.created_at") < F.col("created_at"), F.col("_p.scan_id")).alias("previous_id"))


def carry_last_changed(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """A page changed now if it is new or its hash differs from that in its previous run; else when it last did.

    Gaps and islands over the history of each (site, url).
    """
    p = pages.join(runs.where("status = 'done'").select("scan_id", "created_at"), "scan_id")
    w = W.partitionBy("site_id", "url").orderBy("created_at", "scan_id")
    changed = F.when(F.lag("content_hash").over(w).eqNullSafe(F.col("content_hash")), F.lit(None)).otherwise(F.col("created_at"))
    rows = p.withColumn("_c", changed).withColumn("last_changed_at", F.last("_c", ignorenulls=True).over(w))
    return rows.select("scan_id", "page_id", "url", "last_changed_at")


def collapse(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def issue_fingerprint(rule: Column, url: Column, selector: Column, snippet: Column) -> Column:
    """Identity of a finding across runs."""
    return F.sha2(F.concat_ws("|", F.coalesce(rule, F.lit("")), F.coalesce(url, F.lit("")), collapse(selector), F.substring(F.sha1(collapse(snippet)), 1, 16)), 256)


def diff_counts(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """New, resolved and unchanged fingerprints of each pair (scan_id, previous_id).

    Each print goes to the pair of its own run and to those whose previous run it is
    of, in one pass over the prints; then one aggregate over (pair, fingerprint) with
    a flag for each side. ``prints`` has scan_id and fp.
    """
    pairs = pairs.where("previous_id IS NOT NULL").select("scan_id", "previous_id")
    sides = pairs.select("scan_id", F.explode(F.array(F.struct(F.col("scan_id").alias("of"), F.lit(1).alias("n"), F.lit(0).alias("o")), F.struct(F.col("previous_id").alias("of"), F.lit(0).alias("n"), F.lit(1).alias("o")))).alias("s"))
    sides = sides.select("scan_id", "s.*")
    rows = prints.select(F.col("scan_id").alias("of"), "fp").join(sides, "of")
    each = rows.groupBy("scan_id", "fp").agg(F.max("n").alias("n"), F.max("o").alias("o"))
    return each.groupBy("scan_id").agg(F.count_if((F.col("n") == 1) & (F.col("o") == 0)).alias("new"), F.count_if((F.col("n") == 0) & (F.col("o") == 1)).alias("resolved"), F.count_if((F.col("n") == 1) & (F.col("o") == 1)).alias("unchanged"))


def page_deltas(pairs: DataFrame, pages: DataFrame, scores: DataFrame) -> DataFrame:
    """Pages of both runs of a pair: status, change of score and of content; a missing side counts 0."""
    known = pages.join(scores.select("scan_id", "page_id", "score"), ["scan_id", "page_id"]).select("scan_id", "url", "score", "content_hash")
    pairs = pairs.where("previous_id IS NOT NULL").select("scan_id", "previous_id")
    a = known.join(pairs, "scan_id").select("scan_id", "url", F.col("score").alias("now"), F.col("content_hash").alias("h"))
    b = known.withColumnRenamed("scan_id", "previous_id").join(pairs, "previous_id").select("scan_id", "url", F.col("score").alias("before"), F.col("content_hash").alias("g"))
    both = a.join(b, ["scan_id", "url"], "full")
    status = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "removed").otherwise("kept")
    return both.select("scan_id", "url", status.alias("status"), "now", "before", (F.coalesce("now", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"), (F.col("h") != F.col("g")).alias("content_changed"))


def score_deltas(pairs: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Change of each score present in both runs, one row for each key."""
    long_ = scores.unpivot(["scan_id"], keys, "key", "value")
    pairs = pairs.where("previous_id IS NOT NULL").select("scan_id", "previous_id")
    now = long_.join(pairs, "scan_id")
    old = long_.select(F.col("scan_id").alias("previous_id"), "key", F.col("value").alias("old"))
    return now.join(old, ["previous_id", "key"]).where("value IS NOT NULL AND old IS NOT NULL").select("scan_id", "key", (F.col("value") - F.col("old")).alias("delta"))


def list_runs(runs: DataFrame, pages: DataFrame, diffs: DataFrame | None = None) -> DataFrame:
    """Runs with their page counts, documents included, and with their diffs (scan_id, new, resolved, unchanged) if given."""
    n = pages.groupBy("scan_id").agg(F.count("*").alias("n_pages"))
    out = runs.join(n, "scan_id", "left").select("scan_id", "site_id", "status", "created_at", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))
    return out if diffs is None else out.join(diffs, "scan_id", "left")


def compare_issues(a: DataFrame, b: DataFrame, n: int = 50) -> DataFrame:
    """Fingerprints (fp, issue_id) that only run a has (new) or only run b (resolved): the first n of each by issue, and how many there are."""
    both = a.select("fp", "issue_id", F.lit(1).alias("a")).unionByName(b.select("fp", "issue_id", F.lit(0).alias("a")))
    each = both.groupBy("fp").agg(F.min("issue_id").alias("issue_id"), F.max("a").alias("has_a"), F.min("a").alias("only_a"))
    kind = F.when(F.col("only_a") == 1, "new").when(F.col("has_a") == 0, "resolved")
    rows = each.select("fp", "issue_id", kind.alias("kind")).where("kind IS NOT NULL")
    totals = rows.groupBy("kind").agg(F.count("*").alias("total"))
    top = rows.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy("issue_id", "fp"))).where(F.col("rank") <= n)
    return top.join(totals, "kind").select("kind", "rank", "issue_id", "total")


def state_durations(jobs: DataFrame, states: list[str]) -> DataFrame:
    """Seconds between the timestamps of neighbouring states, with counts and means, one row for each step."""
    steps = [F.struct(F.lit(f"{a}->{b}").alias("step"), (F.unix_timestamp(b) - F.unix_timestamp(a)).alias("seconds")) for a, b in zip(states, states[1:], strict=False)]
    rows = jobs.select(F.explode(F.array(*steps)).alias("s")).select("s.*").where("seconds IS NOT NULL")
    return rows.groupBy("step").agg(F.count("*").alias("n"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.round(F.avg(F.col("seconds").cast("decimal(18,6)")), 1).cast("double").alias("mean"))


def duration_sketches(jobs: DataFrame, states: list[str], by: list[str], k: int = 400) -> DataFrame:
    """A quantile sketch (KLL) of the seconds of each step between neighbouring states, for each ``by``: rows (by, step, n, sketch).

    Sketches merge: those of days make that of a month without reading the jobs again.
    Their rank error is about 1.65 / k, a little over half a percent.
    """
    steps = [F.struct(F.lit(f"{a}->{b}").alias("step"), (F.unix_timestamp(b) - F.unix_timestamp(a)).alias("seconds")) for a, b in zip(states, states[1:], strict=False)]
    rows = jobs.select(*by, F.explode(F.array(*steps)).alias("s")).select(*by, "s.*").where("seconds IS NOT NULL")
    return rows.groupBy(*by, "step").agg(F.count("*").alias("n"), F.kll_sketch_agg_bigint("seconds", k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: list[str], k: int = 400) -> DataFrame:
    """The sketches of finer groups merged into those of ``by``."""
    return sketches.groupBy(*by, "step").agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def duration_percentiles(sketches: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Percentiles of each sketch, as columns p50, p90, p99."""
    rest = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*rest, *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)).alias(f"p{round(q * 100)}") for q in shares])
