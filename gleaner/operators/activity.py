"""Source activity, statistics and gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.settings import DEFAULT, Settings

METRICS = ["msg_count", "order_candidates", "active_days", "relevant_orders", "spam", "dup"]
#: Bounds of the latency histogram, in seconds, and known access statuses.
LATENCY_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
SOURCE_STATUSES = ["ok", "not_public", "invalid_username", "floodwait", "disabled"]


def source_activity_metrics(sources: DataFrame, messages: DataFrame, orders: DataFrame, classifications: DataFrame, as_of: Column, days: int = 7, settings: Settings = DEFAULT) -> DataFrame:
    """A row for each source, silent ones with zeros.  Order and spam counts do not ask whether the post was deleted."""
    since = as_of - F.expr(f"interval {days} days")
    recent = messages.where(F.col("published_at") >= since)
    posts = recent.where("deleted_at is null").groupBy("source_id").agg(
        F.count("*").alias("msg_count"), F.max("published_at").alias("last_published_at"), F.count_distinct(F.to_date("published_at")).alias("active_days"), F.count_if(F.coalesce("passed_prefilter", F.lit(False))).alias("order_candidates")
    )
    noisy = classifications.where(F.col("label").isin("spam", "service_ad")).select("message_id").distinct()
    spam = recent.join(noisy, "message_id", "left_semi").groupBy("source_id").agg(F.count_distinct("message_id").alias("spam"))
    found = orders.where(F.col("published_at") >= since).groupBy("source_id").agg(F.count_if(F.col("relevance_score") >= settings.order_min_relevance).alias("relevant_orders"), F.count_if(F.col("duplicate_group_id").isNotNull()).alias("dup"))
    out = sources.join(posts, "source_id", "left").join(spam, "source_id", "left").join(found, "source_id", "left")
    hours = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros("last_published_at")) / F.lit(3600e6))
    return out.withColumns({m: F.coalesce(m, F.lit(0)) for m in METRICS}).withColumn("hours_since_last", F.when(F.col("last_published_at").isNotNull(), hours)).drop("last_published_at")


def activity_score(msg: Column, candidates: Column, hours: Column, days: Column, relevant: Column, spam: Column, dup: Column) -> Column:
    """0 to 100, rounded half to even.  The share of relevant orders itself is not clamped."""
    upto1 = lambda x: F.least(x, F.lit(1.0))
    recency = F.coalesce(F.greatest(F.lit(0.0), 1 - hours / 168), F.lit(0.0))
    one = F.lit(1)
    raw = (
        0.20 * upto1(msg / 200) + 0.30 * upto1(candidates / 40) + 0.15 * recency + 0.15 * upto1(days / 7) + 0.20 * (relevant / F.greatest(candidates, one)) - 0.15 * upto1((spam + dup) / F.greatest(msg, one))
    )
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * 100).cast("int")


def activity_status(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "active").when(score >= 20, "low").otherwise("inactive")


def poll_mode(score: Column, kind: Column) -> Column:
    return F.when((score >= 75) | ((score >= 50) & (kind == "megagroup")), "realtime").otherwise("poll")


def score_sources(sources: DataFrame, messages: DataFrame, orders: DataFrame, classifications: DataFrame, as_of: Column, settings: Settings = DEFAULT) -> DataFrame:
    rest = sources.drop("activity_score", "activity_status", "poll_mode")
    out = source_activity_metrics(rest, messages, orders, classifications, as_of, 7, settings)
    score = activity_score(*[F.col(c) for c in ("msg_count", "order_candidates", "hours_since_last", "active_days", "relevant_orders", "spam", "dup")])
    return out.withColumn("activity_score", score).withColumn("activity_status", activity_status(F.col("activity_score"))).withColumn("poll_mode", poll_mode(F.col("activity_score"), F.col("type")))


def stats_summary(orders: DataFrame, sources: DataFrame, classifications: DataFrame) -> DataFrame:
    """Long form (metric, name, n): totals, labels and statuses."""
    one = lambda df, metric: df.agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("name"), "n")
    by = lambda df, metric, c: df.groupBy(F.coalesce(c, F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "name", "n")
    return one(orders, "orders").unionByName(one(sources, "sources")).unionByName(by(classifications, "label", "label")).unionByName(by(orders, "status", "status"))


def counters(df: DataFrame, column: str, metric: str) -> DataFrame:
    """(metric, name, n) by a column; null counts as unknown."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(metric).alias("metric"), "name", "n")


def runtime_gauges(failed: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """(metric, name, value): failed tasks, lag in seconds, enabled sources by status with zeros for known ones."""
    enabled = sources.where("enabled")
    lag = enabled.where("access_status = 'ok'").agg(F.max("last_checked_at").alias("t")).select(F.lit("lag_seconds").alias("metric"), F.lit("").alias("name"), ((F.unix_micros(as_of) - F.unix_micros("t")) / F.lit(1e6)).alias("value"))
    known = sources.sparkSession.createDataFrame([(s,) for s in SOURCE_STATUSES], "name string")
    by = enabled.groupBy(F.col("access_status").alias("name")).agg(F.count("*").cast("double").alias("value"))
    statuses = known.join(by, "name", "full_outer").select(F.lit("sources").alias("metric"), "name", F.coalesce("value", F.lit(0.0)).alias("value"))
    return failed.agg(F.count("*").cast("double").alias("value")).select(F.lit("failed_tasks").alias("metric"), F.lit("").alias("name"), "value").unionByName(lag).unionByName(statuses)


def latency_histogram(df: DataFrame, value: str, bounds: list[float] = LATENCY_BOUNDS) -> DataFrame:
    """(le, n): how many values are at most each bound, infinity last.  One pass, one row for each bound."""
    counts = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def histogram_quantile(buckets: DataFrame, p: float, *by: str) -> DataFrame:
    """(by.., quantile) from cumulative buckets(by.., le, n): the value at rank p of the total, taken to lie evenly within its bucket.

    The first bucket starts at 0 (or at its own bound, if that is not above 0).  A rank in the last bucket, which has no
    upper bound, gives the greatest finite bound.  Null without values or without that last bucket.
    """
    rows = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("le", F.col("n").cast("double").alias("n")))).alias("b"))  # a row for each bound
    total = F.try_element_at("b", F.lit(-1))
    reached = F.get(F.filter("b", lambda x: x["n"] >= total["n"] * p), F.lit(0))
    before = F.try_element_at(F.filter("b", lambda x: x["le"] < reached["le"]), F.lit(-1))
    low, under = F.coalesce(before["le"], F.least(reached["le"], F.lit(0.0))), F.coalesce(before["n"], F.lit(0.0))
    inside = low + (reached["le"] - low) * (total["n"] * p - under) / F.nullif(reached["n"] - under, F.lit(0.0))
    value = F.when(reached["le"] == float("inf"), before["le"]).otherwise(F.coalesce(inside, reached["le"]))
    return rows.select(*by, F.when((total["le"] == float("inf")) & (total["n"] > 0), value).alias("quantile"))


def sustained(samples: DataFrame, condition: Column, step_seconds: int, hold_seconds: int, key: str = "metric", time: str = "at") -> DataFrame:
    """(key, pending_from, firing_from, until, samples): runs in which the condition held at every step, and for as long as asked.

    samples has a row for each key and step.  A run ends where the condition fails, is null or a step is missing; it fires
    from hold_seconds after its start on.  A key's samples are a series of one row a step.
    """
    at = F.unix_seconds(time)
    held = samples.where(F.coalesce(condition, F.lit(False))).select(F.col(key), F.col(time).alias("t"), at.alias("s"))
    # of consecutive steps, the step less its number is the same
    island = F.col("s") - step_seconds * F.row_number().over(Window.partitionBy(key).orderBy("s"))
    runs = held.withColumn("run", island).groupBy(key, "run").agg(F.min("t").alias("pending_from"), F.max("t").alias("until"), F.count("*").alias("samples"), F.min("s").alias("first"), F.max("s").alias("last"))
    fired = runs.where(F.col("last") - F.col("first") >= hold_seconds)
    return fired.select(key, "pending_from", F.timestamp_seconds(F.col("first") + hold_seconds).alias("firing_from"), "until", "samples")


def alerts(df: DataFrame, value: str, failed: str, p: float = 0.95, most_latency: float = 5.0, most_failures: float = 0.001) -> DataFrame:
    """(p_latency, failure_ratio, latency_alert, failure_alert) of a window of rows."""
    out = df.agg(F.percentile_approx(value, p).alias("p_latency"), F.avg(F.col(failed).cast("int")).alias("failure_ratio"))
    return out.withColumn("latency_alert", F.col("p_latency") > most_latency).withColumn("failure_alert", F.col("failure_ratio") > most_failures)


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def evaluate(df: DataFrame, labels: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, precision, recall, f1, support) for every label, 0 where undefined; one grouped pass."""
    known = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    pairs = confusion(df, label, predicted)
    told = pairs.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = pairs.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    out = known.join(told, "label", "left").join(said, "label", "left").fillna(0, ["support", "hit", "said"])
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    out = out.withColumn("precision", ratio("hit", "said")).withColumn("recall", ratio("hit", "support"))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.select("label", "precision", "recall", f1.alias("f1"), F.col("support").cast("long").alias("support"))


def summary_metrics(per_class: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row from evaluate() and confusion(): accuracy, and the plain and the support-weighted mean of precision, recall and f1."""
    acc = pairs.agg((F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")).withColumn("one", F.lit(1))
    names = ("precision", "recall", "f1")
    means = [F.avg(c).alias(f"macro_{c}") for c in names] + [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in names]
    return per_class.agg(*means).withColumn("one", F.lit(1)).join(acc, "one").drop("one")
