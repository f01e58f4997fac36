"""Comparison, diff, review, feedback, learning and price reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def golden_rows(predicted: DataFrame, expected: DataFrame, most_pct: float = 10.0, tolerance: float = 0.01, least: float = 0.01) -> DataFrame:
    """Each prediction beside its expected value, with errors and a verdict."""
    joined = predicted.select("row_index", F.col("qty").alias("predicted")).join(expected.select("row_index", F.col("qty").alias("expected")), "row_index", "left")
    joined = joined.where(F.col("expected").isNull() | (F.col("expected") >= least))
    gap = F.abs(F.col("predicted") - F.col("expected"))
    none, lost = F.col("expected").isNull(), F.col("predicted").isNull()
    passes = (gap / F.col("expected") * 100 <= most_pct) | (gap / F.col("expected") <= tolerance)
    return joined.select(
        "row_index",
        F.coalesce("expected", F.lit(0.0)).alias("expected"),
        "predicted",
        F.when(none, 0.0).when(lost, F.col("expected")).otherwise(gap).alias("abs_error"),
        F.when(none, 0.0).when(lost, 100.0).otherwise(gap / F.col("expected") * 100).alias("pct_error"),
        F.when(none, "missing_expected").when(lost, "missing_prediction").when(passes, "pass").otherwise("fail").alias("status"),
    )


def golden_summary(rows: DataFrame, least_rate: float = 0.8) -> DataFrame:
    own = F.col("status").isin("pass", "fail")
    of = lambda s: F.count_if(F.col("status") == s)
    out = rows.agg(
        F.count("*").alias("total_rows"), F.count_if(own).alias("matched_rows"), of("pass").alias("passed_rows"), of("fail").alias("failed_rows"), of("missing_prediction").alias("missing_predictions"),
        F.coalesce(F.avg(F.when(own, F.col("abs_error"))), F.lit(0.0)).alias("avg_abs_error"), F.coalesce(F.avg(F.when(own, F.col("pct_error"))), F.lit(0.0)).alias("avg_pct_error"),
        F.coalesce(F.max(F.when(own, F.col("pct_error"))), F.lit(0.0)).alias("max_pct_error"), F.coalesce(F.median(F.when(own, F.col("pct_error"))), F.lit(0.0)).alias("median_pct_error"),
    )
    rate = F.when(F.col("matched_rows") > 0, F.col("passed_rows") / F.col("matched_rows")).otherwise(0.0)
    return out.withColumn("quality_gate", F.when(rate >= least_rate, "PASS").otherwise("FAIL"))


def golden_worst(rows: DataFrame, most: int = 20) -> DataFrame:
    return rows.where("status IN ('fail', 'missing_prediction')").orderBy(F.desc("pct_error"), "row_index").limit(most)


def golden_compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """Change of pass rate and mean error between two summaries: one row."""
    rate = lambda: F.when(F.col("matched_rows") > 0, F.col("passed_rows") / F.col("matched_rows")).otherwise(0.0)
    side = lambda d, p: d.select(rate().alias(f"{p}_rate"), F.col("avg_pct_error").alias(f"{p}_err"), F.col("missing_predictions").alias(f"{p}_missing"))
    one = side(now, "now").join(F.broadcast(side(before, "old")))
    d, e = F.col("now_rate") - F.col("old_rate"), F.col("now_err") - F.col("old_err")
    return one.select(d.alias("rate_change"), e.alias("error_change"), F.when((d < -0.02) | (e > 1), "worse").when((d > 0.02) | (e < -1), "better").otherwise("same").alias("verdict"), (F.col("now_missing") - F.col("old_missing")).alias("missing_change"))


def regression(staging: DataFrame, expected: DataFrame) -> DataFrame:
    """Errors of staged quantities against expected ones; outliers by an absolute bound."""
    j = staging.select("id", "qty_final", "status").join(expected.select(F.col("row_index").alias("id"), F.col("qty").alias("expected")), "id", "left")
    gap = F.abs(F.col("qty_final") - F.col("expected"))
    return j.select("id", "status", gap.alias("abs_error"), F.when(F.col("expected") != 0, gap / F.col("expected") * 100).alias("pct_error"), F.coalesce(gap > 50, F.lit(False)).alias("outlier"))


TRACKED = ["qty_final", "unit_price_ref", "status", "height_factor"]


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows added, removed or modified between two snapshots, with the fields that changed and the change of price and quantity."""
    a = before.select("id", *[F.col(c).alias(f"a_{c}") for c in TRACKED], F.lit(True).alias("in_a"))
    b = after.select("id", *[F.col(c).alias(f"b_{c}") for c in TRACKED], F.lit(True).alias("in_b"))
    j = a.join(b, "id", "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in TRACKED]))
    value = lambda p: F.coalesce(F.col(f"{p}_unit_price_ref"), F.lit(0.0)) * F.coalesce(F.col(f"{p}_qty_final"), F.lit(0.0))
    kind = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.size(changed) > 0, "modified")
    return j.withColumn("change", kind).where("change IS NOT NULL").select(
        "id", "change", F.when(F.col("change") == "modified", F.array_join(changed, ",")).otherwise("").alias("fields"),
        (value("b") - value("a")).alias("price_impact"), (F.coalesce("b_qty_final", F.lit(0.0)) - F.coalesce("a_qty_final", F.lit(0.0))).alias("qty_impact"),
    )


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"), F.sum("price_impact").alias("price_impact"), F.sum("qty_impact").alias("qty_impact"))


def snapshot(rows: DataFrame) -> DataFrame:
    """All rows of each batch as one JSON array, in the order of their ids."""
    return rows.groupBy("batch_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("id", F.to_json(F.struct(*[c for c in rows.columns if c != "batch_id"])).alias("j")))), lambda x: x["j"])).alias("snapshot"))


def layer_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """Layers that only one side has."""
    l, r = left.select("layer").distinct(), right.select("layer").distinct()
    return l.join(r, "layer", "left_anti").withColumn("side", F.lit("left")).unionByName(r.join(l, "layer", "left_anti").withColumn("side", F.lit("right")))


def coverage(layers: DataFrame, used: DataFrame) -> DataFrame:
    hit = used.select("layer").where("layer IS NOT NULL").distinct().withColumn("used", F.lit(True))
    return layers.join(hit, "layer", "left").select("layer", "entity_count", F.coalesce("used", F.lit(False)).alias("used"))


def review_stats(rows: DataFrame) -> DataFrame:
    s = F.col("status")
    return rows.agg(F.count_if(s == "approved").alias("approved"), F.count_if(s.startswith("pending")).alias("pending"), F.count_if(s.isin("ignored", "rejected")).alias("hidden"), F.count_if(F.col("match_confidence") < 0.5).alias("low_confidence"))


def confidence_bucket(c: Column) -> Column:
    return F.when(c > 0.8, "high").when(c > 0.4, "medium").otherwise("low")


def review_filter(rows: DataFrame, which: str) -> DataFrame:
    how = {"pending": F.col("status").startswith("pending"), "low": F.col("match_confidence") < 0.5, "zero": (F.coalesce("qty_final", F.lit(0.0)) == 0) & (F.col("n_sources") > 0), "rejected": F.col("status") == "rejected"}
    return rows.where(how[which])


def diagnostic(rows: DataFrame) -> DataFrame:
    """Counts over all staged rows in one pass."""
    s, q = F.col("status"), F.col("qty_final")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(s == "approved").alias("approved"), F.count_if(s == "pending_no_match").alias("no_match"), F.count_if(s == "pending_semantics").alias("semantics"),
        F.count_if(q.isNull()).alias("null_qty"), F.count_if(q == 0).alias("zero_qty"), F.count_if(F.col("unit_price_ref").isNull()).alias("no_price"), F.count_if(F.col("height_factor").isNotNull()).alias("with_height"),
        F.count_if((s == "approved") & q.isNull()).alias("approved_without_qty"), F.count_if((F.col("match_confidence") > 0.8) & (s != "approved")).alias("sure_but_open"), F.avg("match_confidence").alias("avg_confidence"),
    )


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Newest accepted correction of each text."""
    w = Window.partitionBy("item_text").orderBy(F.desc("created_at"), F.desc("id"))
    own = feedback.where("correction IN ('accept', 'modify', 'manual')")
    return own.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("item_text", "target", "confidence", "created_at")


def similar_matches(feedback: DataFrame, text: str, most: int = 100) -> DataFrame:
    """Targets of the newest accepted rows whose text contains the given one, most frequent first."""
    own = feedback.where((F.col("correction") == "accept") & F.col("item_text").contains(text)).orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    return own.groupBy("target").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))


def feedback_accuracy(feedback: DataFrame) -> DataFrame:
    return feedback.agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"), (100.0 * F.avg((F.col("correction") == "accept").cast("double"))).alias("accept_pct"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def metrics_by_day(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy(F.to_date("created_at").alias("day")).agg(F.avg("accuracy").alias("avg_accuracy"), F.sum("cost").alias("cost"), F.count("*").alias("batches"))


def metrics_alerts(metrics: DataFrame, last: int = 10) -> DataFrame:
    """Alerts on the newest batches."""
    recent = metrics.orderBy(F.desc("created_at"), "batch_id").limit(last)
    one = recent.agg(F.avg("accuracy").alias("a"), F.avg("cost").alias("c"), F.avg("time_ms").alias("t"))
    alerts = F.array_compact(F.array(F.when(F.col("a") < 70, "low_accuracy"), F.when(F.col("c") > 100, "high_cost"), F.when(F.col("t") > 300_000, "slow")))
    return one.select(F.explode(alerts).alias("alert"))


def learning_stats(mappings: DataFrame, most: int = 10) -> DataFrame:
    return mappings.groupBy("layer").agg(F.sum("times_used").alias("times_used"), F.count("*").alias("n")).orderBy(F.desc("times_used"), "layer").limit(most)


def learned_lookup(mappings: DataFrame, user: str, text: str, most: int = 5) -> DataFrame:
    own = mappings.where((F.col("user_id") == user) & F.col("item_text").contains(text))  # equal or containing
    return own.orderBy(F.desc("times_used"), F.desc("confidence"), "layer").limit(most)


def upsert_mappings(table: DataFrame, new: DataFrame) -> DataFrame:
    """New uses added to the table: keys (user_id, item_text, layer) keep one row, counts add up, the newest use stays."""
    both = table.unionByName(new)
    return both.groupBy("user_id", "item_text", "layer").agg(F.sum("times_used").alias("times_used"), F.max("confidence").alias("confidence"), F.max("last_used").alias("last_used"))


def fresh_mappings(mappings: DataFrame, today: Column, days: int = 180) -> DataFrame:
    return mappings.where(F.col("last_used") >= F.date_sub(today, days))


def prices(sources: DataFrame) -> DataFrame:
    """Least, mean and largest price of each item with a usable address, the range in percent, and how sure that is."""
    ok = F.col("url").isNotNull() & (F.trim("url") != "") & (F.lower("url") != "null") & F.col("url").startswith("http")
    return sources.groupBy("item").agg(
        F.min("price").alias("min_price"), F.avg("price").alias("avg_price"), F.max("price").alias("max_price"), F.count("*").alias("n"), F.count_if(ok).alias("n_valid")
    ).withColumn("confidence", F.when(F.col("n_valid") == 0, "low").when((F.col("n_valid") < F.col("n")) | (F.col("n") == 1), "medium").otherwise("high"))


def price_outliers(rows: DataFrame, times: float = 3.0, peers: int = 2) -> DataFrame:
    """Rows whose price is more than so many times the mean of the others with the same first word."""
    w = Window.partitionBy("word")
    own = rows.withColumn("word", F.substring_index("description", " ", 1)).withColumns({"n": F.count("price").over(w) - 1, "s": F.sum("price").over(w) - F.col("price")})
    return own.where((F.col("n") >= peers) & (F.col("price") > times * F.col("s") / F.col("n"))).select("row_index", "word", "price", (F.col("s") / F.col("n")).alias("peer_avg"))


def next_version(versions: DataFrame) -> DataFrame:
    return versions.groupBy("batch_id").agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("next_version"))
