"""Relational reports over documents, pairs, alerts and reviews. Every report is one pass of conditional aggregates, or a window over a stated key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import parse_time

#: Reviews that take a pair out of the count.
DISMISSED = ("REJECTED", "FALSE_POSITIVE", "INTENTIONAL_DIVERGENCE")
REVIEWS = ("PENDING", "CONFIRMED", "REJECTED", "FALSE_POSITIVE", "INTENTIONAL_DIVERGENCE")


def share(a: Column, b: Column, digits: int) -> Column:
    return F.round(a / F.greatest(b, F.lit(1)), digits)


def live(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("deleted"))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in a total order: order ends with a unique key."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def sides(pairs: DataFrame) -> DataFrame:
    """Each pair twice, once under each of its documents (an equi-join then finds a document's pairs)."""
    return pairs.withColumn("document_id", F.explode(F.array_distinct(F.array("doc_a", "doc_b"))))


def doc_contradictions(pairs: DataFrame) -> DataFrame:
    """document_id with each genuine pair that it takes part in."""
    kept = ~F.col("is_evolution") & ~F.coalesce(F.col("review_status").isin(*DISMISSED), F.lit(False))
    return sides(pairs.where(kept))


def doc_contradiction_stats(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every document's number of contradictions, their ratio to its claims and their mean confidence."""
    counted = doc_contradictions(pairs).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"))
    rows = docs.join(counted, "document_id", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select(*docs.columns, n.alias("contradictions"), (n / F.greatest("aligned_claims", F.lit(1))).alias("ratio"), F.coalesce("mean", F.lit(0.0)).alias("mean_confidence"))


def review_stats(pairs: DataFrame) -> DataFrame:
    status = F.coalesce("review_status", F.lit("PENDING"))
    counts = [F.count_if(status == s).alias(s.lower()) for s in REVIEWS]
    out = pairs.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if("is_evolution").alias("evolutions"))
    return out.withColumn("review_rate", share(F.col("total") - F.col("pending"), F.col("total"), 4))


def alert_stats(alerts: DataFrame, as_of: str) -> DataFrame:
    today = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    resolved = (F.col("status") == "RESOLVED") & (F.col("created_at").cast("timestamp") >= today)
    return alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "OPEN").alias("open"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(resolved).alias("resolved_today"),
    )


def gate_calibration(pairs: DataFrame, threshold: float) -> DataFrame:
    """How pairs sampled below the similarity gate fare, and whether the gate should move."""
    low, high = F.col("sampled"), ~F.col("sampled")
    real = low & ~F.col("is_evolution") & F.coalesce(F.col("review_status") == "CONFIRMED", F.lit(False))
    sim = lambda f, c: F.round(f(F.when(c, F.col("gate_similarity"))), 4)
    out = pairs.agg(
        F.count_if(low).alias("sampled"), F.count_if(high).alias("above"), F.count_if(real).alias("sampled_real"),
        sim(F.avg, low).alias("sampled_avg"), sim(F.min, low).alias("sampled_min"), sim(F.max, low).alias("sampled_max"), sim(F.avg, high).alias("above_avg"), sim(F.min, high).alias("above_min"),
    )
    rate = F.col("sampled_real") / F.greatest("sampled", F.lit(1))
    action = F.when(rate > 0.15, "LOWER_THRESHOLD").when((F.col("sampled") >= 10) & (rate < 0.02), "RAISE_THRESHOLD").otherwise("NO_CHANGE")
    suggested = F.when(rate > 0.15, max(0.5, threshold - 0.05)).when((F.col("sampled") >= 10) & (rate < 0.02), min(0.9, threshold + 0.03)).otherwise(threshold)
    return out.withColumn("rate", F.round(rate, 4)).withColumn("action", action).withColumn("suggested", F.round(suggested, 3))


def adaptive_threshold(pairs: DataFrame, base: float = 0.6, days: int = 30, least: int = 5) -> DataFrame:
    """The confidence threshold that recent verdicts call for."""
    recent = F.col("review_status").isNotNull() & (F.col("review_status") != "PENDING") & (F.col("reviewed_days_ago") <= days)
    out = pairs.agg(F.count_if(recent).alias("reviews"), F.count_if(recent & F.col("review_status").isin("FALSE_POSITIVE", "REJECTED")).alias("wrong"))
    rate = F.col("wrong") / F.greatest("reviews", F.lit(1))
    value = F.when(F.col("reviews") < least, base).when(rate > 0.3, F.least(F.lit(0.85), base + rate * 0.3)).when(rate > 0.1, F.least(F.lit(0.75), base + rate * 0.15)).otherwise(base)
    return out.withColumn("threshold", F.round(value, 3))


def suppression_rules(pairs: DataFrame, docs: DataFrame, days: int = 60, least: int = 3) -> DataFrame:
    """Pairs of document types whose recent reviews reject more than half."""
    types = docs.select("document_id", "document_type")
    a, b = (types.withColumnsRenamed({"document_id": f"doc_{s}", "document_type": f"type_{s}"}) for s in "ab")
    recent = pairs.where((F.col("reviewed_days_ago") <= days) & F.col("review_status").isNotNull() & (F.col("review_status") != "PENDING"))
    rows = recent.join(a, "doc_a").join(b, "doc_b").groupBy(F.least("type_a", "type_b").alias("first"), F.greatest("type_a", "type_b").alias("second"))
    wrong = F.count_if(F.col("review_status").isin("FALSE_POSITIVE", "REJECTED"))
    out = rows.agg(F.count(F.lit(1)).alias("total"), wrong.alias("rejected"))
    return out.where((F.col("total") >= least) & (F.col("rejected") / F.col("total") > 0.5))


def suppress_detection(pairs: DataFrame, docs: DataFrame, rules: DataFrame, threshold: float) -> DataFrame:
    """pairs and suppressed: below the threshold, or of types that the rules suppress."""
    types = docs.select("document_id", "document_type")
    a, b = (types.withColumnsRenamed({"document_id": f"doc_{s}", "document_type": f"type_{s}"}) for s in "ab")
    rows = pairs.join(a, "doc_a", "left").join(b, "doc_b", "left").withColumn("first", F.least("type_a", "type_b")).withColumn("second", F.greatest("type_a", "type_b"))
    hit = rows.join(rules.select("first", "second", F.lit(True).alias("_rule")), ["first", "second"], "left")
    return hit.select(*pairs.columns, ((F.col("confidence") < threshold) | F.coalesce("_rule", F.lit(False))).alias("suppressed"))


def version_chain(files: DataFrame) -> DataFrame:
    """Uploads (org_id, filename, document_id, created_at) in versions: the one replaced, the number and when the next one ends it."""
    by = Window.partitionBy("org_id", "filename").orderBy("created_at", "document_id")
    return files.withColumns({"supersedes": F.lag("document_id").over(by), "version": F.row_number().over(by).cast("long"), "effective_until": F.lead("created_at").over(by)})


def ledger_merge(ledger: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows of scanned (org_id, doc_a, doc_b in either order) that the ledger lacks, in canonical order, once each."""
    new = scanned.select("org_id", F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).where("doc_a != doc_b").distinct()
    return new.join(ledger, ["org_id", "doc_a", "doc_b"], "left_anti")


def cascade_delete(pairs: DataFrame, claims: DataFrame, document_ids: DataFrame) -> DataFrame:
    """The pairs that stay when these documents go with their claims. A claim is told by its document and its id: documents may give equal ids."""
    gone = claims.join(document_ids, "document_id", "left_semi").select("document_id", "claim_id")
    for s in "ab":
        pairs = pairs.join(gone.withColumnsRenamed({"document_id": f"doc_{s}", "claim_id": f"claim_{s}"}), [f"doc_{s}", f"claim_{s}"], "left_anti")
    return pairs


def rate_limit(events: DataFrame, seconds: int = 60, most: int = 3) -> DataFrame:
    """Requests (user_id, ts, event_id) with how many the user made in the trailing window, and whether that is allowed."""
    by = Window.partitionBy("user_id").orderBy("_s").rangeBetween(-seconds + 1, 0)
    rows = events.withColumn("_s", F.unix_seconds(F.col("ts").cast("timestamp"))).withColumn("recent", F.count(F.lit(1)).over(by))
    return rows.withColumn("allowed", F.col("recent") <= most).drop("_s")


def apply_updates(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns overwritten where updates has the key."""
    new = updates.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(new, key, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in rows.columns))


#: Columns of a document that its governance metadata holds, and the levels of authority.
METADATA = ("authority_level", "owner_department", "document_type", "effective_from", "effective_until", "version_number")
AUTHORITY = (1, 5)


def update_metadata(docs: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (org_id, document_id, deleted and the columns of METADATA) after updates (org_id, document_id and some of these, null: as it is), and the updates that were refused, with a reason.

    An update is refused as a whole if its level is not from 1 to 5, or if its organisation has no such live document. Dates are read leniently; of several updates of a document the last by ord counts.
    """
    columns = [c for c in METADATA if c in updates.columns]
    last = F.row_number().over(Window.partitionBy("org_id", "document_id").orderBy(F.desc("ord")))
    live_ids = docs.where(~F.col("deleted")).select("org_id", "document_id", F.lit(True).alias("_known"))
    rows = updates.join(live_ids, ["org_id", "document_id"], "left")
    wrong = ~F.col("authority_level").between(*AUTHORITY) if "authority_level" in columns else F.lit(False)
    reason = F.when(F.col("_known").isNull(), "document not found").when(F.coalesce(wrong, F.lit(False)), f"authority_level must be {AUTHORITY[0]}-{AUTHORITY[1]}")
    rows = rows.withColumn("reason", reason).drop("_known")
    good = rows.where("reason is null").withColumn("_n", last).where("_n = 1").select("org_id", "document_id", *(F.col(c).alias(f"_{c}") for c in columns))
    changed = docs.join(good, ["org_id", "document_id"], "left")
    read = lambda c: parse_time(F.col(f"_{c}")) if c.startswith("effective") and dict(updates.dtypes)[c] == "string" else F.col(f"_{c}")
    changed = changed.withColumns({c: F.coalesce(read(c).cast(docs.schema[c].dataType), F.col(c)) for c in columns})
    return changed.select(*docs.columns), rows.where("reason is not null").select("org_id", "document_id", "ord", "reason")


def submit_reviews(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """pairs with review_status, reviewed_by, reviewed_at and review_reason of verdicts (pair_id and these); one with a status that isn't allowed changes nothing."""
    columns = ["review_status", "reviewed_by", "reviewed_at", "review_reason"]
    good = verdicts.withColumn("review_status", F.upper("review_status")).where(F.col("review_status").isin("APPROVED", *DISMISSED))
    return apply_updates(pairs, good, "pair_id", columns)


def feedback_rows(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What each verdict on an inferred replacement (pairs: pair_id, inferred_lineage, classification, explanation) says about the heuristic's signals."""
    from .pairs import feedback_signals

    good = verdicts.withColumn("decision", F.upper("review_status")).where(F.col("decision").isin("APPROVED", *DISMISSED))
    rows = feedback_signals(pairs.where("inferred_lineage").select("pair_id", "classification", "explanation"))
    return rows.join(good.select("pair_id", "decision", "reviewed_by"), "pair_id").select("pair_id", "title_similarity", "gap_days", F.lit(True).alias("department_match"), "decision", "classification", "reviewed_by")


def cache_report(lookups: DataFrame) -> DataFrame:
    """Hit rates and hits of lookups (kind: parse, chunk or claim; hit)."""
    count = lambda kind, hit: F.count_if((F.col("kind") == kind) & (F.col("hit") if hit else F.lit(True)))
    out = lookups.agg(*(count(k, h).alias(f"{k}_{'hits' if h else 'all'}") for k in ("parse", "claim") for h in (True, False)))
    rate = lambda k: share(F.col(f"{k}_hits"), F.col(f"{k}_all"), 2).alias(f"{k}_hit_rate")
    return out.select(rate("parse"), rate("claim"), "parse_hits", "claim_hits")


def latency_stats(calls: DataFrame) -> DataFrame:
    """Seconds in all, items and milliseconds an item of calls (seconds, items)."""
    out = calls.agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("items"), F.lit(0)).alias("total_items"))
    return out.select(F.round("_s", 4).alias("total_seconds"), "total_items", F.round(F.col("_s") / F.greatest("total_items", F.lit(1)) * 1000, 2).alias("ms_an_item"))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The last row by order of each key."""
    both = old.unionByName(new)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return both.withColumn("_r", rank).where("_r = 1").drop("_r")
