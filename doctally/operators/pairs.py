"""Decisions on pairs of claims, propositions and documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import lexicon as L
from ..functions import text as X


def scan_route(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pairs (confidence_a, confidence_b) and route: structured only if both texts are regular enough."""
    return pairs.withColumn("route", F.when(F.least("confidence_a", "confidence_b") >= config.structured, "structured").otherwise("embedding"))


def seed_claims(claims: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The heaviest claims (document_id, importance_weight, ord) of each document, or all; ties go to the earlier."""
    if config.seed_claims is None:
        return claims
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("importance_weight"), "ord"))
    return claims.withColumn("_r", rank).where(F.col("_r") <= config.seed_claims).drop("_r")


def similarity_gate(pairs: DataFrame, config: Config = DEFAULT, rate: float | None = None) -> DataFrame:
    """Pairs (a_id, b_id, similarity) at or above the gate, and of those below a sample fixed by their ids; sampled tells which."""
    rate = config.gate_sample if rate is None else rate
    chance = F.pmod(F.xxhash64("a_id", "b_id"), F.lit(10_000)) < int(rate * 10_000)
    passed = F.col("similarity") >= config.gate_similarity
    return pairs.where(passed | chance).withColumn("sampled", ~passed)


def dynamic_topk(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Of each claim's candidates (a_id, b_id, similarity) three, five or top_k, as the best is above 0.92, above 0.85 or below."""
    by = Window.partitionBy("a_id")
    best = F.max("similarity").over(by)
    k = F.when(best > 0.92, 3).when(best > 0.85, 5).otherwise(config.top_k)
    rank = F.row_number().over(by.orderBy(F.desc("similarity"), "b_id"))
    return pairs.withColumn("_k", k).withColumn("rank", rank.cast("long")).where((F.col("rank") <= F.col("_k")) & (F.col("rank") <= config.retrieve_k)).drop("_k")


def confidence_bands(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pairs (label, score, ratio) that count as contradictions, with band high or borderline (to be reviewed)."""
    limit = F.when(F.col("ratio") > config.uneven_ratio, max(config.contradiction, config.contradiction_uneven)).otherwise(config.contradiction)
    band = F.when(F.col("score") >= limit, "high").when(F.col("score") >= config.borderline, "borderline")
    return pairs.where("label = 'contradiction'").withColumn("band", band).where("band is not null").withColumn("requires_review", F.col("band") == "borderline")


def symmetric(pairs: DataFrame) -> DataFrame:
    """Pairs whose labels (label, reverse_label) are contradiction both ways."""
    return pairs.where("label = 'contradiction' and reverse_label = 'contradiction'")


def dedup_pairs(pairs: DataFrame) -> DataFrame:
    """The first (by ord) of each unordered pair (a_id, b_id)."""
    rank = F.row_number().over(Window.partitionBy(F.least("a_id", "b_id"), F.greatest("a_id", "b_id")).orderBy("ord"))
    return pairs.withColumn("_r", rank).where("_r = 1").drop("_r")


def canonical_pairs(pairs: DataFrame, swapped: tuple[tuple[str, str], ...] = (("a_id", "b_id"),)) -> DataFrame:
    """Pairs with a_id < b_id, the other column pairs swapped along; a claim with itself is no pair."""
    flip = F.col("a_id") > F.col("b_id")
    new = {c: F.when(flip, F.col(d)).otherwise(F.col(c)) for a, b in swapped for c, d in ((a, b), (b, a))}
    return pairs.where("a_id != b_id").withColumns(new)


def entities_align(a: Column, b: Column) -> Column:
    """Equal, one within the other, or half of their words shared."""
    x, y = F.lower(a), F.lower(b)
    m, n = (F.array_except(F.array_distinct(X.words(t)), X.literals(L.ENTITY_STOPWORDS)) for t in (x, y))
    union = F.size(F.array_union(m, n))
    jaccard = F.when((F.size(m) > 0) & (F.size(n) > 0), F.size(F.array_intersect(m, n)) / F.greatest(union, F.lit(1))).otherwise(0.0)
    filled = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return filled & ((x == y) | F.contains(x, y) | F.contains(y, x) | (jaccard >= 0.5))


def attributes_align(a: Column, b: Column) -> Column:
    """Equal, or of the shorter's words two in five shared."""
    x, y = F.lower(a), F.lower(b)
    m, n = (F.array_except(F.array_distinct(X.words(t)), X.literals(L.ATTRIBUTE_STOPWORDS)) for t in (x, y))
    least = F.least(F.size(m), F.size(n))
    filled = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return filled & ((x == y) | ((least > 0) & (F.size(F.array_intersect(m, n)) / F.greatest(least, F.lit(1)) >= 0.4)))


def with_similarities(pairs: DataFrame, encode) -> DataFrame:
    """pairs of propositions with entity_similarity and attribute_similarity by an encoder (a frame and a text column's name to the frame with `embedding`, as vectors.hash_embed)."""
    from .vectors import similarity

    for c in ("entity", "attribute"):
        texts = pairs.select(F.explode(F.array(f"{c}_a", f"{c}_b")).alias("_x")).where("_x is not null").distinct()
        coded = encode(texts, "_x").select("_x", "embedding").hint("merge")  # a vector for every text: not broadcast
        for s in "ab":
            pairs = pairs.join(coded.withColumnsRenamed({"_x": f"{c}_{s}", "embedding": f"_{s}"}), f"{c}_{s}", "left")
        pairs = pairs.withColumn(f"{c}_similarity", similarity(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    return pairs


def parse_time(x: Column) -> Column:
    """A timestamp from the usual ways of writing dates, without a zone as UTC; null if it is none of them."""
    formats = ("yyyy/MM/dd[ HH:mm:ss]", "dd.MM.yyyy[ HH:mm:ss]", "MM/dd/yyyy[ HH:mm:ss]", "d MMM yyyy[ HH:mm:ss]", "MMM d, yyyy[ HH:mm:ss]", "MMMM d, yyyy[ HH:mm:ss]", "yyyyMMdd")
    text = F.trim(x)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))
    return F.coalesce(iso, *(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def _inverted(a: Column, b: Column, yes: str, no: str) -> Column:
    return (a.rlike(yes) & b.rlike(no)) | (a.rlike(no) & b.rlike(yes))


def ruled(pairs: DataFrame) -> DataFrame:
    """Pairs that one of the taxonomy's rules holds for, aligned or not, with its type, confidence and severity: few, so what aligns them is asked of these only."""
    found, _ = _by_rules()
    # a one-element array keeps the rules from being copied into each condition and column
    return pairs.select("*", F.explode(F.array(found)).alias("_t")).where("_t.type is not null").select(*pairs.columns, "_t.*")


def _by_rules() -> tuple[Column, Column]:
    """What the first rule that holds gives (type, confidence, severity), and what no rule does."""
    a, b = (lambda c, s=s: F.col(f"{c}_{s}") for s in "ab")
    sides = ("positive", "negative")
    opposed = (a("polarity") != b("polarity")) & a("polarity").isin(*sides) & b("polarity").isin(*sides) & (a("confidence_level") == "certain") & (b("confidence_level") == "certain")
    opposed = opposed & (F.col("nli_label") == "contradiction") & (F.col("nli_score") >= 0.8)
    causal = [F.size(F.array_intersect(X.words(F.lower(s("sentence"))), X.literals(L.CAUSAL))) > 0 for s in (a, b)]
    same = a("polarity") == b("polarity")
    level = lambda c: F.when(c == "certain", 3).when(c == "speculative", 1).otherwise(2)
    rules = (
        ("direct_opposition", opposed, F.col("nli_score"), "HIGH"),
        ("outcome_inversion", _inverted(a("sentence"), b("sentence"), L.OUTCOME_POSITIVE, L.OUTCOME_NEGATIVE), F.lit(0.75), "HIGH"),
        ("capability_reversal", _inverted(a("sentence"), b("sentence"), L.CAPABLE, L.INCAPABLE), F.lit(0.70), "HIGH"),
        ("causal_attenuation", same & (a("polarity") != "neutral") & (causal[0] != causal[1]), F.lit(0.60), "MEDIUM"),
        ("confidence_conflict", same & (F.abs(level(a("confidence_level")) - level(b("confidence_level"))) >= 2), F.lit(0.50), "LOW"),
    )
    none = F.struct(F.lit(None).cast("string").alias("type"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("severity"))
    found = reduce(lambda rest, r: F.when(r[1], F.struct(F.lit(r[0]).alias("type"), r[2].alias("confidence"), F.lit(r[3]).alias("severity"))).otherwise(rest), reversed(rules), none)
    return found, none


def taxonomy(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pairs of propositions (entity_, attribute_, polarity_, confidence_level_, sentence_ with a and b; nli_label, nli_score) and type, confidence, severity.

    Where pairs have entity_similarity or attribute_similarity, these align what words don't.
    """
    found, none = _by_rules()
    return pairs.withColumn("_t", F.when(aligned(pairs, config), found).otherwise(none)).select(*pairs.columns, "_t.*")


def aligned(pairs: DataFrame, config: Config = DEFAULT) -> Column:
    """Whether entities and attributes of pairs mean the same, by words or by similarities that pairs have."""
    a, b = (lambda c, s=s: F.col(f"{c}_{s}") for s in "ab")
    near = lambda c, least: F.coalesce(F.col(c) >= least, F.lit(False)) if c in pairs.columns else F.lit(False)
    entities = entities_align(a("entity"), b("entity")) | near("entity_similarity", config.entity_similarity)
    return entities & (attributes_align(a("attribute"), b("attribute")) | near("attribute_similarity", config.attribute_similarity))


def best_taxonomy(classified: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The most confident type of each key; ties go to the first by order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), order))
    return classified.where("type is not null").withColumn("_r", rank).where("_r = 1").drop("_r")


def alert_severity(pairs: DataFrame) -> DataFrame:
    """Pairs (is_evolution, requires_review, confidence) and severity."""
    severity = F.when(F.col("is_evolution"), "low").when(F.col("requires_review"), "medium").when(F.col("confidence") > 0.8, "high").otherwise("medium")
    return pairs.withColumn("severity", severity)


def lineage(pairs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pairs of documents (department_, version_, created_ with a and b; similarity) and newer (a, b or null), lineage_confidence."""
    dept_a, dept_b = (F.coalesce(f"department_{s}", F.lit("")) for s in "ab")
    related = (dept_a != "") & (dept_a == dept_b) & (F.col("similarity") > config.lineage_similarity)
    days = F.floor((F.unix_micros("created_a") - F.unix_micros("created_b")) / F.lit(86_400_000_000))
    by_version = F.col("version_a") != F.col("version_b")
    newer = F.when(by_version, F.when(F.col("version_a") > F.col("version_b"), "a").otherwise("b")).when(F.abs(days) > 30, F.when(days > 0, "a").otherwise("b"))
    sure = F.when(by_version, F.least(F.lit(0.9), "similarity")).otherwise(F.least(F.lit(0.8), "similarity"))
    newer = F.when(related, newer)
    return pairs.withColumn("newer", newer).withColumn("lineage_confidence", F.when(newer.isNotNull(), sure))


def temporal_class(pairs: DataFrame, as_of: str, config: Config = DEFAULT) -> DataFrame:
    """Pairs of documents (id_, supersedes_, from_, until_ and the columns of lineage, with a and b) and class, class_confidence, inferred, as of a timestamp."""
    now = F.lit(as_of).cast("timestamp")
    replaces = (F.col("supersedes_a") == F.col("id_b")) | (F.col("supersedes_b") == F.col("id_a"))
    over = [F.coalesce(F.col(f"until_{s}") < now, F.lit(False)) for s in "ab"]
    apart = (F.col("until_a") < F.col("from_b")) | (F.col("until_b") < F.col("from_a"))
    rules = (
        (F.coalesce(replaces, F.lit(False)), "evolution", F.lit(1.0), False),
        (over[0] & over[1], "expired", F.lit(0.95), False),
        (over[0] | over[1], "evolution", F.lit(0.9), False),
        (F.coalesce(apart, F.lit(False)), "evolution", F.lit(0.85), False),
        (F.col("newer").isNotNull(), "evolution", F.col("lineage_confidence"), True),
    )
    make = lambda name, sure, inferred: F.struct(F.lit(name).alias("class"), sure.alias("class_confidence"), F.lit(inferred).alias("inferred"))
    found = reduce(lambda rest, r: F.when(r[0], make(*r[1:])).otherwise(rest), reversed(rules), make("contradiction", F.lit(0.7), False))
    rows = lineage(pairs, config).withColumn("_t", found)
    return rows.select(*pairs.columns, "newer", "lineage_confidence", "_t.*")


def feedback_signals(reviews: DataFrame) -> DataFrame:
    """reviews (explanation) and title_similarity, gap_days as numbers, null where the text has none."""
    number = lambda p: F.regexp_extract("explanation", p, 1)
    sim, gap = number(r"sim=([0-9.]+)"), number(r"newer by (\d+) days")
    return reviews.withColumn("title_similarity", F.when(sim != "", sim.cast("double"))).withColumn("gap_days", F.when(gap != "", gap.cast("long")))
