"""The pair scan: claims of different documents that may contradict each other, by similarity, a pair classifier and shared subjects.

Encoder and classifier are pluggable; the defaults are rules, deterministic and offline.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import text as X
from ..storage import stored
from . import pairs as P
from . import text as T
from . import vectors as V
from .vector_index import nearest_indexed

_NEGATION = re.compile(r"\b(not|no|never|cannot|without|prohibited|forbidden)\b|n't\b", re.I)
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_WORD = re.compile(r"[^\W\d_]{3,}")


def rule_label(a: str, b: str) -> tuple[str, float]:
    """A pair's label and score: different numbers or negation on mostly equal words contradict, containment entails."""
    x, y = (set(_WORD.findall((t or "").lower())) for t in (a, b))
    if not x or not y:
        return "neutral", 0.0
    shared = len(x & y) / min(len(x), len(y))
    numbers = [set(_NUMBER.findall(t)) for t in (a, b)]
    against = bool(_NEGATION.search(a)) != bool(_NEGATION.search(b)) or (all(numbers) and numbers[0] != numbers[1])
    if against and shared >= 0.5:
        return "contradiction", 0.6 + 0.4 * shared
    return ("entailment", shared) if shared >= 0.95 else ("neutral", 1 - shared)


def rule_columns(a: Column, b: Column) -> tuple[Column, Column]:
    """The label and score of rule_label as expressions."""
    words = [F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(r"(\p{L}{3,})"))) for x in (a, b)]
    numbers = [F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"))) for x in (a, b)]
    negated = [F.coalesce(x, F.lit("")).rlike(f"(?i){_NEGATION.pattern}") for x in (a, b)]
    least = F.least(*map(F.size, words))
    shared = F.size(F.array_intersect(*words)) / F.greatest(least, F.lit(1))
    same = F.size(F.array_intersect(*numbers))
    differ = (F.size(numbers[0]) > 0) & (F.size(numbers[1]) > 0) & ((same < F.size(numbers[0])) | (same < F.size(numbers[1])))
    against = ((negated[0] != negated[1]) | differ) & (shared >= 0.5)
    label = F.when(least == 0, "neutral").when(against, "contradiction").when(shared >= 0.95, "entailment").otherwise("neutral")
    return label, F.when(least == 0, 0.0).when(against, 0.6 + 0.4 * shared).when(shared >= 0.95, shared).otherwise(1 - shared)


def classify(pairs: DataFrame, rule=None, texts: tuple[str, str] = ("a", "b"), prefix: str = "") -> DataFrame:
    """pairs (a, b: texts) and label, score: of rule_label, as expressions, or of a user's rule of two texts (a model, say), in Arrow batches."""
    if rule is None:
        label, score = rule_columns(*map(F.col, texts))
        # one-element arrays: a condition on the label must not be rewritten into the expression, which would then be computed again and again
        made = F.explode(F.array(F.struct(label.alias("label"), score.alias("score"))))
    else:

        def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([rule(x, y) for x, y in zip(a, b, strict=True)], columns=["label", "score"])

        run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
        made = F.pandas_udf(run, "label string, score double")(*texts)
    return pairs.select("*", made.alias("_n")).select(*pairs.columns, *(F.col(f"_n.{c}").alias(f"{prefix}{c}") for c in ("label", "score")))


def overlap_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """A scorer for reranking: the share of the first text's words that the second has."""
    both = [(set(x.lower().split()), set(y.lower().split())) for x, y in zip(a, b, strict=True)]
    return pd.Series([round(len(x & y) / max(len(x), 1), 6) for x, y in both])


EXPLANATION = "These two statements present conflicting information. Contradiction detected with %.0f%% confidence."


def explained(pairs: DataFrame, write=None) -> DataFrame:
    """pairs (a, b, score) and explanation: what a user's function of two texts and a score gives (a language model, say) if it has more than ten characters, else the template."""
    template = F.format_string(EXPLANATION, F.col("score") * 100)
    if write is None:
        return pairs.withColumn("explanation", template)

    def run(a: pd.Series, b: pd.Series, score: pd.Series) -> pd.Series:
        def one(*x):
            try:
                return write(*x)
            except Exception:  # a provider that fails leaves the template
                return None

        return pd.Series([one(*x) for x in zip(a, b, score, strict=True)], dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "score": pd.Series, "return": pd.Series}
    given = F.pandas_udf(run, "string")("a", "b", "score")
    return pairs.withColumn("_given", given).withColumn("explanation", F.when(F.length(F.trim("_given")) > 10, F.trim("_given")).otherwise(template)).drop("_given")


def seeds(claims: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Claims that a scan starts from: no structural noise, and of each document the heaviest."""
    return P.seed_claims(without_noise(claims, "content"), config)


def without_noise(rows: DataFrame, text: str) -> DataFrame:
    bare = X.without_bullets(F.col(text))
    noise = X.is_structural_noise(bare, X.words(F.lower(bare)))
    return rows.where(F.col(text).isNotNull()).select("*", F.explode(F.array(noise)).alias("_noise")).where("not _noise").drop("_noise")


def claim_pairs(claims: DataFrame, new: DataFrame | None = None, config: Config = DEFAULT, rule=None, write=None, within: str | None = None) -> DataFrame:
    """Contradicting pairs of claims of different documents; if new claims are given, pairs that one of them takes part in.

    claims: document_id, claim_id, content, and if known modality, importance_weight, ord and embedding (else hashed words). Seeds are compared with the
    nearest claims of other documents above the gate (and a sample below it; above vector_index.SMALL claims by an index, which leaves out cells that are too far), noise dropped, the dynamic cut, classification both ways, modalities, bands,
    and shared salient terms. within: a column (an organisation, say) that both claims of a pair must share.
    """

    def filled(rows: DataFrame) -> DataFrame:
        rows = rows.dropDuplicates(["claim_id"])
        for c, default in (("modality", F.lit(None).cast("string")), ("importance_weight", F.lit(1.0)), ("ord", F.col("claim_id"))):
            rows = rows if c in rows.columns else rows.withColumn(c, default)
        # read by every step of the search and twice after it: neither extracted nor embedded anew
        return stored(rows if "embedding" in rows.columns else V.hash_embed(rows, "content"))

    known = filled(claims)
    fresh = known if new is None else filled(new)
    chosen = seeds(fresh, config).select(F.col("claim_id").alias("query_id"), "document_id", "embedding", *([within] if within else []))
    least = -1.0 if config.gate_sample > 0 else config.gate_similarity
    there = known.withColumnRenamed("claim_id", "vec_id")
    if within:
        found = V.nearest_within(chosen, there, within, config.retrieve_k, least, skip_self=True, apart="document_id").drop(within)
    else:
        found = nearest_indexed(chosen, there, config.retrieve_k, least, skip_self=True, apart="document_id")
    found = P.similarity_gate(found.withColumnsRenamed({"query_id": "a_id", "vec_id": "b_id"}).drop("rank"), config)
    for s in "ab":
        side = known if s == "b" else fresh
        found = found.join(side.select(F.col("claim_id").alias(f"{s}_id"), F.col("document_id").alias(f"doc_{s}"), F.col("content").alias(s), F.col("modality").alias(f"modality_{s}")), f"{s}_id")
    # the rules on two texts cost far more than their bytes tell: few rows are spread over the cores too, not put together in one task
    spark = found.sparkSession
    found = found.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "a_id")
    rows = P.dynamic_topk(without_noise(found, "b"), config).drop("rank")
    rows = classify(rows, rule).withColumn("ratio", X.specificity_ratio(F.col("a"), F.col("b")))
    rows = P.confidence_bands(rows, config).where(X.modalities_comparable(F.col("modality_a"), F.col("modality_b")))
    rows = classify(rows, rule, ("b", "a"), "reverse_").drop("reverse_score")
    kept = P.symmetric(rows).withColumn("shared", X.shared_terms(F.col("a"), F.col("b"))).where(F.col("shared") >= config.shared_terms)
    ordered = kept.withColumn("ord", F.concat_ws(":", F.lpad(F.col("a_id").cast("string"), 40, "0"), F.lpad(F.col("b_id").cast("string"), 40, "0")))
    ordered = P.canonical_pairs(ordered, (("a_id", "b_id"), ("doc_a", "doc_b"), ("a", "b"), ("modality_a", "modality_b")))
    return explained(P.dedup_pairs(ordered).drop("ord"), write)


def verdicts(replies: DataFrame) -> DataFrame:
    """replies (reply: a language model's on a pair of texts) and classification, confidence, reason, claims: of its JSON object, in a code fence or bare; UNRELATED at 0 if it has none."""
    fenced = F.regexp_extract("reply", r"(?s)```(?:json)?\s*(.*?)(?:```|$)", 1)
    body = F.trim(F.when(F.contains("reply", F.lit("```")), fenced).otherwise(F.col("reply")))
    kind = "classification string, confidence string, explanation string, conflicting_claims array<string>"
    rows = replies.withColumn("_v", F.from_json(F.when(body.startswith("{") & F.try_parse_json(body).isNotNull(), body), kind))
    sure = F.coalesce(F.col("_v.confidence"), F.lit("0.5")).try_cast("double")
    usable = F.col("_v").isNotNull() & sure.isNotNull()
    return rows.select(
        *replies.columns,
        F.when(usable, F.coalesce("_v.classification", F.lit("UNRELATED"))).otherwise("UNRELATED").alias("classification"),
        F.when(usable, sure).otherwise(0.0).alias("confidence"),
        F.when(usable, F.coalesce("_v.explanation", F.lit(""))).otherwise("").alias("reason"),
        F.when(usable, F.coalesce("_v.conflicting_claims", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("claims"),
    )


def rule_reply(a: str, b: str) -> str:
    """The rule's label in the form of a language model's reply."""
    label, score = rule_label(a, b)
    return json.dumps({"classification": "CONTRADICTORY" if label == "contradiction" else "UNRELATED", "confidence": score})


def chunk_pairs(chunks: DataFrame, ask=rule_reply, new: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Pairs of chunks of different documents that a user's function of two texts (a language model, say; see verdicts) takes for contradictory or superseding.

    chunks: document_id, chunk_id, content, and if known embedding (else hashed words). Each chunk, or each new one, is asked about with its nearest chunks; those of
    its own document count among these, but aren't asked about. A call that fails is unrelated; of the two directions of a pair the one of the smaller id stays.
    """

    def coded(rows: DataFrame) -> DataFrame:
        return rows if "embedding" in rows.columns else V.hash_embed(rows, "content")

    stored = coded(chunks.dropDuplicates(["chunk_id"]))
    asked = stored if new is None else coded(new.dropDuplicates(["chunk_id"]))
    found = nearest_indexed(asked.withColumnRenamed("chunk_id", "query_id"), stored.withColumnRenamed("chunk_id", "vec_id"), config.chunk_partners, config.chunk_similarity, skip_self=True)
    found = found.withColumnsRenamed({"query_id": "a_id", "vec_id": "b_id"})
    for s, side in (("a", asked), ("b", stored)):
        found = found.join(side.select(F.col("chunk_id").alias(f"{s}_id"), F.col("document_id").alias(f"doc_{s}"), F.col("content").alias(s)), f"{s}_id")

    def one(a: str, b: str) -> str | None:
        try:
            return ask(a, b)
        except Exception:  # a provider that fails leaves the pair unrelated
            return None

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    # a call may be dear: not copied into filters
    reply = F.pandas_udf(run, "string").asNondeterministic()("a", "b")
    judged = verdicts(found.where("doc_a != doc_b").withColumn("reply", reply))
    kept = judged.where(F.col("classification").isin("CONTRADICTORY", "SUPERSEDES") & (F.col("confidence") >= config.verdict))
    return P.dedup_pairs(kept.withColumn("ord", F.struct("a_id", "rank"))).drop("ord", "rank", "reply")


def split_by_time(pairs: DataFrame, contexts: DataFrame, as_of: str, config: Config = DEFAULT) -> DataFrame:
    """pairs (doc_a, doc_b) with class, class_confidence, inferred: whether two claims contradict each other or one replaces the other by their documents' dates.

    contexts: id, supersedes, from, until, created, version, department of each document; pairs of unknown documents are contradictions.
    """
    for s in "ab":
        own = contexts.select(F.col("id").alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("supersedes", "from", "until", "created", "version", "department")))
        pairs = pairs.join(own, F.col(f"doc_{s}") == F.col(f"id_{s}"), "left")
    rows = P.temporal_class(pairs if "similarity" in pairs.columns else pairs.withColumn("similarity", F.lit(0.0)), as_of, config)
    return rows.drop(*(f"{c}_{s}" for c in ("id", "supersedes", "from", "until", "created", "version", "department") for s in "ab"))


def aligned_sections(pairs: DataFrame, docs: DataFrame, least: float = DEFAULT.alignment) -> DataFrame:
    """doc_a, doc_b, position_a, position_b, score, content_a, content_b: sections of each pair of documents (doc_id, text) matched by their summaries."""
    # the optimizer takes texts and vectors that are made within a row for as small as what they are made of, and would broadcast them: all joins are merges
    sections = stored(V.hash_embed(T.section_summary(T.sections(docs)), "summary").select("doc_id", "position", "content", "embedding"))
    keyed = stored(pairs.select("doc_a", "doc_b", F.concat_ws(":", "doc_a", "doc_b").alias("pair")))
    vectors = sections.drop("content")
    sides = [keyed.join(vectors.withColumnRenamed("doc_id", f"doc_{s}").hint("merge"), f"doc_{s}") for s in "ab"]
    out = align_sections(*sides, least=least).join(keyed.hint("merge"), "pair")
    for s in "ab":
        own = sections.select(F.col("doc_id").alias(f"doc_{s}"), F.col("position").alias(f"position_{s}"), F.col("content").alias(f"content_{s}"))
        out = out.join(own.hint("merge"), [f"doc_{s}", f"position_{s}"])
    return out.drop("pair")


def structured_scan(pairs: DataFrame, docs: DataFrame, rule=None, config: Config = DEFAULT) -> DataFrame:
    """Contradictions of propositions in aligned sections of each pair of documents: doc_a, doc_b, position_a, position_b, sentence_a, sentence_b, type, confidence, severity, band."""
    # sentences and rules cost far more than their bytes tell: rows are dealt over the cores, not put together in a few tasks
    tasks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    aligned = stored(aligned_sections(pairs, docs, config.alignment).repartition(tasks, "doc_a", "doc_b"))  # each side reads them
    keys = ["doc_a", "doc_b", "position_a", "position_b"]

    def side(s: str) -> DataFrame:
        parts = aligned.select(F.struct(*keys).alias("doc_id"), F.col(f"content_{s}").alias("text"))
        found = T.propositions(T.sentences(parts)).drop("modality", "pos")
        return found.select("doc_id", *(F.col(c).alias(f"{c}_{s}") for c in ("entity", "attribute", "polarity", "confidence_level", "sentence")))

    both = side("a").repartition(tasks, "doc_id").join(side("b").repartition(tasks, "doc_id").hint("merge"), "doc_id").withColumns({"a": F.col("sentence_a"), "b": F.col("sentence_b")})
    both = P.ruled(classify(both, rule).withColumnsRenamed({"label": "nli_label", "score": "nli_score"}))
    both = both.withColumns({f"{c}_similarity": V.hash_similarity(F.col(f"{c}_a"), F.col(f"{c}_b")) for c in ("entity", "attribute")})
    typed = both.where(P.aligned(both, config))
    band = F.when(F.col("confidence") >= 0.75, "high").otherwise("borderline")
    return typed.select("doc_id.*", "sentence_a", "sentence_b", "type", "confidence", "severity", band.alias("band")).distinct()


def routed_scan(pairs: DataFrame, docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Contradictions of each pair of documents (doc_a, doc_b) by the path that both their structures allow: doc_a, doc_b, a, b, confidence, band, scan_path."""
    regular = T.structure_confidence(docs).hint("merge")
    for s in "ab":
        pairs = pairs.join(regular.select(F.col("doc_id").alias(f"doc_{s}"), F.col("structure_confidence").alias(f"confidence_{s}")), f"doc_{s}")
    routed = stored(P.scan_route(pairs, config))
    by_structure = structured_scan(routed.where("route = 'structured'").select("doc_a", "doc_b"), docs, config=config)
    out = by_structure.select("doc_a", "doc_b", F.col("sentence_a").alias("a"), F.col("sentence_b").alias("b"), "confidence", "band", F.lit("structured").alias("scan_path"))
    wanted = routed.where("route = 'embedding'").select(F.least("doc_a", "doc_b").alias("_x"), F.greatest("doc_a", "doc_b").alias("_y")).distinct()
    wanted = stored(wanted)
    if not wanted.take(1):
        return out
    claims = T.extract_claims(docs).select(F.col("doc_id").alias("document_id"), F.concat_ws("_claim_", "doc_id", "pos").alias("claim_id"), "content", "importance_weight", F.col("pos").alias("ord"))
    # only claims of these documents are asked about, among those of all
    claims, asked = stored(claims), wanted.select(F.explode(F.array("_x", "_y")).alias("document_id")).distinct()
    found = claim_pairs(claims, claims.join(asked, "document_id", "left_semi"), config)
    found = found.withColumns({"_x": F.least("doc_a", "doc_b"), "_y": F.greatest("doc_a", "doc_b")}).join(wanted, ["_x", "_y"], "left_semi")
    return out.unionByName(found.select("doc_a", "doc_b", "a", "b", F.col("score").alias("confidence"), "band", F.lit("embedding").alias("scan_path")))


def align_sections(a: DataFrame, b: DataFrame, least: float = DEFAULT.alignment, most: int = 256) -> DataFrame:
    """pair, position_a, position_b, score: sections (pair, position, embedding) matched one to one, best first, by cosine less a tenth of their relative distance.

    A pair of documents with up to `most` sections a side is matched in one task, a longer one in rounds over its sections' best partners; both give the same matching.
    """
    # fresh columns: both sides may come from one frame
    a, b = (t.select(*(F.col(c).alias(c) for c in ("pair", "position", "embedding"))) for t in (a, b))
    counts = stored(a.groupBy("pair").count().unionByName(b.groupBy("pair").count()))
    buckets = -(-(counts.agg(F.sum("count")).first()[0] or 0) // SECTIONS) or 1
    long = stored(counts.where(F.col("count") > most).select("pair").distinct())
    if not long.take(1):
        return _align_short(a, b, least, buckets)
    short = _align_short(*(t.join(long, "pair", "left_anti") for t in (a, b)), least, buckets)
    return short.unionByName(align_in_rounds(*(t.join(long, "pair", "left_semi") for t in (a, b)), least, most))


#: Sections that meet in one call, on average.
SECTIONS = 4096


def _align_short(a: DataFrame, b: DataFrame, least: float, buckets: int) -> DataFrame:
    """Pairs are many and short, so a call matches those of a bucket, one after another."""
    kind = a.schema["pair"].dataType.simpleString()
    columns = ["pair", "position_a", "position_b", "score"]
    a, b = (t.withColumn("_bucket", F.pmod(F.xxhash64("pair"), F.lit(buckets))) for t in (a, b))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame(columns=columns)
        x, y = x.sort_values("position"), y.sort_values("position")
        vectors = [V.unit(np.stack(t["embedding"].to_numpy()).astype(np.float64)) for t in (x, y)]
        places, others, out = [t["position"].to_numpy() for t in (x, y)], y.groupby("pair").indices, []
        for pair, mine in x.groupby("pair").indices.items():
            its = others.get(pair)
            if its is not None:
                out += [(pair, int(places[0][mine[i]]), int(places[1][its[j]]), score) for i, j, score in _greedy(vectors[0][mine], vectors[1][its], least)]
        return pd.DataFrame(out, columns=columns)

    return a.groupBy("_bucket").cogroup(b.groupBy("_bucket")).applyInPandas(run, f"pair {kind}, position_a long, position_b long, score double")


def _greedy(m: np.ndarray, n: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Places and scores of the best matches, one after another."""
    score = np.round(m @ n.T - 0.1 * np.abs(np.arange(len(m))[:, None] / len(m) - np.arange(len(n))[None, :] / len(n)), 6)
    out, open_ = [], (np.ones(len(m), bool), np.ones(len(n), bool))
    for at in np.argsort(-score, axis=None, kind="stable"):
        i, j = divmod(int(at), len(n))
        if score[i, j] < least:
            break
        if open_[0][i] and open_[1][j]:
            open_[0][i] = open_[1][j] = False
            out.append((i, j, float(score[i, j])))
    return out


def align_in_rounds(a: DataFrame, b: DataFrame, least: float = DEFAULT.alignment, block: int = 256) -> DataFrame:
    """The matching of align_sections without a task that holds all scores of a pair: scores are made block by block, and only those that reach the limit are kept; in each round those that are the
    best of both their sections are matched and leave with all others of theirs. With the order of score, then places, taken as strict, this is what taking the best of all, one after another, gives."""
    kind = a.schema["pair"].dataType.simpleString()

    def numbered(rows: DataFrame) -> DataFrame:
        by = Window.partitionBy("pair")
        return rows.select("*", (F.row_number().over(by.orderBy("position")) - 1).alias("_i"), F.count(F.lit(1)).over(by).alias("_n"))

    a, b = stored(numbered(a)), stored(numbered(b))
    blocks = lambda rows, name: rows.select("pair", F.ceil(F.col("_n") / block).cast("int").alias(name)).distinct()
    own = lambda: F.floor(F.col("_i") / block).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.join(blocks(b, "_m"), "pair").withColumn("_x", own()).withColumn("_y", every("_m"))
    right = b.join(blocks(a, "_m"), "pair").withColumn("_y", own()).withColumn("_x", every("_m"))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        columns = ["pair", "position_a", "position_b", "score", "i", "j"]
        if not len(x) or not len(y):
            return pd.DataFrame(columns=columns)
        m, n = (V.unit(np.stack(t["embedding"].to_numpy()).astype(np.float64)) for t in (x, y))
        place = [t["_i"].to_numpy() / t["_n"].to_numpy() for t in (x, y)]
        score = np.round(m @ n.T - 0.1 * np.abs(place[0][:, None] - place[1][None, :]), 6)
        i, j = np.nonzero(score >= least)
        return pd.DataFrame({"pair": x["pair"].iloc[0], "position_a": x["position"].to_numpy()[i], "position_b": y["position"].to_numpy()[j], "score": score[i, j], "i": x["_i"].to_numpy()[i], "j": y["_i"].to_numpy()[j]})

    schema = f"pair {kind}, position_a long, position_b long, score double"
    open_ = stored(left.groupBy("pair", "_x", "_y").cogroup(right.groupBy("pair", "_x", "_y")).applyInPandas(meet, f"{schema}, i long, j long"))
    done = None
    while open_.take(1):
        first = lambda c: F.row_number().over(Window.partitionBy("pair", c).orderBy(F.desc("score"), "i", "j")) == 1
        matched = stored(open_.withColumns({"_a": first("i"), "_b": first("j")}).where("_a and _b").drop("_a", "_b"))
        done = matched if done is None else done.unionByName(matched)
        for c in "ij":
            open_ = open_.join(matched.select("pair", c), ["pair", c], "left_anti")
        open_ = stored(open_)
    done = open_ if done is None else done
    return done.select("pair", "position_a", "position_b", "score")


def claims_or_chunks(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """The claims (doc_id, content, kind), and for documents without any their chunks."""
    return claims.unionByName(chunks.join(claims.select("doc_id").distinct(), "doc_id", "left_anti"))
