"""Text queries over documents, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import text as T
from ..operators.observed import Funnel
from .registry import contains_any, dealt, listed, matches, matches_any, query, quoted, table

SPACE = r"[\s\x0b\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def STRIP(x):
    return r"regexp_replace(%s, '^\s+|\s+$', '', 'g')" % x


def COLLAPSE(x):
    return "trim(regexp_replace(" + x + ", '" + SPACE + "', ' ', 'g'))"


def WORDS(x):
    return r"list_filter(string_split_regex(%s, '\s+'), lambda z: z <> '')" % x


def ALPHA(x):
    return rf"(length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')) / greatest(length({x}), 1))"


def SENTENCES(x):
    return r"""sent AS (SELECT doc_id, i AS pos, l[i + 1] AS sentence FROM
    (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM %s WHERE text IS NOT NULL) d, unnest(range(len(l))) t(i))""" % x


def PREP(x):
    bare = STRIP("regexp_replace(" + STRIP("sentence") + ", " + quoted(L.BULLETS) + ", '')")
    return "prep AS (SELECT *, list_transform(" + WORDS("s") + ", lambda q: lower(q)) AS w FROM (SELECT *, " + bare + " AS s FROM " + x + ") x)"


REPETITIVE = "(len(w) >= 4 AND (len(list_filter(range(3, len(w) + 1), lambda i: w[i] = w[i - 1] AND w[i] = w[i - 2])) > 0 OR (len(w) >= 6 AND len(list_distinct(w)) / len(w) < 0.5)))"
REASON = f"""CASE WHEN s = '' THEN 'empty_after_bullet_strip' WHEN {matches('s', L.HEADLESS)} THEN 'headless_predicate'
    WHEN length(s) < 25 THEN 'too_short' WHEN length(s) > 600 THEN 'too_long' WHEN {ALPHA('s')} < 0.55 THEN 'low_alpha_ratio'
    WHEN len(w) < 5 THEN 'too_few_words' WHEN len(w) > 80 THEN 'too_many_words' WHEN {REPETITIVE} THEN 'repetitive_fragment'
    WHEN {matches_any('s', L.DOCUMENT_HEADERS)} THEN 'document_header' WHEN {matches_any('s', L.SENTENCE_NOISE)} THEN 'boilerplate_pattern'
    WHEN regexp_matches(s, '^\\p{{Ll}}') AND NOT regexp_matches(s, '^(i |e\\.g\\.|i\\.e\\.)') THEN 'lowercase_start'
    WHEN {matches('s', L.DANGLING_PRONOUN)} THEN 'dangling_pronoun' WHEN {matches('s', L.DANGLING_NOUN)} THEN 'dangling_generic_reference'
    WHEN {matches_any('s', L.UNRESOLVED)} THEN 'unresolved_reference'
    WHEN len(list_filter(w, lambda z: NOT list_contains({listed(L.STOPWORDS)}, trim(z, '.,;:!?"''()')))) < CASE WHEN {matches('s', L.REGULATORY)} THEN 4 ELSE 8 END
        THEN 'insufficient_content_words'
    WHEN NOT regexp_matches(lower(s), ' ({'|'.join(L.VERBS)}) ') THEN 'no_verb' ELSE '' END"""
NOISE = f"(s = '' OR len(w) < 3 OR {ALPHA('s')} < 0.55 OR {REPETITIVE} OR {matches_any('s', L.DOCUMENT_HEADERS)} OR {matches_any('s', L.SENTENCE_NOISE)})"

def FILTERED(least):
    return f"""fl AS (SELECT doc_id, i AS n, l[i + 1] AS line, {STRIP('l[i + 1]')} AS s FROM
        (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND length({STRIP('text')}) >= {least}) d, unnest(range(len(l))) t(i)),
    fs AS (SELECT *, last_value(CASE WHEN {matches('s', L.REFERENCES_OPEN)} THEN true WHEN {matches('s', L.REFERENCES_CLOSE)} THEN false END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM fl),
    filtered AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT coalesce(st, false) AND NOT {matches_any('s', L.BOILERPLATE_LINES)} AND length(s) >= 5), '') AS text
        FROM fs GROUP BY doc_id)"""


CLAIMS = f"""{FILTERED(20)}, {SENTENCES('filtered')}, sized AS (SELECT doc_id, pos, {STRIP('sentence')} AS sentence FROM sent), {PREP('sized')},
    claims AS (SELECT doc_id, pos, sentence, {COLLAPSE('sentence')} AS content, {REASON} AS reason FROM prep
        WHERE length(sentence) BETWEEN 15 AND 1000 AND {ALPHA('sentence')} >= 0.5)"""
LOW = "lower(sentence)"
WEIGHT = f"CASE WHEN {contains_any(LOW, L.WEAK_KEYWORDS)} THEN 0.5::DOUBLE WHEN {contains_any(LOW, L.STRONG_KEYWORDS)} THEN 1.5 ELSE 1.0 END"


def _signal(words, x="sentence"):
    return f"len(list_intersect(list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')), {listed(words)}))"


def _polarity(x):
    up, down = _signal(L.POSITIVE, x), _signal(L.NEGATIVE, x)
    more = f"(CASE WHEN {contains_any(f'lower({x})', L.NEGATIONS)} THEN -1 ELSE 1 END * ({up} - {down}))"
    return f"CASE WHEN {more} > 0 THEN 'positive' WHEN {more} < 0 THEN 'negative' WHEN {up} > 0 AND {down} > 0 THEN 'mixed' ELSE 'neutral' END"


POLARITY = _polarity("sentence")
CONFIDENCE = f"""CASE WHEN {_signal(L.HEDGES)} > {_signal(L.CERTAIN)} THEN 'hedged' WHEN {_signal(L.CERTAIN)} > 0 THEN 'certain'
    WHEN {contains_any(LOW, L.SPECULATIVE)} THEN 'speculative' ELSE 'certain' END"""


def docs_of(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents"), "doc_id")


def sentences_of(spark, sf_dir):
    return T.sentences(docs_of(spark, sf_dir))


CLEAN = "translate(regexp_replace(regexp_replace(text, '" + SPACE + r"', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '“”‘’–—', '""''''--')"


@query("clean_text", f"SELECT doc_id, length(c) AS n_chars, sha256(c) AS digest FROM (SELECT doc_id, CASE WHEN regexp_full_match(trim({CLEAN}), '\\d+') THEN '' ELSE trim({CLEAN}) END AS c FROM documents)")
def clean_text(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.clean(F.col("text")).alias("c")).select("doc_id", F.length("c").cast("long").alias("n_chars"), F.sha2("c", 256).alias("digest"))


@query("normalize_ws", f"SELECT doc_id, sha256({COLLAPSE('text')}) AS digest FROM documents")
def normalize_ws(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", F.sha2(X.collapse(F.col("text")), 256).alias("digest"))


@query(
    "chunk_windows",
    f"""WITH d AS (SELECT doc_id, {WORDS('text')} AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, i // 462 AS chunk_index, sha256(array_to_string(w[i + 1:i + 512], ' ')) AS digest, len(w[i + 1:i + 512]) AS token_count FROM d, unnest(range(0, len(w), 462)) t(i)""",
)
def chunk_windows(spark, sf_dir):
    return T.chunk_windows(docs_of(spark, sf_dir)).select("doc_id", "chunk_index", F.sha2("content", 256).alias("digest"), "token_count")


@query(
    "chunk_pages",
    f"""WITH d AS (SELECT doc_id, {WORDS('text')} AS w, length(text) AS n FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, n, i // 462 AS chunk_index, CASE WHEN i = 0 THEN 0 ELSE length(array_to_string(w[1:i], ' ')) END AS a, length(array_to_string(w[i + 1:i + 512], ' ')) AS k FROM d, unnest(range(0, len(w), 462)) t(i))
    SELECT doc_id, chunk_index, CAST(least(a // 3000, n // 3000) + 1 AS INTEGER) AS start_page, CAST(least((a + k) // 3000, n // 3000) + 1 AS INTEGER) AS end_page FROM c""",
)
def chunk_pages(spark, sf_dir):
    """Windows with their pages, where every page has 3000 characters."""
    page = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / 3000).cast("int")), lambda i: F.struct((i + 1).alias("key"), (i * 3000).alias("value"))))
    return T.chunk_pages(docs_of(spark, sf_dir).where("text is not null").withColumn("page_map", page)).select("doc_id", "chunk_index", "start_page", "end_page")


@query("embedding_version", "SELECT lang AS model, 64 AS dimension, left(sha256(lang || ':64'), 12) AS version, count(*) AS n_docs FROM documents GROUP BY lang")
def embedding_version(spark, sf_dir):
    models = docs_of(spark, sf_dir).groupBy(F.col("lang").alias("model")).agg(F.count(F.lit(1)).alias("n_docs"))
    return models.select("model", F.lit(64).alias("dimension"), X.embedding_version(F.col("model"), F.lit("64")).alias("version"), "n_docs")


@query("sentences", f"WITH {SENTENCES('documents')} SELECT * FROM sent")
def sentences(spark, sf_dir):
    return sentences_of(spark, sf_dir)


@query("structural_filter", f"WITH {FILTERED(0)} SELECT doc_id, sha256(text) AS digest, length(text) AS n_chars FROM filtered")
def structural_filter(spark, sf_dir):
    return T.structural_filter(docs_of(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query("claim_worthiness", f"WITH {SENTENCES('documents')}, {PREP('sent')} SELECT doc_id, pos, {REASON} AS reason FROM prep")
def claim_worthiness(spark, sf_dir):
    return T.claim_worthiness(sentences_of(spark, sf_dir)).drop("sentence")


@query("structural_noise", f"WITH {SENTENCES('documents')}, {PREP('sent')} SELECT doc_id, pos, {NOISE} AS is_noise FROM prep")
def structural_noise(spark, sf_dir):
    return T.structural_noise(sentences_of(spark, sf_dir)).drop("sentence")


@query("repetitive_fragment", f"WITH {SENTENCES('documents')}, {PREP('sent')} SELECT doc_id, count(*) AS n, count(*) FILTER ({REPETITIVE}) AS repetitive FROM prep GROUP BY doc_id")
def repetitive_fragment(spark, sf_dir):
    rows = T.prepared(sentences_of(spark, sf_dir)).select("doc_id", X.is_repetitive(F.col("_w")).alias("r"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("r").alias("repetitive"))


@query("extract_claims", f"WITH {CLAIMS} SELECT doc_id, pos, content, {WEIGHT} AS importance_weight, sha256(content || '|rule_based') AS content_hash FROM claims WHERE reason = ''")
def extract_claims(spark, sf_dir):
    return T.extract_claims(docs_of(spark, sf_dir))


@query("filter_claims", f"WITH {CLAIMS} SELECT doc_id, count(*) AS n_claims, sum({WEIGHT}) AS weight FROM claims WHERE reason = '' AND {WEIGHT} >= 0.3 GROUP BY doc_id")
def filter_claims(spark, sf_dir):
    return T.extract_claims(docs_of(spark, sf_dir)).where("importance_weight >= 0.3").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_claims"), F.sum("importance_weight").alias("weight"))


@query("aligned_claims", f"WITH {CLAIMS}, n AS (SELECT doc_id, count(*) AS aligned_claims FROM claims WHERE reason = '' GROUP BY 1) SELECT d.doc_id, coalesce(n.aligned_claims, 0) AS aligned_claims FROM documents d LEFT JOIN n USING (doc_id)")
def aligned_claims(spark, sf_dir):
    n = T.extract_claims(docs_of(spark, sf_dir)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("aligned_claims"))
    return docs_of(spark, sf_dir).select("doc_id").join(n, "doc_id", "left").na.fill(0)


@query(
    "observed_funnel",
    f"""WITH {CLAIMS}, s AS (SELECT count(*) AS a, count(*) FILTER (reason = '') AS b, count(*) FILTER (reason = '' AND {WEIGHT} >= 0.3) AS c FROM claims)
    SELECT 'sentences' AS step, a AS n, NULL::DOUBLE AS reduction FROM s UNION ALL SELECT 'worthy', b, round(1 - b / greatest(a, 1), 4) FROM s UNION ALL SELECT 'weighty', c, round(1 - c / greatest(b, 1), 4) FROM s""",
)
def observed_funnel(spark, sf_dir):
    """What passes each step, counted while the claims are made."""
    funnel = Funnel()
    filtered = T.structural_filter(docs_of(spark, sf_dir).where(F.length(X.strip(F.col("text"))) >= 20))
    found = T.sentences(filtered).withColumn("sentence", X.strip(F.col("sentence")))
    judged = T.claim_worthiness(found.where(F.length("sentence").between(15, 1000) & (X.letters_share(F.col("sentence")) >= 0.5)))
    worthy = funnel.step(funnel.step(judged, "sentences").where("reason = ''"), "worthy").withColumn("weight", X.claim_weight(F.col("sentence")))
    funnel.step(worthy.where("weight >= 0.3"), "weighty").write.format("noop").mode("overwrite").save()
    smaller = funnel.reductions()
    return spark.createDataFrame([(k, x["rows"], smaller.get(k)) for k, x in funnel.figures().items()], "step string, n long, reduction double")


@query(
    "claim_funnel",
    f"""WITH {CLAIMS}, s AS (SELECT count(*) AS sentences, count(*) FILTER (reason = '') AS worthy, count(DISTINCT content) FILTER (reason = '') AS unique_claims FROM claims)
    SELECT *, round(1 - worthy / greatest(sentences, 1), 2) AS extraction_reduction, round(1 - unique_claims / greatest(worthy, 1), 2) AS dedup_reduction FROM s""",
)
def claim_funnel(spark, sf_dir):
    filtered = T.structural_filter(docs_of(spark, sf_dir).where(F.length(X.strip(F.col("text"))) >= 20))
    found = T.sentences(filtered).withColumn("sentence", X.strip(F.col("sentence")))
    rows = T.claim_worthiness(found.where(F.length("sentence").between(15, 1000) & (X.letters_share(F.col("sentence")) >= 0.5)))
    good = F.col("reason") == ""
    out = rows.agg(F.count(F.lit(1)).alias("sentences"), F.count_if(good).alias("worthy"), F.countDistinct(F.when(good, X.collapse(F.col("sentence")))).alias("unique_claims"))
    ratio = lambda a, b: F.round(1 - F.col(a) / F.greatest(F.col(b), F.lit(1)), 2)
    return out.withColumn("extraction_reduction", ratio("worthy", "sentences")).withColumn("dedup_reduction", ratio("unique_claims", "worthy"))


@query(
    "rejection_histogram",
    f"""WITH {SENTENCES('documents')}, {PREP('sent')}, r AS (SELECT doc_id, {REASON} AS reason FROM prep), c AS (SELECT doc_id, reason, count(*) AS n FROM r WHERE reason <> '' GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, reason) AS rank FROM c) WHERE rank <= 5""",
)
def rejection_histogram(spark, sf_dir):
    return T.rejection_histogram(sentences_of(spark, sf_dir))


@query("claim_hash", f"SELECT doc_id, sha256({STRIP('text')} || '|rule_based') AS content_hash FROM documents")
def claim_hash(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", X.claim_hash(F.col("text"), "rule_based").alias("content_hash"))


@query("polarity", f"WITH {SENTENCES('documents')} SELECT doc_id, pos, {POLARITY} AS polarity FROM sent")
def polarity(spark, sf_dir):
    return sentences_of(spark, sf_dir).select("doc_id", "pos", X.polarity(F.col("sentence")).alias("polarity"))


@query("confidence_level", f"WITH {SENTENCES('documents')} SELECT doc_id, pos, {CONFIDENCE} AS confidence_level FROM sent")
def confidence_level(spark, sf_dir):
    return sentences_of(spark, sf_dir).select("doc_id", "pos", X.confidence_level(F.col("sentence")).alias("confidence_level"))


_FIRST = f"CASE WHEN given = 'positive' AND {contains_any('lower(text)', L.STRONG_NEGATIVE)} THEN 'negative' ELSE given END"
_STORY = "concat_ws(' ', p_type, CASE p_partkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'improved' WHEN 2 THEN 'failed and improved' ELSE 'was stable' END, p_name)"
_GIVEN = "CASE p_partkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END"


@query("polarity_validated", f"SELECT p_partkey, CASE WHEN {_FIRST} = 'negative' AND {contains_any('lower(text)', L.STRONG_POSITIVE)} THEN 'positive' ELSE {_FIRST} END AS polarity FROM (SELECT p_partkey, {_STORY} AS text, {_GIVEN} AS given FROM part)")
def polarity_validated(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_STORY} AS text", f"{_GIVEN} AS given")
    return rows.select("p_partkey", X.validated_polarity(F.col("given"), F.col("text")).alias("polarity"))


_MODALITY = "CASE {0} % 6 WHEN 0 THEN 'MANDATORY' WHEN 1 THEN 'prohibited' WHEN 2 THEN 'RECOMMENDED' WHEN 3 THEN 'OPTIONAL' WHEN 4 THEN 'INFORMATIONAL' END"


@query("modality_weight", f"SELECT p_partkey, CASE upper({_MODALITY.format('p_size')}) WHEN 'MANDATORY' THEN 1.5::DOUBLE WHEN 'PROHIBITED' THEN 1.5 WHEN 'RECOMMENDED' THEN 1.2 WHEN 'OPTIONAL' THEN 0.8 ELSE 1.0 END AS weight FROM part")
def modality_weight(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_MODALITY.format('p_size')} AS m").select("p_partkey", X.modality_weight(F.col("m")).alias("weight"))


@query(
    "modality_gate",
    f"""WITH m AS (SELECT p_partkey, {_MODALITY.format('p_size')} AS a, {_MODALITY.format('p_partkey')} AS b FROM part)
    SELECT p_partkey, a IS NULL OR b IS NULL OR list_contains({listed('|'.join(sorted(p)) for p in L.COMPARABLE)}, least(upper(a), upper(b)) || '|' || greatest(upper(a), upper(b))) AS comparable FROM m""",
)
def modality_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_MODALITY.format('p_size')} AS a", f"{_MODALITY.format('p_partkey')} AS b")
    return rows.select("p_partkey", X.modalities_comparable(F.col("a"), F.col("b")).alias("comparable"))


_NEXT = "SELECT doc_id, pos, sentence, lead(sentence) OVER (PARTITION BY doc_id ORDER BY pos) AS other FROM {}"
_TERMS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda z: length(z) > 2 AND NOT list_contains(" + listed(L.STOPWORDS) + ", z))"


def _neighbours(spark, sf_dir):
    from pyspark.sql import Window

    return sentences_of(spark, sf_dir).withColumn("other", F.lead("sentence").over(Window.partitionBy("doc_id").orderBy("pos"))).where("other is not null")


@query("shared_terms", f"WITH {SENTENCES('documents')}, n AS ({_NEXT.format('sent')}) SELECT doc_id, pos, len(list_intersect({_TERMS.format('sentence')}, {_TERMS.format('other')})) AS shared FROM n WHERE other IS NOT NULL")
def shared_terms(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("doc_id", "pos", X.shared_terms(F.col("sentence"), F.col("other")).alias("shared"))


@query(
    "specificity_ratio",
    f"""WITH {SENTENCES('documents')}, n AS ({_NEXT.format('sent')}), c AS (SELECT doc_id, pos, len({WORDS('sentence')}) AS a, len({WORDS('other')}) AS b FROM n WHERE other IS NOT NULL)
    SELECT doc_id, pos, round(greatest(a, b, 1) / greatest(least(a, b), 1), 4) AS ratio FROM c""",
)
def specificity_ratio(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("doc_id", "pos", F.round(X.specificity_ratio(F.col("sentence"), F.col("other")), 4).alias("ratio"))


@query("cache_keys", "SELECT doc_id, left(sha256(text || ':v1'), 16) AS parse_key, left(sha256(left(text, 10000) || ':512:50'), 16) AS chunk_key FROM documents")
def cache_keys(spark, sf_dir):
    key = lambda x, version: F.left(F.sha2(F.concat(x, F.lit(version)), 256), F.lit(16))
    return docs_of(spark, sf_dir).select("doc_id", key(F.col("text"), ":v1").alias("parse_key"), key(F.left("text", F.lit(10000)), ":512:50").alias("chunk_key"))


@query(
    "claim_cache_hits",
    f"WITH {CLAIMS}, c AS (SELECT doc_id, pos, sha256(content || '|rule_based') AS h FROM claims WHERE reason = ''), k AS (SELECT DISTINCT h FROM c WHERE doc_id % 2 = 0) SELECT doc_id, pos, h AS content_hash FROM c WHERE h IN (SELECT h FROM k) AND doc_id % 2 = 1",
)
def claim_cache_hits(spark, sf_dir):
    claims = T.extract_claims(docs_of(spark, sf_dir)).select("doc_id", "pos", "content_hash")
    return claims.where("doc_id % 2 = 1").join(claims.where("doc_id % 2 = 0").select("content_hash"), "content_hash", "left_semi").select("doc_id", "pos", "content_hash")


@query("highlight", "SELECT item_id, regexp_replace(text, '(?i)(thing|the)', '<mark>\\1</mark>', 'g') AS marked FROM benchmark")
def highlight(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.highlight(F.col("text"), "the thing").alias("marked"))


_HEAD = f"(x <> '' AND ({matches('x', L.HEADING)} OR (upper(x) = x AND regexp_matches(x, '\\p{{Lu}}') AND len({WORDS('x')}) BETWEEN 3 AND 8)))"


@query(
    "structure_confidence",
    f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, len(l) AS n, len(list_filter(list_transform(l, lambda y: {STRIP('y')}), lambda x: {_HEAD})) AS h, len(regexp_extract_all(text, '(?m)^\\s*\\d+\\.\\d*')) AS k, len({WORDS('text')}) AS w FROM d)
    SELECT doc_id, CASE WHEN n < 5 THEN 0 ELSE round((least(1, h / greatest(n / 30, 1)) * 0.4::DOUBLE + least(1, k / 3) * 0.35::DOUBLE + least(1, w / 500) * 0.25::DOUBLE)::DECIMAL(18, 9), 2)::DOUBLE END AS structure_confidence FROM c""",
)
def structure_confidence(spark, sf_dir):
    return T.structure_confidence(docs_of(spark, sf_dir))


@query(
    "scan_route",
    f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, len(l) AS n, len(list_filter(list_transform(l, lambda y: {STRIP('y')}), lambda x: {_HEAD})) AS h, len(regexp_extract_all(text, '(?m)^\\s*\\d+\\.\\d*')) AS k, len({WORDS('text')}) AS w FROM d),
    s AS (SELECT doc_id, CASE WHEN n < 5 THEN 0 ELSE round((least(1, h / greatest(n / 30, 1)) * 0.4::DOUBLE + least(1, k / 3) * 0.35::DOUBLE + least(1, w / 500) * 0.25::DOUBLE)::DECIMAL(18, 9), 2)::DOUBLE END AS v FROM c)
    SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, CASE WHEN least(a.v, b.v) >= 0.65 THEN 'structured' ELSE 'embedding' END AS route FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""",
)
def scan_route(spark, sf_dir):
    from ..operators import pairs

    confidence = T.structure_confidence(docs_of(spark, sf_dir))
    a = confidence.select(F.col("doc_id").alias("doc_a"), F.col("structure_confidence").alias("confidence_a"))
    b = confidence.select((F.col("doc_id") - 1).alias("doc_a"), F.col("doc_id").alias("doc_b"), F.col("structure_confidence").alias("confidence_b"))
    return pairs.scan_route(a.join(b, "doc_a")).select("doc_a", "doc_b", "route")


_PROP = f"""p AS (SELECT doc_id, pos, sentence, w, coalesce(list_position(list_transform(w, lambda z, i: i > 1 AND list_contains({listed(L.VERB_MARKERS)}, regexp_replace(lower(z), '[.,;:!?]+$', ''))), true), 0) - 1 AS v,
    coalesce(list_position(list_transform(w[1:6], lambda z: NOT (regexp_matches(z, '^\\p{{Lu}}') OR lower(z) IN ('the', 'a', 'an'))), true), 0) AS st
    FROM (SELECT doc_id, pos, {STRIP('sentence')} AS sentence, {WORDS(STRIP('sentence'))} AS w FROM sent) q WHERE length(sentence) >= 30 AND len(w) >= 5),
props AS (SELECT doc_id, pos, sentence, regexp_replace(CASE WHEN v < 1 AND lead = 0 THEN w[1] ELSE array_to_string(w[1:cut], ' ') END, '^(The|A|An)\\s+', '') AS entity,
    left(array_to_string(w[cut + 1:], ' '), 100) AS attribute FROM (SELECT *, CASE WHEN v >= 1 THEN v ELSE lead END AS cut FROM (SELECT *, CASE WHEN st = 0 THEN least(len(w), 6) ELSE st - 1 END AS lead FROM p) x) y)"""


@query("propositions", f"WITH {SENTENCES('documents')}, {_PROP} SELECT doc_id, pos, entity, attribute, {POLARITY} AS polarity, {CONFIDENCE} AS confidence_level FROM props")
def propositions(spark, sf_dir):
    return T.propositions(sentences_of(spark, sf_dir)).drop("sentence", "modality")


@query("processing_status", "SELECT CASE WHEN text IS NULL OR length(text) < 20 THEN 'FAILED' WHEN length(text) < 200 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, count(*) AS n FROM documents GROUP BY 1")
def processing_status(spark, sf_dir):
    n = F.length("text")
    status = F.when(F.col("text").isNull() | (n < 20), "FAILED").when(n < 200, "PARTIAL").otherwise("COMPLETE")
    return docs_of(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "exact_dedup",
    "SELECT doc_id, source AS org_id, sha256(text) AS content_hash, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) = 1 AS accepted FROM documents",
)
def exact_dedup(spark, sf_dir):
    from pyspark.sql import Window

    rows = docs_of(spark, sf_dir).select("doc_id", F.col("source").alias("org_id"), F.sha2("text", 256).alias("content_hash"))
    return rows.withColumn("accepted", F.row_number().over(Window.partitionBy("org_id", "content_hash").orderBy("doc_id")) == 1)


_PARA = f"""f AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda y: {STRIP('y')}), lambda y: len({WORDS('y')}) >= 5) AS p FROM documents
    WHERE text <> '' AND len({WORDS('text')}) > 200)"""


@query(
    "sections",
    f"""WITH lines AS (SELECT doc_id, i AS n, l[i + 1] AS line, {STRIP('l[i + 1]')} AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '') d, unnest(range(len(l))) t(i)),
    h AS (SELECT *, coalesce({_HEAD}, false) AS hd FROM lines), r AS (SELECT *, sum((NOT hd)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM h),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run, hd ORDER BY n) AS k FROM r), o AS (SELECT *, hd AND (k % 2) = (CASE WHEN run = 0 THEN 0 ELSE 1 END) AS op FROM k),
    s AS (SELECT *, sum(op::INT) OVER (PARTITION BY doc_id ORDER BY n) AS sec FROM o),
    g AS (SELECT doc_id, sec, coalesce(max(x) FILTER (op), 'Introduction') AS heading, {STRIP("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT op), '')")} AS content FROM s GROUP BY 1, 2),
    m AS (SELECT *, len({WORDS('content')}) AS word_count FROM g), made AS (SELECT * FROM m WHERE word_count >= 10),
    {_PARA}, few AS (SELECT * FROM f WHERE (SELECT count(*) FROM made WHERE made.doc_id = f.doc_id) <= 1),
    fb AS (SELECT doc_id, i AS sec, CASE WHEN len(p) = 0 THEN 'Full Document' ELSE left(string_split(p[i + 1], '.')[1], 60) END AS heading,
        CASE WHEN len(p) = 0 THEN text ELSE array_to_string(p[i + 1:i + greatest(1, len(p) // 6)], chr(10) || chr(10)) END AS content FROM few, unnest(CASE WHEN len(p) = 0 THEN [0] ELSE range(0, len(p), greatest(1, len(p) // 6)) END) t(i)),
    u AS (SELECT doc_id, sec, heading, content, word_count FROM made WHERE doc_id NOT IN (SELECT doc_id FROM few) UNION ALL SELECT doc_id, sec, heading, content, len({WORDS('content')}) FROM fb)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS position, heading, word_count, sha256(content) AS digest FROM u""",
)
def sections(spark, sf_dir):
    return T.sections(docs_of(spark, sf_dir)).select("doc_id", "position", "heading", "word_count", F.sha2("content", 256).alias("digest"))


@query(
    "section_summary",
    f"""WITH p AS (SELECT item_id, text, list_filter(list_transform(string_split(text, '.'), lambda y: {STRIP('y')}), lambda y: len({WORDS('y')}) >= 3) AS l FROM benchmark)
    SELECT item_id, CASE WHEN len(l) = 0 THEN left(text, 200) WHEN len(l) = 1 THEN l[1] ELSE l[1] || '. ' || l[-1] || '.' END AS summary FROM p""",
)
def section_summary(spark, sf_dir):
    return T.section_summary(table(spark, sf_dir, "benchmark").withColumnRenamed("text", "content")).select("item_id", "summary")


@query(
    "table_claims",
    """WITH c AS (SELECT r_regionkey AS table_id, r_name AS subject, n_name, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey),
    x AS (SELECT table_id, 'Nations' AS cap, n_name AS subject, 'key' AS predicate, n_nationkey::VARCHAR || ' of 25' AS value, n_nationkey AS i, 1 AS j FROM c
        UNION ALL SELECT table_id, 'Nations', n_name, 'region', subject, n_nationkey, 2 FROM c)
    SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY i, j) AS ord, 'In Nations, for ' || subject || ', the ' || predicate || ' is ' || value || '.' AS sentence, subject, predicate, value FROM x""",
)
def table_claims(spark, sf_dir):
    cells = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.struct("n_nationkey", F.array("n_name", F.concat(F.col("n_nationkey").cast("string"), F.lit(" of 25")), "r_name").alias("row"))
    grids = cells.groupBy(F.col("r_regionkey").alias("table_id")).agg(F.array_sort(F.collect_list(row)).alias("_r"))
    body = F.concat(F.array(X.literals(["name", " key ", "region"])), F.transform("_r", lambda r: r["row"]))
    return T.table_claims(grids.select("table_id", F.lit("Nations").alias("caption"), body.alias("cells")))


_REPLY = """CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Here: ```json ' ELSE 'Result ' END || '[{"claim": "Order ' || o_orderkey || ' costs money", "modality": "' || CASE WHEN o_orderkey % 2 = 0 THEN 'mandatory' ELSE 'odd' END
    || '", "confidence": ' || CASE WHEN o_orderkey % 5 = 0 THEN '7.5' ELSE '0.5' END || '}, {"claim": "short", "modality": "x", "confidence": 0.1}]' || CASE o_orderkey % 3 WHEN 1 THEN ' ```' WHEN 2 THEN ' end' ELSE '' END"""


@query(
    "json_claim_recovery",
    """SELECT o_orderkey AS reply_id, 0 AS pos, 'Order ' || o_orderkey || ' costs money' AS claim, CASE WHEN o_orderkey % 2 = 0 THEN 'MANDATORY' ELSE 'INFORMATIONAL' END AS modality,
    CASE WHEN o_orderkey % 5 = 0 THEN 0.8::DOUBLE ELSE 0.5 END AS confidence FROM orders""",
)
def json_claim_recovery(spark, sf_dir):
    return T.recover_json_claims(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS reply_id", f"{_REPLY} AS reply"))


_PROPOSED = """CASE o_orderkey % 2 WHEN 0 THEN '' ELSE '```json ' END || '[{"entity": " Order ' || o_orderkey || '", "attribute": "' || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'cost' END || '", "polarity": "' || CASE o_orderkey % 4 WHEN 0 THEN 'Positive' WHEN 1 THEN 'odd' ELSE 'neutral' END
    || '", "modality": "Predicted", "source_sentence": "Costs ' || CASE o_orderkey % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'improved' ELSE 'stayed' END || '"}]' || CASE o_orderkey % 2 WHEN 0 THEN '' ELSE ' ```' END"""
_GIVEN_POLARITY = "CASE o_orderkey % 4 WHEN 0 THEN 'positive' WHEN 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' ELSE 'neutral' END ELSE 'neutral' END"


@query(
    "json_proposition_recovery",
    f"""SELECT o_orderkey AS reply_id, 0 AS pos, 'Order ' || o_orderkey AS entity, 'cost' AS attribute, CASE WHEN g = 'positive' AND o_orderkey % 3 = 0 THEN 'negative' WHEN g = 'negative' AND o_orderkey % 3 = 1 THEN 'positive' ELSE g END AS polarity,
    'certain' AS confidence_level, 'predicted' AS modality FROM (SELECT o_orderkey, {_GIVEN_POLARITY} AS g FROM orders WHERE o_orderkey % 11 <> 0)""",
)
def json_proposition_recovery(spark, sf_dir):
    return T.recover_json_propositions(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS reply_id", f"{_PROPOSED} AS reply")).drop("sentence")


@query(
    "table_chunks",
    """SELECT 'prose' AS kind, doc_id AS table_id, count(*) AS n, 0::DOUBLE AS weight FROM (SELECT doc_id, unnest(range(0, len(list_filter(string_split_regex(text, '\\s+'), lambda z: z <> '')), 462)) AS i FROM documents) GROUP BY doc_id
    UNION ALL SELECT 'table', r_regionkey, 2 * count(*), 1.2 FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
)
def table_chunks(spark, sf_dir):
    prose = T.chunk_windows(docs_of(spark, sf_dir)).groupBy(F.col("doc_id").alias("table_id")).agg(F.count(F.lit(1)).alias("n"))
    facts = table_claims(spark, sf_dir).groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    kinds = lambda rows, kind, weight: rows.select(F.lit(kind).alias("kind"), "table_id", "n", F.lit(weight).alias("weight"))
    return kinds(prose, "prose", 0.0).union(kinds(facts, "table", 1.2))
