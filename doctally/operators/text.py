"""Text dataflow: documents to chunks, sentences, claims, propositions, sections and table facts.

Documents are frames (doc_id, text, ...). What reads whole texts is a narrow transformation, so that no text is shuffled; only counts, claims and table cells are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import arrays as A
from ..functions import lexicon as L
from ..functions import text as X


def chunk_windows(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """doc_id, chunk_index, content, token_count: overlapping windows of words."""
    size, stride = config.chunk_words, config.chunk_words - config.chunk_overlap
    worded = docs.select("doc_id", X.words(F.col("text")).alias("_w"))
    starts = A.unpacked(worded, ["doc_id", "_w"], F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(stride))), "chunk_index", "_at")
    part = F.slice("_w", F.col("_at") + 1, size)
    return starts.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join(part, " ").alias("content"), F.size(part).cast("long").alias("token_count"))


def chunk_pages(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Chunks as of chunk_windows with start_page and end_page; docs hold page_map: page to its first character. Null without pages.

    A window's place is that of its words joined by blanks; its pages are found by binary search among the pages' first characters.
    """
    size, stride = config.chunk_words, config.chunk_words - config.chunk_overlap
    worded = docs.select("doc_id", X.words(F.col("text")).alias("_w"), F.array_sort(F.map_entries("page_map")).alias("_m"))
    worded = worded.withColumn("_starts", F.when(F.size("_w") > 0, F.sequence(F.lit(0), F.size("_w") - 1, F.lit(stride))))
    letters = lambda at: F.aggregate(F.slice("_w", at + 1, stride), F.lit(0), lambda n, w: n + F.length(w))
    worded = worded.withColumn("_letters", A.running(F.transform("_starts", letters), lambda a, b: a + b, 0))
    rows = A.unpacked(worded, ["doc_id", "_w", "_m", "_letters"], F.col("_starts"), "_i", "_at")
    part = F.slice("_w", F.col("_at") + 1, size)
    first = F.when(F.col("_i") > 0, F.col("_letters")[F.col("_i") - 1] + F.col("_at") - 1).otherwise(0)
    rows = rows.select("doc_id", F.col("_i").cast("long").alias("chunk_index"), F.array_join(part, " ").alias("content"), F.size(part).cast("long").alias("token_count"), first.alias("_first"), "_m")
    page = lambda c: F.get(F.transform("_m", lambda e: e["key"]), A.at_most(F.transform("_m", lambda e: e["value"]), c) - 1)
    both = {"start_page": page(F.col("_first")), "end_page": page(F.col("_first") + F.length("content"))}
    return rows.withColumns(both).drop("_first", "_m")


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, sentence."""
    split = A.unpacked(docs, ["doc_id"], F.split("text", X.SENTENCE_END), "pos", "sentence")
    return split.withColumn("pos", F.col("pos").cast("long"))


def prepared(sentence: DataFrame) -> DataFrame:
    """sentence and _s (without bullets), _w (its lower-cased words)."""
    return sentence.withColumn("_s", X.without_bullets(F.col("sentence"))).withColumn("_w", X.words(F.lower("_s")))


def claim_worthiness(sentence: DataFrame) -> DataFrame:
    """sentence and reason (empty: worthy)."""
    reason = X.worthiness(F.col("_s"), F.col("_w"))
    # a one-element array: conditions on the reason must not be rewritten into the cascade, which would then repeat its parts again and again
    return prepared(sentence).select(*sentence.columns, F.explode(F.array(reason)).alias("reason"))


def structural_noise(sentence: DataFrame) -> DataFrame:
    return prepared(sentence).withColumn("is_noise", X.is_structural_noise(F.col("_s"), F.col("_w"))).drop("_s", "_w")


def structural_filter(docs: DataFrame) -> DataFrame:
    """doc_id, text without boilerplate lines and lists of references (which end at the next appendix-like line). A row's text never leaves it."""

    def parts(line: Column) -> Column:
        s = X.strip(line)
        mark = F.when(s.rlike(L.REFERENCES_OPEN), 1).when(s.rlike(L.REFERENCES_CLOSE), 0).otherwise(-1)
        good = (F.length(s) >= 5) & ~X.any_of(s, L.BOILERPLATE_LINES)
        return F.struct(line.alias("line"), mark.alias("mark"), good.alias("good"))

    def kept(lines: Column) -> Column:
        # without any list of references, which most texts haven't, there is nothing to carry from line to line
        inside = F.when(
            F.exists(lines, lambda x: x["mark"] == 1),
            A.running(F.transform(lines, lambda x: x["mark"]), lambda state, mark: F.when(mark < 0, state).otherwise(mark), -1),
        ).otherwise(F.transform(lines, lambda x: F.lit(-1)))
        both = F.zip_with(lines, inside, lambda x, i: F.when(x["good"] & (i < 1), x["line"]))
        return F.array_join(both, "\n")  # nulls are left out

    return docs.where("text is not null").select("doc_id", F.coalesce(A.let(F.transform(F.split("text", "\n"), parts), kept), F.lit("")).alias("text"))


def extract_claims(docs: DataFrame, model: str = "rule_based") -> DataFrame:
    """doc_id, pos, content, importance_weight, content_hash: worthy sentences of structurally filtered texts."""
    filtered = structural_filter(docs.where(F.length(X.strip(F.col("text"))) >= 20))
    found = sentences(filtered).withColumn("sentence", X.strip(F.col("sentence")))
    sized = found.where(F.length("sentence").between(15, 1000) & (X.letters_share(F.col("sentence")) >= 0.5))
    worthy = claim_worthiness(sized).where("reason = ''")
    content = X.collapse(F.col("sentence"))
    return worthy.select("doc_id", "pos", content.alias("content"), X.claim_weight(F.col("sentence")).alias("importance_weight"), X.claim_hash(content, model).alias("content_hash"))


def rejection_histogram(sentence: DataFrame, top: int = 5) -> DataFrame:
    """doc_id, reason, n, rank: the most frequent reasons of each document."""
    counted = claim_worthiness(sentence).where("reason != ''").groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "reason"))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def propositions(sentence: DataFrame) -> DataFrame:
    """Sentences of 30 characters and five words as entity, attribute, polarity, confidence_level, modality."""
    text = sentence.withColumn("sentence", X.strip(F.col("sentence"))).withColumn("_w", X.words(F.col("sentence"))).where((F.length("sentence") >= 30) & (F.size("_w") >= 5))
    marks = F.transform("_w", lambda w, i: (i >= 1) & F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(*L.VERB_MARKERS))
    text = text.withColumn("_verb", F.array_position(marks, True).cast("int") - 1)
    leads = F.transform(F.slice("_w", 1, 6), lambda w: ~(w.rlike(r"^\p{Lu}") | F.lower(w).isin("the", "a", "an")))
    stop = F.array_position(leads, True).cast("int")
    text = text.withColumn("_lead", F.when(stop == 0, F.least(F.size("_w"), F.lit(6))).otherwise(stop - 1))
    cut = F.when(F.col("_verb") >= 1, F.col("_verb")).otherwise(F.col("_lead"))
    entity = F.when((F.col("_verb") < 1) & (F.col("_lead") == 0), F.col("_w")[0]).otherwise(F.array_join(F.slice("_w", 1, cut), " "))
    attribute = F.left(F.array_join(F.slice("_w", cut + 1, F.size("_w")), " "), F.lit(100))
    text = text.withColumn("_t", X.tokens(F.col("sentence")))
    return text.select(
        *[c for c in sentence.columns],
        F.regexp_replace(entity, r"^(The|A|An)\s+", "").alias("entity"),
        attribute.alias("attribute"),
        X.polarity(F.col("sentence"), F.col("_t")).alias("polarity"),
        X.confidence_level(F.col("sentence"), F.col("_t")).alias("confidence_level"),
        F.lit("factual").alias("modality"),
    )


def structure_confidence(docs: DataFrame) -> DataFrame:
    """doc_id, structure_confidence: how regularly a text is divided by headings, from 0 to 1."""
    lines = F.split("text", "\n")
    counted = docs.where("text is not null").select("doc_id", "text", lines.alias("_lines"))
    headings = F.size(F.filter(F.transform("_lines", lambda x: X.strip(x)), X.is_heading))
    numbered = F.regexp_count("text", F.lit(r"(?m)^\s*\d+\.\d*"))
    n = F.size("_lines")
    density = F.least(F.lit(1.0), headings / F.greatest(n / 30, F.lit(1.0)))
    value = density * 0.4 + F.least(F.lit(1.0), numbered / 3) * 0.35 + F.least(F.lit(1.0), F.size(X.words(F.col("text"))) / 500) * 0.25
    return counted.select("doc_id", F.when(n < 5, 0.0).otherwise(F.round(value, 2)).alias("structure_confidence"))


def sections(docs: DataFrame, target: int = 6) -> DataFrame:
    """doc_id, position, heading, content, word_count.

    A heading opens a new section if the open one has any line, else it is content; sections of fewer than ten words fall away. A text of more than 200
    words with at most one section is cut into groups of paragraphs. All of it is done within the text's row.
    """

    def opening(h: Column) -> Column:
        """Places of the headings that open a section: in a run of headings every other, from the first behind a line of text and from the second at the text's start."""
        last = A.running(F.transform(h, lambda x, i: F.when(x, -1).otherwise(i)), lambda a, b: F.greatest(a, b), -1)
        marked = F.zip_with(h, F.transform(last, lambda at, i: F.struct(at.alias("at"), i.alias("i"))), lambda x, y: F.when(x & ((y["i"] - y["at"]) % 2 == F.when(y["at"] < 0, 0).otherwise(1)), y["i"]))
        return F.filter(marked, lambda i: i.isNotNull())

    def section(heading: Column, content: Column) -> Column:
        return F.struct(heading.alias("heading"), content.alias("content"), F.size(X.words(content)).cast("long").alias("word_count"))

    def cut(lines: Column, opens: Column) -> Column:
        ends = F.concat(opens, F.array(F.size(lines)))
        between = lambda a, b: X.strip(F.array_join(F.slice(lines, a + 1, b - a), "\n"))
        first = F.array(section(F.lit("Introduction"), between(F.lit(0), ends[0])))
        return F.concat(first, F.transform(opens, lambda at, k: section(X.strip(lines[at]), between(at + 1, ends[k + 1]))))

    def paragraphs(text: Column, found: Column) -> Column:
        per = F.greatest(F.lit(1), F.floor(F.size(found) / target).cast("int"))
        group = lambda k: section(F.left(F.split(found[k], r"\.")[0], F.lit(60)), F.array_join(F.slice(found, k + 1, per), "\n\n"))
        return F.when(F.size(found) == 0, F.array(section(F.lit("Full Document"), text))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), per), group))

    rows = docs.where("text is not null and text != ''").select("doc_id", "text", F.split("text", "\n").alias("_lines"))
    rows = rows.select("doc_id", "text", "_lines", opening(F.transform("_lines", lambda x: X.is_heading(X.strip(x)))).alias("_opens"))
    rows = rows.select("doc_id", "text", F.filter(cut(F.col("_lines"), F.col("_opens")), lambda x: x["word_count"] >= 10).alias("_made"))
    found = F.filter(F.transform(F.split("text", "\n\n"), lambda p: X.strip(p)), lambda p: F.size(X.words(p)) >= 5)
    few = (F.size("_made") <= 1) & (F.size(X.words(F.col("text"))) > 200)
    rows = A.unpacked(rows, ["doc_id"], F.when(few, A.let(found, lambda p: paragraphs(F.col("text"), p))).otherwise(F.col("_made")), "position", "_s")
    return rows.select("doc_id", F.col("position").cast("long").alias("position"), "_s.*")


def section_summary(section: DataFrame) -> DataFrame:
    """section and summary: its first and last sentence of three words and more, else its first 200 characters."""
    parts = section.withColumn("_p", F.filter(F.transform(F.split("content", r"\."), lambda p: X.strip(p)), lambda p: F.size(X.words(p)) >= 3))
    n = F.size("_p")
    both = F.concat(F.get("_p", F.lit(0)), F.lit(". "), F.get("_p", n - 1), F.lit("."))
    return parts.withColumn("summary", F.when(n == 0, F.left("content", F.lit(200))).when(n == 1, F.get("_p", F.lit(0))).otherwise(both)).drop("_p")


def table_claims(tables: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """table_id, ord, sentence, subject, predicate, value of tables (table_id, caption, cells: rows of cells).

    A table with a header row and a label column gives a sentence a cell, one of two columns without header a sentence a row; others give none.
    """
    has_word = lambda x: x.rlike(r"[\p{L}\p{N}]")
    numeric = lambda x: x.rlike(r"\d") & (X.letters_share(x) < 0.5)
    norm = lambda c: F.coalesce(X.collapse(c), F.lit(""))
    grid = F.filter(F.transform("cells", lambda row: F.transform(row, norm)), lambda row: F.exists(row, lambda c: c != ""))
    t = tables.select("table_id", norm(F.col("caption")).alias("_cap"), grid.alias("_g")).where(F.size("_g") > 0)
    t = t.withColumn("_cols", F.array_max(F.transform("_g", lambda r: F.size(r)))).withColumn("_head", F.get("_g", F.lit(0)))
    t = t.withColumn("_named", F.filter("_head", lambda c: c != ""))
    labels = F.size("_named")
    two = (labels == 2) & ~numeric(F.get("_head", F.lit(0))) & ~numeric(F.coalesce(F.get("_head", F.lit(1)), F.lit("")))
    many = (F.col("_cols") >= 2) & (labels >= 2) & (F.size(F.filter("_named", numeric)) <= F.floor(labels / 2))
    t = t.withColumn("_matrix", (F.size("_g") >= 2) & F.when(F.col("_cols") == 2, two).otherwise(many))
    rows = t.where(F.col("_matrix") | (F.col("_cols") == 2)).select("*", F.posexplode("_g").alias("_i", "_row"))
    label = F.coalesce(F.get("_row", F.lit(0)), F.lit(""))
    cells = rows.where("_matrix and _i > 0").withColumn("_label", label).where(has_word(F.col("_label")))
    cells = cells.select("*", F.explode(F.sequence(F.lit(1), F.col("_cols") - 1)).alias("_j"))
    cells = cells.withColumn("_col", F.coalesce(F.get("_head", F.col("_j")), F.lit(""))).withColumn("_value", F.coalesce(F.get("_row", F.col("_j")), F.lit("")))
    cells = cells.where((F.col("_col") != "") & has_word(F.col("_value")) & (F.col("_value") != F.col("_label")))
    start = F.when(F.col("_cap") != "", F.concat(F.lit("In "), F.col("_cap"), F.lit(", for "))).otherwise("For ")
    one = cells.select("table_id", "_i", "_j", F.concat(start, "_label", F.lit(", the "), "_col", F.lit(" is "), "_value", F.lit(".")).alias("sentence"), F.col("_label").alias("subject"), F.col("_col").alias("predicate"), F.col("_value").alias("value"))
    pairs = rows.where("not _matrix").withColumn("_label", label).withColumn("_value", F.coalesce(F.get("_row", F.lit(1)), F.lit("")))
    pairs = pairs.where((F.col("_label") != "") & has_word(F.col("_value")) & ~numeric(F.col("_label")) & (F.col("_label") != F.col("_value")))
    start = F.when(F.col("_cap") != "", F.concat(F.lit("In "), F.col("_cap"), F.lit(", the "))).otherwise("The ")
    other = pairs.select("table_id", "_i", F.lit(1).alias("_j"), F.concat(start, "_label", F.lit(" is "), "_value", F.lit(".")).alias("sentence"), F.col("_label").alias("subject"), F.lit("is").alias("predicate"), F.col("_value").alias("value"))
    found = one.unionByName(other).withColumn("_same", F.row_number().over(Window.partitionBy("table_id", "sentence").orderBy("_i", "_j"))).where("_same = 1")
    ord_ = F.row_number().over(Window.partitionBy("table_id").orderBy("_i", "_j")).cast("long")
    return found.withColumn("ord", ord_).where(F.col("ord") <= config.table_cells).select("table_id", "ord", "sentence", F.left("subject", F.lit(500)).alias("subject"), F.left("predicate", F.lit(500)).alias("predicate"), "value")


def _recovered(reply: str, kind: str) -> Column:
    """The objects of a language model's reply: the whole reply, else a fenced block, else the outermost array."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    array = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    return F.coalesce(*(F.from_json(F.when(F.try_parse_json(x).isNotNull(), x), kind) for x in (F.col(reply), fenced, array)))


def recover_json_propositions(replies: DataFrame) -> DataFrame:
    """Propositions in replies (reply_id, reply) of a language model; unknown polarities and levels are inferred from the sentence, strong words overrule a polarity."""
    kind = "array<struct<entity:string,attribute:string,polarity:string,confidence_level:string,modality:string,source_sentence:string>>"
    rows = A.unpacked(replies, ["reply_id"], _recovered("reply", kind), "pos", "_p")
    text = lambda c: X.strip(F.coalesce(f"_p.{c}", F.lit("")))
    low = lambda c: F.lower(text(c))
    sentence = text("source_sentence")
    polarity = F.when(low("polarity").isin("positive", "negative", "mixed", "neutral"), low("polarity")).when(F.col("_p.polarity").isNull(), "neutral").otherwise(X.polarity(sentence))
    level = F.when(low("confidence_level").isin("certain", "hedged", "speculative"), low("confidence_level")).when(F.col("_p.confidence_level").isNull(), "certain").otherwise(X.confidence_level(sentence))
    rows = rows.where((text("entity") != "") & (text("attribute") != ""))
    return rows.select(
        "reply_id", F.col("pos").cast("long").alias("pos"), text("entity").alias("entity"), text("attribute").alias("attribute"), X.validated_polarity(polarity, sentence).alias("polarity"),
        level.alias("confidence_level"), F.when(low("modality").isin("factual", "predicted", "disputed"), low("modality")).otherwise("factual").alias("modality"), sentence.alias("sentence"),
    )


def recover_json_claims(replies: DataFrame) -> DataFrame:
    """Claims in replies (reply_id, reply) of a language model: the whole reply, else a fenced block, else the outermost array; invalid fields are mended."""
    kind = "array<struct<claim:string,modality:string,confidence:double>>"
    known = ("MANDATORY", "PROHIBITED", "RECOMMENDED", "OPTIONAL", "INFORMATIONAL")
    rows = A.unpacked(replies, ["reply_id"], _recovered("reply", kind), "pos", "_c").where(F.length(X.strip(F.col("_c.claim"))) >= 10)
    modality = F.upper("_c.modality")
    return rows.select(
        "reply_id",
        F.col("pos").cast("long").alias("pos"),
        X.strip(F.col("_c.claim")).alias("claim"),
        F.when(modality.isin(*known), modality).otherwise("INFORMATIONAL").alias("modality"),
        F.when(F.col("_c.confidence").between(0, 1), F.col("_c.confidence")).otherwise(0.8).alias("confidence"),
    )
