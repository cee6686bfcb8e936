"""Operators on small literal frames."""

import io
import shutil
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctally.config import Config
from doctally.functions import lexicon as L
from doctally.functions import text as X
from doctally.operators import drift, evaluation, graph, pairs, reports, scan, vectors
from doctally.operators import text as T
from doctally.sources import files

CASES = [
    ("", "empty_after_bullet_strip"),
    ("• is initial estimate location of the vehicle.", "headless_predicate"),
    ("Too short here.", "too_short"),
    ("12 34 56 78 90 12 34 56 78 90 ab", "low_alpha_ratio"),
    ("Internationalisation internationalisation works", "too_few_words"),
    ("Yes yes yes Can the cells repeat here", "repetitive_fragment"),
    ("RETIRED DRAFT The attached publication has been superseded by another one.", "document_header"),
    ("In this section we describe the general approach to the question.", "boilerplate_pattern"),
    ("continuing the previous sentence without any capital letter in front.", "lowercase_start"),
    ("This is clearly an important consequence of the previous discussion here.", "dangling_pronoun"),
    ("These results confirm the general hypothesis across every tested environment.", "dangling_generic_reference"),
    ("The procedure works as described above in every single tested environment.", "unresolved_reference"),
    ("The cat is on the mat and so are we.", "insufficient_content_words"),
    ("Wonderful green mountains near quiet northern villages beyond distant shining rivers.", "no_verb"),
    ("Verifiers SHALL NOT require periodic password changes in any production system.", "no_verb"),
    ("Renewable electricity generation has exceeded regional consumption targets across northern provinces.", ""),
]


def test_worthiness_reasons(spark):
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CASES)], "i int, sentence string")
    found = {r["i"]: r["reason"] for r in T.claim_worthiness(rows).collect()}
    wanted = {i: r for i, (_, r) in enumerate(CASES)}
    wanted[14] = ""  # "shall" is among the verbs
    assert found == wanted


def test_structural_filter_resumes_after_references(spark):
    text = "Body line one\nReferences\n[1] Someone wrote this\nplain entry\nAppendix A follows\nBody line two\npage 3 of 9\nabc"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    assert {r["doc_id"]: r["text"] for r in T.structural_filter(docs).collect()} == {1: "Body line one\nAppendix A follows\nBody line two", 2: ""}


def test_chunks_overlap(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(1000)))), (2, ""), (3, None)], "doc_id int, text string")
    rows = sorted(map(tuple, T.chunk_windows(docs).select("chunk_index", "token_count", F.split("content", " ")[0]).collect()))
    assert rows == [(0, 512, "0"), (1, 512, "462"), (2, 76, "924")]


def test_sections_by_headings(spark):
    body = "word, " * 12  # a line of letters only would be a heading
    text = f"1. First\n{body}\n## Second\n{body}\n### Third\n{body}"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [r["heading"] for r in T.sections(docs).orderBy("position").collect()] == ["Introduction", "## Second", "### Third"]


def test_tables(spark):
    matrix = [["Class", "Limit"], ["Cars", "50 km/h"], ["Trucks", ""], [None, "x"]]
    pairs_ = [["Max speed", "50 km/h"], ["Max speed", "50 km/h"], ["12", "x"]]
    wide = [["1", "2", "3"], ["4", "5", "6"]]
    rows = spark.createDataFrame([(1, "", matrix), (2, "Rules", pairs_), (3, "", wide), (4, "", [])], "table_id int, caption string, cells array<array<string>>")
    assert sorted((r["table_id"], r["sentence"]) for r in T.table_claims(rows).collect()) == [(1, "For Cars, the Limit is 50 km/h."), (2, "In Rules, the Max speed is 50 km/h.")]


def test_modalities_and_polarity(spark):
    row = spark.range(1).select(
        X.modalities_comparable(F.lit("mandatory"), F.lit("PROHIBITED")),
        X.modalities_comparable(F.lit("MANDATORY"), F.lit("INFORMATIONAL")),
        X.modalities_comparable(F.lit(None), F.lit("X")),
        X.polarity(F.lit("Output improved")),
        X.polarity(F.lit("Output never improved")),
        X.confidence_level(F.lit("We expect growth")),
    ).first()
    assert tuple(row) == (True, False, True, "positive", "negative", "speculative")


def test_drift_golden(spark):
    rows = spark.createDataFrame([(1, 22, 1.0, (12 * 0.9959 + 10 * 0.9979) / 22, 0.0, 0.007, 3), (1, 0, 0.0, 0.0, 0.0, 1.0, 3)], "org_id int, contradictions long, ratio double, mean_confidence double, shift double, decay double, authority_level int")
    high, zero = drift.drift_scores(rows).orderBy(F.desc("factual")).collect()
    assert abs(high["factual"] - 97.65) <= 0.01 and high["drift_type"] == "both"
    assert (zero["factual"], zero["semantic"], zero["combined"], zero["drift_type"]) == (0.0, 0.0, 0.0, "none")
    weights = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, 0.0)], "org_id int, density double, confidence double, volume double, factual double, semantic double")
    assert drift.drift_scores(rows, weights).agg(F.max("combined")).first()[0] == round((12 * 0.9959 + 10 * 0.9979) / 22 * 100, 2)


def test_impact_takes_the_first_parent(spark):
    edges = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.9), (1, 3, 0.5), (2, 3, 1.0), (3, 0, 1.0), (3, 4, 0.5), (4, 5, 1.0)], "source int, target int, weight double")
    found = {r["node"]: (r["depth"], r["parent"], r["impact"]) for r in graph.impact_trace(edges, 0).collect()}
    assert found == {1: (1, 0, 0.5), 2: (1, 0, 0.9), 3: (2, 1, 0.25), 4: (3, 3, 0.125)}


@pytest.mark.parametrize("most", [4096, 150])
def test_dedup_is_greedy_in_order(spark, most):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(700, 4))
    rows = spark.createDataFrame([(i % 2, i, [float(x) for x in v]) for i, v in enumerate(base)], "group_id int, vec_id int, embedding array<double>")
    found = {r["vec_id"]: r["representative"] for r in vectors.deduplicate(rows, most=most).collect()}
    units = vectors.unit(base)
    for g in (0, 1):
        kept = []
        for i in range(g, 700, 2):
            first = next((j for j in kept if round(float(units[i] @ units[j]), 6) >= 0.93), i)
            assert found[i] == first
            if first == i:
                kept.append(i)


@pytest.mark.parametrize("block", [2000, 7])
@pytest.mark.parametrize("apart", [None, "g"])
def test_nearest_equals_brute_force(spark, block, apart):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(50, 8)), np.repeat(rng.normal(size=(2, 8)), 5, 0)])  # equal ones too
    rows = spark.createDataFrame([(i, i % 3, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id int, g int, embedding array<double>")
    found = vectors.nearest(rows.withColumnRenamed("vec_id", "query_id"), rows, 4, 0.1, skip_self=True, apart=apart, block=block).collect()
    sims = np.round(vectors.unit(v) @ vectors.unit(v).T, 6)
    want = set()
    for i in range(60):
        order = [j for j in np.lexsort((np.arange(60), -sims[i])) if j != i and sims[i, j] >= 0.1 and not (apart and i % 3 == j % 3)]
        want |= {(i, int(j), n + 1) for n, j in enumerate(order[:4])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found} == want and len(found) == len(want)
    partners = rows.select(F.col("vec_id").alias("query_id"), "embedding", ((F.col("vec_id") + 1) % 61).alias("partner_id"))
    ranks = {r["query_id"]: r["rank"] for r in vectors.partner_ranks(partners, rows).collect()}
    assert ranks == {i: 1 + [int(j) for j in np.lexsort((np.arange(60), -sims[i]))].index((i + 1) % 61) for i in range(60) if (i + 1) % 61 < 60}


def test_hybrid_blend(spark):
    semantic = spark.createDataFrame([(1, 1, 0.8)], "query_id int, doc_id int, similarity double")
    lexical = spark.createDataFrame([(1, 1, 3.0), (1, 2, 5.0)], "query_id int, doc_id int, bm25 double")
    assert [(r["doc_id"], r["score"]) for r in vectors.hybrid(semantic, lexical, 5).collect()] == [(1, 0.72), (2, 0.4)]


def test_published_confusion_matrix(spark):
    counts = {("c", "c"): 24, ("c", "n"): 12, ("e", "c"): 2, ("e", "e"): 4, ("e", "n"): 3, ("n", "c"): 2, ("n", "n"): 3}
    rows = spark.createDataFrame([k for k, n in counts.items() for _ in range(n)], "truth string, predicted string")
    report = {r["label"]: r for r in evaluation.multiclass_report(rows).collect()}
    assert (report["c"]["precision"], report["c"]["recall"], report["c"]["f1"]) == (0.8571, 0.6667, 0.75)
    assert (report["n"]["precision"], report["n"]["recall"], report["n"]["f1"]) == (0.1667, 0.6, 0.2609)
    assert report["macro"]["f1"] == pytest.approx(0.5421, abs=1e-4) and report["macro"]["tp"] / 50 == 0.62


def test_scan_finds_a_contradiction(spark):
    rows = [("a", "a1", "Solar output exceeded the regional target of 40 percent in spring"), ("b", "b1", "Solar output exceeded the regional target of 25 percent in spring"), ("b", "b2", "Bicycles are cheap")]
    claims = spark.createDataFrame(rows, "document_id string, claim_id string, content string")
    config = Config(gate_similarity=0.5, gate_sample=0.0)
    found = scan.claim_pairs(claims, config=config).collect()
    assert [(r["a_id"], r["b_id"], r["band"], r["explanation"]) for r in found] == [("a1", "b1", "high", "These two statements present conflicting information. Contradiction detected with 100% confidence.")]
    assert scan.claim_pairs(claims, new=claims.where("claim_id = 'b2'"), config=config).count() == 0
    assert scan.claim_pairs(claims, new=claims.where("claim_id = 'b1'"), config=config).count() == 1
    # the gates one by one: modalities that can't contradict, no common subject, one document, noise as a candidate
    odd = claims.withColumn("modality", F.when(F.col("claim_id") == "a1", "MANDATORY").otherwise("INFORMATIONAL"))
    assert scan.claim_pairs(odd, config=config).count() == 0 and scan.claim_pairs(claims, config=replace(config, shared_terms=99)).count() == 0
    assert scan.claim_pairs(claims.withColumn("document_id", F.lit("a")), config=config).count() == 0
    noisy = claims.withColumn("content", F.when(F.col("claim_id") == "b1", F.concat(F.lit("RETIRED DRAFT "), "content")).otherwise(F.col("content")))
    assert scan.claim_pairs(noisy, config=config).count() == 0
    # below the gate a sample fixed by the ids is kept, here all
    high = scan.claim_pairs(claims, config=Config(gate_similarity=0.99, gate_sample=1.0)).collect()
    assert [(r["a_id"], r["b_id"], r["sampled"]) for r in high] == [("a1", "b1", True)] and scan.claim_pairs(claims, config=Config(gate_similarity=0.99, gate_sample=0.0)).count() == 0


def test_sample_below_the_gate(spark):
    pairs_ = spark.range(20_000).select(F.col("id").alias("a_id"), (F.col("id") * 7).alias("b_id"), F.lit(0.5).alias("similarity"))
    kept = pairs.similarity_gate(pairs_)
    assert 0.03 < kept.count() / 20_000 < 0.07 and kept.where("not sampled").count() == 0
    assert kept.exceptAll(pairs.similarity_gate(pairs_.repartition(7))).count() == 0


def test_chunk_pairs_by_replies(spark):
    replies = {
        '```json\n{"classification": "SUPERSEDES", "confidence": "0.9", "conflicting_claims": ["x"]}\n```': ("SUPERSEDES", 0.9, ["x"]),
        '{"classification": "CONTRADICTORY"}': ("CONTRADICTORY", 0.5, []),
        "```\n{}```": ("UNRELATED", 0.5, []),
        '{"classification": "CONTRADICTORY", "confidence": "high"}': ("UNRELATED", 0.0, []),
        "they contradict": ("UNRELATED", 0.0, []),
        '["CONTRADICTORY"]': ("UNRELATED", 0.0, []),
        "": ("UNRELATED", 0.0, []),
        None: ("UNRELATED", 0.0, []),
    }
    rows = scan.verdicts(spark.createDataFrame([(x,) for x in replies], "reply string")).collect()
    assert {r["reply"]: (r["classification"], r["confidence"], r["claims"]) for r in rows} == replies

    vectors = {"a1": [1.0, 0.0], "b1": [1.0, 0.1], "b2": [0.9, 0.1], "c1": [1.0, 0.2], "d1": [0.0, 1.0]}
    chunks = spark.createDataFrame([(x[0], x, f"text {x}", v) for x, v in vectors.items()], "document_id string, chunk_id string, content string, embedding array<double>")

    def ask(a, b):
        if "c1" in (a[5:], b[5:]):
            raise ConnectionError
        return '{"classification": "CONTRADICTORY", "confidence": 0.7}'

    pairs_of = lambda **x: sorted((r["a_id"], r["b_id"]) for r in scan.chunk_pairs(chunks, ask, **x).collect())
    assert pairs_of() == [("a1", "b1"), ("a1", "b2")]
    assert pairs_of(new=chunks.where("chunk_id = 'b2'")) == [("b2", "a1")]
    # the nearest counts although it is of the same document
    assert pairs_of(config=Config(chunk_partners=1)) == [("a1", "b1")] and pairs_of(config=Config(verdict=0.71)) == []


def test_explanations(spark):
    rows = spark.createDataFrame([("x", "y", 0.5), ("long enough", "z", 0.876)], "a string, b string, score double")
    template = "These two statements present conflicting information. Contradiction detected with %s%% confidence."

    def model(a, b, score):
        if a == "x":
            raise ConnectionError
        return f" {a} against {b} "

    assert [r["explanation"] for r in scan.explained(rows, model).orderBy("score").collect()] == [template % 50, "long enough against z"]
    assert [r["explanation"] for r in scan.explained(rows, lambda *x: "short").orderBy("score").collect()] == [template % 50, template % 88]


REPORT_A = "1. Energy\nThe solar output of the northern plant improved by 40 percent across the whole region in spring.\n2. Water\n" + "The reservoir level of the valley was stable during the long and rather quiet winter season. " * 2 + "\n"
REPORT_B = "1. Energy\nThe solar output of the northern plant failed to improve by 40 percent across the whole region in spring.\n2. Water\n" + "The reservoir level of the valley was stable during the long and rather quiet winter season. " * 2 + "\n"


def test_structured_scan(spark):
    docs = spark.createDataFrame([(1, REPORT_A), (2, REPORT_B)], "doc_id int, text string")
    both = spark.createDataFrame([(1, 2)], "doc_a int, doc_b int")
    aligned = {(r["position_a"], r["position_b"]) for r in scan.aligned_sections(both, docs, 0.5).collect()}
    assert (1, 1) in aligned or (0, 0) in aligned
    found = scan.structured_scan(both, docs, config=Config(alignment=0.5)).collect()
    assert {(r["type"], r["band"]) for r in found} >= {("outcome_inversion", "high")}
    routed = scan.routed_scan(both, docs, Config(alignment=0.5, structured=0.0)).collect()
    assert {r["scan_path"] for r in routed} == {"structured"}
    routed = scan.routed_scan(both, docs, Config(gate_similarity=0.4, gate_sample=0.0, structured=1.1)).collect()
    assert {r["scan_path"] for r in routed} <= {"embedding"}


def test_split_by_time(spark):
    contexts = spark.createDataFrame([(1, None, "2020-01-01", "2021-01-01"), (2, 1, "2021-01-02", None), (3, None, "2020-01-01", None)], "id int, supersedes int, from string, until string")
    contexts = contexts.select("id", "supersedes", F.to_timestamp("from").alias("from"), F.to_timestamp("until").alias("until"), F.to_timestamp("from").alias("created"), F.lit(1).alias("version"), F.lit("").alias("department"))
    both = spark.createDataFrame([(1, 2), (1, 3), (3, 9)], "doc_a int, doc_b int")
    got = {(r["doc_a"], r["doc_b"]): (r["class"], r["inferred"]) for r in scan.split_by_time(both, contexts, "2022-01-01 00:00:00").collect()}
    assert got == {(1, 2): ("evolution", False), (1, 3): ("evolution", False), (3, 9): ("contradiction", False)}


def test_embeddings_align_what_words_do_not(spark):
    rows = spark.createDataFrame([("cars", "automobiles", "top speed", "velocity")], "entity_a string, entity_b string, attribute_a string, attribute_b string")
    same = {"cars": 0, "automobiles": 0, "top speed": 1, "velocity": 1}
    encode = lambda df, c: df.withColumn("embedding", F.create_map(*(F.lit(x) for k, v in same.items() for x in (k, v)))[F.col(c)]).withColumn("embedding", F.array((F.col("embedding") == 0).cast("double"), (F.col("embedding") == 1).cast("double")))
    rest = {f"{c}_{s}": F.lit(v) for s in "ab" for c, v in (("polarity", "neutral"), ("confidence_level", "certain"))}
    rest |= {"sentence_a": F.lit("it gained"), "sentence_b": F.lit("it failed"), "nli_label": F.lit("neutral"), "nli_score": F.lit(0.1)}
    plain = rows.withColumns(rest)
    assert pairs.taxonomy(plain).first()["type"] is None
    assert pairs.taxonomy(pairs.with_similarities(plain, encode)).first()["type"] == "outcome_inversion"


def test_times(spark):
    texts = ["2024-03-01", "2024-03-01T10:20:30Z", "2024-03-01T10:20:30+02:00", "01.03.2024", "03/01/2024", "1 Mar 2024", "March 1, 2024", "20240301", "soon", "", None]
    got = [str(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(pairs.parse_time(F.col("t")).cast("string")).collect()]
    day = "2024-03-01 00:00:00"
    assert got == [day, "2024-03-01 10:20:30", "2024-03-01 08:20:30", day, day, day, day, day, "None", "None", "None"]


def test_markdown(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "truth string, predicted string")
    text = evaluation.markdown_report(evaluation.multiclass_report(rows), evaluation.confusion_matrix(rows, ["a", "b"]), "T")
    assert text.splitlines() == [
        "# T", "", "**Accuracy:** 0.6667", "**Macro F1:** 0.6667", "**Samples:** 3", "", "| Class | Precision | Recall | F1 | Support |", "|-------|-----------|--------|-----|---------|",
        "| a | 1.0000 | 0.5000 | 0.6667 | 2 |", "| b | 0.5000 | 1.0000 | 0.6667 | 1 |", "", "## Confusion Matrix", "", "| True \\ Pred | a | b |", "|---|---|---|", "| a | 1 | 1 |", "| b | 0 | 1 |",
    ]


def brute_sections(text, target=6):
    """Sections by going through the lines."""
    import re

    words = lambda t: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]

    def heading(line):
        n = len(words(line))
        capitals = line.upper() == line and any(c.isupper() for c in line) and 3 <= n <= 8
        return bool(line) and (bool(re.search(r"(?i)^\s*(?:\d+\.(?:\d+\.?)*\s+|#{1,4}\s+|[A-Z][A-Z\s]{3,}(?:\n|$)|(?:Section|Chapter|Part)\s+\d+)", line)) or capitals)

    made, head, lines = [], "Introduction", []
    for line in text.split("\n"):
        if heading(line.strip()) and lines:
            made.append((head, lines))
            head, lines = line.strip(), []
        else:
            lines.append(line)
    made.append((head, lines))
    made = [(h, c, len(words(c))) for h, ls in made if len(words(c := "\n".join(ls).strip())) >= 10]
    if len(made) <= 1 and len(words(text)) > 200:
        found = [p.strip() for p in text.split("\n\n") if len(words(p)) >= 5]
        if not found:
            return [("Full Document", text, len(words(text)))]
        per = max(1, len(found) // target)
        return [(found[k].split(".")[0][:60], c := "\n\n".join(found[k : k + per]), len(words(c))) for k in range(0, len(found), per)]
    return made


def test_sections_and_filter_by_brute_force(spark):
    import random

    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["river", "stone", "lime, moss", "field.", "7"]) for _ in range(rng.randint(1, 14)))
    kinds = ["1. Title here", "## Head", "ALL CAPS LINE", "", "References", "Appendix B", "page 3 of 9", "Section 4", "  \t", "x"]
    texts = ["\n".join(rng.choice(kinds) if rng.random() < 0.35 else plain() for _ in range(rng.randint(1, 40))) for _ in range(120)]
    texts += ["\n\n".join(plain() for _ in range(n)) for n in (1, 5, 40, 60)] + ["w " * 300, "\n" * 50, "# a\n# b\n# c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in T.sections(docs).orderBy("doc_id", "position").collect():
        got.setdefault(r["doc_id"], []).append((r["heading"], r["content"], r["word_count"]))
    assert got == {i: s for i, t in enumerate(texts) if (s := brute_sections(t))}

    def filtered(text):
        import re

        out, inside = [], False
        for line in text.split("\n"):
            s = line.strip()
            if re.search(r"(?i)^\s*(references|bibliography|works\s+cited)\s*$", s):
                inside = True
            elif re.search(r"(?i)^\s*(appendix|supplementary|about)", s):
                inside = False
            if not inside and len(s) >= 5 and not any(re.search(p, s) for p in L.BOILERPLATE_LINES):
                out.append(line)
        return "\n".join(out)

    assert {r["doc_id"]: r["text"] for r in T.structural_filter(docs).collect()} == {i: filtered(t) for i, t in enumerate(texts)}


def test_canonical_and_dedup(spark):
    rows = spark.createDataFrame([("b", "a", 1), ("a", "b", 2), ("c", "c", 3)], "a_id string, b_id string, ord int")
    assert [tuple(r) for r in pairs.dedup_pairs(pairs.canonical_pairs(rows)).collect()] == [("a", "b", 1)]


def test_tenants_do_not_mix(spark):
    rows = spark.createDataFrame([(1, "f", 1, 1), (2, "f", 2, 2), (1, "f", 3, 3)], "org_id int, filename string, document_id int, created_at int")
    found = {r["document_id"]: (r["supersedes"], r["version"]) for r in reports.version_chain(rows).collect()}
    assert found == {1: (None, 1), 2: (None, 1), 3: (1, 2)}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("café \xff".encode("latin-1"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "b.docx").write_bytes(out.getvalue())
    (tmp_path / "c.docx").write_bytes(b"broken")
    found = {r["path"].rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert found["a.txt"]["text"] == "caf " and found["b.docx"]["text"] == "Hello"
    assert found["b.docx"]["tables"][0]["cells"] == [["k"]] and found["c.docx"]["error"]


def test_stream_is_idempotent(spark, tmp_path):
    from doctally.streaming import ingest, windows

    (tmp_path / "in").mkdir()
    for n, share in (("x", 40), ("y", 25)):
        (tmp_path / "in" / f"{n}.txt").write_text(f"Solar electricity output has exceeded the northern regional target of {share} percent during spring months.")
    for _ in range(2):
        ingest.watch(spark, str(tmp_path / "in"), str(tmp_path / "store")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store/documents")).count() == 2
    assert spark.read.parquet(str(tmp_path / "store/pairs")).count() == 1
    # an upload that comes later is scanned against what is stored; one whose scan was lost is found again
    (tmp_path / "in" / "z.txt").write_text("Solar electricity output has exceeded the northern regional target of 70 percent during spring months.")
    ingest.watch(spark, str(tmp_path / "in"), str(tmp_path / "store")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store/pairs")).count() == 3 and ingest.reconcile(spark, str(tmp_path / "store")).count() == 0
    last = spark.read.parquet(str(tmp_path / "store/scanned")).agg(F.max("batch")).first()[0]
    shutil.rmtree(tmp_path / f"store/scanned/batch={last}")
    before = spark.read.parquet(str(tmp_path / "store/pairs")).count()
    assert ingest.reconcile(spark, str(tmp_path / "store")).count() == 2
    # it is noted, and pairs that were there already stay as they are
    assert ingest.reconcile(spark, str(tmp_path / "store")).count() == 0 and spark.read.parquet(str(tmp_path / "store/pairs")).count() == before
    spark.range(1).selectExpr("timestamp_ntz'2024-01-01 00:00:30' as ts", "'a' as event_type", "1.0 as value").write.parquet(str(tmp_path / "ev"))
    stream = windows.tumbling(windows.timed(spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "ev")), "1 minute"), "1 hour")
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("counts").first()["n"] == 1


def test_pages_of_chunks(spark):
    """As found by going through the pages one by one."""
    from doctally.config import Config

    texts = {1: " ".join(f"w{i}" * (i % 4 + 1) for i in range(700)), 2: "one", 3: "", 4: None, 5: " a  b " * 90}
    maps = {1: {1: 0, 2: 1000, 3: 1000, 4: 2500}, 2: {1: 0, 2: 3}, 3: {1: 0}, 4: {1: 0}, 5: {}}
    docs = spark.createDataFrame([(i, t, maps[i]) for i, t in texts.items()], "doc_id long, text string, page_map map<int,int>")
    found = {(r["doc_id"], r["chunk_index"]): (r["content"], r["start_page"], r["end_page"]) for r in T.chunk_pages(docs, Config(chunk_words=60, chunk_overlap=7)).collect()}
    wanted = {}
    for i, t in texts.items():
        words = (t or "").split()
        for n, at in enumerate(range(0, len(words), 53)):
            content = " ".join(words[at : at + 60])
            start = len(" ".join(words[:at]))
            page = lambda c, pages=maps[i]: max((p for p, s in pages.items() if s <= c), default=None)
            wanted[i, n] = (content, page(start), page(start + len(content)))
    assert found == wanted
