"""Column functions over text: cleaning, counting, cascades. All are built-in expressions, so they stay in generated code where Spark can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

SENTENCE_END = r"(?<=[.!?])\s+"


#: Fixed value: what `\s` matches.
BLANKS = " \t\n\x0b\f\r"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def collapse(x: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def clean(x: Column) -> Column:
    """Collapsed text without control characters, with straight quotes and plain dashes; a text of digits only is a page number and becomes empty."""
    out = F.translate(F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), "“”‘’–—", "\"\"''--")
    out = F.trim(out)
    return F.when(out.rlike(r"^\d+$"), "").otherwise(out)


def words(x: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def any_of(x: Column, patterns: tuple[str, ...]) -> Column:
    """One search for all patterns (flags within a group end with it), so that a text is converted once."""
    return x.rlike("|".join(f"(?:{p})" for p in patterns))


def contains_any(x: Column, texts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (x.contains(t) for t in texts))


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def letters_share(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}]+", "")) / F.greatest(F.length(x), F.lit(1))


def without_bullets(x: Column) -> Column:
    return strip(F.regexp_replace(strip(x), L.BULLETS, ""))


def is_repetitive(w: Column) -> Column:
    """Of a column of lower-cased words: three equal in a row, or of six and more fewer than half distinct."""
    run = F.exists(F.sequence(F.lit(2), F.size(w) - 1), lambda i: (w[i] == w[i - 1]) & (w[i] == w[i - 2]))
    scarce = (F.size(w) >= 6) & (F.size(F.array_distinct(w)) / F.size(w) < 0.5)
    return F.when(F.size(w) < 4, False).otherwise(run | scarce)


def worthiness(s: Column, w: Column) -> Column:
    """Why a sentence is no claim, or an empty string; s: without bullets, w: its lower-cased words. The order of the tests is part of the result."""
    content = F.size(F.filter(w, lambda x: ~F.btrim(x, F.lit(".,;:!?\"'()")).isin(*L.STOPWORDS)))
    spaced = F.split(F.lower(s), " ")  # a verb between two spaces is neither the first nor the last piece
    verb = F.exists(F.slice(spaced, F.lit(2), F.greatest(F.size(spaced) - 2, F.lit(0))), lambda x: x.isin(*L.VERBS))
    tests = (
        ("empty_after_bullet_strip", s == ""),
        ("headless_predicate", s.rlike(L.HEADLESS)),
        ("too_short", F.length(s) < 25),
        ("too_long", F.length(s) > 600),
        ("low_alpha_ratio", letters_share(s) < 0.55),
        ("too_few_words", F.size(w) < 5),
        ("too_many_words", F.size(w) > 80),
        ("repetitive_fragment", is_repetitive(w)),
        ("document_header", any_of(s, L.DOCUMENT_HEADERS)),
        ("boilerplate_pattern", any_of(s, L.SENTENCE_NOISE)),
        ("lowercase_start", s.rlike(r"^\p{Ll}") & ~s.rlike(r"^(i |e\.g\.|i\.e\.)")),
        ("dangling_pronoun", s.rlike(L.DANGLING_PRONOUN)),
        ("dangling_generic_reference", s.rlike(L.DANGLING_NOUN)),
        ("unresolved_reference", any_of(s, L.UNRESOLVED)),
        ("insufficient_content_words", content < F.when(s.rlike(L.REGULATORY), 4).otherwise(8)),
        ("no_verb", ~verb),
    )
    return reduce(lambda rest, t: F.when(t[1], t[0]).otherwise(rest), reversed(tests), F.lit(""))


def is_structural_noise(s: Column, w: Column) -> Column:
    """Text that is no proposition at all; s and w as for worthiness."""
    return (s == "") | (F.size(w) < 3) | (letters_share(s) < 0.55) | is_repetitive(w) | any_of(s, L.DOCUMENT_HEADERS) | any_of(s, L.SENTENCE_NOISE)


def claim_weight(x: Column) -> Column:
    low = F.lower(x)
    return F.when(contains_any(low, L.WEAK_KEYWORDS), 0.5).when(contains_any(low, L.STRONG_KEYWORDS), 1.5).otherwise(1.0)


def claim_hash(x: Column, model: str) -> Column:
    return F.sha2(F.concat_ws("|", strip(x), F.lit(model)), 256)


def embedding_version(model: Column, dimension: Column) -> Column:
    return F.left(F.sha2(F.concat_ws(":", model, dimension), 256), F.lit(12))


def tokens(x: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores (and maybe an empty text)."""
    return F.split(F.lower(x), r"[^\p{L}\p{N}_]+")


def _signals(t: Column, signals: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(t, literals(signals)))


def polarity(x: Column, t: Column | None = None) -> Column:
    """positive, negative, mixed or neutral by signal words; a negation swaps the sides. t: the tokens, if known."""
    t = tokens(x) if t is None else t
    negated = contains_any(F.lower(x), L.NEGATIONS)
    up, down = _signals(t, L.POSITIVE), _signals(t, L.NEGATIVE)
    more = F.when(negated, down - up).otherwise(up - down)
    return F.when(more > 0, "positive").when(more < 0, "negative").when((up > 0) & (down > 0), "mixed").otherwise("neutral")


def confidence_level(x: Column, t: Column | None = None) -> Column:
    t = tokens(x) if t is None else t
    hedged, certain = _signals(t, L.HEDGES), _signals(t, L.CERTAIN)
    return F.when(hedged > certain, "hedged").when(certain > 0, "certain").when(contains_any(F.lower(x), L.SPECULATIVE), "speculative").otherwise("certain")


def validated_polarity(given: Column, x: Column) -> Column:
    """A given polarity, overruled by strong words: first towards negative, then back."""
    low = F.lower(x)
    first = F.when((given == "positive") & contains_any(low, L.STRONG_NEGATIVE), "negative").otherwise(given)
    return F.when((first == "negative") & contains_any(low, L.STRONG_POSITIVE), "positive").otherwise(first)


def salient_terms(x: Column) -> Column:
    terms = F.filter(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)")), lambda t: F.length(t) > 2)
    return F.array_except(F.array_distinct(terms), literals(L.STOPWORDS))


def shared_terms(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(salient_terms(a), salient_terms(b)))


def specificity_ratio(a: Column, b: Column) -> Column:
    n, m = F.size(words(a)), F.size(words(b))
    return F.greatest(n, m, F.lit(1)) / F.greatest(F.least(n, m), F.lit(1))


def modalities_comparable(a: Column, b: Column) -> Column:
    """Null or empty modalities do not stand in the way."""
    pair = F.concat_ws("|", F.array_sort(F.array(F.upper(a), F.upper(b))))
    known = ["|".join(sorted(p)) for p in L.COMPARABLE]
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), True).otherwise(pair.isin(*known))


def modality_weight(x: Column) -> Column:
    return reduce(lambda rest, kv: F.when(F.upper(x) == kv[0], kv[1]).otherwise(rest), L.MODALITY_WEIGHTS.items(), F.lit(1.0))


def is_heading(line: Column) -> Column:
    n = F.size(words(line))
    capitals = (F.upper(line) == line) & line.rlike(r"\p{Lu}") & (n >= 3) & (n <= 8)
    return (line != "") & (line.rlike(L.HEADING) | capitals)


def highlight(x: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Every word of the query set between marks, whatever its case."""
    found = sorted({w for w in query.split() if w}, key=lambda w: (-len(w), w))
    escaped = ["".join(c if c.isalnum() or c == "_" else "\\" + c for c in w) for w in found]
    return F.regexp_replace(x, f"(?i)({'|'.join(escaped)})", f"{before}$1{after}") if found else x
