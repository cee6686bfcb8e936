"""Patterns and word lists that results depend on, in plain text and natural order. All patterns are read without regard to case unless they say otherwise."""

#: Fixed value. A line that matches one of these is boilerplate (the first and the ninth regard case).
BOILERPLATE_LINES = (
    r"^\s*\[?\d+\]?\s*[A-Z][a-z]+.*\d{4}\b",
    r"(?i)^\s*references\s*$",
    r"(?i)^\s*bibliography\s*$",
    r"(?i)^\s*(figure|fig\.?|table|tab\.?)\s+\d+",
    r"(?i)^\s*acknowledgements?\s*$",
    r"(?i)the\s+authors?\s+(would\s+like\s+to|wish\s+to)\s+thank",
    r"^\s*-?\s*\d+\s*-?\s*$",
    r"(?i)^\s*page\s+\d+\s*(of\s+\d+)?\s*$",
    r"^\s*\d+\.?\d*\.?\s+[A-Z][a-z]+(\s+[A-Z][a-z]+){0,3}\s*$",
    r"(?i)^\s*(https?://|www\.|[a-zA-Z0-9._%+-]+@)",
    r"^\s*\(([A-Z][a-z]+,?\s*)+\d{4}[a-z]?\)\s*$",
    r"(?i)(copyright|©|all rights reserved|creative commons)",
    r"(?i)^\s*(doi|issn|isbn)\s*:",
)
#: Fixed value. Sentence-level noise.
SENTENCE_NOISE = (
    r"(?i)^(in\s+this\s+(section|paper|study|chapter|article))",
    r"(?i)^(the\s+rest\s+of\s+(this|the)\s+(paper|section))",
    r"(?i)^(as\s+(shown|described|discussed|mentioned|noted)\s+(in|above|below))",
    r"(?i)^(see\s+(figure|fig|table|section|appendix))",
    r"(?i)^(we\s+(also|further|next|now|then)\s+(discuss|describe|present|show|consider))",
    r"(?i)^(let\s+us\s+(consider|define|assume|denote))",
    r"(?i)^(note\s+that\s+)",
    r"(?i)^(it\s+(is|should\s+be)\s+(noted|worth|important))",
    r"(?i)(et\s+al\.?\s*[,\(]\s*\d{4})",
)
#: Fixed value. References to something outside the sentence.
UNRESOLVED = (
    r"(?i)\b(as\s+(described|noted|mentioned|stated|discussed|shown)\s+(above|below|earlier|previously))",
    r"(?i)\b(see\s+(section|chapter|appendix|above|below|figure|table|page))",
    r"(?i)\b(the\s+following\s+(section|table|figure|list|example)s?)\b",
    r"(?i)\b(as\s+noted\b)",
    r"(?i)\b(the\s+above\s+(results?|findings?|analysis|discussion|table|figure))",
    r"(?i)\b(discussed\s+(below|above|later|earlier))\b",
    r"(?i)\b(refer\s+to\s+(section|appendix|table|figure))",
)
#: Fixed value. Running headers and draft notices.
DOCUMENT_HEADERS = (
    r"(?i)\bRETIRED\s+DRAFT\b",
    r"(?i)\bDRAFT\s+(document|Special\s+Publication)\b",
    r"(?i)^[\d.\)]+\s+.*\b(NIST\s+SP|SP\s?800-\d|FIPS\s+\d|Digital\s+Identity\s+Guidelines)\b",
    r"(?i)^\s*\d{1,2},?\s+\d{4}\s+.*\bSP\s?\d{3}",
)
#: Fixed value.
DANGLING_PRONOUN = (
    r"(?i)^(This|These|Those|It|They|Such|Here)\s+"
    r"(is|are|was|were|has|have|had|can|could|may|might|will|would|shall|should|also|further|additionally)\b"
)
#: Fixed value.
DANGLING_NOUN = (
    r"(?i)^(These|Those)\s+(results?|findings?|data|values?|numbers?|factors?|issues?|changes?|conditions?|observations?|outcomes?"
    r"|conclusions?|measures?|effects?|aspects?)\b"
)
#: Fixed value.
HEADLESS = r"(?i)^(is|are|was|were|has|have|had|can|will|shall|should|does|do|may|might|could|would)\b"
#: Fixed value.
REGULATORY = r"(?i)\b(shall(\s+not)?|must(\s+not)?|may\s+not|prohibited|mandatory|required\s+to)\b"
#: Fixed value.
BULLETS = r"^[\s•\-\*>◦▪‣⁃∙]+"
#: Fixed value. Headings that open and phrases that close a list of references.
REFERENCES_OPEN = r"(?i)^\s*(references|bibliography|works\s+cited)\s*$"
#: Fixed value.
REFERENCES_CLOSE = r"(?i)^\s*(appendix|supplementary|about)"
#: Fixed value.
HEADING = r"(?i)^\s*(?:\d+\.(?:\d+\.?)*\s+|#{1,4}\s+|[A-Z][A-Z\s]{3,}(?:\n|$)|(?:Section|Chapter|Part)\s+\d+)"

#: Fixed value.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should",
    "may", "might", "can", "could", "must", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before",
    "after", "above", "below", "between", "under", "and", "but", "or", "nor", "not", "so", "yet", "both", "either", "neither", "each", "every", "all",
    "any", "few", "more", "most", "other", "some", "such", "no", "only", "than", "too", "very", "that", "this", "these", "those", "it", "its", "they",
    "them", "their", "we", "our", "he", "she", "his", "her", "i", "me", "my", "you", "your", "who", "which", "what", "when", "where", "how", "if", "then",
    "also", "just", "about", "up", "out", "over",
)
#: Fixed value. Words that, between spaces, make a sentence a statement.
VERBS = (
    "is", "are", "was", "were", "has", "have", "had", "must", "shall", "should", "will", "can", "may", "require", "requires", "required", "define",
    "defines", "defined", "mean", "means", "meant", "state", "states", "stated", "provide", "provides", "provided", "include", "includes", "included",
    "specify", "specifies", "specified", "establish", "establishes", "established", "determine", "determines", "determined", "involve", "involves",
    "involved", "prohibit", "prohibits", "prohibited", "allow", "allows", "allowed", "mandate", "mandates", "mandated", "recommend", "recommends",
    "recommended", "demonstrate", "demonstrates", "demonstrated", "indicate", "indicates", "indicated", "reduce", "reduces", "reduced", "increase",
    "increases", "increased", "show", "shows", "showed", "shown", "suggest", "suggests", "suggested", "represent", "represents", "represented", "consist",
    "consists", "consisted", "produce", "produces", "produced", "operate", "operates", "operated", "support", "supports", "supported", "use", "uses",
    "used", "need", "needs", "needed", "achieve", "achieves", "achieved", "exceed", "exceeds", "exceeded", "fail", "fails", "failed", "improve",
    "improves", "improved", "decline", "declines", "declined", "result", "results", "resulted", "maintain", "maintains", "maintained",
)
#: Fixed value.
STRONG_KEYWORDS = ("is defined as", "means", "refers to", "must", "shall", "is required", "mandatory", "prohibited", "policy states", "regulation requires", "standard requires")
#: Fixed value.
WEAK_KEYWORDS = ("for example", "e.g.", "such as", "for instance", "note that", "consider", "typically")
#: Fixed value. Words at which a proposition's entity ends.
VERB_MARKERS = (
    "is", "are", "was", "were", "has", "have", "had", "shows", "showed", "indicates", "indicated", "demonstrates", "demonstrated", "reveals", "revealed",
    "improved", "declined", "increased", "decreased", "reduced", "exceeded", "failed", "succeeded", "requires", "required", "provides", "provided",
    "maintains", "maintained", "supports", "supported", "dropped", "rose", "fell", "grew", "gained", "struggled", "achieved", "produced", "generated",
    "offset", "surpassed", "led", "caused", "resulted", "remained", "became", "experienced",
)
#: Fixed value.
POSITIVE = (
    "increased", "improved", "succeeded", "enhanced", "boosted", "gained", "rose", "grew", "strengthened", "effective", "efficient", "successful",
    "positive", "benefit", "offset", "maintained", "stable", "robust", "thrived", "narrowed", "recovered", "transformed", "favorable", "accelerated",
    "expanded", "optimized",
)
#: Fixed value.
NEGATIVE = (
    "declined", "failed", "worsened", "struggled", "insufficient", "inadequate", "minimal", "limited", "partial", "fell", "deteriorated", "collapsed",
    "stalled", "stagnated", "underperformed", "disrupted", "inconsistent", "uncertain", "complicated", "widened", "concentrated", "unstable",
)
#: Fixed value.
HEDGES = (
    "suggested", "partially", "some", "somewhat", "may", "could", "might", "possibly", "potentially", "appears", "seems", "approximately", "roughly",
    "about",
)
#: Fixed value.
CERTAIN = (
    "demonstrated", "confirmed", "proved", "established", "clearly", "significantly", "definitively", "conclusively", "states", "shows", "reveals",
    "indicates",
)
#: Fixed value.
SPECULATIVE = ("predict", "forecast", "expect", "anticipate")
#: Fixed value.
NEGATIONS = ("not ", "no ", "never ", "neither ", "nor ", "didn't", "doesn't", "don't", "won't", "can't", "failed to", "unable to", "lack of")
#: Fixed value.
STRONG_NEGATIVE = ("failed", "declined", "worsened", "insufficient", "collapsed", "struggled", "deteriorated", "inadequate")
#: Fixed value.
STRONG_POSITIVE = ("succeeded", "improved", "enhanced", "thrived", "exceeded expectations")
#: Fixed value.
ENTITY_STOPWORDS = ("the", "a", "an", "of", "in", "to", "for", "and", "is")
#: Fixed value.
ATTRIBUTE_STOPWORDS = (*ENTITY_STOPWORDS, "was", "were", "are")
#: Fixed value.
CAUSAL = ("because", "due", "caused", "resulted", "driven", "attributed", "owing")
#: Fixed value.
OUTCOME_POSITIVE = r"(?i)\b(offset|exceeded|surpassed|improved|gained|achieved|successful|effective|dropped significantly|reduced)\b"
#: Fixed value.
OUTCOME_NEGATIVE = r"(?i)\b(exceeded costs|failed|struggled|insufficient|minimal improvement|showed minimal|underperformed|inadequate|only partial|partially)\b"
#: Fixed value.
CAPABLE = r"(?i)\b(automatically|seamlessly|efficiently|reliably|successfully|maintained service|redistributed|adapted)\b"
#: Fixed value.
INCAPABLE = r"(?i)\b(struggled to|failed to|unable to|could not|only partial|partially|manually|required intervention)\b"
#: Fixed value. Unordered pairs of modalities whose claims can contradict each other.
COMPARABLE = (
    ("MANDATORY", "MANDATORY"),
    ("MANDATORY", "PROHIBITED"),
    ("MANDATORY", "RECOMMENDED"),
    ("PROHIBITED", "PROHIBITED"),
    ("PROHIBITED", "RECOMMENDED"),
    ("RECOMMENDED", "RECOMMENDED"),
    ("OPTIONAL", "OPTIONAL"),
    ("INFORMATIONAL", "INFORMATIONAL"),
)
#: Fixed value.
MODALITY_WEIGHTS = {"MANDATORY": 1.5, "PROHIBITED": 1.5, "RECOMMENDED": 1.2, "OPTIONAL": 0.8}
