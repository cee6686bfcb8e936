"""Secret scans: fixed patterns and a battery of randomness tests, in DataFrame operations only.

Base spans come from three patterns. Beyond them, every run of at least MIN_RUN letters, digits and `+ / _ -` is a candidate. Its encoding is inferred from the
characters it uses, and under the hypothesis of uniform random characters three tests give p-values: chi-squared of the alphabet's counts,
the number of runs above and below the alphabet's middle, and the correlation of neighbours. Their combined p-value (three times the
smallest) is high for random strings and tiny for words.

False discoveries are controlled by length class over the whole corpus: runs that are plain words (letters only, in one case or capitalised)
are decoys. In each class the lowest p-value is taken at which decoys are at most `rate` of the other candidates above it, and not below
FLOOR; candidates at or above it, not covered by a base span, are `random` spans. The histogram behind this has a fixed number of
cells, so it is all that reaches the driver, whatever the input's size; texts are not shuffled.

Positions are code points, ends exclusive. Nulls: a null text is empty and has no span. Repeated rows are scanned each; empty tables give
empty results. Other columns, whatever their names, are kept by `redact` and not touched by `scan`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: The patterns of the base kinds, in their order. A run of at least so many characters is the same as a long enough match.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
MIN_RUN = 20
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Lengths from which the classes begin.
CLASSES = (20, 28, 40, 64)
#: p-values are counted in cells of a tenth of a decimal power; a random string falls below FLOOR one time in a hundred.
CELLS, FLOOR = 200, 20
_MARK, _OTHER = "\u0001", "\u0002"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the pattern that a run must fit, the first that fits; then their alphabets.
ENCODINGS = (
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)


def _before(values: Column, combine) -> Column:
    """For each of the whole numbers what all before it combine to (from 0), in steps of the square root, so that no long array grows one by one."""

    def scan(values: Column, first: Column) -> Column:
        step = lambda acc, x: F.struct(combine(acc["now"], x).alias("now"), F.concat(acc["all"], F.array(acc["now"])).alias("all"))
        return F.aggregate(values, F.struct(first.alias("now"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])

    def cut(values: Column) -> Column:
        width = F.greatest(F.lit(1), F.floor(F.sqrt(F.size(values)))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), width), lambda at: F.slice(values, at, width))

    def joined(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), combine))
        return F.flatten(F.zip_with(parts, scan(whole, F.lit(0)), scan))

    return _let(values, lambda v: _let(cut(v), joined))


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All matches as structs (start, kind, end, found).

    Matches are set between marks (which are replaced in the text by a character that no pattern knows), the text is split there, and the
    lengths of the pieces are summed; every second piece is a match.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,found:string>>")

    def found(piece: Column) -> Column:
        sizes = F.transform(piece, lambda p: F.length(p))
        match = lambda starts: F.transform(
            F.sequence(F.lit(1), F.size(piece) - 2, F.lit(2)),
            lambda i: F.struct(starts[i].alias("start"), F.lit(kind).alias("kind"), (starts[i] + F.length(piece[i])).alias("end"), piece[i].alias("found")),
        )
        return _let(_before(sizes, lambda a, x: a + x), match)

    return _let(pieces, lambda p: F.when(F.size(p) > 2, found(p)).otherwise(none))


def _tail(z: Column) -> Column:
    """Two-sided p-value of a standard normal value, by the logistic approximation."""
    x = F.least(F.abs(z), F.lit(60.0))
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * x + F.lit(0.070565992) * x * x * x))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))


def _tests(places: Column, k: Column) -> Column:
    """From the characters' places in an alphabet of k, counted from its middle."""
    n = F.size(places).cast("double")
    first, second = F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places) - 1)
    squares = _sum(F.array_distinct(places), lambda p: F.pow(F.size(F.filter(places, lambda q: q == p)).cast("double"), F.lit(2.0)))
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    changes = F.size(F.filter(F.zip_with(first, second, lambda a, b: (a > 0) != (b > 0)), lambda x: x)).cast("double")
    high = F.size(F.filter(places, lambda p: p > 0)).cast("double")
    runs = _let(2 * high * (n - high) / n, lambda m: F.when(m > 1, (changes - m) / F.sqrt(m * (m - 1) / (n - 1))).otherwise(F.sqrt(n)))

    def correlation(centre: Column) -> Column:
        spread = _sum(places, lambda p: (p - centre) * (p - centre))
        product = _sum(F.zip_with(first, second, lambda a, b: (a - centre) * (b - centre)), lambda x: x)
        return _let(spread, lambda v: F.when(v > 0, product / v * F.sqrt(n)).otherwise(F.sqrt(n)))

    serial = _let(_sum(places, lambda p: p) / n, correlation)
    return F.least(F.lit(1.0), 3 * F.least(_tail(chi), _tail(runs), _tail(serial)))


def randomness(run: Column) -> Column:
    """Combined p-value of a run of characters under uniform randomness."""
    body = F.regexp_replace(run, "=+$", "")
    whole = F.lit(_UPPER + _LOWER + _DIGITS + "+/-_")

    def placed(body: Column) -> Column:
        alphabet = reduce(lambda rest, x: F.when(body.rlike(x[0]), F.lit(x[1])).otherwise(rest), reversed(ENCODINGS), whole)
        return _let(alphabet, lambda a: _let(_places(body, a), lambda p: _tests(p, F.length(a).cast("double"))))

    return _let(body, placed)


def _places(body: Column, alphabet: Column) -> Column:
    middle = (F.length(alphabet) + 1) / 2
    return F.transform(F.array_remove(F.split(body, ""), ""), lambda c: F.call_function("instr", alphabet, c).cast("double") - middle)


def _length_class(start: Column, end: Column) -> Column:
    return reduce(lambda rest, i: F.when(end - start >= CLASSES[i], F.lit(i)).otherwise(rest), range(1, len(CLASSES)), F.lit(0))


def _candidates(text: Column) -> Column:
    """Runs as structs (start, end, cell of the p-value, length class, decoy)."""
    decoy = lambda x: x["found"].rlike("^([a-z]+|[A-Z]+|[A-Z][a-z]+)$")
    return F.transform(
        _matches(text, RUN, 3),
        lambda x: F.struct(
            x["start"].alias("start"),
            x["end"].alias("end"),
            F.least(F.lit(CELLS), F.floor(-10 * F.log10(F.greatest(randomness(x["found"]), F.lit(1e-30))))).cast("int").alias("cell"),
            _length_class(x["start"], x["end"]).alias("class"),
            decoy(x).alias("decoy"),
        ),
    )


def _clean(column: str) -> Column:
    return F.translate(F.coalesce(F.col(column), F.lit("")), _MARK, _OTHER)


def cuts(docs: DataFrame, text_col: str = "text", rate: float = 0.05) -> list[int]:
    """For each length class the highest cell that counts as random, or -1; from all documents."""
    runs = docs.select(_clean(text_col).alias("_text")).where(F.col("_text").rlike(RUN)).select(F.explode(_candidates(F.col("_text"))).alias("x"))
    cells = runs.where(F.col("x.cell") <= FLOOR).groupBy("x.class", "x.cell", "x.decoy").count().collect()
    out = []
    for k in range(len(CLASSES)):
        best, real, decoys = -1, 0, 0
        for cell in range(FLOOR + 1):
            real += sum(r["count"] for r in cells if (r["class"], r["cell"], r["decoy"]) == (k, cell, False))
            decoys += sum(r["count"] for r in cells if (r["class"], r["cell"], r["decoy"]) == (k, cell, True))
            if real and decoys <= rate * real:
                best = cell
        out.append(best)
    return out


def _spans(text: Column, highest: list[int]) -> tuple[Column, Column]:
    """Base spans and all spans, as arrays of structs (start, kind, end) in order."""
    short = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    assign = F.filter(_matches(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 1)) >= 6)
    base = F.array_sort(F.concat(*(F.transform(a, short) for a in (assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2)))))
    limit = F.array(*map(F.lit, highest))
    return base, F.filter(_candidates(text), lambda x: x["cell"] <= limit[x["class"]]) if max(highest) >= 0 else None


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text_col: str, highest: list[int], to: str) -> DataFrame:
    """docs and two columns, `to`_base and `to`_all: arrays of spans (start, kind, end)."""
    kind = "array<struct<start:int,kind:int,end:int>>"
    none = F.array().cast(kind)
    clean, first, new, whole = (f"{to}_{x}" for x in ("clean", "base", "new", "all"))
    text = F.col(clean)
    base, random = _spans(text, highest)
    some = text.rlike("|".join((ASSIGN, ACCESS, HEX)))
    out = docs.withColumn(clean, _clean(text_col)).withColumn(first, F.when(some, base).otherwise(none))
    if random is None:
        return out.withColumn(whole, F.col(first)).drop(clean)
    found = F.transform(
        F.filter(random, lambda x: ~F.exists(first, lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")),
    )
    out = out.withColumn(new, F.when(text.rlike(RUN), found).otherwise(none))
    return out.withColumn(whole, F.array_sort(F.concat(first, new))).drop(clean, new)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", highest: list[int] | None = None) -> DataFrame:
    """One row per document: counts of base kinds, the digest of the base spans and all spans as text."""
    highest = cuts(docs, text_col) if highest is None else highest
    rows = with_spans(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", highest, "_found")
    base = F.col("_found_base")
    counts = [F.size(F.filter(base, lambda x: x["kind"] == F.lit(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]  # noqa: B023
    return rows.select(F.col("_id").alias(id_col), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_found_all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", highest: list[int] | None = None, by: str = "[secret]") -> DataFrame:
    """docs with each span, or run of overlapping spans, replaced; size_col, if given, is the new length where the text has changed."""
    highest = cuts(docs, text_col) if highest is None else highest
    text, found = F.col(text_col), free_name(docs.columns, "found")
    spans, done = F.col(f"{found}_all"), f"{found}_done"

    def replaced(through: Column) -> Column:
        """through: how far the spans before each one reach."""
        pieces = F.zip_with(spans, through, lambda x, at: F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), F.lit(by))).otherwise(""))
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))

    through = _before(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    some = F.size(spans) > 0
    out = with_spans(docs, text_col, highest, found).withColumn(done, F.when(some, _let(through, replaced)).otherwise(text))
    changed = {text_col: F.col(done)}
    if size_col:
        changed[size_col] = F.when(some, F.length(done).cast(docs.schema[size_col].dataType)).otherwise(F.col(size_col))
    return out.withColumns(changed).select(*docs.columns)


def op8_secrets(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
