"""Quality metrics of classifiers and retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _guarded(a: Column, b: Column, digits: int = 4) -> Column:
    return F.round(F.when(b > 0, a / F.greatest(b, F.lit(1e-300))).otherwise(0.0), digits)


def _f1(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [_guarded(tp, tp + fp).alias("precision"), _guarded(tp, tp + fn).alias("recall"), _guarded(2 * tp, 2 * tp + fp + fn).alias("f1")]


def precision_recall(rows: DataFrame) -> DataFrame:
    """One row of precision, recall and F1 of rows (truth, predicted: booleans)."""
    out = rows.agg(F.count_if(F.col("truth") & F.col("predicted")).alias("tp"), F.count_if(~F.col("truth") & F.col("predicted")).alias("fp"), F.count_if(F.col("truth") & ~F.col("predicted")).alias("fn"))
    return out.select("tp", "fp", "fn", *_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion_matrix(rows: DataFrame, labels: list[str]) -> DataFrame:
    """truth, predicted, n for all pairs of labels, zeros included."""
    grid = rows.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "truth string, predicted string")
    return grid.join(rows.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("_n")), ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("_n", F.lit(0)).alias("n"))


def multiclass_report(rows: DataFrame) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of each class, and a row `macro` with their means and the accuracy as tp over all."""
    each = rows.select(F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("label"), "truth", "predicted")
    t, p = F.col("truth") == F.col("label"), F.col("predicted") == F.col("label")
    counts = each.groupBy("label").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    out = counts.select("label", "tp", "fp", "fn", *_f1(F.col("tp"), F.col("fp"), F.col("fn")))
    macro = out.agg(F.lit("macro").alias("label"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), *(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")))
    return out.unionByName(macro)


def accuracy_by(rows: DataFrame, key: str) -> DataFrame:
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("truth") == F.col("predicted")).alias("correct"))
    return out.withColumn("accuracy", _guarded(F.col("correct"), F.col("total")))


def ranks(scored: DataFrame) -> DataFrame:
    """query_id and rank of the relevant item of scored (query_id, item_id, score, relevant)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    return scored.withColumn("rank", rank.cast("long")).where("relevant").groupBy("query_id").agg(F.min("rank").alias("rank"))


def retrieval_metrics(ranked: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Mean reciprocal rank and recall at some depths of (query_id, rank)."""
    return ranked.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(1 / F.col("rank")), 4).alias("mrr"), *(F.round(F.avg((F.col("rank") <= k).cast("double")), 4).alias(f"recall_{k}") for k in at))


def quality_ratios(rows: DataFrame) -> DataFrame:
    """Coverage, detection rate and mean confidence of rows (scanned, detected: booleans, confidence)."""
    out = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("scanned").alias("scanned"), F.count_if(F.col("scanned") & F.col("detected")).alias("detected"), F.avg(F.when(F.col("detected"), F.col("confidence"))).alias("_c"))
    return out.select("total", "scanned", "detected", _guarded(F.col("scanned"), F.col("total")).alias("coverage"), _guarded(F.col("detected"), F.col("scanned")).alias("detection_rate"), F.round(F.coalesce("_c", F.lit(0.0)), 4).alias("mean_confidence"))


def _row(cells) -> str:
    """Cells as a row of a Markdown table."""
    return f"| {' | '.join(map(str, cells))} |"


def _rule(widths) -> str:
    """The line between a table's head and its rows."""
    return f"|{'|'.join('-' * w for w in widths)}|"


def report_lines(report: DataFrame) -> DataFrame:
    """label and line: the rows of a multiclass report as rows of a Markdown table."""
    figures = [F.format_string("%.4f", c) for c in ("precision", "recall", "f1")]
    support = (F.col("tp") + F.col("fn")).cast("string")
    return report.select("label", F.concat(F.lit("| "), F.concat_ws(" | ", "label", *figures, support), F.lit(" |")).alias("line"))


#: The report's headings and the names of its figures and columns.
HEADINGS = ("# {}", "## Confusion Matrix")
FIGURES = ("**Accuracy:** {:.4f}", "**Macro F1:** {:.4f}", "**Samples:** {}")
COLUMNS = ("Class", "Precision", "Recall", "F1", "Support")
CORNER = "True \\ Pred"


def markdown_report(report: DataFrame, matrix: DataFrame, title: str = "Evaluation Report") -> str:
    """A multiclass report and its confusion matrix as Markdown text; both have a row or a cell for each label, so they are small."""
    lines = {r["label"]: r["line"] for r in report_lines(report).collect()}
    counts = {(r["truth"], r["predicted"]): r["n"] for r in matrix.collect()}
    labels, total = sorted({k for pair in counts for k in pair}), sum(counts.values())
    accuracy, macro = sum(counts.get((k, k), 0) for k in labels) / max(total, 1), report.where("label = 'macro'").first()["f1"]
    classes = [_row(COLUMNS), _rule(max(len(c), 3) + 2 for c in COLUMNS), *(lines[k] for k in labels if k in lines)]
    grid = [_row([CORNER, *labels]), _rule([3] * (len(labels) + 1)), *(_row([a, *(counts.get((a, b), 0) for b in labels)]) for a in labels)]
    head = [line.format(x) for line, x in zip(FIGURES, (accuracy, macro, total), strict=True)]
    return "\n".join([HEADINGS[0].format(title), "", *head, "", *classes, "", HEADINGS[1], "", *grid])
