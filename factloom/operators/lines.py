"""Lines of texts: the line relation, width tiers, tabs, comment and Markdown exemptions, line classes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.extract import text_state
from factloom.operators.findings import diagnostics

#: Warning, discouraged and hard widths.
WIDTHS = (90, 100, 120)


def lines_of(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per line with its number from 1; the last line is kept if empty, a null text has none."""
    return texts.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def width_tier(width: Column, widths: tuple[int, int, int] = WIDTHS) -> Column:
    """The rule of the highest width exceeded, null if none."""
    warning, discouraged, hard = widths
    return F.when(width > hard, f"COMMON-LINE-{hard}").when(width > discouraged, f"COMMON-LINE-{discouraged}").when(width > warning, f"COMMON-LINE-{warning}")


def width_findings(lines: DataFrame, widths: tuple[int, int, int] = WIDTHS) -> DataFrame:
    """Findings for ``(path, line, width)`` rows that are too wide."""
    rule = width_tier(F.col("width"), widths)
    allowed = F.when(F.col("width") > widths[2], widths[2]).when(F.col("width") > widths[1], widths[1]).otherwise(widths[0])
    text = F.when(allowed == widths[2], F.concat(F.lit("Line exceeds the hard "), allowed, F.lit("-character limit."))).when(allowed == widths[1], F.concat(F.lit("Line exceeds the discouraged "), allowed, F.lit("-character limit."))).otherwise(F.concat(F.lit("Line exceeds the "), allowed, F.lit("-character warning threshold.")))
    rows = lines.withColumn("_rule", rule).filter("_rule is not null")
    return diagnostics(rows, rule_id=F.col("_rule"), path=F.col("path"), line=F.col("line"), column=allowed + 1, message=text, measured=F.col("width"), allowed=allowed, source=F.lit("common"))


def tab_findings(lines: DataFrame) -> DataFrame:
    """One finding per line with a tab, at the first one."""
    rows = lines.filter(F.instr("content", "\t") > 0)
    return diagnostics(rows, rule_id=F.lit("COMMON-NO-TABS"), path=F.col("path"), line=F.col("line"), column=F.instr("content", "\t"), message=F.lit("Tab characters are not allowed."), source=F.lit("common"))


STATE = "path string, line long, content string, width long, exempt boolean, blank boolean, comment boolean"


def line_states(files: DataFrame) -> DataFrame:
    """Lines of source files ``(path, language, text)`` with their effective width and what exempts them.

    The states (nested comments, strings, fences, tables) run through a whole file, so each file is
    folded once in Python; files are independent of each other.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "text"))):
                rows = text_state.states(language or "", text or "")
                columns = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds))], [f.split()[0] for f in STATE.split(", ")])

    return files.select("path", "language", "text").mapInArrow(fold, STATE)


def line_counts(files: DataFrame, lines: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Physical, blank, comment, code and source lines of each file.

    ``comments`` are further ``(path, line)`` of documentation.  A blank line within a comment counts
    as both, so code lines are what is left after taking away both counts.
    """
    marked = lines
    if comments is not None:
        doc = comments.select("path", "line").distinct().withColumn("_doc", F.lit(True))
        marked = lines.join(doc, ["path", "line"], "left").withColumn("comment", F.col("comment") | F.coalesce("_doc", F.lit(False)))
    last = marked.groupBy("path").agg(
        F.count("*").alias("n"),
        F.max_by("content", "line").alias("tail"),
        F.count_if("blank").alias("blank_all"),
        F.count_if("comment").alias("comment_lines"),
    )
    drop = F.when(F.col("tail") == "", 1).otherwise(0)
    joined = files.select("path", "language").join(last, "path", "left")
    physical = F.coalesce(F.col("n") - drop, F.lit(0))
    blank = F.coalesce(F.col("blank_all") - drop, F.lit(0))
    comment = F.coalesce("comment_lines", F.lit(0))
    return joined.select("path", "language", physical.alias("physical_lines"), (physical - blank).alias("source_lines"), (physical - blank - comment).alias("code_lines"), comment.alias("comment_lines"), blank.alias("blank_lines"))
