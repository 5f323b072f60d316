"""Quality rules with risk-controlled thresholds.

Every text gets rule features.  A score of badness is fitted on a bounded sample of labelled documents; the
cutoff of each stratum (language) is the lowest on a fixed grid for which an exact binomial bound on all
held-out good documents that the base rules keep proves that the score rejects at most ``RISK`` of such
documents.  Cutoffs are tested from the highest down and the first failure ends the sequence (so the tests
of a stratum need no correction); strata share the error probability equally (Bonferroni).  Strata with
too few holdouts to prove anything even alone are not tested and reject by the base rules only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textbuf as tb
from factloom.llm.common import arrow_map, materialize
from factloom.llm.fit import logistic, predict
from factloom.llm.line_dedup import line_spans

#: Good documents that a stratum's rule may reject, and the probability that any stratum's rule rejects more.
RISK = 0.01
ERROR = 0.05
#: One in so many labelled documents is fitted on, ``SAMPLE`` at most; all other labelled ones are holdouts.
FITTED = 10
SAMPLE = 20_000
#: Cutoffs that are tested.
GRID = 200

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_short", "n_lines", "n_distinct")
WINDOW = 8


def _duplicates(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the items that an earlier one of their row equals, and of those that any other one equals."""
    key = tb.mix(hashes ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    later, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return later, any_


def text_features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` counts for each text.  Words are ``[^\\x20\\x09-\\x0D]+`` as they stand."""
    rows = len(bounds) - 1
    starts, ends = tb.runs(tb.NOT_SPACE[data], bounds)
    first = tb.rows_of(starts, bounds)
    words = tb.span_hashes(data, starts, ends)
    point = (data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(point)))
    lengths = points[ends] - points[starts]
    lines_a, lines_b, lines = line_spans(data, bounds)
    held = np.searchsorted(starts, lines_b) > np.searchsorted(starts, lines_a)
    line_rows = tb.row_ids(lines)[held]
    later, _ = _duplicates(tb.span_hashes(data, lines_a[held], lines_b[held], 3), line_rows)
    windows, inner = tb.window_hashes(words, first, WINDOW)
    window_rows = tb.row_ids(inner)
    _, twice = _duplicates(windows, window_rows)
    at = (np.arange(len(windows)) - inner[window_rows] + first[window_rows])[twice]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    seen, _ = _duplicates(words, tb.row_ids(first))
    return np.stack(
        [
            np.diff(first),
            tb.row_sums(lengths, first),
            tb.row_sums(SYMBOLS[data], bounds),
            np.bincount(line_rows[later], minlength=rows),
            tb.row_sums(np.cumsum(cover[:-1]) > 0, first),
            tb.row_sums((data >= 0x41) & (data <= 0x5A), bounds),
            tb.row_sums(lengths <= 3, first),
            np.diff(lines),
            tb.row_sums(~seen, first),
        ],
        axis=1,
    )


def model_inputs(counts: np.ndarray) -> np.ndarray:
    """Rates of the counts, on scales of like size."""
    n_words, chars, symbols, dup, repeat, upper, short, lines, distinct = (counts[:, k].astype(float) for k in range(len(FEATURES)))
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    rates = np.stack([symbols / c, dup / np.maximum(lines, 1), repeat / w, upper / c, short / w, distinct / w, chars / w / 10, np.log1p(n_words) / 5], axis=1)
    return np.hstack([rates, np.sqrt(rates[:, :4]), rates[:, 4:6] ** 2, np.abs(rates[:, 4:5] - 0.5)])


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])


def binomial_tail(failures: int, trials: int, rate: float) -> float:
    """The probability of at most so many failures: the incomplete beta function by its continued fraction."""
    if failures >= trials or rate <= 0:
        return 1.0
    if rate >= 1:
        return 0.0
    a, b, x = float(trials - failures), failures + 1.0, 1.0 - rate
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, 1.0 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    value = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value


def binomial_upper(failures: int, trials: int, error: float) -> float:
    """The exact (Clopper-Pearson) upper bound: the rate at which so few failures have probability ``error``."""
    if failures >= trials:
        return 1.0
    low, high = failures / trials, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        if binomial_tail(failures, trials, middle) > error:
            low = middle
        else:
            high = middle
    return high


def least_trials(risk: float, error: float) -> int:
    """Holdouts below which not even no failure at all proves the risk."""
    return math.ceil(math.log(error) / math.log1p(-risk))


def certified(rejected: np.ndarray, trials: int, risk: float, error: float) -> int:
    """The lowest certified grid step, ``len(rejected)`` if none: ``rejected[g]`` good holdouts score step g or more."""
    best = len(rejected)
    for g in range(len(rejected) - 1, -1, -1):
        if trials == 0 or rejected[g] > risk * trials or binomial_tail(int(rejected[g]), trials, risk) > error:
            break
        best = g
    return best


@dataclass
class QualityModel:
    """Weights of the score and the grid step from which each stratum rejects.

    A stratum without a certified cutoff, or without holdouts, rejects by the base rules only.
    """

    weights: np.ndarray
    cutoffs: dict[str | None, int]

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return predict(model_inputs(counts), self.weights)

    def verdict(self, counts: np.ndarray, strata: list[str | None]) -> np.ndarray:
        cut = np.array([self.cutoffs.get(s, GRID) for s in strata], np.int64)
        return ~base_failed(counts) & (grid_step(self.scores(counts)) < cut)


def grid_step(scores: np.ndarray) -> np.ndarray:
    return np.minimum((scores * GRID).astype(np.int64), GRID - 1)


def _counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """All columns but the text (the last), then the features."""
    for part, data, bounds in tb.slices(batch, batch.schema.names[-1]):
        counts = text_features(data, bounds)
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(counts[:, k]) for k in range(len(FEATURES)))], [*batch.schema.names[:-1], *FEATURES])


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum`` and the features of every row; a null text has none of anything but one line."""
    schema = ", ".join(["doc_id long, stratum string", *(f"{f} long" for f in FEATURES)])
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("stratum"), "text"), _counts, schema)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(f)).to_numpy() for f in FEATURES], axis=1)


def fit_quality(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, sample: int = SAMPLE) -> QualityModel:
    """Fit the score and certify the cutoffs from a table of ``features`` and labels ``(doc_id, quality 0/1)``.

    The score learns from one in ``FITTED`` labelled documents, ``sample`` at most, chosen by hash of doc_id; all
    other good ones that the base rules keep are counted by stratum and grid step for the bounds.  Repeated
    labels of a doc_id count once (the better one), repeated rows of a labelled doc_id each count; null labels
    and null doc_ids do not.  Strata are certified on the executors; what comes back is one number for each
    certified stratum, at most one for every ``least_trials`` (299 by default) labelled documents.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    draw = F.xxhash64(F.lit("quality"), "doc_id")
    part = F.pmod("d", F.lit(FITTED)) == 0
    edge = known.select(draw.alias("d")).filter(part).orderBy("d").limit(sample).agg(F.max("d")).first()[0]
    labelled = materialize(rows.join(known, "doc_id").withColumn("d", draw), "labelled")
    fitted = part & (F.col("d") <= F.lit(edge if edge is not None else 0))
    train = labelled.filter(fitted).orderBy("d", *FEATURES).limit(sample).select("quality", *FEATURES).toPandas()
    counts = train[list(FEATURES)].to_numpy(np.int64).reshape(-1, len(FEATURES))
    y = (train["quality"].to_numpy() == 0).astype(float)
    inside = ~base_failed(counts)
    width = model_inputs(np.zeros((1, len(FEATURES)), np.int64)).shape[1]
    weights = logistic(model_inputs(counts[inside]), y[inside], 0.1) if 0 < y[inside].sum() < inside.sum() else np.append(np.zeros(width), -9.0)
    scorer = QualityModel(weights, {})

    def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = _matrix(batch)
        keep = pa.array(~base_failed(counts))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("stratum")), pa.array(grid_step(scorer.scores(counts)))], ["stratum", "step"]).filter(keep)

    good = arrow_map(labelled.filter(~fitted & (F.col("quality") == 1)).select("stratum", *FEATURES), steps, "stratum string, step long")
    table = materialize(good.groupBy("stratum", "step").agg(F.count("*").alias("n")), "steps")
    sizes = table.groupBy("stratum").agg(F.sum("n").alias("trials")).filter(F.col("trials") >= least_trials(risk, error))
    tested = sizes.count()

    def cutoff(key: tuple, group: pa.Table) -> pa.Table:
        n = np.zeros(GRID, np.int64)
        np.add.at(n, group.column("step").to_numpy(), group.column("n").to_numpy())
        cut = certified(np.cumsum(n[::-1])[::-1], int(n.sum()), risk, error / tested)
        return pa.table({"stratum": pa.array([key[0].as_py()], pa.string()), "cut": pa.array([cut], pa.int64())})

    chosen = table.join(sizes.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s"))).select("stratum", "step", "n")
    found = chosen.groupBy("stratum").applyInArrow(cutoff, "stratum string, cut long").filter(F.col("cut") < GRID)
    scorer.cutoffs = {r["stratum"]: r["cut"] for r in found.collect()}
    return scorer


def apply_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Contract columns and score of every row."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = _matrix(batch)
        strata = batch.column(batch.schema.get_field_index("stratum")).to_pylist()
        columns = [*batch.columns[:2], *(pa.array(counts[:, k]) for k in range(5)), pa.array(base_failed(counts)), pa.array(model.verdict(counts, strata)), pa.array(np.round(model.scores(counts), 6))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "stratum", *FEATURES[:5], "base_failed", "kept", "score"])

    return arrow_map(docs, each, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features and verdict of every row: ``doc_id, n_words, .., base_failed, kept`` and the score.

    A null text has no word and fails the base rules.  A null language is a stratum of its own.  Rows may
    repeat; a label counts for all rows of its doc_id; without labels only the base rules reject.
    Columns other than ``doc_id, text, lang`` are ignored; an empty table gives an empty result.
    """
    rows = materialize(features(docs), "features")
    return apply_quality(rows, fit_quality(rows, labels)).drop("stratum")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the rules keep, with all their columns; texts take part in no shuffle."""
    model = fit_quality(materialize(features(docs), "features"), labels)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in tb.slices(batch, batch.schema.names[text]):
            kept = model.verdict(text_features(data, bounds), [None if s is None else str(s) for s in part.column(lang).to_pylist()])
            yield part.filter(pa.array(kept))

    return arrow_map(docs, each, docs.schema)

