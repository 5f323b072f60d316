"""Language identification by a blended-spectrum string kernel.

A text is the set of hashed 1- to 4-byte n-grams that occur in it; the kernel of two texts is the size of
the common set over the root of the product of both sizes.  Landmarks approximate the kernel (Nyström), a
one-versus-rest ridge regression on the approximation gives the classes.  Scores are two matrix products,
presence by landmarks and landmarks by classes; the second is done once, and a batch of texts takes the
product of its sparse presence with the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm import textbuf as tb
from factloom.llm.common import arrow_map

#: Buckets of n-gram hashes (16 bits of hash).
BUCKETS = 1 << 16
#: Labelled documents of all languages together that the model is fitted on, and landmarks among them (two a language at least).
SAMPLE = 6000
LANDMARKS = 96
#: Rows whose flags are laid out at once.
ROWS = 128
RIDGE = 1e-3
#: Sharpness of the score.
SHARP = 6.0
UNKNOWN = "und"


def presence(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted buckets whose n-grams occur in each text, and their row bounds.  A-Z are lower-cased."""
    low = tb.LOWER[data]
    rows = len(bounds) - 1
    flags = np.zeros(rows * BUCKETS, np.uint8)
    owner = np.repeat(np.arange(rows, dtype=np.int64) * BUCKETS, np.diff(bounds))
    code = np.zeros(len(low), np.uint32)
    for n in range(1, 5):
        size = len(low) - n + 1
        if size <= 0:
            break
        code = (code[:size] << np.uint32(8)) | low[n - 1 : n - 1 + size]
        bucket = ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(16)
        at = owner[:size] + bucket
        if n > 1:
            at = at[owner[:size] == owner[n - 1 : n - 1 + size]]
        flags[at] = 1
    at = np.flatnonzero(flags)
    return (at % BUCKETS).astype(np.uint16), np.searchsorted(at, np.arange(rows + 1) * BUCKETS)


def products(table: np.ndarray, buckets: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Presence rows, over the root of their sizes, times a table by bucket."""
    total = np.zeros((len(cut) - 1, table.shape[1]))
    full = np.flatnonzero(np.diff(cut))
    if len(full):
        total[full] = np.add.reduceat(table[buckets], cut[full], axis=0)
    return total / np.sqrt(np.maximum(np.diff(cut), 1))[:, None]


@dataclass
class LanguageModel:
    """``weights``: buckets by classes, the product of the landmarks with their weights."""

    classes: list[str]
    weights: np.ndarray

    def scores(self, buckets: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return products(self.weights, buckets, cut)


def fit_language_model(sets: list[np.ndarray], langs: list[str], landmarks: int = LANDMARKS) -> LanguageModel:
    """Fit on sets of buckets.  Landmarks are taken from the classes in turn, in the rows' order."""
    classes = sorted(set(langs))
    if not classes:
        return LanguageModel([], np.zeros((BUCKETS, 0)))
    by = {c: [k for k, lang in enumerate(langs) if lang == c] for c in classes}
    most = max(landmarks, 2 * len(classes))
    chosen = [by[c][k] for k in range(max(map(len, by.values()))) for c in classes if k < len(by[c])][:most]
    z = np.zeros((BUCKETS, len(chosen)))
    for k, row in enumerate(chosen):
        z[sets[row], k] = 1 / np.sqrt(max(1, len(sets[row])))
    phi = np.concatenate([products(z, np.concatenate(sets[k : k + ROWS]), np.concatenate(([0], np.cumsum([len(s) for s in sets[k : k + ROWS]])))) for k in range(0, len(sets), ROWS)])
    values, vectors = np.linalg.eigh(phi[chosen])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # landmarks to Nyström features
    phi = phi @ root
    y = np.array([[1.0 if lang == c else -1.0 for c in classes] for lang in langs])
    weight = 1.0 / np.sqrt(np.array([len(by[lang]) for lang in langs], float))[:, None]
    a = (phi * weight).T @ (phi * weight) + RIDGE * weight.mean() ** 2 * len(langs) * np.eye(phi.shape[1])
    w = np.linalg.solve(a, (phi * weight).T @ (y * weight))
    return LanguageModel(classes, z @ (root @ w))


def held_out(doc_id: Column) -> Column:
    """One fifth of the ids, which no model learns from; a null id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, limit: int = SAMPLE) -> tuple[list[np.ndarray], list[str]]:
    """Bucket sets and languages of at most ``limit`` learnable rows, as many of each language as there are or fit."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    each = max(1, limit // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * each / n + 20 / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    some = known.filter(draw < F.element_at(share, F.col("lang")))

    def flags(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in tb.slices(batch, "text"):
            for k in range(0, part.num_rows, ROWS):
                cut = bounds[k : k + ROWS + 1]
                buckets, edge = presence(data[cut[0] : cut[-1]], cut - cut[0])
                rows = part.slice(k, ROWS)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([buckets[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())], ["lang", "draw", "flags"])

    found = arrow_map(some.select("lang", F.xxhash64(F.lit("langid"), "doc_id").alias("draw"), "text"), flags, "lang string, draw long, flags binary")
    kept = found.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "flags"))).filter(F.col("k") <= each)
    rows = sorted(kept.select("lang", "draw", "flags").collect(), key=lambda r: (r["draw"], r["lang"], bytes(r["flags"])))
    return [np.frombuffer(r["flags"], np.uint16) for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its text alone.

    ``und`` with score 0 for a null text and one without letters, and where nothing was learned.  Ties go
    to the class that sorts first; equal texts get equal predictions; other columns are ignored.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in tb.slices(batch, "text"):
            names, scores = [], []
            for k in range(0, part.num_rows, ROWS):
                cut = bounds[k : k + ROWS + 1]
                some = data[cut[0] : cut[-1]]
                best, score = _best(model, some, cut - cut[0])
                names += best
                scores.append(score)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return arrow_map(chosen, each, "doc_id long, held_out boolean, lang_pred string, score double")


def _best(model: LanguageModel, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
    n = len(bounds) - 1
    ascii_ = (data | 0x20) - 0x61 < 26
    letters = tb.row_sums(ascii_, bounds) > 0
    for r in np.flatnonzero(~letters & (tb.row_sums(data >= 0x80, bounds) > 0)).tolist():
        letters[r] = any(map(str.isalpha, data[bounds[r] : bounds[r + 1]].tobytes().decode("utf-8", "replace")))
    if not model.classes:
        return [UNKNOWN] * n, np.zeros(n)
    scores = model.scores(*presence(data, bounds))
    top = scores.argmax(axis=1)
    odds = np.exp(SHARP * (scores - scores.max(axis=1, keepdims=True)))
    score = np.round(odds[np.arange(n), top] / odds.sum(axis=1), 6)
    return [model.classes[t] if ok else UNKNOWN for t, ok in zip(top.tolist(), letters.tolist())], np.where(letters, score, 0.0)


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on the table's learnable rows and predict every row."""
    return identify(docs, fit_language_model(*labelled_sample(docs)))
