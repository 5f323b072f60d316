"""Toxicity by a classifier chain of linear models over word presence.

Categories are predicted in order; each later model also sees the probabilities of the earlier ones.  In
training those probabilities are out-of-fold predictions, so a later model meets what it will meet in use.

Where the labels have columns for categories, these are the first links.  Else they are graded from the one
label: a toxic document is ``explicit`` if it holds a word that tells toxic documents apart, ``severe`` if it
holds two, where such words are found on the other folds.  The last link is ``toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textbuf as tb
from factloom.llm.common import arrow_map
from factloom.llm.fit import logistic, predict

#: Labelled documents that the chain is fitted on, and words that become features.
SAMPLE = 12_000
WORDS = 256
FOLDS = 3
#: Share of non-toxic training documents that out-of-fold predictions may flag.
FALSE_ALARMS = 0.002

#: Links before ``toxic`` where the labels name no category, with the telling words that each asks for.
GRADES = {"explicit": 1, "severe": 2}


def word_hashes(words: list[str]) -> np.ndarray:
    data, bounds = tb.column_bytes(pa.array(words, pa.string()))
    return tb.span_hashes(data, bounds[:-1], bounds[1:], 21)


def document_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters, digits and non-ASCII, A-Z lower-cased), and their row bounds."""
    low = tb.LOWER[data]
    starts, ends = tb.runs(tb.ALNUM[low], bounds)
    return tb.span_hashes(low, starts, ends, 21), tb.rows_of(starts, bounds)


@dataclass
class Chain:
    """Sorted word hashes, one weight vector for each category, and the probability from which a text is toxic."""

    words: np.ndarray
    weights: list[np.ndarray]
    threshold: float
    categories: tuple[str, ...] = (*GRADES, "toxic")

    def features(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first) - 1, len(self.words)), np.float32)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == hashes)
            out[np.searchsorted(first, hit, side="right") - 1, at[hit]] = 1
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.weights)))
        for k, w in enumerate(self.weights):
            out[:, k] = predict(np.hstack([x, out[:, :k]]), w)
        return out


def _copies(sets: list[np.ndarray]) -> np.ndarray:
    """Marks documents that share four minima of word hashes with an earlier one: they are no further evidence."""
    seen: set[tuple] = set()
    out = np.zeros(len(sets), bool)
    for k, s in enumerate(sets):
        key = tuple(int(tb.mix(s ^ np.uint64(c * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min()) for c in range(1, 5)) if len(s) else ()
        out[k] = key in seen
        seen.add(key)
    return out


def telling_words(sets: list[np.ndarray], y: np.ndarray, words: int) -> np.ndarray:
    """The words with the highest lower bound of log odds between toxic and other documents, in the order of their hashes."""
    positive = [s for s, t in zip(sets, y) if t]
    if not positive:
        return np.zeros(0, np.uint64)
    names, hits = np.unique(np.concatenate(positive), return_counts=True)
    others = np.sort(np.concatenate([np.zeros(0, np.uint64), *(s for s, t in zip(sets, y) if not t)]))
    misses = np.searchsorted(others, names, side="right") - np.searchsorted(others, names, side="left")
    n1, n0 = len(positive), max(1, int((~y).sum()))
    odds = np.log((hits + 0.5) / (n1 + 1)) - np.log((misses + 0.5) / (n0 + 1)) - 1.64 * np.sqrt(1 / (hits + 0.5) + 1 / (misses + 0.5))
    best = np.argsort(-odds, kind="stable")[:words]
    return np.sort(names[best[(odds[best] > 0.5) & (hits[best] >= 3)]])


def fit_chain(sets: list[np.ndarray], toxic: np.ndarray, folds: np.ndarray, words: int = WORDS, named: dict[str, np.ndarray] | None = None) -> Chain:
    """Fit on documents' sets of word hashes; ``named`` has the labels of categories of their own.

    Near copies count once for the choice of words and all for the weights.  Out-of-fold inputs and grades use
    words that the other folds choose.  Ties of words are broken by hash.  Documents without words are rows
    without features.  Without toxic documents, or without others, the chain is constant.
    """
    y = toxic.astype(bool)
    categories = (*(named or GRADES), "toxic")
    if not y.any() or y.all():
        constant = -9.0 if not y.any() else 9.0
        return Chain(np.zeros(0, np.uint64), [np.append(np.zeros(k), constant) for k in range(len(categories))], 0.5, categories)
    once = ~_copies(sets)

    def telling(rows: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(rows & once)
        return telling_words([sets[k] for k in some.tolist()], y[some], words)

    chain = Chain(telling(np.ones(len(y), bool)), [], 0.5, categories)
    x = chain.features(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))).astype(float)
    # by fold: the words that the others choose, among the features of all
    known = [np.isin(chain.words, telling(folds != f)) for f in range(FOLDS)]
    held = np.array([x[k, known[f]].sum() for k, f in enumerate(folds)])
    targets = [np.asarray(t, bool) for t in named.values()] if named else [y & (held >= n) for n in GRADES.values()]
    earlier = np.zeros((len(x), 0))
    for target in [*targets, y]:
        outside = np.zeros(len(x))
        for f in range(FOLDS):
            test = folds == f
            if test.any() and (~test).any():
                inputs = np.hstack([x * known[f], earlier])
                outside[test] = predict(inputs[test], logistic(inputs[~test], target[~test]))
        chain.weights.append(logistic(np.hstack([x, earlier]), target))
        earlier = np.hstack([earlier, outside[:, None]])
    clean = np.sort(earlier[~y, -1])
    chain.threshold = float(min(0.9, max(0.5, clean[min(len(clean) - 1, int(np.ceil(len(clean) * (1 - FALSE_ALARMS))))])))
    return chain


def labelled_words(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, categories: tuple[str, ...] = ()) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Word sets, labels, folds and named categories of the ``limit`` labelled documents with the smallest hashes of doc_id.

    Repeated labels of a doc_id count as toxic if one of them does; of repeated rows of a doc_id one counts.
    """
    draw = F.xxhash64(F.lit("toxicity"), "doc_id")
    marks = F.struct("toxic", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in categories))
    names = ["toxic", *categories]
    some = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(marks).alias("m")).select("doc_id", F.array(*(F.col(f"m.{c}").cast("int") for c in names)).alias("marks")).orderBy(draw, "doc_id").limit(limit)

    def sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in tb.slices(batch, "text"):
            hashes, first = document_words(data, bounds)
            values, cut = tb.distinct_by_row(hashes, first)
            packed = [values[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["doc_id", "marks", "words"])

    # the sample has `limit` rows at most, so it can be broadcast; the texts stay where they are
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("doc_id", "marks", "text")
    # rows of one doc_id may repeat: one of them counts, so that the sample stays within its limit
    found = arrow_map(chosen, sets, "doc_id long, marks array<int>, words binary").groupBy("doc_id").agg(F.max("marks").alias("marks"), F.min("words").alias("words"))
    rows = sorted(found.collect(), key=lambda r: r["doc_id"])
    folds = np.array([int(tb.mix(np.array([r["doc_id"]], np.int64).view(np.uint64))[0] % np.uint64(FOLDS)) for r in rows], np.int64)
    marked = np.array([r["marks"] for r in rows], np.int64).reshape(len(rows), len(names))
    return [np.frombuffer(r["words"], np.uint64) for r in rows], marked[:, 0], folds, {c: marked[:, k + 1] for k, c in enumerate(categories)}


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability for each category and ``is_toxic`` for every row.

    Null and empty texts have no word and get the base rates.  Equal texts get equal results, rows may
    repeat, other columns are ignored.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in tb.slices(batch, "text"):
            p = chain.probabilities(chain.features(*document_words(data, bounds)))
            columns = [pa.array(np.round(p[:, k], 6)) for k in range(p.shape[1])]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(p[:, -1] >= chain.threshold)], ["doc_id", *(f"p_{c}" for c in chain.categories), "is_toxic"])

    schema = ", ".join(["doc_id long", *(f"p_{c} double" for c in chain.categories), "is_toxic boolean"])
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, schema)


def toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """Fit the chain on the labelled documents and classify all; ``categories`` names 0/1 columns of the labels."""
    sets, toxic, folds, named = labelled_words(docs, labels, categories=categories)
    return classify(docs, fit_chain(sets, toxic, folds, named=named))
