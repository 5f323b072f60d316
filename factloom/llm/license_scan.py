"""License scans: ordered signatures, keyword prefilter, priority and containment suppression."""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textbuf as tb
from factloom.llm.common import arrow_map
from factloom.llm.license_rules import Signature, signatures
from factloom.llm.toxicity import word_hashes

#: Phrases whose places are counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@functools.lru_cache(maxsize=1)
def _rules() -> tuple[list[Signature], np.ndarray, list[list[int]]]:
    """Signatures, the sorted hashes of their keywords, and the signatures of each keyword."""
    found = signatures()
    names = sorted({s.keyword for s in found})
    hashes = word_hashes(names)
    order = np.argsort(hashes)
    return found, hashes[order], [[k for k, s in enumerate(found) if s.keyword == names[i]] for i in order.tolist()]


def detections(text: str, candidates: list[int], rules: list[Signature]) -> list[tuple[int, int, Signature]]:
    """Matches of the candidate signatures in a text of blank-joined words, after suppression.

    Matches are taken by priority, then length, place and order of the signatures; one is suppressed if an
    accepted one contains it, or if both overlap and the accepted one has the smaller priority number.
    """
    hits = [(m.start(), m.end(), k) for k in candidates for m in rules[k].pattern.finditer(text)]
    kept = unsuppressed([(a, b, rules[k].priority, k) for a, b, k in hits])
    return sorted(((a, b, rules[k]) for a, b, _, k in kept), key=lambda h: (h[0], h[1], h[2].label))


def unsuppressed(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The accepted ones of the intervals ``(start, end, priority, order)``.

    A priority's intervals that overlap an accepted one of a smaller number are out; of the others those that
    no other contains are accepted, of equal ones the first.  One sweep for each priority: the time grows as
    n log n, however many detections a text has.
    """
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []
    ends: list[int] = []  # the union of what is accepted, as disjoint intervals in order
    by_priority: dict[int, list[tuple[int, int, int, int]]] = {}
    for hit in hits:
        by_priority.setdefault(hit[2], []).append(hit)
    for priority in sorted(by_priority):
        last, accepted = -1, []
        for hit in sorted(by_priority[priority], key=lambda h: (h[0], -h[1], h[3])):
            before = bisect.bisect_left(starts, hit[1]) - 1
            if before >= 0 and ends[before] > hit[0]:
                continue
            if hit[1] > last:
                accepted.append(hit)
                last = hit[1]
        kept += accepted
        every = sorted([*zip(starts, ends), *((a, b) for a, b, _, _ in accepted)])
        starts, ends = [], []
        for a, b in every:
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
    return kept


def _scan(data: np.ndarray, bounds: np.ndarray):
    """Words by text, places of the base phrases, and the detections of the texts that hold a keyword."""
    low = tb.LOWER[data]
    starts, ends = tb.runs(tb.ALNUM[low], bounds)
    hashes = tb.span_hashes(low, starts, ends, 21)
    first = tb.rows_of(starts, bounds)
    rows = len(bounds) - 1
    row = tb.row_ids(first)
    places = np.zeros(0, np.int64)
    label = np.zeros(0, np.int64)
    for k, phrase in enumerate(BASE):
        want = word_hashes(phrase.split())
        n = max(0, len(hashes) - len(want) + 1)
        hit = np.ones(n, bool)
        for j, h in enumerate(want):
            hit &= hashes[j : j + n] == h
        hit &= row[:n] == row[len(want) - 1 : len(want) - 1 + n]
        found = np.flatnonzero(hit)
        places, label = np.append(places, found), np.append(label, np.full(len(found), k))
    rules, keys, by_key = _rules()
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    has = np.flatnonzero(keys[at] == hashes)
    pairs = np.unique(np.stack([row[has], at[has]]), axis=1) if len(has) else np.zeros((2, 0), np.int64)
    raw = low.tobytes()
    found_rules: list[list[tuple[int, int, Signature]]] = [[] for _ in range(rows)]
    edge = np.searchsorted(pairs[0], np.arange(rows + 1))
    for r in np.flatnonzero(np.diff(edge)).tolist():
        a, b = first[r], first[r + 1]
        text = b" ".join([raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]).decode("utf-8")
        chosen = sorted(k for key in pairs[1][edge[r] : edge[r + 1]].tolist() for k in by_key[key])
        found_rules[r] = detections(text, chosen, rules)
    return first, row, places, label, found_rules


def _contract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    names = list(BASE.values())
    for part, data, bounds in tb.slices(batch, "text"):
        first, row, places, label, found = _scan(data, bounds)
        rows = len(bounds) - 1
        n_base = np.bincount(row[places], minlength=rows) if len(places) else np.zeros(rows, np.int64)
        low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
        if len(places):
            np.minimum.at(low, row[places], places - first[row[places]])
            np.maximum.at(high, row[places], places - first[row[places]])
        none = n_base == 0
        base: list[set[str]] = [set() for _ in range(rows)]
        for r, k in zip(row[places].tolist() if len(places) else [], label.tolist()):
            base[r].add(names[k])
        every = [base[r] | {s.label for _, _, s in found[r]} for r in range(rows)]
        score = [_score(base[r], found[r]) for r in range(rows)]
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(np.diff(first)),
                pa.array(n_base.astype(np.int64)),
                pa.array(low, mask=none),
                pa.array(high, mask=none),
                pa.array([",".join(sorted(b)) for b in base]),
                pa.array([",".join(sorted(e)) for e in every]),
                pa.array(score, pa.float64()),
                pa.array([len(f) for f in found], pa.int64()),
            ],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"],
        )


def _score(base: set[str], found: list[tuple[int, int, Signature]]) -> float:
    """Confidence of the strongest evidence: 1 for a base phrase, else by the best signature's priority."""
    if base:
        return 1.0
    return round(max((1.0 - s.priority / 100.0 for _, _, s in found), default=0.0), 6)


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: word count, places of the base phrases, base labels, all labels, score.

    A null or empty text has no word, no label (empty strings) and score 0.  Equal texts get equal rows;
    rows may repeat; ids may be null; other columns are ignored; an empty table gives an empty result.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _contract, schema)


def license_spans(docs: DataFrame) -> DataFrame:
    """One row per detection: ``doc_id, label, priority, first_word, n_words``; documents without one have none."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in tb.slices(batch, "text"):
            low = tb.LOWER[data]
            starts, ends = tb.runs(tb.ALNUM[low], bounds)
            first, _, _, _, found = _scan(data, bounds)
            rows, labels, priorities, begins, sizes = [], [], [], [], []
            for r, hits in enumerate(found):
                if not hits:
                    continue
                a, b = first[r], first[r + 1]
                # each word takes its characters and a blank
                ends_ = np.cumsum([len(low[x:y].tobytes().decode("utf-8")) + 1 for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())])
                for x, y, rule in hits:
                    begin = int(np.searchsorted(ends_, x, side="right"))
                    rows.append(r)
                    labels.append(rule.label)
                    priorities.append(rule.priority)
                    begins.append(begin)
                    sizes.append(int(np.searchsorted(ends_, y, side="left")) - begin + 1)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(labels, pa.string()), pa.array(priorities, pa.int64()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "label", "priority", "first_word", "n_words"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, label string, priority long, first_word long, n_words long")
