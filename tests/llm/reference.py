"""Slow and plain versions of the operators, written from their contracts alone."""

import hashlib
import math
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def similar(docs, threshold=70, roots=None):
    """(n_shingles, n_similar, component) of rows ``(doc_id, text)``, in order; ``roots`` gets the group of each row."""
    sets = [shingles(t) for _, t in docs]
    linked, root = defaultdict(set), list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                linked[i].add(j)
                linked[j].add(i)
                root[max(find(i), find(j))] = min(find(i), find(j))
    if roots is not None:
        roots += [find(k) for k in range(len(docs))]
    least = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[find(k)].append(i)
    return [(len(sets[k]), len(linked[k]), min(least[find(k)]) if least[find(k)] else None) for k in range(len(docs))]


def one_of_each(docs):
    """Rows ``(doc_id, text)`` that stay: of each group that of the smallest doc_id, then text; all without words."""
    roots = []
    sets = similar(docs, roots=roots)
    order = lambda r: (math.inf if r[0] is None else r[0], r[1] or "")
    groups = defaultdict(list)
    for row, (n, *_), root in zip(docs, sets, roots):
        groups[root if n else object()].append(row)
    return [min(g, key=order) for g in groups.values()]


def dedup(docs):
    """(n_lines, n_dropped, kept) by row."""
    key = lambda line: line.strip(BLANK).translate(LOWER)
    order = lambda i: math.inf if i is None else i
    owner = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            k = key(line)
            owner[k] = min(owner.get(k, math.inf), order(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] >= order(i)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_features(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def poisson(u, rate):
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else 1.0
        if u < total or k > 400:
            return k
        k += 1


def mixed(docs, temperature=0.5, seed="mix"):
    """Copies of rows ``(doc_id, source, text)``."""
    size = defaultdict(int)
    for _, s, t in docs:
        size[s] += len(t or "")
    weight = sum(v**temperature for v in size.values() if v)
    out = []
    for i, s, _ in docs:
        rate = round(size[s] ** temperature / weight * sum(size.values()) / size[s], 9) if size[s] else 0.0
        u = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13
        out.append(poisson(u, rate) if rate else 0)
    return out


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for label, phrase in PHRASES.items():
        p = phrase.split()
        found = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def accepted(hits):
    """Intervals ``(start, end, priority, order)`` that no accepted one suppresses, taken one after the other."""
    kept = []
    for a, b, p, k in sorted(hits, key=lambda h: (h[2], h[0] - h[1], h[0], h[3])):
        if not any((x <= a and b <= y) or (x < b and a < y and q < p) for x, y, q, _ in kept):
            kept.append((a, b, p, k))
    return kept


def license_labels(text, rules):
    """All labels and the score, from every signature on the whole text, without a prefilter."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = [(m.start(), m.end(), r.priority, k) for k, r in enumerate(rules) for m in r.pattern.finditer(" ".join(w))]
    found = accepted(hits)
    base = {x for x in license_base(text)[4].split(",") if x}
    labels = base | {rules[k].label for _, _, _, k in found}
    score = 1.0 if base else round(max((1 - p / 100 for _, _, p, _ in found), default=0.0), 6)
    return ",".join(sorted(labels)), score
