"""Operators against plain versions, on a table of awkward rows."""

import functools
import hashlib
import os
import random
import zlib

import duckdb
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import reference as R
from factloom.llm import quality
from factloom.llm import queries as Q
from factloom.llm.jaccard_join import jaccard_components, keep_one_of_each, similar
from factloom.llm.langid import language_id
from factloom.llm.license_scan import license_scan, license_spans
from factloom.llm.line_dedup import dedup_lines
from factloom.llm.media import text_media
from factloom.llm.mixing import mix
from factloom.llm.packing import pack
from factloom.llm.quality import binomial_upper, certified, keep_good, quality_rules
from factloom.llm.toxicity import toxicity
from factloom.llm.warc import read_warc, warc_round_trip, write_warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# columns of operators' own names, in other cases, must not disturb them
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, N_Lines string, tokens int, Replica string, lost int"


def table():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéüñ") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(70), "A line that Stands in many documents"
    texts = [None, "", " \t\n\r ", "one", "ONE", "two words", "x y z", "X Y Z", "\n\n\n", "漢字 かな 漢字", "a b c", "été ÀÉ ×÷ it's <|endoftext|> don't|won't 12ab!!", "|||", "1 2 3 !!"]
    base = [prose(rng.randint(20, 200)) for _ in range(12)]
    for b in base:
        w = b.split()
        texts += [b, b, b.upper(), " ".join(w[: int(len(w) * 0.9)]), " ".join(w[5:] + [word()]), f"{line}\n{b}\n  {line.lower()} \n" + prose(5), passage + "\n" + prose(40)]
    texts += [prose(9000), "spam " * 5000, "\n".join([line] * 50), " ".join(["loop it now here we go once more"] * 30), "Released under the MIT License. Apache License, Version 2.0 and CC BY-NC 4.0; under the MIT license", "idiot " + prose(60)]
    rows = []
    for k, t in enumerate(texts):
        rows.append((k * 3 if k != 7 else None, t, ["en", "de", None, "fr"][k % 4], ["big", "big", "big", None, "small"][k % 5], None if t is None else len(t), "k", "n", 1, "r", 2))
    rows += rows[20:24]  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k * 3, int(k % 9 != 0), int(k % 7 == 0)) for k in range(80)] + [(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def pairs(rows):
    return sorted(rows, key=repr)


def test_mixing(docs, empty):
    rows = table()
    got = mix(docs)
    assert got.columns == [c for c in docs.columns if c.lower() != "replica"] + ["replica", "shuffle_key"]
    want = R.mixed([(r[0], r[3], r[1]) for r in rows])
    expected = [(r[0], r[1], k) for r, n in zip(rows, want) for k in range(n)]
    assert pairs((r.doc_id, r.text, r.replica) for r in got.collect()) == pairs(expected)
    assert mix(empty).count() == 0
    only = mix(docs, {"small": 1.0}).collect()
    assert only and {r.source for r in only} == {"small"}
    keys = [r.shuffle_key for r in got.collect()]
    assert keys == sorted(keys)


def test_mixing_of_many_sources(spark):
    rows = [(k, f"s{k % 1500}", "some text") for k in range(3000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    want = R.mixed([(i, s, t) for i, s, t in rows])
    assert pairs(r.doc_id for r in got.collect()) == pairs(r[0] for r, n in zip(rows, want) for _ in range(n))


def test_media(docs, empty):
    want = []
    for r in table():
        raw = (r[1] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.append((r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    got = text_media(docs).collect()
    assert pairs(tuple(r)[:5] for r in got) == pairs(want)
    by_payload = {}
    for r in got:
        assert by_payload.setdefault((r.n_bytes, r.payload_sha256), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert text_media(empty).count() == 0


def test_packing(docs, empty):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rows = table()
    got = pack(docs, VOCABULARY).collect()
    ids = [[*e.ids, 1] for e in tokenizer.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    pieces = {}
    for p in got:
        pieces.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length, p.ids_crc32))
    want = {}
    for r, x in zip(rows, ids):
        want.setdefault((r[0], len(x)), []).append(x)
    assert pieces.keys() == want.keys()
    for key, copies in want.items():
        mine = sorted(pieces[key])
        assert sum(n for _, n, _ in mine) == sum(map(len, copies))
        for start, n, crc in mine:
            cut = copies[0][start : start + n]
            assert len(cut) == n and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut)) == crc
    filled = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0) and p.length > 0
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values()) <= 2048
    padding = sum(2048 - n for n in filled.values() if n & (n - 1))
    assert padding <= 0.02 * sum(filled.values()) + 2048
    assert pack(empty, VOCABULARY).count() == 0


def test_quality(docs, empty, labels):
    got = quality_rules(docs, labels).collect()
    want = []
    for r in table():
        f = R.base_features(r[1])
        want.append((r[0], *f, f[0] < 20 or 100 * f[4] > 30 * f[0]))
    assert pairs(tuple(r)[:7] for r in got) == pairs(want)
    # so few labels prove nothing, so the base rules decide alone
    assert all(r.kept == (not r.base_failed) for r in got)
    assert quality_rules(empty, labels).count() == 0
    assert quality_rules(docs, labels.limit(0)).count() == len(want)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)


def test_quality_cutoffs():
    assert abs(binomial_upper(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert binomial_upper(5, 5, 0.05) == 1.0
    for n, k, p in ((50, 3, 0.2), (400, 0, 0.01), (3000, 41, 0.01), (10**6, 9_800, 0.01), (7, 6, 0.9)):
        exact = __import__("math").fsum(__import__("math").exp(__import__("math").lgamma(n + 1) - __import__("math").lgamma(j + 1) - __import__("math").lgamma(n - j + 1) + j * __import__("math").log(p) + (n - j) * __import__("math").log1p(-p)) for j in range(k + 1))
        assert abs(quality.binomial_tail(k, n, p) - exact) < 1e-6 * exact
    exact = sum(__import__("math").comb(50, k) * 0.2**k * 0.8 ** (50 - k) for k in range(4))
    assert abs(binomial_upper(3, 50, exact) - 0.2) < 1e-9
    import numpy as np

    assert certified(np.array([900, 50, 5, 0]), 1000, 0.02, 0.05) == 2
    assert certified(np.array([0, 0, 0]), 10, 0.01, 0.05) == 3  # ten holdouts prove nothing


def test_quality_with_certified_cutoffs(spark):
    """Thousands of labels: the cutoffs are those of plain binomial sums, they reject bad texts and few good ones."""
    import math

    import numpy as np

    from factloom.llm import textbuf as tb

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    vocabulary = [word() for _ in range(800)]

    def text(good):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(25, 60))]
        if not good:
            w = [x.upper() + rng.choice("#$%|") if rng.random() < 0.5 else x for x in w]
        return "\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12))

    sizes = {"en": 5000, "de": 5000, None: 700, "rare": 200}
    rows, labels_ = [], []
    for lang, n in sizes.items():
        for _ in range(n):
            good = rng.random() < 0.85
            # some good texts look bad, so that cutoffs have to give way
            rows.append((len(rows), text(good and rng.random() > 0.004), lang))
            labels_.append((len(labels_), int(good), 0))
    rows += [(None, text(False), "en"), (10**6, text(False), "rare"), (10**6 + 1, None, "de")]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    known = spark.createDataFrame(labels_, "doc_id long, quality int, toxic int")
    table_ = quality.features(docs_).persist()
    model = quality.fit_quality(table_, known)
    data, bounds = tb.column_bytes(__import__("pyarrow").array([r[1] for r in rows]))
    counts = quality.text_features(data, bounds)
    scores, failed = model.scores(counts), quality.base_failed(counts)
    fitted = {r[0] for r in spark.sql("select id from range(20000) where pmod(xxhash64('quality', id), 10) = 0").collect()}
    held = {}
    for (i, _, lang), (_, q, _), score, bad in zip(rows, labels_, scores, failed):
        if q and i not in fitted and not bad:
            held.setdefault(lang, []).append(min(int(score * 200), 199))
    tested = {k: v for k, v in held.items() if 0.99 ** len(v) <= 0.05}
    assert set(tested) == {"en", "de", None}
    want = {}
    for lang, steps in tested.items():
        n, cut = len(steps), 200
        for g in range(199, -1, -1):
            k = sum(x >= g for x in steps)
            tail = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(0.01) + (n - j) * math.log(0.99)) for j in range(k + 1))
            if k > 0.01 * n or tail > 0.05 / 3:
                break
            cut = g
        if cut < 200:
            want[lang] = cut
    assert model.cutoffs == want and {"en", "de"} <= set(want) and any(sum(x >= c for x in held[k]) for k, c in want.items())
    got = {r.doc_id: r.kept for r in quality_rules(docs_, known).collect()}
    for (i, _, lang), score, bad in zip(rows, scores, failed):
        assert got[i] == (not bad and int(score * 200) < want.get(lang, 200)), (i, lang)
    judged = [(q, got[i]) for (i, _, lang), (_, q, _) in zip(rows, labels_) if lang in ("en", "de")]
    assert sum(not k for q, k in judged if q) <= 0.01 * sum(q for q, _ in judged)
    assert sum(not k for q, k in judged if not q) >= 0.9 * sum(not q for q, _ in judged)
    kept = sorted((r.doc_id is None, r.doc_id) for r in keep_good(docs_, known).collect())
    assert kept == sorted((i is None, i) for i, k in got.items() if k)


@pytest.mark.parametrize("tile", [4096, 2])
def test_jaccard(docs, empty, tile):
    rows = [(r[0], r[1]) for r in table()]
    got = jaccard_components(docs, tile=tile).collect()
    assert pairs(map(tuple, got)) == pairs((i, *w) for (i, _), w in zip(rows, R.similar(rows)))
    assert jaccard_components(empty).count() == 0


def test_jaccard_of_a_hot_group(spark, monkeypatch):
    """Copies and near copies beyond the hot and tile limits lose no link."""
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 9**6)}" for _ in range(80)]
    rows = [(k, " ".join(base[: 80 - k % 20])) for k in range(150)] + [(1000 + k, " ".join(base)) for k in range(60)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tile=8).collect()
    assert pairs(map(tuple, got)) == pairs((i, *w) for (i, _), w in zip(rows, R.similar(rows)))


def test_jaccard_classes(docs):
    members, links, classes = similar(docs)
    assert classes.agg({"rows": "sum"}).first()[0] == members.filter("n > 0").count()
    assert links.filter("a >= b").count() == 0


def test_keep_one_of_each(docs, empty):
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert pairs((r.doc_id, r.text) for r in kept.collect()) == pairs(R.one_of_each([(r[0], r[1]) for r in table()]))
    assert keep_one_of_each(empty).count() == 0


def test_keep_one_of_each_judges_rows(spark):
    """Repeated and null doc_ids name nothing: each row goes by its own text."""
    rng = random.Random(3)
    prose = lambda: " ".join(f"w{rng.randint(0, 9**5)}" for _ in range(60))
    a, b, c, d = prose(), prose(), prose(), prose()
    rows = [(1, a), (1, b), (2, b + " more"), (3, a), (4, c), (4, c + " more"), (4, c), (None, c), (None, d), (None, d + " more"), (None, ""), (5, ""), (5, None), (6, prose())]
    got = keep_one_of_each(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key int"))
    assert got.columns == ["doc_id", "text", "key"]
    want = R.one_of_each(rows)
    assert len(want) == 8 and pairs((r.doc_id, r.text) for r in got.collect()) == pairs(want)


def test_components_small_and_large(spark):
    """One task or many rounds: the same least nodes."""
    from factloom.llm.components import components

    rng = random.Random(9)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for u, v in edges:
        x, y = find(u), find(v)
        root[max(x, y)] = min(x, y)
    want = sorted({(n, find(n)) for e in edges if e[0] != e[1] for n in e})
    table_ = spark.createDataFrame(edges, "a long, b long")
    for one_task in (1 << 21, 0):
        assert sorted(map(tuple, components(table_, one_task).collect())) == want


@pytest.mark.parametrize("batches,fanout", [(4, 3), (1, 2), (6, 2)])
def test_line_dedup(docs, empty, batches, fanout):
    rows = [(r[0], r[1]) for r in table()]
    got = dedup_lines(docs, batches, fanout)
    assert got.columns == [c for c in docs.columns if c != "N_Lines"] + ["n_lines", "n_dropped"]
    assert pairs((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == pairs((i, *w) for (i, _), w in zip(rows, R.dedup(rows)))
    assert dedup_lines(empty).count() == 0


def test_line_dedup_of_null_and_repeated_ids(spark):
    """Rows without doc_id are told apart by their texts; rows that share one keep what it owns."""
    rng = random.Random(14)
    lines = [f"{rng.choice('abc')} line number {k} of many" for k in range(25)] + ["short", "", "  short  "]
    rows = [(rng.choice([None, None, 1, 2, 3, 50, 51]), None if rng.random() < 0.05 else "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for _ in range(150)]
    got = dedup_lines(spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, Sub int, key int").repartition(5))
    assert got.columns == ["doc_id", "text", "Sub", "key", "n_lines", "n_dropped"]
    assert pairs((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got.collect()) == pairs((i, *w) for (i, _), w in zip(rows, R.dedup(rows)))


def test_sorted_runs():
    import numpy as np

    from factloom.llm.line_dedup import in_run

    rng = np.random.default_rng(3)
    run = np.unique(rng.integers(-4, 4, (60, 2)), axis=0)
    asked = rng.integers(-5, 6, (300, 2))
    held = set(map(tuple, run.tolist()))
    assert in_run(*asked.T, *run.T).tolist() == [tuple(k) in held for k in asked.tolist()]
    assert not in_run(*asked.T, *run[:0].T).any()


def test_toxicity(docs, empty, labels, spark):
    assert toxicity(docs, labels).count() == len(table())
    assert toxicity(empty, labels).count() == 0
    assert not toxicity(docs, labels.limit(0)).filter("is_toxic").count()
    got = Q.op8_toxicity_chain(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert sum(r.is_toxic and not r.toxic for r in got) <= 2
    assert sum(r.is_toxic for r in got) >= 0.6 * sum(r.toxic for r in got)


def toxic_table(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    prose, bad = [word() for _ in range(300)], ["vile", "Rotten", "BRUTE", "ghoul"]
    rows, marks = [], []
    for k in range(900):
        w = [rng.choice(prose) for _ in range(rng.randint(5, 40))]
        n = rng.choice([0, 0, 0, 0, 1, 2, 3])
        for b in rng.sample(bad, n):
            w.insert(rng.randint(0, len(w)), b)
        rows.append((k, " ".join(w)))
        marks.append((k, int(n > 0), int(n > 1), int("vile" in w)))
    return spark.createDataFrame([*rows, (None, "vile brute"), (5000, None), (5001, "")], "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, toxic int, many int, vile int"), rows, marks


@pytest.mark.parametrize("categories", [(), ("many", "vile")])
def test_toxicity_chain(spark, categories):
    """Every link minimises the penalised loss over words and out-of-fold links; probabilities follow link by link."""
    import math

    import numpy as np

    from factloom.llm import toxicity as T

    docs_, labels_, rows, marks = toxic_table(spark)
    sets, toxic, folds, named = T.labelled_words(docs_, labels_, categories=categories)
    chain = T.fit_chain(sets, toxic, folds, named=named)
    assert chain.categories == ((*categories, "toxic") if categories else ("explicit", "severe", "toxic"))
    words = lambda t: set(R.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(R.LOWER)))
    place = {int(h): k for k, h in enumerate(chain.words)}
    assert set(T.word_hashes(["vile", "rotten", "brute", "ghoul"]).tolist()) <= set(place)
    names = sorted(set().union(*(words(t) for _, t in rows)) | {"vile"})
    column = {w: place[int(h)] for w, h in zip(names, T.word_hashes(names)) if int(h) in place}
    links = len(chain.weights)

    def plain(text):
        on, p = {column[w] for w in words(text) if w in column}, []
        for weights in chain.weights:
            total = sum(weights[k] for k in on) + weights[-1] + sum(w * q for w, q in zip(weights[len(place) :], p))
            p.append(1 / (1 + math.exp(-total)))
        return p

    for r in toxicity(docs_, labels_, categories).collect():
        text = {**dict(rows), None: "vile brute"}.get(r.doc_id)
        p = plain(text)
        assert all(abs(x - y) < 2e-6 for x, y in zip(list(r)[1 : 1 + links], p)) and r.is_toxic == (p[-1] >= chain.threshold)
    # the loss of the first link has no slope at its weights: its inputs are the words alone
    x = np.array([[float(k in {column[w] for w in words(t) if w in column}) for k in range(len(place))] + [1.0] for _, t in rows])
    if categories:
        y = np.array([m[2] for m in marks], float)
        p = 1 / (1 + np.exp(-x @ chain.weights[0]))
        slope = x.T @ (p - y) + np.append(np.full(len(place), 1.0), 1e-6) * chain.weights[0]
        assert np.abs(slope).max() < 1e-3


def test_toxicity_of_unseen_documents(spark):
    """Of the documents that hold a telling word, nine in ten are caught on rows that the chain never saw, and clean ones stay."""
    from factloom.llm import toxicity as T

    folder = "/root/testdata/sf0.1"
    docs_, labels_ = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    seen = "pmod(xxhash64(doc_id, 'held'), 4) <> 0"
    chain = T.fit_chain(*T.labelled_words(docs_, labels_.filter(seen))[:3])
    telling = r"(?i)\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron)\b"
    got = T.classify(docs_, chain).join(labels_.filter(f"not ({seen})"), "doc_id").join(docs_.selectExpr("doc_id", f"text rlike '{telling.replace(chr(92), chr(92) * 2)}' as tells"), "doc_id").collect()
    marked = [r for r in got if r.toxic and r.tells]
    assert len(marked) > 60 and sum(r.is_toxic for r in marked) >= 0.95 * len(marked)
    assert sum(r.is_toxic for r in got if r.toxic) >= 0.85 * sum(r.toxic for r in got)
    assert sum(r.is_toxic and not r.toxic for r in got) <= 0.003 * len(got)


def test_license(docs, empty):
    got = license_scan(docs).collect()
    assert pairs((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == pairs((r[0], *R.license_base(r[1])) for r in table())
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == bool(r.labels) and 0 <= r.score <= 1
    assert license_scan(empty).count() == 0


def test_license_suppression():
    from factloom.llm.license_scan import unsuppressed

    rng = random.Random(8)
    for _ in range(300):
        hits = []
        for k in range(rng.randint(0, 40)):
            a = rng.randint(0, 60)
            hits.append((a, a + rng.randint(1, 25), rng.randint(1, 4), k))
        assert sorted(unsuppressed(hits)) == sorted(R.accepted(hits))


def test_license_labels(spark):
    """Labels and scores against all signatures on whole texts; a collection of notices takes seconds."""
    import time

    from factloom.llm.license_rules import signatures

    rng = random.Random(6)
    parts = [p.split("|")[-1].strip() for p in __import__("factloom.llm.license_rules", fromlist=["SIGNATURES"]).SIGNATURES.splitlines() if "|" in p]
    plain = [R.re.sub(r"[^a-z0-9 ]", " ", R.re.sub(r"\(\?:([^|)]*)[^)]*\)\??", r"\1", p)) for p in parts]
    texts = [" ".join(rng.choice(plain) if rng.random() < 0.5 else rng.choice(["prose", "é", "Foo;", "the", "license", "GPL", "2", "0"]) for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "MIT", "mit mit license mit license"]
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.labels, r.score) for r in got} == {k: R.license_labels(t, signatures()) for k, t in enumerate(texts)}
    assert len({r.labels for r in got}) > 60
    begun = time.time()
    notices = "Released under the MIT License. Apache License, Version 2.0 and CC BY-NC 4.0. New BSD License.\n" * 50_000
    assert license_scan(spark.createDataFrame([(1, notices)], "doc_id long, text string")).first().n_base == 150_000
    assert time.time() - begun < 120


def test_license_overlaps(spark):
    text = "Licensed under the Apache License, Version 2.0 (the License). é CC-BY-NC-SA 4.0. New BSD License."
    rows = license_spans(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    words = [w for w in R.re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(R.LOWER))]
    found = {r.label: " ".join(words[r.first_word : r.first_word + r.n_words]) for r in rows}
    assert found == {"apache-2": "licensed under the apache license version 2 0", "cc-by-nc-sa": "cc by nc sa 4 0", "bsd-3-clause": "new bsd license"}


def test_language(docs, empty, spark):
    rows = {r.doc_id: r for r in language_id(docs).collect()}
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r.held_out for i, r in rows.items() if i is not None)
    assert all(r.lang_pred == "und" and r.score == 0 for i, r in rows.items() if i in (0, 3, 6, 24))
    assert language_id(empty).count() == 0
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = Q.op10_language_id(spark, "/root/testdata/sf0.01").join(truth, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_language_kernel():
    """Scores are those of kernel values between plain n-gram sets, with a ridge regression on the Nyström features."""
    import numpy as np

    from factloom.llm import langid
    from factloom.llm import textbuf as tb

    rng = random.Random(31)
    alphabets = {"aa": "abcdef ", "bb": "defghi ", "cc": "ghiéü ", "dd": "klm "}
    make = lambda lang, n: "".join(rng.choice(alphabets[lang]) for _ in range(n))
    langs = [rng.choice(list(alphabets)) for _ in range(120)]
    texts = [make(lang, rng.randint(5, 200)) for lang in langs]
    asked = ["", "A", make("aa", 60), make("cc", 5000), make("bb", 70).upper(), make("dd", 200_000)]

    @functools.cache
    def grams(text):
        raw = text.translate(R.LOWER).encode()
        return {((int.from_bytes(raw[k : k + n], "big") + n) * 2654435761 % 2**32) >> 16 for n in range(1, 5) for k in range(len(raw) - n + 1)}

    def encode(some):
        data, bounds = tb.column_bytes(__import__("pyarrow").array(some))
        buckets, cut = langid.presence(data, bounds)
        return [buckets[a:b] for a, b in zip(cut[:-1], cut[1:])], buckets, cut

    assert [set(s.tolist()) for s in encode(texts)[0]] == [grams(t) for t in texts]
    model = langid.fit_language_model(encode(texts)[0], langs, 20)
    classes = sorted(set(langs))
    turn = {c: [k for k, x in enumerate(langs) if x == c] for c in classes}
    chosen = [turn[c][k] for k in range(120) for c in classes if k < len(turn[c])][:20]
    kernel = lambda x, y: len(grams(x) & grams(y)) / max(1, len(grams(x)) * len(grams(y))) ** 0.5
    k_mm = np.array([[kernel(texts[i], texts[j]) for j in chosen] for i in chosen])
    k_nm = np.array([[kernel(t, texts[j]) for j in chosen] for t in texts])
    counts = np.array([len(turn[x]) for x in langs], float)
    weight = 1 / counts
    ridge = 1e-3 * np.sqrt(weight).mean() ** 2 * len(texts)
    y = np.array([[1.0 if x == c else -1.0 for c in classes] for x in langs])
    # minimise the weighted loss over coefficients of the landmarks, with their kernel norm as the penalty
    beta = np.linalg.solve(k_nm.T @ (k_nm * weight[:, None]) + ridge * k_mm, k_nm.T @ (y * weight[:, None]))
    want = np.array([[kernel(t, texts[j]) for j in chosen] for t in asked]) @ beta
    got = model.scores(*encode(asked)[1:])
    assert np.abs(got - want).max() < 1e-6
    assert [classes[k] for k in got[2:].argmax(axis=1)] == ["aa", "cc", "bb", "dd"]


def test_warc(spark, tmp_path):
    body = "payload " * 200
    rows = [(1, "http://a/\r\n", body), (2, None, body), (3, "http://c", body), (4, "d", None), (5, "e", ""), (6, "f", "small"), (7, "g", "small"), (8, "h", "é" * 600), (9, "i", "x" * 3_000_000), (10, "j", "\x1f\x8b\x08" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    payload = {i: (h or "").encode() for i, _, h in rows}
    want = [(i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if i in (1, 2) else "response", 3 if i in (1, 2) else None) for i, p in payload.items()]
    assert pairs(map(tuple, warc_round_trip(pages).collect())) == pairs(want)
    folder = f"file://{tmp_path}/warc"
    write_warc(pages, folder)
    for split in (100, 1000, 50_000_000):  # records are owned once however the files are cut
        got = read_warc(spark, folder, split)
        assert pairs((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()) == pairs(want)
    assert {r.page_id: bytes(r.payload) for r in got.filter("record_type = 'response'").collect()} == {i: p for i, p in payload.items() if i not in (1, 2)}
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_warc_of_embedded_records(spark, tmp_path):
    """Payloads that hold whole records, archives or parts of them make no record, however the files are cut."""
    from factloom.llm.warc import record_bytes

    rng = random.Random(2)
    noise = lambda n: rng.randbytes(n)
    inner = [record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{900 + k}>")], noise(300)) for k in range(6)]
    bodies = [noise(500), noise(2000) + inner[0] + noise(700), b"".join(inner), inner[1], inner[2] + inner[3][:-5], noise(100), b"", b"".join(inner[2:]) + b"\x1f\x8b\x08", noise(3000)]
    os.makedirs(f"{tmp_path}/a")
    for name in ("a/one.warc.gz", "two.warc.gz"):
        with open(tmp_path / name, "wb") as out:
            for k, body in enumerate(bodies):
                out.write(record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{k}>")], body))
    want = sorted([(k, len(b), hashlib.sha1(b).hexdigest()) for k, b in enumerate(bodies)] * 2)
    for split in (64, 333, 1000, 4096, 1 << 24):
        got = read_warc(spark, f"file://{tmp_path}", split)
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got.collect()) == want
    with open(tmp_path / "two.warc.gz", "r+b") as out:
        out.seek(900)
        out.write(b"damage")
    for split in (333, 1 << 24):
        with pytest.raises(Exception, match="record"):
            read_warc(spark, f"file://{tmp_path}", split).count()


def test_warc_of_null_and_repeated_ids(spark):
    big, other = "payload " * 200, "another " * 200
    rows = [(1, big), (1, big), (2, big), (2, big), (None, big), (None, other), (None, other), (3, other), (3, "small"), (4, None), (4, "x" * 1000), (None, None)]
    pages = spark.createDataFrame([(i, None, h, 0) for i, h in rows], "page_id long, url string, html string, owner int")
    owner = {big: 2, other: 3}
    want = []
    for i, h in rows:
        p, o = (h or "").encode(), owner.get(h)
        again = o is not None and i != o
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", o if again else None))
    assert pairs(map(tuple, warc_round_trip(pages).collect())) == pairs(want)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        duck.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = duck.sql(Q.ORACLE_SQL[name])
    got = Q.QUERIES[name](spark, "/root/testdata/sf0.001").select(*want.columns).collect()
    assert pairs(tuple(map(str, r)) for r in got) == pairs(tuple(map(str, r)) for r in want.fetchall())


def test_without_keys(spark, monkeypatch):
    from factloom.llm import sift

    rows = spark.createDataFrame([(k if k % 9 else None, str(k), "x") for k in range(-2000, 2000)], "doc_id long, text string, word string")
    gone = spark.createDataFrame([(k,) for k in range(-2000, 2000, 7)], "doc_id long")
    want = sorted(str(k) for k in range(-2000, 2000) if not k % 9 or (k + 2000) % 7)
    for bits in (1 << 26, 1 << 10):  # an overfull filter changes nothing
        monkeypatch.setattr(sift, "BITS", bits)
        assert sorted(r.text for r in sift.without_keys(rows, gone, "doc_id").collect()) == want
    assert sift.without_keys(rows, gone.limit(0), "doc_id").count() == 4000
