"""The pipeline against its stages in plain Python."""

import pathlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
import reference as R
from test_operators import SCHEMA, pairs, table


def plain(rows):
    """(doc_id, source, text) of what the first four stages keep; no cutoff is certified on so few labels."""
    out = []
    for i, s, t in rows:
        f = R.base_features(t)
        if f[0] >= 20 and 100 * f[4] <= 30 * f[0]:
            out.append((i, s, t))
    out = [(i, s, k[2]) for (i, s, _), k in zip(out, R.dedup([(i, t) for i, _, t in out]))]
    out = [r for r, k in zip(out, R.similar([(i, t) for i, _, t in out])) if r[0] == k[2]]
    copies = R.mixed([(i, s, t) for i, s, t in out])
    return [r for r, n in zip(out, copies) for _ in range(n)]


def test_pipeline(spark, tmp_path):
    rows = [r for r in {r[0]: r for r in table() if r[0] is not None}.values()]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:50]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = plain([(r[0], r[3], r[1]) for r in rows])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA_NAMES
    assert pairs((r.doc_id, r.source, r.text) for r in docs.collect()) == pairs(want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, _, t in want)
    assert sum(p.length for p in got) == total and len({p.doc_id for p in got}) == len({r[0] for r in want})


SCHEMA_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_guard():
    source = pathlib.Path(corpus_pipeline.__file__).read_text()
    assert "except" not in source
