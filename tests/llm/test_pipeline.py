"""Every stage on its own input against plain Python, and the whole on the small tables."""

import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidencelens.llm import bpe, language_id, secret_scans
from evidencelens.llm.text import ship, table
from evidencelens.session import materialise
from tests.conftest import SMALL
from tests.llm.test_operators import brute_components


def unwords(t):
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", t.lower())


@pytest.fixture(scope="module")
def steps(spark):
    ship(spark)
    docs = table(spark, SMALL, "documents").withColumn("winner", F.lit("mine"))
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL), name)
        out.append(docs.collect())
    return out


def test_stages_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scans", "bpe"]
    for rows in steps[1:-1]:
        assert set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "winner"}


def test_language_stage(spark, steps):
    net = language_id.fit(table(spark, SMALL, "documents"))
    names, scores = language_id.evaluator(net).predict([r.text for r in steps[0]])
    want = {(r.doc_id, n) for r, n, s in zip(steps[0], names, scores) if n != "und" and s >= corpus_pipeline.MIN_SCORE}
    assert {(r.doc_id, r.lang) for r in steps[1]} == want


def test_near_dedup_stage(steps):
    groups = brute_components([(r.doc_id, r.text) for r in steps[1]], 5, 80)
    assert sorted(r.doc_id for r in steps[2]) == sorted({g for _, _, g in groups})


def test_decontamination_stage(spark, steps):
    items = [unwords(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    items = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]

    def dirty(t):
        w = unwords(t)
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(100 * len(s & own) >= 80 * len(s) for s in items)

    assert sorted(r.doc_id for r in steps[3]) == sorted(r.doc_id for r in steps[2] if not dirty(r.text))


def test_secret_stage(steps):
    owners = {}
    for r in steps[3]:
        for _, _, _, h, _ in secret_scans.candidates(r.text):
            owners.setdefault(h, set()).add(r.source)
    for before, after in zip(sorted(steps[3], key=lambda r: r.doc_id), sorted(steps[4], key=lambda r: r.doc_id)):
        out, at = "", 0
        for _, s, e, h, strong in secret_scans.candidates(before.text):
            if strong and len(owners[h]) < secret_scans.EXAMPLE_OWNERS:
                if s >= at:
                    out += before.text[at:s] + "[secret]"
                at = max(at, e)
        assert (after.doc_id, after.text) == (before.doc_id, out + before.text[at:]) and after.n_chars == len(after.text)


def test_bpe_stage(steps):
    tool = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in steps[4]}
    assert len(steps[5]) == len(texts) > 0
    assert all(r.ids == tool.encode(texts[r.doc_id]) for r in steps[5])


def test_empty_table_and_edge_rows(spark, tmp_path):
    for name in ("benchmark",):
        table(spark, SMALL, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    seen = next(i for i in range(5, 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5), (None, "the cat sat on the mat and then it slept all day", "en", "s", 48), (seen, "The cat sat on the mat and then it slept all day", "en", "s", 48), (seen, "The cat sat on the mat and then it slept all day", "en", "s", 48)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [seen]
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    table(spark, SMALL, "benchmark").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
