"""The pipeline's stages on a small table: each one's decisions against its operator's own rows."""

import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievewright.llm import common, quality_rules, ranking, simhash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    inputs, out = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = out
        stage(spark, out, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != names[-1]:
            assert out.columns == docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = quality_rules.op2(inputs["quality_rules"]).where("kept")
    assert ids(kept) == ids(inputs["quality_classifier"])
    model = ranking.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert ids(ranking.with_scores(inputs["quality_classifier"], model).where("predicted = 1")) == ids(inputs["near_dedup"])
    assert ids(inputs["mixing"]) == sorted({r.component_id for r in simhash.op9(inputs["near_dedup"]).collect()})
    assert out.where("not round_trip").count() == 0 and out.count() == inputs["tokenising"].count()
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(str, out.collect()))


def test_empty(spark):
    empty = spark.read.parquet(f"{DATA}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_odd_rows_and_columns(spark):
    """NULLs in any column, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    plain = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()]
    rows = [(*r, f"k{r.doc_id}", 1) for r in plain]
    rows += [(None, None, None, None, None, None, None), (9001, None, None, "s", None, "k", 2), (9002, "", "en", None, 0, "k", 3), (9003, " \n\t ", "en", "s", 5, "k", 4)]
    rows += [rows[0], rows[0], (9004, " ".join(f"word{i % 977} end{i % 1013}" for i in range(150_000)), "en", "s", 1, "k", 5), (None, plain[1].text, None, None, 1, "k", 6), (None, plain[1].text, None, None, 1, "k", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score int")
    out = df
    for name, stage in corpus_pipeline.STAGES:
        before = out
        out = stage(spark, before, DATA)
        found = out.collect()
        if name != "tokenising":
            assert out.columns == df.columns, name
            out = spark.createDataFrame(found, df.schema)
            if name != "mixing":
                assert {tuple(r) for r in found} <= {tuple(r) for r in before.collect()}, name
    assert found and all(r.round_trip and r.n_tokens == len(r.ids) for r in found)
    # each stage also takes rows that its predecessors would have dropped
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, DATA)
        assert got.columns == df.columns or name == "tokenising"
        n = got.count()
        assert n == len(rows) if name == "tokenising" else n > 0, name


MEASURES = [quality_rules.base_counts, ranking.features, simhash.fingerprint]


@pytest.mark.parametrize("measure", MEASURES)
def test_memory_of_a_long_text(measure):
    """The words of a long text are never all objects at once: a worker takes less than six times the text."""
    words = np.array([f"w{i:x}ord" for i in range(30_000)])
    text = " ".join(words[np.random.default_rng(1).integers(0, len(words), 900_000)].tolist())
    measure("a b c d")
    tracemalloc.start()
    try:
        measure(text)
        assert tracemalloc.get_traced_memory()[1] < 6 * len(text)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("measure", MEASURES)
def test_long_texts_by_pieces(measure, monkeypatch):
    """A text counts the same whole and in pieces: any blanks, words longer than a piece, repeats over a piece's end."""
    line = "Été one\x0btwo  three\tfour five six seven eight nine ten "
    texts = [None, "", " \n\t ", "a", "a  B", "a b c", line * 9, "x" * 500 + " y z " + "é" * 300, (line + "\n") * 4 + "w " * 80, " " * 200 + "a b" + " " * 200]
    texts += [" ".join(f"{k % 41}é{k % 7}" for k in range(n)) for n in range(1, 300, 13)]
    whole = [measure(x) for x in texts]
    for size in (1, 7, 64):
        monkeypatch.setattr(common, "PIECE_BYTES", size)
        assert [measure(x) for x in texts] == whole
    assert all(b"".join(common.pieces(x.encode())) == x.encode() for x in texts if x)
