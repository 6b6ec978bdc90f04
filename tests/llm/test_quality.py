import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from llm import plain
from vigil.llm.quality import QualityModel, fit_curve, fit_quality, pieces, score_quality
from vigil.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_columns(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    rows = QUERIES["op2_compression_quality"](spark, SF_MID).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for y, s, _ in held if y == 1], [s for y, s, _ in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([p for y, _, p in held if y == 1]) > 0.97


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = fit_quality(docs, labels)
    b = fit_quality(docs.select("doc_id", "text").repartition(7), flipped.repartition(3))
    assert (a.good, a.bad, a.slope, a.bias) == (b.good, b.bad, b.slope, b.bias)


def test_scores_match_plain_version(spark):
    rows = [(1, "good text good"), (2, "bad!! worse!! bad"), (3, ""), (4, None), (None, "x"), (5, "é" * 300_000), (1, "good text good")]
    model = QualityModel(b"good text good " * 3, b"bad!! worse!! bad " * 3, 80.0, 0.25)
    out = score_quality(plain.docs(spark, rows), model).collect()
    assert len(out) == len(rows)
    for r in out:
        text = (r.text or "").encode()
        good, bad = model._compressors
        gain = sum(len(bad.compress(text[k : k + 1024])) - len(good.compress(text[k : k + 1024])) for k in range(0, len(text), 1024))
        want = 1 / (1 + np.exp(-(80.0 * gain / max(len(text), 1) + 0.25)))
        assert r.score == pytest.approx(want, abs=1e-12) and r.predicted == int(want >= 0.3)
    assert {r.score > 0.5 for r in out if r.doc_id == 1} == {True} and [r.score < 0.5 for r in out if r.doc_id == 2] == [True]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, None, 0), (None, 0, 0)], [(k, 0, 0) for k in range(20)]])
def test_too_few_labels_give_a_constant_score(spark, labels):
    docs = plain.docs(spark, [(k, f"text {k}") for k in range(20)])
    out = score_quality(docs, fit_quality(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert len(out) == 20 and len({r.score for r in out}) == 1


def test_empty_texts_in_the_sample(spark):
    docs = plain.docs(spark, [(k, "" if k % 2 else None) for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], LABELS)
    assert {r.predicted for r in score_quality(docs, fit_quality(docs, labels)).collect()} == {1}


def test_empty_table_and_clashing_columns(spark):
    model = QualityModel(None, None)
    assert score_quality(plain.docs(spark, []), model).collect() == []
    df = plain.docs(spark, [(1, "a")]).withColumns({"Score": F.lit("x"), "label": F.lit(1), "gain": F.lit(2)})
    out = score_quality(df, model)
    assert {"label", "gain", "score", "predicted"} <= set(out.columns) and "Score" not in out.columns
    assert out.first().score == 0.5


def test_pieces_cover_the_text():
    text = bytes(range(256)) * 30
    assert b"".join(pieces(text)) == text and pieces(b"") == []


def test_curve_recovers_a_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    slope, bias = fit_curve(x, y, np.ones(len(x)))
    assert slope == pytest.approx(2, abs=0.1) and bias == pytest.approx(-1, abs=0.1)
