import math
import zlib
from collections import Counter

import numpy as np
import pytest
from .plain import docs
from pyspark.sql import functions as F
from vigil.llm import language
from vigil.llm.language import LanguageModel, fit_languages, fit_temperature, gram_counts, identify, softmax, train
from vigil.llm.queries import op13_ftrl_language

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    """Distinct n-grams of one to three characters, spelt out."""
    folded = "".join(c if c.isalpha() else " " for c in text.lower())
    line = " ".join(["", *folded.split(), ""])
    out = {}
    for n in (1, 2, 3):
        for k in range(1 if n == 1 else 0, len(line) - n + 1):
            out[line[k : k + n]] = out.get(line[k : k + n], 0) + 1
    return out if any(c.isalpha() for c in text) else {}


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 4 == 2


def test_grams_equal_the_spelt_ones():
    for text in ("", " ", "12 ?!", "a", "Ab", "Été déjà-vu 12 你好 \U0001d400x", "the  the\n\nthe"):
        found, counts = gram_counts(text)
        # hashes of few n-grams don't meet
        assert sorted(counts.tolist()) == sorted(plain_grams(text).values())


def test_pieces_change_nothing(monkeypatch):
    text = "Some words, 12 and déjà  vu ... " * 40 + "  .. x"
    whole = gram_counts(text)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language, "CHARACTERS_AT_ONCE", size)
        assert all((a == b).all() for a, b in zip(gram_counts(text), whole))


def test_ftrl_equals_a_plain_loop():
    draw = np.random.default_rng(1)
    rows = [(np.sort(draw.choice(40, 6, replace=False)), draw.normal(size=6)) for _ in range(30)]
    y, share = draw.integers(0, 3, 30), draw.uniform(0.5, 2, 30)
    alpha, beta, l1, l2 = 0.7, 1.0, 0.1, 0.3
    z, n = {}, {}

    def weight(i, k):
        v = z.get((i, k), 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get((i, k), 0.0))) / alpha + l2)

    for _ in range(2):
        for (at, x), label, s in zip(rows, y, share):
            w = {(i, k): weight(i, k) for i in at for k in range(3)}
            score = [math.exp(sum(v * w[i, k] for i, v in zip(at, x))) for k in range(3)]
            for i, v in zip(at, x):
                for k in range(3):
                    g = s * v * (score[k] / sum(score) - (k == label))
                    old = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, k]
                    n[i, k] = old + g * g
    found = train(rows, y, share, 3, 2, alpha, beta, l1, l2)
    assert np.allclose(found[:40], [[weight(i, k) for k in range(3)] for i in range(40)], atol=1e-12)
    assert (found[:40] == 0).any() and not found[40:].any()  # sparse


def test_temperature_minimises_the_log_loss():
    draw = np.random.default_rng(2)
    z = draw.normal(size=(400, 3)) * 4
    y = np.array([draw.choice(3, p=p) for p in softmax(z / 3.0)])
    t = fit_temperature(z, y)
    loss = lambda s: -np.log(softmax(z / s)[np.arange(400), y]).sum()
    assert 2.2 < t < 4.2 and all(loss(t) <= loss(t * f) + 1e-9 for f in (0.8, 0.95, 1.05, 1.25))


def test_held_out_accuracy_and_calibration(spark):
    out = op13_ftrl_language(spark, SF)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    given = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(given)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    tested = [r for r in rows if r.held_out]
    right = [r.lang_pred == given[r.doc_id].lang for r in tested]
    assert len(tested) > 200 and sum(right) / len(right) > 0.99
    assert abs(sum(r.score for r in tested) / len(tested) - sum(right) / len(right)) < 0.02


def test_short_and_mixed_texts_get_lower_scores(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit_languages(df.filter("doc_id < 600"))
    full = {k: t for k, t in df.filter("doc_id >= 600 and length(text) > 600").groupBy("lang").agg(F.min("text")).collect()}
    for name, text in full.items():
        assert model.predict(text)[0] == name and model.predict(text[200:400])[0] == name
    half = "".join(t[:300] for t in full.values())
    assert model.predict(half)[1] < min(model.predict(t)[1] for t in full.values())


def test_fit_reads_no_held_out_labels(spark):
    """Held-out labels, sources and ids turned round change nothing."""
    rows = [(k, f"{'der die das und nicht' if k % 2 else 'the and with from this'} {k}", "de" if k % 2 else "en", "s") for k in range(300)]
    turned = [(k, t, ("en" if lang == "de" else "de") if held(k) else lang, "other") for k, t, lang, s in rows]
    a, b = (fit_languages(docs(spark, r)) for r in (rows, turned))
    assert (a.weights == b.weights).all() and a.temperature == b.temperature
    found = {r.doc_id: r.lang_pred for r in identify(docs(spark, rows), a).collect()}
    assert all(found[k] == lang for k, _, lang, _ in rows)


def test_bounds_of_the_fit(spark):
    rows = [(k, f"text {k}", f"l{k % 7}") for k in range(400)]
    model = fit_languages(docs(spark, rows), max_languages=3, per_language=10)
    known = Counter(f"l{k % 7}" for k in range(400) if not held(k))
    assert model.languages == sorted(sorted(known, key=lambda x: (-known[x], x))[:3])


def test_odd_rows(spark):
    rows = [(None, "the and with", "en"), (1, None, "en"), (1, "", None), (2, "12 ?!", "fr"), (3, "the and " * 100_000, "en"), (3, "the and", "en"), (4, "der die das", "de"), (5, "der und", "de")] * 2
    model = fit_languages(docs(spark, rows))
    df = docs(spark, rows).withColumns({"score": F.lit(9), "Held_Out": F.lit(1), "_lang": F.lit("x"), "_order": F.lit(2)})
    out = identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_lang", "_order", "held_out", "lang_pred", "score"]
    found = out.collect()
    assert len(found) == 16 and all((r.lang_pred, r.score) == ("und", 0.0) for r in found if not r.text or r.doc_id == 2)
    assert {r.lang_pred for r in found if r.doc_id == 3} == {"en"}
    empty = docs(spark, [])
    assert identify(empty, model).count() == 0 and fit_languages(empty).languages == []
    assert fit_languages(docs(spark, [(1, None, "en"), (3, "??", "de")])).languages == []
    assert {r.lang_pred for r in identify(docs(spark, rows), LanguageModel([])).collect()} == {"und"}
    alone = fit_languages(docs(spark, [(k, "the and", "en") for k in range(9)]))
    assert alone.predict("xyz") == ("en", pytest.approx(1.0))
