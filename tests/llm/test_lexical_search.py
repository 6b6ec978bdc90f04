import math
import random
import re
from collections import Counter

import numpy as np
from .plain import LOWER
from pyspark.sql import functions as F
from vigil.llm import lexical_search as search
from vigil.llm.lexical_search import lexical_search, text_terms
from vigil.llm.queries import op11_presence_masks

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, top=10):
    tf = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    tf = [(doc_id, c) for doc_id, c in tf if c]
    n, length = len(tf), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in tf:
            m = 100 - 90 + (90 * c.total() * n) // length
            w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if t in c}
            score = sum(w[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in w)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        out += [(item_id, k, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **options):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lexical_search(df, spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    return sorted([tuple(r) for r in rows], key=repr)


def corpus(seed, docs=300, vocabulary=200):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    share = [1 / (k + 1) for k in range(vocabulary)]
    rows = [(k, " ".join(draw.choices(words, share, k=draw.choice([1, 5, 40, 300])))) for k in range(docs)]
    rows += [(k + 1000, rows[0][1]) for k in range(30)]
    items = [(k, " ".join(draw.choices(words, k=draw.choice([1, 3, 30, 150])))) for k in range(25)]
    return rows, items


def test_equals_the_plain_version(spark, monkeypatch):
    rows, items = corpus(1)
    expected = plain_search(rows, items)
    assert searched(spark, rows, items) == expected
    # many small portions of documents, several blocks of items
    monkeypatch.setattr(search, "DOCS_AT_ONCE", 16)
    monkeypatch.setattr(search, "BITMAP_OCTETS", 100)
    assert searched(spark, rows, items, block_terms=100) == expected
    assert searched(spark, rows, items, top=3) == plain_search(rows, items, 3)


def test_terms_are_those_of_the_pattern():
    draw = random.Random(2)
    for _ in range(200):
        text = "".join(chr(draw.choice([draw.randrange(128), draw.randrange(128, 0x2000), draw.randrange(0x10000, 0x11000), 32])) for _ in range(draw.randrange(60)))
        assert {t.decode(): n for t, n in text_terms(text.encode()).items()} == Counter(terms(text))


def test_long_texts_are_read_whole(monkeypatch):
    whole = text_terms("ab1 éé Cd".encode() * 50)
    monkeypatch.setattr(search, "OCTETS_AT_ONCE", 7)
    assert text_terms("ab1 éé Cd".encode() * 50) == whole


def test_masks_spare_most_documents():
    """Documents that can't reach the best scores are never evaluated."""
    draw = random.Random(3)
    size, terms_ = 4000, 12
    doc, term, tf = [], [], []
    for d in range(size):
        for t in range(terms_):
            if draw.random() < 0.9 / (t + 1):
                doc.append(d), term.append(t), tf.append(draw.randint(1, 3))
    n = np.array([draw.randint(50, 200) for _ in range(size)])
    postings = search.Postings(np.array(doc), np.array(term), np.array(tf), n, size, int(n.sum()))
    weight = np.array([math.floor(1000 * math.log((2 * size + 2) / (2 * c + 1))) for c in np.bincount(term)])
    visited = [0, 0]
    parts = list(search.best_documents(postings, np.arange(terms_), weight, 1, 10, visited))
    held = np.flatnonzero(np.bincount(doc, minlength=size))
    at = np.arange(terms_)
    every = postings.scores(held, at, postings.masks(at)[0], weight)
    best = sorted(np.concatenate([s for _, s in parts]).tolist(), reverse=True)[:10]
    assert best == sorted(every.tolist(), reverse=True)[:10]
    assert visited[1] == len(held) and visited[0] < visited[1] / 3


def test_odd_rows(spark):
    items = [(None, "alpha beta"), (1, None), (2, ""), (3, "... !"), (4, "alpha"), (4, "alpha"), (5, "été ALPHA-7"), (6, "nowhere")]
    docs = [(None, "alpha"), (None, "alpha"), (3, "alpha"), (3, "alpha"), (1, None), (2, ""), (9, "?!"), (5, "Été été 7"), (6, "beta " * 5000), (7, "gamma")]
    assert searched(spark, docs, items) == plain_search(docs, items)
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == [] and searched(spark, [(1, None)], items) == []
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "Rank": F.lit(2), "item_id": F.lit(3), "n": F.lit(0)})
    given = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit(1), "doc_id": F.lit(7), "terms": F.lit("x")})
    out = lexical_search(df, given)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and sorted([tuple(r) for r in out.collect()], key=repr) == plain_search(docs, items)


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted([tuple(r) for r in op11_presence_masks(spark, sf).collect()], key=repr) == plain_search(docs, items)
