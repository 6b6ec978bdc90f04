import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_SMALL
from llm import plain
from llm.test_mixing import expected as mixed
from llm.test_packing import ids
from vigil.llm.quality import fit_quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def exact(rows):
    keep = {}
    for i, t, _ in rows:
        keep[plain.ascii_lower(t)] = max(keep.get(plain.ascii_lower(t), -1), i)
    return [r for r in rows if keep[plain.ascii_lower(r[1])] == r[0]]


def near(rows):
    prints = {i: plain.fingerprint(t) for i, t, _ in rows}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    comp = plain.components(list(prints), links)
    return [r for r in rows if comp[r[0]] == r[0]]


def test_run_matches_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    kept = near(exact([r for r in rows if model.score((r[1] or "").encode()) >= 0.3]))
    texts = {i: t for i, t, _ in kept}
    assert 50 < len(kept) < len(rows)
    copies = Counter(i for i, _, _, _ in mixed([(i, s) for i, _, s in kept]).elements())
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == copies
    assert {r.doc_id: r.start + r.length for r in sorted(out, key=lambda r: r.piece)} == {i: len(ids(texts[i])) for i in copies}
    cells = Counter((r.sequence_id, r.offset) for r in out)
    assert max(cells.values()) == 1
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024 and len(fill) <= 1.05 * sum(fill.values()) / 1024 + 1


ODD = [
    (1, "The same text", "en", "a", 13), (2, "the SAME text", None, "a", None), (3, None, "en", None, 0), (4, "", "en", "b", 0), (5, "x" * 200_000, "en", "a", 200_000),
    (6, "word " * 30_000, "en", "a", 5), (7, "the same text", "en", "a", 1), (7, "the same text", "en", "a", 1), (None, "no id", "de", "b", 2),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_take_odd_rows_and_extra_columns(spark, rows, tmpdir_path):
    path = f"{tmpdir_path}/documents.parquet"
    clash = {"kept": F.lit("k"), "Score": F.lit(1), "piece": F.lit(2), "n": F.lit(3), "copy": F.lit("c"), "fingerprint": F.lit(0), "label": F.lit(1)}
    plain.docs(spark, rows).withColumns(clash).write.parquet(path)
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmpdir_path}/labels.parquet")
    docs = spark.read.parquet(path)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tmpdir_path)
        out.write.parquet(f"{tmpdir_path}/{n}")
        docs = spark.read.parquet(f"{tmpdir_path}/{n}")
        if n < 4:
            assert docs.columns == [*COLUMNS, *clash]
        if n == 1 and rows:
            assert Counter(r.doc_id for r in docs.collect()) == Counter([4, 5, 6, 7, 7, None])
    assert docs.isEmpty() == (not rows)


def test_stages_are_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "poisson_mixing", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
