import pytest

from conftest import SF_SMALL
from llm import plain
from vigil.llm.queries import QUERIES
from vigil.llm.sharding import jump, shard_by_key


def key(doc_id):
    import hashlib

    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def check(rows, texts, shards=16):
    slots = {}
    for r in rows:
        text = texts[r.doc_id]
        assert r["size"] == (len(text.encode()) if text is not None else 0) + 1
        assert r.text_crc32 == plain.crc(text) and r.law == "key"
        assert r.shard == plain.jump(key(r.doc_id), shards)
        assert r.grown_shard == plain.jump(key(r.doc_id), shards + 1)
        assert r.grown_shard in (r.shard, shards)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_known_values_of_the_hash():
    import numpy as np

    keys = [0, 1, 2, 12345, 2**63, 2**64 - 1, 0xDEADBEEF]
    for n in (1, 2, 16, 17, 1000):
        assert jump(np.array(keys, np.uint64), n).tolist() == [plain.jump(k, n) for k in keys]


def test_query_matches_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op4_jump_shards"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    check(rows, docs)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "é" * 100_000), (None, "x")], [(5, "a")] * 20])
def test_odd_rows(spark, rows):
    out = shard_by_key(plain.docs(spark, rows)).collect()
    assert len(out) == len(rows)
    check(out, dict(rows))


def test_appended_shard_only_receives(spark):
    df = plain.docs(spark, [(i, str(i)) for i in range(4000)])
    moved = shard_by_key(df).filter("shard != grown_shard")
    assert 120 < moved.count() < 360 and moved.filter("grown_shard != 16").isEmpty()


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = plain.docs(spark, [(1, "a"), (2, "b")]).withColumns({"Shard": F.lit("x"), "rank": F.lit(1), "slot": F.lit(9)})
    out = shard_by_key(df)
    check(out.collect(), {1: "a", 2: "b"})
    assert "rank" in out.columns and "Shard" not in out.columns
