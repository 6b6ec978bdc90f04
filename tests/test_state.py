"""Keyed state: what batches leave, merged in generations, equals a plain dictionary; it stays small; crashes lose nothing."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.streaming.state import KeyedState, least, newest, stored_schema

SCHEMA = T.StructType().add("k", "string").add("v", "long").add("gone", "boolean")


def make(spark, path, **more):
    return KeyedState(spark, os.path.join(path, "s"), SCHEMA, ["k"], merge=newest(["k"]), buckets=4, fan=3, **more)


def rows(spark, items):
    return spark.createDataFrame([(k, v, g) for k, (v, g) in items.items()], SCHEMA)


def got(df):
    return {r.k: (r.v, r.gone) for r in df.collect()}


def test_many_batches(spark, tmpdir_path):
    draw = random.Random(1)
    state, want = make(spark, tmpdir_path, keep=~F.col("gone")), {}
    most = []
    for batch in range(20):
        state.compact(batch)
        some = {f"k{draw.randrange(12)}": (draw.randrange(1000), draw.random() < 0.2) for _ in range(3)}
        state.write(rows(spark, some), batch)
        want |= some
        most.append(len(state.runs(batch + 1)))
    assert got(state.read(20)) == {k: v for k, v in want.items() if k in got(state.read(20)) or not v[1]}
    assert {k: v for k, v in got(state.read(20)).items() if not v[1]} == {k: v for k, v in want.items() if not v[1]}
    # so many runs at the end as in the middle, but for a generation more
    assert max(most) <= 3 + 2 + 2
    keys = spark.createDataFrame([("k1",), ("k5",), ("none",)], "k string")
    assert got(state.read(20, keys)) == {k: v for k, v in got(state.read(20)).items() if k in ("k1", "k5")}
    assert stored_schema(spark, state.path) == SCHEMA


def test_only_the_buckets_of_the_keys_are_read(spark, tmpdir_path):
    state = make(spark, tmpdir_path)
    state.write(rows(spark, {f"k{i}": (i, False) for i in range(40)}), 0)
    keys = spark.createDataFrame([("k7",)], "k string")
    files = state.read(1, keys).inputFiles()
    assert len(files) == 1 and len(state.read(1).inputFiles()) == 4


def test_a_retried_batch_and_a_crash_while_merging(spark, tmpdir_path):
    state = make(spark, tmpdir_path)
    for batch in range(3):
        state.write(rows(spark, {"a": (batch, False), f"b{batch}": (batch, False)}), batch)
    state.write(rows(spark, {"a": (2, False), "b2": (2, False)}), 2)  # the retry
    before = got(state.read(3))
    assert before == {"a": (2, False), "b0": (0, False), "b1": (1, False), "b2": (2, False)}
    state.compact(3)
    (merged,) = state.runs(3)
    assert (merged.first, merged.last, merged.generation) == (0, 2, 1) and got(state.read(3)) == before
    # the merged run isn't complete: its parts still count, and the next call writes it again
    os.remove(os.path.join(state.path, merged.name, "_SUCCESS"))
    assert len(state.runs(3)) == 3 and got(state.read(3)) == before
    state.compact(3)
    assert got(state.read(3)) == before
    # a batch that runs again sees only what was there before it
    assert got(state.read(1)) == {"a": (0, False), "b0": (0, False)}
    state.write(rows(spark, {"c": (3, False)}), 3)
    state.compact(4)  # what was merged goes one batch later
    assert len([n for n in os.listdir(state.path) if n.startswith("run=")]) == 2
    assert got(state.read(4)) == before | {"c": (3, False)}
    shutil.rmtree(state.path)
    assert got(state.read(4)) == {}


def test_least_merges_step_by_step(spark, tmpdir_path):
    state = KeyedState(spark, os.path.join(tmpdir_path, "s"), SCHEMA, ["k"], merge=least(["k"], "v"), buckets=2, fan=2)
    for batch, v in enumerate([5, 3, 9, 3, 1, 7]):
        state.compact(batch)
        state.write(rows(spark, {"a": (v, False), f"x{batch}": (v, False)}), batch)
    found = got(state.read(6))
    assert found["a"][0] == 1 and len(found) == 7


@pytest.mark.parametrize("keep", ["v >= 3", None])
def test_what_is_out_of_reach_goes_with_the_oldest_run(spark, tmpdir_path, keep):
    state = make(spark, tmpdir_path)
    for batch in range(4):
        state.compact(batch, keep and F.expr(keep))
        state.write(rows(spark, {f"k{batch}": (batch, False)}), batch)
    assert set(got(state.read(4))) == ({"k3"} if keep is not None else {"k0", "k1", "k2", "k3"})
