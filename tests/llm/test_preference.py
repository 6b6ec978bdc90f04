import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from vigil.llm.preference import format_preferences, swapped_replies
from vigil.llm.queries import QUERIES

SCHEMA = "pair_id long, turn long, role string, text string"


def brute(chosen, rejected):
    def turns(rows, i):
        mine = [r for r in rows if r[0] == i]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        return [(r[2] or "", r[3] or "") for r in mine]

    def render(part):
        text, spans = "", []
        for role, body in part:
            head, rest = f"<|{role}|>\n", f"{body}<|end|>\n"
            a = len(text)
            spans += [(a, a + len(head), False), (a + len(head), a + len(head) + len(rest), role == "assistant")]
            text += head + rest
        return text, spans

    out = []
    for i in {r[0] for r in chosen + rejected}:
        a, b = turns(chosen, i), turns(rejected, i)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        (x, mx), (y, my) = render(a[n:]), render(b[n:])
        out.append((i, render(a[:n])[0], n, x, y, mx, my))
    return sorted(out, key=repr)


def got(df):
    return sorted(
        ((r.pair_id, r.prompt, r.prompt_turns, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]) for r in df.collect()),
        key=repr,
    )


CHOSEN = [
    (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "yes"), (1, 3, "user", "more"), (1, 4, "assistant", "ok"),
    (2, 0, "user", "only"), (3, 0, "user", "same"), (3, 1, "assistant", "same"), (4, 0, None, None), (4, None, "user", "first"),
    (5, 0, "user", "x" * 200_000), (6, 0, "user", "longer"), (6, 1, None, None), (None, 0, "user", "n"), (8, 0, "user", "t"), (8, 0, "user", "t"),
]
REJECTED = [
    (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "no"), (1, 3, "user", "more"), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
    (4, 0, "", ""), (4, None, "user", "first"), (5, 0, "user", "x" * 200_000), (5, 1, "assistant", "é"), (6, 0, "user", "longer"),
    (7, 0, "assistant", "alone"), (8, 0, "user", "t"),
]


@pytest.mark.parametrize("chosen, rejected", [(CHOSEN, REJECTED), (REJECTED, CHOSEN), ([], []), (CHOSEN, []), ([], REJECTED)])
def test_matches_plain_version(spark, chosen, rejected):
    out = format_preferences(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA))
    assert got(out) == brute(chosen, rejected)


def test_masks_cover_completions(spark):
    for r in format_preferences(spark.createDataFrame(CHOSEN, SCHEMA), spark.createDataFrame(REJECTED, SCHEMA)).collect():
        for text, spans in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert "".join(text[s.start : s.end] for s in spans) == text
            assert all(text[s.start : s.end].endswith("<|end|>\n") for s in spans if s.train)


def test_clashing_columns(spark):
    a = spark.createDataFrame(CHOSEN, SCHEMA).withColumns({"prompt": F.lit(1), "chosen": F.lit(2), "_0": F.lit(3)})
    b = spark.createDataFrame(REJECTED, SCHEMA).withColumn("x", F.lit(1))
    assert got(format_preferences(a, b)) == brute(CHOSEN, REJECTED)


def test_query_holds_every_conversation_and_no_python(spark):
    df = QUERIES["op3_preference_format"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    turns = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    other = [tuple(r) for r in swapped_replies(turns).collect()]
    want = {r[0]: r[1:5] for r in brute(rows, other)}
    assert {r.conv_id: (r.prompt, r.prompt_turns, r.chosen, r.rejected) for r in df.collect()} == want


def test_turns_without_pair_are_pairs_of_their_own(spark):
    chosen = CHOSEN + [(None, 3, "assistant", "a"), (None, 3, "assistant", "a"), (None, None, None, None)]
    rejected = REJECTED + [(None, 0, "user", "n")]
    out = format_preferences(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA))
    held = lambda rows: [r for r in rows if r[0] is not None]
    alone = [r for row in chosen if row[0] is None for r in brute([row], [])] + [r for row in rejected if row[0] is None for r in brute([], [row])]
    assert got(out) == sorted(brute(held(chosen), held(rejected)) + alone, key=repr)


def test_long_conversations(spark):
    chosen = [(1, k, "assistant" if k % 2 else "user", "é" * (k % 5)) for k in range(1000)]
    rejected = [(1, k, "assistant" if k % 3 else "user", "x" * (k % 7)) for k in range(37)]
    out = format_preferences(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA))
    assert got(out) == brute(chosen, rejected)


def test_masks_of_very_long_conversations_end(spark):
    n = 40_000
    turns = spark.range(n).selectExpr("1L AS pair_id", "id AS turn", "'assistant' AS role", "'t' AS text")
    out = format_preferences(turns, turns.limit(0)).selectExpr("size(chosen_mask) AS n", "chosen_mask[size(chosen_mask) - 1].end AS end", "length(chosen) AS length")
    start = time.monotonic()
    assert [tuple(r) for r in out.collect()] == [(2 * n, n * 23, n * 23)]
    assert time.monotonic() - start < 40
