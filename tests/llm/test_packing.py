import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from llm import plain
from vigil.llm.packing import WordTokens, cut_points, fill, pack, place, plan, sequences
from vigil.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(VOCABULARY)
WORDS = WordTokens(VOCABULARY, words=50)
SPACES = st.sampled_from([" ", " ", " ", "\n", "\t", "  ", "\n\n", " \n", "\n ", "\r\n", "\xa0", " ", "\x1c", "　", ""])
TEXTS = st.lists(st.one_of(SPACES, st.text(max_size=6), st.sampled_from(["the", "don't", "a.b", "'s", "12ab", "<|endoftext|>", "é", "日本"])), max_size=30).map("".join)


def ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=8))
def test_ids_of_words_are_ids_of_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in WORDS.texts(texts)] == [ids(t)[:-1] for t in texts]


def check(rows, texts, capacity=1024, crc=True):
    """rows: pieces with doc_id; every doc_id occurs once in texts."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for i, found in pieces.items():
        found.sort(key=lambda r: r.piece)
        want, at = ids(texts[i]), 0
        assert [r.piece for r in found] == list(range(len(found)))
        assert [r.length for r in found[1:]] == [capacity] * (len(found) - 1)
        for r in found:
            assert r.start == at and 0 < r.length <= capacity
            part = np.array(want[at : at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            assert r.ids is None if crc else r.ids == part.tolist()
            at += r.length
        assert at == len(want)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_query_matches_tokenizer(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op5_best_two_fit"](spark, SF_SMALL).withColumn("ids", F.lit(None)).collect()
    used, tokens = check(rows, docs)
    assert used <= -(-tokens // 1024) + 2


@pytest.mark.parametrize(
    "rows",
    [[], [(1, None), (2, ""), (3, " "), (4, "a\n\n\nb  c"), (5, "<|endoftext|> x"), (6, "word " * 40_000), (None, "n")], [(1, "x y z " * 500)]],
)
def test_odd_rows(spark, rows):
    check(pack(plain.docs(spark, rows), VOCABULARY).collect(), dict(rows), crc=False)


def test_repeated_rows_are_documents_of_their_own(spark):
    out = pack(plain.docs(spark, [(1, "a b c")] * 700), VOCABULARY).collect()
    assert len(out) == 700 and len({(r.sequence_id, r.offset) for r in out}) == 700
    assert len({r.sequence_id for r in out}) == -(-700 * 4 // 1024)


def test_sequences_hold_the_ids_in_order(spark):
    texts = {i: "w " * (i * 37 % 900) for i in range(60)}
    pieces = pack(plain.docs(spark, list(texts.items())), VOCABULARY)
    whole = {r.sequence_id: r.ids for r in sequences(pieces).collect()}
    for r in pieces.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_clashing_columns(spark):
    df = plain.docs(spark, [(1, "a"), (2, "b")]).withColumns({"Piece": F.lit("x"), "n": F.lit(1), "offset": F.lit(9)})
    out = pack(df, VOCABULARY)
    check(out.collect(), {1: "a", 2: "b"}, crc=False)
    assert "n" in out.columns and "Piece" not in out.columns


def test_pieces_are_full_but_for_the_first():
    assert cut_points(1, 4) == [1] and cut_points(4, 4) == [4] and cut_points(9, 4) == [1, 5, 9]


def test_two_pieces_replace_the_smallest():
    left = np.zeros(11, np.int64)
    for size in (6, 3, 2, 2):
        left[size] += 1
    # greedy fills 6 + 3 (one left over); 2 + 2 fill the gap of 4 exactly
    assert fill(left, 10) == [6, 2, 2]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_places_every_piece_once(histogram):
    table = plan(histogram, 30)
    size = np.repeat(np.array(list(histogram), np.int64), list(histogram.values()))
    rank = np.concatenate([np.arange(n) for n in histogram.values()]) if histogram else np.empty(0, np.int64)
    if not histogram:
        return
    sequence, offset = place(table, size, rank)
    cells = Counter((int(s), int(o) + k) for s, o, z in zip(sequence, offset, size) for k in range(z))
    assert max(cells.values()) == 1
    for s in set(sequence.tolist()):
        assert sorted(o for q, o in cells if q == s) == list(range(int(size[sequence == s].sum())))
        assert size[sequence == s].sum() <= 30
