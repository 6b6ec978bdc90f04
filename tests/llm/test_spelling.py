import random
import re
import zlib
from collections import Counter

from .plain import LOWER
from pyspark.sql import functions as F
from vigil.llm import spelling
from vigil.llm.queries import op12_trie_frontier
from vigil.llm.spelling import spelling_variants

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def plain_variants(rows, min_letters=6, min_count=5):
    """Every word against all spellings one edit away."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_letters and n >= min_count}
    letters = set("".join(words))
    near, form, out = {}, {}, set()
    for w in words:
        less = {w[:k] + w[k + 1 :] for k in range(len(w))}
        more = {w[:k] + c + w[k + d :] for k in range(len(w) + 1) for c in letters for d in (0, 1)}
        near[w] = {x for x in (less | more) - {w} if x in words}
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def variants(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r[c] for c in NAMES) for r in spelling_variants(df, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_random_words_equal_the_plain_version(spark):
    draw = random.Random(5)
    stems = ["".join(draw.choice("abé") for _ in range(draw.randint(3, 9))) for _ in range(60)]
    rows = [(k, " ".join(draw.choices(stems, [2.0**-i for i in range(60)], k=80)) + " " + " ".join(draw.choices(stems, k=40))) for k in range(60)]
    for least in (1, 4, 6):
        expected = plain_variants(rows, least, 2)
        assert variants(spark, rows, min_letters=least, min_count=2) == expected
        assert any(r[1] for r in expected)


def test_edits_at_every_place(spark):
    word = "abcdefgh"
    near = {word[:k] + c + word[k + d :] for k in range(len(word) + 1) for c in "axÿ" for d in (0, 1)} | {word[:k] + word[k + 1 :] for k in range(8)}
    near.discard(word)
    rows = [(1, " ".join([word] * 9 + sorted(near) * 2 + ["abcdefxx"] * 2))]
    found = {r[0]: r for r in variants(spark, rows, min_count=1)}
    assert found[word][4] == len(near & set(found)) and set(found.values()) == plain_variants(rows, 6, 1)


def test_odd_rows(spark):
    assert variants(spark, []) == set()
    long = "ab" * 3000
    rows = [
        (None, "Strasse STRASSE strasse strasse strasse Strassé"), (None, "strasze" * 1), (7, None), (7, ""), (7, "1 2 3 ..."),
        (7, "strasseĀstrasse " * 3), (8, " ".join([long] * 5 + [long[:-1]] * 5 + ["x" + long] * 25)), (8, "aaaaaa " * 5 + "aaaaaaa " * 25 + "aaaaaaaa " * 125),
    ]
    found = variants(spark, rows)
    assert found == plain_variants(rows)
    by = {r[0]: r for r in found}
    assert by["aaaaaa"][1:3] == ("aaaaaaa", "aaaaaaaa") and by[long][1] == "x" + long and by[long[:-1]][1] is None


def test_clashing_columns_and_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    rows = [(1, "anders anderes " * 10 + "andern " * 2), (1, "andern anders " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "wid": F.lit(2), "Root": F.lit(3)})
    out = spelling_variants(df)
    assert out.columns == NAMES and {tuple(r) for r in out.collect()} == plain_variants(rows)


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = op12_trie_frontier(spark, sf)
    assert out.columns == NAMES and {tuple(r) for r in out.collect()} == plain_variants(rows)
