"""Spelling variants: near words found by walking a trie of all words level by level.

1. Words are counted over all texts; words that are long and frequent enough enter two tries, one of
   the words and one of the words reversed. Both start behind ``min_letters`` // 2 characters, which
   every word has. A node's id is a 128-bit hash of the characters up to it. Only nodes that branch
   or end a word stay; an edge carries all characters down to the next such node. Edges are rows of a
   table, numbered by their level.
2. A state is (word, position, node, edits). States without an edit lie on the word's own path, and two
   words part at a node. Words that differ by one edit agree on the first or on the last half of the
   shorter one, so a state needs to spend its edit only behind the first half: in one of both tries it
   meets the other word.
3. Level by level, states are joined with the edges of that level. A state without an edit spends it on
   the first character of an edge that isn't its own (a character replaced by a larger one, or
   inserted); one that has spent it follows only the edge that goes on like its word. A state whose
   word ends on a node that ends a word is a pair of near words, found once; both directions follow.
4. A word's form is its most frequent near word; roots follow from the forms by pointer doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from operator import methodcaller

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import discard, materialize
from .common import bound_batches

RUN = re.compile("[a-zÀ-ÿ]+")
WORDS_AT_ONCE = 300_000
LETTERS_AT_ONCE = 32_000_000
ROWS_AT_ONCE = 50_000
LONG_TEXT = 4_000_000


def text_words(doc_id: str, text: str, divisor: int = 199) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of a text, A-Z lower-cased; a word drawn by the crc32 of "id:word" loses one character."""
    lower = text.encode().lower().decode()
    runs = RUN.findall(lower) if len(lower) < LONG_TEXT else map(methodcaller("group"), RUN.finditer(lower))
    start = zlib.crc32(f"{doc_id}:".encode())
    for word, n in Counter(runs).items():
        drawn = zlib.crc32(word.encode(), start)
        if drawn % divisor == 0:
            at = drawn % len(word)
            word = word[:at] + word[at + 1 :]
        yield word, n


def word_counts(df: DataFrame, id_col: str, text_col: str, min_letters: int, min_count: int, divisor: int) -> DataFrame:
    """(wid, word, n) of all words of at least ``min_letters`` characters and ``min_count`` occurrences, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        read = 0

        def out() -> pa.RecordBatch:
            words = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return words

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for word, n in text_words(doc_id, text, divisor) if text else ():
                    if len(word) >= min_letters:
                        seen[word] += n
                read += len(text or "")
                if len(seen) > WORDS_AT_ONCE or read > LETTERS_AT_ONCE:
                    yield out()
                    read = 0
        yield out()

    bound_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.col(f"`{text_col}`")).mapInArrow(run, "word string, n long")
    counts = rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return materialize(counts.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "llm-words")


def trie_nodes(first: int):
    """mapInArrow function: (wid, word) -> (side, wid, depth, node, next, letters), a row per node on the word's two paths.

    Side 1 is the reversed word; ``next`` is the character that follows the node, empty at the word's end.
    """

    def paths(wid: int, word: str) -> Iterator[tuple]:
        for side, text in ((0, word), (1, word[::-1])):
            state = blake2b(text[:first].encode(), digest_size=16, person=b"%d" % side)
            for depth in range(first, len(text)):
                yield side, wid, depth, state.digest(), text[depth], len(text)
                state.update(text[depth].encode())
            yield side, wid, len(text), state.digest(), "", len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int32()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["side", "wid", "depth", "node", "next", "letters"])

        rows: list[tuple] = []
        for batch in batches:
            for wid, word in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in paths(wid, word.as_py()):
                    rows.append(row)
                    if len(rows) >= ROWS_AT_ONCE:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    return run


def build_trie(words: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: the words' paths (side, wid, level, depth, node, child, child_depth) and the edges.

    Edges are (level, node, start, label, child, leaf, shortest, longest): ``start`` is the label's
    first character, ``leaf`` the word that ends on the child (null: none), and the words below the
    child have from ``shortest`` to ``longest`` characters.
    """
    rows = materialize(words.select("wid", "word").mapInArrow(trie_nodes(first), "side int, wid long, depth int, node binary, next string, letters int"), "llm-trie-rows")
    nodes = (
        rows.groupBy("node")
        .agg(
            F.min("next").alias("low"),
            F.max("next").alias("high"),
            F.min("depth").alias("depth"),
            F.max(F.when(F.col("next") == "", F.col("wid"))).alias("leaf"),
            F.min("letters").alias("shortest"),
            F.max("letters").alias("longest"),
        )
        .filter((F.col("low") != F.col("high")) | F.col("leaf").isNotNull() | (F.col("depth") == first))
        .select("node", "leaf", "shortest", "longest")
    )
    nodes = materialize(nodes, "llm-trie-nodes")
    down = Window.partitionBy("side", "wid").orderBy("depth")
    path = (
        rows.join(nodes.select("node"), "node")
        .select(
            "side", "wid", "depth", "node",
            (F.row_number().over(down) - 1).alias("level"),
            F.lead("node").over(down).alias("child"),
            F.lead("depth").over(down).alias("child_depth"),
        )
    )
    path = materialize(path, "llm-trie-paths")
    text = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    label = F.substring(text, F.col("depth") + 1, F.col("child_depth") - F.col("depth"))
    edges = (
        path.filter("child is not null")
        .groupBy("child")
        .agg(F.min(F.struct("wid", "side", "level", "node", "depth", "child_depth")).alias("e"))
        .select("child", "e.*")
        .join(words.select("wid", "word"), "wid")
        .withColumn("label", label)
        .join(nodes.withColumnRenamed("node", "child"), "child")
        .select("level", "node", F.left("label", F.lit(1)).alias("start"), "label", "child", "leaf", "shortest", "longest")
    )
    edges = materialize(edges, "llm-trie-edges")
    discard(rows)
    discard(nodes)
    return path, edges


def spend_edit(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """States that part from their own word's path and take their one edit there: (wid, goal, rest, node, leaf).

    ``rest`` are the word's characters that are left, ``goal`` the length of the word looked for.
    """
    rest, m = F.col("rest"), F.length("label")
    tail = F.substring(F.col("label"), F.lit(2), m)
    first = F.left(rest, F.lit(1))
    replaced = (rest != "") & (first < F.col("start")) & F.startswith(F.substring(rest, F.lit(2), F.length(rest)), tail)
    inserted = F.startswith(rest, tail)

    def state(fits: Column, used: Column, goal: Column) -> Column:
        fits = fits & goal.between(F.col("shortest"), F.col("longest"))
        return F.when(fits, F.struct(goal.alias("goal"), F.substring(rest, used + 1, F.length(rest)).alias("rest")))

    found = F.array_compact(F.array(state(replaced, m, F.col("letters")), state(inserted, m - 1, F.col("letters") + 1)))
    return (
        starts.join(edges, "node")
        .filter(first != F.col("start"))
        .select("wid", F.explode(found).alias("s"), F.col("child").alias("node"), "leaf")
        .select("wid", "s.goal", "s.rest", "node", "leaf")
    )


def follow(states: DataFrame, edges: DataFrame) -> DataFrame:
    """States whose edit is spent, moved down the one edge that goes on like their word."""
    rest, m = F.col("rest"), F.length("label")
    return (
        states.filter(rest != "")
        .select("wid", "goal", "rest", "node", F.left(rest, F.lit(1)).alias("start"))
        .join(edges, ["node", "start"])
        .filter(F.startswith(rest, F.col("label")) & F.col("goal").between(F.col("shortest"), F.col("longest")))
        .select("wid", "goal", F.substring(rest, m + 1, F.length(rest)).alias("rest"), F.col("child").alias("node"), "leaf")
    )


def near_pairs(words: DataFrame, min_letters: int) -> DataFrame:
    """(a, b) of word ids, once for each of both directions, of words one edit apart."""
    spark = words.sparkSession
    path, edges = build_trie(words, max(1, min_letters // 2))
    letters = F.length("word")
    half = F.when(F.col("side") == 0, F.ceil(letters / 2)).otherwise(F.floor(letters / 2)).cast("int")
    text = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word"))
    starts = (
        path.join(words.select("wid", "word"), "wid")
        .filter(F.col("depth") >= half)
        .select("level", "node", "wid", letters.alias("letters"), F.substring(text, F.col("depth") + 1, letters).alias("rest"))
    )
    starts = materialize(starts.sortWithinPartitions("level"), "llm-trie-starts")
    last = edges.agg(F.max("level")).first()[0]
    levels = []
    for level in range(0 if last is None else last + 1):
        own = edges.filter(F.col("level") == level).drop("level")
        moved = spend_edit(starts.filter(F.col("level") == level).drop("level"), own)
        if levels:
            moved = moved.unionByName(follow(levels[-1], own))
        levels.append(materialize(moved.filter("rest != '' or leaf is not null"), "llm-frontier"))
    none = spark.createDataFrame([], "wid long, leaf long")
    ended = reduce(DataFrame.unionByName, [s.filter("rest = ''").select("wid", "leaf") for s in levels], none)
    both = F.array(F.struct(F.col("wid").alias("a"), F.col("leaf").alias("b")), F.struct(F.col("leaf").alias("a"), F.col("wid").alias("b")))
    pairs = materialize(ended.distinct().select(F.explode(both).alias("p")).select("p.a", "p.b").distinct(), "llm-near-words")
    for table in [path, edges, starts, *levels]:
        discard(table)
    return pairs


def follow_forms(forms: DataFrame) -> DataFrame:
    """(wid, form) with every form followed to the last.

    Occurrences grow fivefold along a chain, so 64-bit counts allow fewer than 32 steps: five doublings.
    """
    now = materialize(forms, "llm-roots")
    for _ in range(5):
        on = now.select(F.col("wid").alias("form"), F.col("form").alias("_next"))
        step = now.join(on, "form", "left")
        if step.filter("_next is not null").isEmpty():
            break
        after = materialize(step.select("wid", F.coalesce("_next", "form").alias("form")), "llm-roots")
        discard(now)
        now = after
    return now


def spelling_variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = 6, min_count: int = 5, divisor: int = 199
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``min_letters`` characters and ``min_count`` occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased; where
    ``divisor`` divides the crc32 of "<id>:<run>", the run loses the character at that number modulo
    its length. Words are near if one inserted, deleted or replaced character makes them equal;
    ``n_near`` counts them. ``form`` is the near word of largest ``n`` (ties: the smallest in
    code-point order) if that is at least five times the word's own; ``root`` follows forms to the last.

    Null and empty texts have no words, null ids count as empty texts, rows that share an id count
    each. Texts are read whole, long ones run by run. Columns beside id and text are not looked at,
    whatever their names. An empty table gives an empty result.
    """
    words = word_counts(df, id_col, text_col, min_letters, min_count, divisor)
    pairs = near_pairs(words, min_letters)
    other = words.select(F.col("wid").alias("b"), F.col("word").alias("b_word"), F.col("n").alias("b_n"))
    best = pairs.join(other, "b").groupBy(F.col("a").alias("wid")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("k"), F.col("b_word").alias("form"), F.col("b").alias("form_id"))).alias("best")
    )
    large = (-F.col("best.k")) >= 5 * F.col("n")
    known = words.join(best, "wid", "left").select(
        "wid", "word", "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(large, F.col("best.form")).alias("form"),
        F.when(large, F.col("best.form_id")).alias("form_id"),
        F.when(large, -F.col("best.k")).alias("form_n"),
    )
    known = materialize(known, "llm-forms")
    discard(pairs)
    roots = follow_forms(known.filter("form_id is not null").select("wid", F.col("form_id").alias("form")))
    roots = roots.join(words.select(F.col("wid").alias("form"), F.col("word").alias("root")), "form").select("wid", "root")
    return known.join(roots, "wid", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
