"""Ranked lexical search by presence masks.

1. Items are dealt into blocks of bounded size; a block's distinct terms are shared with all tasks.
2. One pass over the texts leaves, per document, its length and the block's terms with their counts
   (written). Document counts, lengths and document frequencies of all documents follow from it.
3. Documents are taken some thousands at a time. Every term has a bitmap of the documents that hold
   it; an item's bitmaps, turned by 90 degrees, are its documents' presence masks. Documents are
   grouped by mask. A mask's highest possible score is the sum of its terms' highest shares among these
   documents; masks are evaluated by descending highest score, document by document, until it can't
   reach the item's best scores any more. What a task found before counts for its later documents.
4. Each task hands on the best documents of each item; the best of these are the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import materialize
from .common import bound_batches

OCTETS_AT_ONCE = 4_000_000
DOCS_AT_ONCE = 8192
POSTINGS_AT_ONCE = 4_000_000
BITMAP_OCTETS = 64_000_000
# Octets that belong to terms (digits, letters, all of non-ASCII characters), lower-cased; others are blanks.
TERM_OCTETS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def text_terms(text: bytes) -> Counter:
    """Occurrences of every term; long texts are read in pieces that end between terms."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(at + OCTETS_AT_ONCE, len(text))
        while end < len(text) and TERM_OCTETS[text[end]] != 32:
            end += 1
        found.update(text[at:end].translate(TERM_OCTETS).split())
        at = end
    return found


def read_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, terms) of every row of ``items``, written; ``item`` numbers the rows."""
    id_type = items.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(text_terms(t.as_py() or b"")) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    schema = T.StructType().add("item_id", id_type).add("terms", T.ArrayType(T.BinaryType()))
    rows = items.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
    return materialize(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "terms"), "llm-items")


def read_postings(df: DataFrame, id_col: str, text_col: str, lexicon: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with terms, written: all its terms' number, and the lexicon's terms it holds."""
    shared = df.sparkSession.sparkContext.broadcast({term: k for k, term in enumerate(lexicon)})
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            terms: list[int] = []
            tfs: list[int] = []
            ends = [0]
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                found = text_terms(text.as_py() or b"")
                n[k] = found.total()
                for term in found.keys() & number.keys() if len(found) > len(number) else [t for t in found if t in number]:
                    terms.append(number[term])
                    tfs.append(found[term])
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    bound_batches(df.sparkSession)
    schema = T.StructType().add("doc_id", id_type).add("n", "long").add("terms", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.LongType()))
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
    return materialize(rows, "llm-postings")


class Postings:
    """The postings of some documents, by term, with their score shares and the terms' bitmaps."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, docs: int, length: int):
        order = np.argsort(term, kind="stable")
        self.size = len(n)
        self.doc, term, tf = doc[order], term[order], tf[order]
        m = 10 + 90 * n * docs // length
        self.share = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.doc])
        self.term, first = np.unique(term, return_index=True)
        self.first = np.append(first, len(term))
        self.best = np.maximum.reduceat(self.share, first) if len(term) else np.zeros(0, np.int64)
        self.bitmaps = np.zeros((len(self.term), -(-self.size // 8)), np.uint8)
        rows = max(1, BITMAP_OCTETS // max(self.size, 1))
        for at in range(0, len(self.term), rows):
            some = slice(self.first[at], self.first[min(at + rows, len(self.term))])
            held = np.zeros((min(rows, len(self.term) - at), self.size), bool)
            held[np.searchsorted(self.term, term[some]) - at, self.doc[some]] = True
            self.bitmaps[at : at + rows] = np.packbits(held, axis=1)

    def masks(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the terms at ``at``: which documents hold them (terms x documents), the distinct masks (masks x terms), each document's mask."""
        held = np.unpackbits(self.bitmaps[at], axis=1, count=self.size)
        packed = np.packbits(held, axis=0)
        words = np.zeros((self.size, -(-packed.shape[0] // 8) * 8), np.uint8)
        words[:, : packed.shape[0]] = packed.T
        words = words.view(np.uint64)
        _, one, which = np.unique(words[:, 0], return_index=True, return_inverse=True)
        for k in range(1, words.shape[1]):
            _, next_which = np.unique(words[:, k], return_inverse=True)
            _, one, which = np.unique(which * (int(next_which.max()) + 1) + next_which, return_index=True, return_inverse=True)
        return held, held[:, one].T, which

    def scores(self, chosen: np.ndarray, at: np.ndarray, held: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores of the ``chosen`` documents."""
        out = np.zeros(len(chosen), np.int64)
        for k, t in enumerate(at):
            has = np.flatnonzero(held[k, chosen])
            if has.size:
                first, last = self.first[t], self.first[t + 1]
                out[has] += weight[k] * self.share[first + np.searchsorted(self.doc[first:last], chosen[has])]
        return out


def best_documents(postings: Postings, terms: np.ndarray, weight: np.ndarray, least: int, top: int, visited: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, scores) among which are all ``top`` best of the item, scores of at least ``least`` (and above 0) only.

    ``visited`` counts the documents that were evaluated and all that hold a term.
    """
    at = np.searchsorted(postings.term, terms)
    fits = at < len(postings.term)
    fits[fits] = postings.term[at[fits]] == terms[fits]
    fits &= weight > 0
    at, weight = at[fits], weight[fits]
    if not at.size:
        return
    held, masks, which = postings.masks(at)
    # whole numbers below 2^53, so exact in doubles
    high = masks.astype(np.float64) @ (weight * postings.best[at]).astype(np.float64)
    order = np.argsort(-high, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs = np.argsort(place[which], kind="stable")
    above = high[which[docs]]
    some = int(np.count_nonzero(above > 0))
    done, portion = 0, 4 * top
    best = np.empty(0, np.int64)
    while done < some and above[done] >= least:
        chosen = docs[done : min(done + portion, some)]
        chosen = chosen[above[done : done + len(chosen)] >= least]
        scores = postings.scores(chosen, at, held, weight)
        good = scores >= max(least, 1)
        yield chosen[good], scores[good]
        done += len(chosen)
        best = np.sort(np.concatenate([best, scores[good]]))[-top:]
        if len(best) == top:
            least = max(least, int(best[0]))
        portion *= 2
    if visited is not None:
        visited[0] += done
        visited[1] += some


def rank_block(rows: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], docs: int, length: int, top: int, id_type: T.DataType) -> DataFrame:
    """(item, doc_id, score): per task the ``top`` best documents of every item (item, terms, weights)."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def key(row: tuple) -> tuple:
        return -row[0], row[1] is None, row[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in shared.value]
        type_ = None

        def solve(waiting: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            ids = table.column("doc_id")
            lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
            doc = np.repeat(np.arange(table.num_rows), lists[0].value_lengths().to_numpy())
            postings = Postings(doc, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), table.column("n").to_numpy(), docs, length)
            for k, (_, terms, weight) in enumerate(shared.value):
                least = best[k][-1][0] if len(best[k]) == top else 1
                for chosen, scores in best_documents(postings, terms, weight, least, top):
                    found = zip(scores.tolist(), (ids[int(c)].as_py() for c in chosen))
                    best[k] = sorted([*best[k], *found], key=key)[:top]

        waiting: list[pa.RecordBatch] = []
        n = size = 0
        for batch in batches:
            type_ = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                waiting.append(part)
                n, size = n + part.num_rows, size + len(part.column(2).flatten())
                if n >= DOCS_AT_ONCE or size >= POSTINGS_AT_ONCE:
                    solve(waiting)
                    waiting, n, size = [], 0, 0
        if waiting:
            solve(waiting)
        if type_ is not None:
            out = [(shared.value[k][0], doc_id, score) for k, found in enumerate(best) for score, doc_id in found]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), type_, pa.int64()))], ["item", "doc_id", "score"])

    schema = T.StructType().add("item", "long").add("doc_id", id_type).add("score", "long")
    return rows.select("doc_id", "n", "terms", "tfs").mapInArrow(run, schema)


def lexical_search(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    top: int = 10,
    block_terms: int = 50_000,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of every item whose score is above 0, best first.

    A term is a run of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. With
    N documents that hold a term and L terms in them, a document of n terms has m = 10 + 90 n N div L; a
    term in df documents weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))) and adds
    w (10^9 tf div (1000 tf + 8 m)) where the document holds it tf times. Equal scores go by ascending
    id, null ids last; rows that share an id are documents of their own, and rows of ``items`` that
    share an id are ranked each. Null and empty texts have no terms; items without terms have no rows.
    Texts are read whole. Columns beside id and text are not looked at, whatever their names. Empty
    tables give an empty result.

    Items are dealt by hash into blocks of about ``block_terms`` terms (or one item, if that has more),
    and each block reads all documents: what tasks share is bounded by a block, whatever the number of items.
    """
    spark = df.sparkSession
    bound_batches(spark)
    given = read_items(items, item_id_col, item_text_col)
    total = given.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_terms))
    found = []
    for block in range(blocks):
        own = given.filter((F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) & (F.size("terms") > 0))
        rows = [(r["item"], [bytes(t) for t in r.terms]) for r in own.orderBy("item").collect()]
        if not rows:
            continue
        lexicon = sorted({t for _, terms in rows for t in terms})
        postings = read_postings(df, id_col, text_col, lexicon)
        docs, length = postings.agg(F.count("*"), F.sum("n")).first()
        frequency = np.zeros(len(lexicon), np.int64)
        for r in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
            frequency[r.t] = r["count"]
        if not frequency.any():
            continue
        weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * f + 1))) for f in frequency.tolist()], np.int64)
        number = {term: k for k, term in enumerate(lexicon)}
        asked = []
        for item, terms in rows:
            at = np.array([number[t] for t in terms if frequency[number[t]]], np.int64)
            asked.append((item, at, weight[at]))
        found.append(rank_block(postings, asked, docs, length, top, df.schema[id_col].dataType))
    if not found:
        empty = T.StructType().add("item_id", given.schema["item_id"].dataType).add("rank", "integer").add("doc_id", df.schema[id_col].dataType).add("score", "long")
        return spark.createDataFrame([], empty)
    best = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return (
        best.withColumn("rank", rank)
        .filter(F.col("rank") <= top)
        .join(given.select("item", "item_id"), "item")
        .select("item_id", "rank", "doc_id", "score")
    )
