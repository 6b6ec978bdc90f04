"""Best-two-fit packing of tokenised documents into fixed-length sequences.

A packing depends on the lengths alone, so it is planned on the histogram of lengths (at most
``capacity`` numbers): a pattern is a set of lengths that fill one sequence, with the number of
sequences that use it. Pieces are numbered within their length in two levels (a running number in
the tokenising task, plus the counts of the tasks before it); the number picks the sequence and the
offset from the broadcast plan, whose size the capacity bounds.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import materialize
from .common import bound_batches, without

CAPACITY = 1024
END = 2
OUT = ["piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]


# ---------------------------------------------------------------- tokens

@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTokens:
    """Token ids of texts by a byte-level BPE file, each distinct word being tokenised once.

    The vocabulary's pre-tokenizer never joins what stands before and after the blank in front of
    a word, nor around a line break, so a text's ids are those of its words put together. Texts with
    other white space than single blanks and line breaks between words are tokenised whole. Known
    words stay for a task, in two generations of at most ``words`` entries and those of a slice, so
    memory is bounded.
    """

    TOGETHER = 1000
    HEAD = "\r"
    RUNS = ("  ", "\n\n", " \n", "\n ")
    OTHER_ASCII = tuple("\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
    OTHER_SPACE = re.compile(r"[^\S \n]")

    def __init__(self, path: str, words: int = 300_000):
        self.tokenizer = _tokenizer(path)
        self.words, self.young, self.old = words, {}, {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.octets = np.zeros(max(vocabulary.values()) + 1, np.int64)
        # a byte-level token has one character for each byte; added tokens stand for their own text
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        for token, i in vocabulary.items():
            self.octets[i] = len(token.encode()) if token in added else len(token)

    def plain(self, text: str) -> bool:
        ends = text[:1] + text[-1:]
        if not ends or " " in ends or "\n" in ends or any(r in text for r in self.RUNS):
            return False
        if text.isascii():
            return not any(c in text for c in self.OTHER_ASCII)
        return not self.OTHER_SPACE.search(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in encoded]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words. Those with a blank or line break before them are tokenised as one text,
        which is cut at the words' byte lengths; a text's first word (marked HEAD) goes alone."""
        heads = [w for w in words if w[0] == self.HEAD]
        self.young.update(zip(heads, (ids.tobytes() for ids in self.encode([w[1:] for w in heads]))))
        rest = [w if w[0] == "\n" else " " + w for w in words if w[0] != self.HEAD]
        ends = np.cumsum(pc.binary_length(pa.array(rest, pa.large_string())).to_numpy(zero_copy_only=False))
        joined = ["".join(rest[at : at + self.TOGETHER]) for at in range(0, len(rest), self.TOGETHER)]
        ids = np.concatenate([np.empty(0, "<u4"), *self.encode(joined)])
        cuts = [0, *(4 * (np.searchsorted(np.cumsum(self.octets[ids]), ends) + 1)).tolist()]
        raw = ids.tobytes()
        names = (w if w[0] == "\n" else w[1:] for w in rest)
        self.young.update((w, raw[a:b]) for w, a, b in zip(names, cuts, cuts[1:]))

    def texts(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        plain = [n for n, text in enumerate(texts) if self.plain(text)]
        marked = pa.array([self.HEAD + texts[n] for n in plain], pa.large_string())
        words = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        self.young.update((w, self.old[w]) for w in distinct if w not in self.young and w in self.old)
        self._learn([w for w in distinct if w not in self.young])
        ids = pa.array([self.young[w] for w in distinct], pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[words.offsets.to_numpy()].tolist() if plain else []
        raw = memoryview(ids.buffers()[2] or b"")
        out = {n: bytes(raw[a:b]) for n, a, b in zip(plain, ends, ends[1:])}
        other = [n for n in range(len(texts)) if n not in out]
        out.update(zip(other, (x.tobytes() for x in self.encode([texts[n] for n in other]))))
        if len(self.young) > self.words:
            self.old, self.young = self.young, {}
        return [out[n] for n in range(len(texts))]


def slices(batch: pa.RecordBatch, column: int, octets: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most about ``octets`` bytes together (a longer text goes alone)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size.astype(np.int64)) // octets
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def cut_points(tokens: int, capacity: int) -> list[int]:
    """Ends of a document's pieces: all of ``capacity`` tokens, but for a shorter first one."""
    return list(range(tokens % capacity or capacity, tokens + 1, capacity))


def token_pieces(
    df: DataFrame,
    vocabulary: str,
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END,
    with_ids: bool = True,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per piece: the carried columns, piece, start, length, ids_crc32, ids (null without
    ``with_ids``) and the pair (_task, _nth) that numbers pieces of one length within a task."""
    carry = df.columns if carry is None else carry
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    added = "piece int, start long, length long, ids_crc32 long, ids array<int>, _task long, _nth long"
    rows = df.select(*[F.col(f"`{c}`") for c in carry], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen, task = WordTokens(vocabulary), Counter(), TaskContext.get().partitionId()
        last = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, len(carry)):
                row, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
                for r, raw in enumerate(tokens.texts(batch.column(len(carry)).to_pylist())):
                    raw += last
                    a = 0
                    for p, b in enumerate(cut_points(len(raw) // 4, capacity)):
                        row.append(r)
                        piece.append(p)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                        nth.append(seen[b - a])
                        seen[b - a] += 1
                        ids.append(np.frombuffer(raw, "<i4")[a:b] if with_ids else None)
                        a = b
                columns = [batch.column(c).take(pa.array(row, pa.int64())) for c in range(len(carry))]
                columns += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([task] * len(row), pa.int64()), pa.array(nth, pa.int64())]
                names = [*carry, "piece", "start", "length", "ids_crc32", "ids", "_task", "_nth"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, f"{fields}, {added}" if fields else added)


# ---------------------------------------------------------------- plan

def fill(left: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one sequence by best-two-fit; ``left``: how many pieces of each length wait."""
    used, room, top = [], capacity, capacity
    free = left.copy()
    while room:
        waiting = np.flatnonzero(free[1 : min(room, top) + 1])
        if not waiting.size:
            break
        top = int(waiting[-1]) + 1
        used.append(top)
        free[top] -= 1
        room -= top
    if room and used:
        # the smallest piece may give way to two waiting ones that fit its gap more tightly
        small = used[-1]
        free[small] += 1
        gap, best = room + small, (small, 0, 0)
        sizes = np.flatnonzero(free[1 : gap + 1]) + 1
        if sizes.size:
            rest = gap - sizes
            at = np.searchsorted(sizes, rest, side="right") - 1
            other = np.where(at >= 0, sizes[np.maximum(at, 0)], 0)
            alone = (other == sizes) & (free[sizes] < 2)  # a single piece can't be taken twice
            other = np.where(alone, np.where(at > 0, sizes[np.maximum(at - 1, 0)], 0), other)
            total = np.where(other > 0, sizes + other, 0)
            k = int(np.argmax(total))
            if total[k] > best[0]:
                best = (int(total[k]), int(max(sizes[k], other[k])), int(min(sizes[k], other[k])))
        if best[1]:
            used[-1:] = best[1:]
    return sorted(used, reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Lookup table of the packing: sorted runs of pieces of one length that share a pattern.

    A sequence of the plan is repeated for as long as every length it uses is left, so the number
    of patterns depends on the lengths that occur, not on the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    taken = np.zeros(capacity + 1, np.int64)
    runs, sequence = [], 0
    while left.any():
        need = Counter(fill(left, capacity))
        times = min(int(left[s]) // k for s, k in need.items())
        offset = 0
        for size, k in need.items():
            runs.append((size, int(taken[size]), k, sequence, offset))
            taken[size] += k * times
            left[size] -= k * times
            offset += size * k
        sequence += times
    runs.sort()
    names = ("size", "first", "each", "sequence", "offset")
    return dict(zip(names, np.array(runs or np.empty((0, 5)), np.int64).T))


def place(table: dict[str, np.ndarray], size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the ``rank``-th piece of length ``size``."""
    span = int(max(table["first"].max(initial=0), rank.max(initial=0))) + 1
    at = np.searchsorted(table["size"] * span + table["first"], size * span + rank, side="right") - 1
    within = rank - table["first"][at]
    each = table["each"][at]
    return table["sequence"][at] + within // each, table["offset"][at] + within % each * size


# ---------------------------------------------------------------- operator

def pack(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END,
    with_ids: bool = True,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per piece: the carried columns (default: all but the text), piece, start, length,
    ids_crc32, ids, sequence_id and offset.

    A document is its text's ids and then ``end_id``; a null text counts as empty and gives the end
    id alone. Longer documents are cut into pieces of ``capacity`` tokens, the first one shorter.
    Every row is a document of its own, repeated rows and ids included. Input columns named like an
    output column are replaced. An empty table gives an empty result.
    """
    bound_batches(df.sparkSession)
    base = without(df, OUT)
    carry = [c for c in base.columns if c != text_col] if carry is None else carry
    spark = df.sparkSession
    pieces = materialize(token_pieces(base, vocabulary, text_col, capacity, end_id, with_ids, carry), "llm-pieces")
    counts = pieces.groupBy("length", "_task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(
        counts.select("length", "_task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")),
        "llm-piece-counts",
    )
    # at most one row for each length up to the capacity
    histogram = {r.length: r.n for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(plan(histogram, capacity))
    ranked = pieces.join(first.drop("n"), ["length", "_task"]).withColumn("_rank", F.col("_first") + F.col("_nth"))
    names = [*carry, "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy())
            sequence, offset = place(table.value, size, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    ranked = ranked.select(*[F.col(f"`{c}`") for c in names], "_rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def sequences(pieces: DataFrame) -> DataFrame:
    """Packed pieces (with ids) -> one row per sequence: sequence_id and its ids in order."""
    return (
        pieces.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
    )
