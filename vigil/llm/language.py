"""Language identification: sparse multinomial logistic regression on TF-IDF weighted character n-grams.

The model is trained with follow-the-regularised-leader (per-coordinate steps, elastic net), then its
scores are calibrated by one temperature fitted on labelled rows that the training left out. Only the
fit is bounded (see ``fit_languages``); prediction reads every letter of every text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, without

OUT = ["held_out", "lang_pred", "score"]
BITS = 16
GRAMS = (1, 2, 3)
SPACE = 32
MIX = np.uint64(0x9E3779B97F4A7C15)
CHARACTERS_AT_ONCE = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of a text (sorted, distinct) and how often each occurs.

    Letters are lower-cased; what lies between runs of letters is one blank, and so are both ends. No
    letters: no n-grams. A long text is read in pieces, each with the last characters of the one before.
    """
    counts = np.zeros(1 << BITS, np.int64)
    before = np.array([SPACE], np.uint32)
    some = False
    for at in range(0, len(text), CHARACTERS_AT_ONCE):
        piece = text[at : at + CHARACTERS_AT_ONCE].lower().encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(piece, "<u4")
        letter = _letters()[codes]
        if letter.any():
            some = True
        last = at + CHARACTERS_AT_ONCE >= len(text)
        codes = np.concatenate([before, np.where(letter, codes, SPACE), np.full(int(last), SPACE, np.uint32)])
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
        codes = codes[new]
        old = len(before)
        for n in GRAMS:
            start = max(old - n + 1, 0)
            size = len(codes) - n + 1
            if size <= start:
                continue
            key = np.full(size - start, n, np.uint64)
            for k in range(n):
                key = (key + codes[start + k : size + k]) * MIX
                key ^= key >> np.uint64(29)
            key *= MIX
            counts += np.bincount((key >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        before = codes[-(max(GRAMS) - 1) :]
    found = np.flatnonzero(counts) if some else np.empty(0, np.int64)
    return found, counts[found]


@dataclass
class LanguageModel:
    """``weights`` has a row per hashed n-gram and one for the bias, a column per language."""

    languages: list[str]
    idf: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(((1 << BITS) + 1, 0)))
    temperature: float = 1.0

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF of unit length; n-grams that the training never saw weigh nothing."""
        x = (1 + np.log(counts)) * self.idf[found]
        size = np.sqrt((x * x).sum())
        return x / size if size else x

    def margins(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = gram_counts(text or "")
        if not found.size or not self.languages:
            return "und", 0.0
        p = softmax(self.margins(found, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(p[best], 1.0))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, weight: np.ndarray, classes: int, rounds: int, alpha: float, beta: float, l1: float, l2: float
) -> np.ndarray:
    """FTRL-proximal over sparse rows (positions, values): a sparse weight matrix, positions x classes."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, classes)), np.zeros((size, classes))

    def weights(at) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(rounds):
        for (at, x), y, share in zip(rows, label, weight):
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = share * np.outer(x, error)
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    return weights(slice(None))


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature from 0.05 to 20 of the least log loss (golden section on its logarithm)."""
    rows = np.arange(len(y))

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(z / np.exp(t))[rows, y], 1e-300)).sum())

    low, high, cut = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 4 (null: as the empty text); rows with 2 are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit_languages(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    max_languages: int = 100,
    rounds: int = 4,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 0.05,
    l2: float = 0.5,
) -> LanguageModel:
    """Fit on rows with a language whose id isn't held out.

    The ``max_languages`` most frequent values (ties: the smaller value) are learned, each from at most
    ``per_language`` ids taken in the order of their hashes: four fifths for the weights, one for the
    temperature. Of rows that share language and id the smallest text counts. Null texts and texts
    without letters are no examples. No rows give a model without languages.
    """
    spark = df.sparkSession
    bound_batches(spark)
    lang = F.col(f"`{lang_col}`").cast("string").alias("_lang")
    order = F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`")), 1).alias("_order")
    known = df.filter(lang.isNotNull() & (remainder(F.col(f"`{id_col}`")) != 2))
    narrow = known.select(lang, order)
    sizes = narrow.groupBy("_lang").agg(F.count("*").alias("n"), F.approx_count_distinct("_order").alias("ids"))
    common = sizes.orderBy(F.desc("n"), "_lang").limit(max_languages).collect()
    languages = sorted(r._lang for r in common)
    if not languages:
        return LanguageModel([])
    # a bound on the hash leaves about four times the rows needed; of these the first are taken
    bounds = [(r._lang, min(2**63 - 1, 2**63 * 4 * per_language // max(r.ids, 1))) for r in common]
    bounds = F.broadcast(spark.createDataFrame(bounds, "_lang string, _bound long"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_order"))
    chosen = narrow.join(bounds, "_lang").filter("_order <= _bound").select("_lang", "_order").distinct()
    chosen = F.broadcast(chosen.withColumn("_rank", rank).filter(F.col("_rank") <= per_language).drop("_rank"))  # <= max_languages * per_language rows
    rows = known.select(lang, order, F.col(f"`{text_col}`").cast("string").alias("_text")).join(chosen, ["_lang", "_order"])
    rows = rows.groupBy("_lang", "_order").agg(F.min("_text").alias("_text")).filter("_text is not null")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [gram_counts(t.as_py()) for t in batch.column(2)]
            found = pa.array([p[0].astype(np.int32) for p in parts], pa.list_(pa.int32()))
            counts = pa.array([p[1] for p in parts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found, counts], ["lang", "o", "found", "counts"])

    # a row is at most 2^16 hashed n-grams
    grams = rows.select("_lang", "_order", "_text").mapInArrow(read, "lang string, o long, found array<int>, counts array<long>")
    seen = grams.toArrow().sort_by([("o", "ascending"), ("lang", "ascending")])
    seen = seen.filter(pa.compute.greater(pa.compute.list_value_length(seen.column("found")), 0))
    number = {name: k for k, name in enumerate(languages)}
    if not seen.num_rows:
        return LanguageModel([])
    y = np.array([number[x] for x in seen.column("lang").to_pylist()])
    found = [np.asarray(x.values.to_numpy(), np.int64) for x in seen.column("found")]
    counts = [x.values.to_numpy() for x in seen.column("counts")]
    held = np.array([o % 5 == 0 for o in seen.column("o").to_pylist()], bool)
    if held.all() or len(languages) == 1:
        held[:] = False
    used = np.flatnonzero(~held)
    df_counts = np.bincount(np.concatenate([found[k] for k in used]), minlength=1 << BITS)
    idf = np.where(df_counts > 0, 1 + np.log((1 + len(used)) / (1 + df_counts)), 0.0)
    model = LanguageModel(languages, idf, np.zeros(((1 << BITS) + 1, len(languages))))
    bias = 1 << BITS
    rows_ = [(np.append(found[k], bias), np.append(model.vector(found[k], counts[k]), 1.0)) for k in used]
    sizes = np.bincount(y[used], minlength=len(languages))
    share = sizes.max() / np.maximum(sizes[y[used]], 1)
    model.weights = train(rows_, y[used], np.minimum(share, 10.0), len(languages), rounds, alpha, beta, l1, l2).astype(np.float32)
    test = np.flatnonzero(held)
    if test.size and len(languages) > 1:
        model.temperature = fit_temperature(np.stack([model.margins(found[k], counts[k]) for k in test]), y[test])
    return model


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: all) of every row plus held_out, lang_pred and score.

    Null texts and texts without a letter are ``und`` with score 0; so are all under a model without
    languages. Of equally likely languages the smaller value is taken. Rows never meet, so repeated
    rows get equal results; long texts are read whole, in pieces. Input columns named like an output
    column are replaced. An empty table gives an empty result.
    """
    base = without(df, OUT)
    carry = base.columns if carry is None else carry
    shared = df.sparkSession.sparkContext.broadcast(model)
    bound_batches(df.sparkSession)
    held_out = (remainder(F.col(f"`{id_col}`")) == 2).alias("held_out")
    rows = base.select(*[F.col(f"`{c}`") for c in carry], held_out, F.col(f"`{text_col}`").cast("string").alias("_text"))
    kept = rows.schema.fields[:-1]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [shared.value.predict(t.as_py()) for t in batch.column(len(kept))]
            added = [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], names)

    return rows.mapInArrow(run, schema)
