"""Quality scores from compression: text is cheaper to compress with a dictionary of its own kind.

Two Zstandard dictionaries are built from pieces of good and of bad labelled texts. A whole text is
compressed piece by piece with both; the difference of the two sizes over the text's size becomes a
probability by a logistic curve fitted on other labelled texts. Only the fit is bounded (see the
parameters of ``fit_quality``); scoring reads every piece of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, without

PIECE = 1024
LEVEL = 1
THRESHOLD = 0.3
OUT = ["held_out", "score", "predicted"]


def remainder(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 5 (null: as the empty text); rows with 0 are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def pieces(text: bytes) -> list[bytes]:
    return [text[at : at + PIECE] for at in range(0, len(text), PIECE)]


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples to train on, their text itself."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class QualityModel:
    """Both dictionaries (None: no labels of both kinds, the score is ``bias`` alone) and the curve."""

    good: bytes | None
    bad: bytes | None
    slope: float = 0.0
    bias: float = 0.0

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("good", "bad", "slope", "bias")}

    @cached_property
    def _compressors(self):
        plain = dict(level=LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (self.good, self.bad)]

    def gain(self, text: bytes) -> float:
        """Bytes saved by the good dictionary over the bad one, per byte of text (0 if empty)."""
        if self.good is None or not text:
            return 0.0
        good, bad = self._compressors
        return sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(text)) / len(text)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.gain(text) + self.bias, -700, 700))))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a weighted logistic regression (Newton steps, slight ridge)."""
    spread = float(x.std()) or 1.0
    z, beta = np.stack([x / spread, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - 1e-3 * beta
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1])


def fit_quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = 4000,
    sample_pieces: int = 8000,
    dictionary_bytes: int = 112_640,
) -> QualityModel:
    """Fit on labelled rows whose id isn't held out.

    At most ``sample_docs`` labelled ids of either label, taken in hash order, are used: one half
    gives at most ``sample_pieces`` pieces of ``PIECE`` bytes per dictionary, the other half the
    curve, weighted back to the labels' true shares. Null ids and labels are ignored; an id labelled
    more than once counts by its largest label.
    """
    spark = df.sparkSession
    bound_batches(spark)
    label = F.col(f"`{label_col}`")
    known = (
        labels.filter(F.col(f"`{id_col}`").isNotNull() & label.isin(0, 1))
        .groupBy(F.col(f"`{id_col}`").alias("_id"))
        .agg(F.max(label).alias("_label"))
        .filter(remainder(F.col("_id")) != 0)
        .withColumn("_order", F.xxhash64("_id"))
    )
    total = {r._label: r.n for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return QualityModel(None, None, 0.0, float(np.log((total.get(1, 0) + 1) / (total.get(0, 0) + 1))))
    # at most 2 * sample_docs narrow rows
    chosen = [known.filter(F.col("_label") == k).orderBy("_order", "_id").limit(sample_docs) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]).withColumn("_half", F.pmod(F.xxhash64("_order"), F.lit(2))))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_text")
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), text).join(chosen, "_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (label, xxhash.xxh64_intdigest(piece, order & 0xFFFFFFFF) >> 1, piece)
                for order, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
                for piece in pieces(text.as_py())
            ]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()))], ["label", "h", "piece"]
            )

    half = rows.filter("_half = 0").select("_order", F.col("_label").cast("int"), "_text")
    cuts = half.mapInArrow(cut, "label int, h long, piece binary")
    built = {}
    for k in (0, 1):
        best = cuts.filter(F.col("label") == k).orderBy("h", "piece").limit(sample_pieces).collect()
        built[k] = build_dictionary([bytes(r.piece) for r in best], dictionary_bytes)
    if not built[0] or not built[1]:
        return QualityModel(None, None, 0.0, float(np.log((total[1] + 1) / (total[0] + 1))))
    model = QualityModel(built[1], built[0])
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains = [shared.value.gain(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gains, pa.float64())], ["label", "gain"])

    # at most sample_docs rows of either label
    held = rows.filter("_half = 1").select(F.col("_label").cast("int"), "_text").mapInArrow(measure, "label int, gain double")
    seen = sorted((r.label, r.gain) for r in held.collect())
    y, x = np.array([s[0] for s in seen], float), np.array([s[1] for s in seen], float)
    if not 0 < y.sum() < len(y):
        return QualityModel(built[1], built[0], 0.0, float(np.log((total[1] + 1) / (total[0] + 1))))
    weight = np.where(y == 1, total[1] / max(y.sum(), 1), total[0] / max((1 - y).sum(), 1)) * len(y) / (total[0] + total[1])
    slope, bias = fit_curve(x, y, weight)
    return QualityModel(built[1], built[0], slope, bias)


def score_quality(
    df: DataFrame,
    model: QualityModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The ``carry`` columns (default: all) of every row plus held_out, score and predicted.

    A null text scores as an empty one, whose gain is 0. Rows never meet, so ties and repeated rows
    keep a score each. Input columns named like an output column are replaced. An empty table gives
    an empty result.
    """
    base = without(df, OUT)
    carry = base.columns if carry is None else carry
    shared = df.sparkSession.sparkContext.broadcast(model)
    bound_batches(df.sparkSession)
    held_out = (remainder(F.col(f"`{id_col}`")) == 0).alias("held_out")
    read = [] if text_col in carry else [F.col(f"`{text_col}`").alias("_text")]
    rows = base.select(*[F.col(f"`{c}`") for c in carry], held_out, *read)
    kept = rows.schema.fields[: len(carry) + 1]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = [f.name for f in schema]
    at = carry.index(text_col) if text_col in carry else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            scores = np.array([shared.value.score(t.as_py() or b"") for t in texts], np.float64)
            added = [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], names)

    return rows.mapInArrow(run, schema)
