"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its share of the input. Each
document's number of copies is the Poisson quantile, with that mean, of a number hashed from the seed
and its id: sources need no second pass, and the same documents come out on every run. The copies are
then put in one global order by a hash of id and copy, whose ranges are dealt to the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import materialize
from .common import without

OUT = ["n_copies", "copy", "shuffle_key"]
LARGEST_MEAN = 500


def uniform(*parts) -> Column:
    """Number in [0, 1) from the first 52 bits of the MD5 of the parts joined by "|" (nulls left out)."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """Probabilities of at most 0, 1, 2, ... events, as far as a double tells them from 1."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 25).cast("int"))
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("all"))

    def grow(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + p)).alias("all"))

    return F.aggregate(steps, first, grow, lambda acc: acc["all"])


def repetition_rates(
    df: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, total: float = 1.0
) -> DataFrame:
    """(source, rate) for an output of ``total`` times the input's rows, in which sources have the
    shares ``weights`` (others: 0; default: equal shares). A null source is a source of its own."""
    sizes = df.groupBy(F.col(f"`{source_col}`").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = sizes.withColumn("w", F.lit(1.0))
    else:
        given = df.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        share = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    sums = share.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    rate = F.col("w") / F.col("all_w") * F.col("all_n") * F.lit(float(total)) / F.col("n")
    # sums is one row
    return share.crossJoin(F.broadcast(sums)).select("source", F.when(F.col("all_w") > 0, rate).otherwise(0.0).alias("rate"))


def poisson_mix(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    total: float = 1.0,
    seed: int = 7,
) -> DataFrame:
    """The columns of ``df``, a row per copy, plus n_copies, copy (from 0) and shuffle_key, in the
    order of shuffle_key.

    Rows that share an id and source get the same number of copies each; a null id counts as no text
    in the hash. A mean above ``LARGEST_MEAN`` is the sum of equal smaller ones with hashes of their
    own. Sources of weight 0 leave no rows. Input columns named like an output column are replaced.
    An empty table gives an empty result.
    """
    base = without(df, OUT)
    ident = F.col(f"`{id_col}`").cast("string")
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_MEAN).cast("int"), F.lit(1))
    rates = repetition_rates(base, source_col, weights, total).withColumn("_parts", parts)
    rates = rates.select(
        F.col("source").alias("_source"), "_parts", poisson_cdf(F.col("rate") / F.col("_parts")).alias("_cdf")
    ).filter("_cdf[0] < 1")
    # written, so that its size is known when the join with the documents is planned
    rates = materialize(rates, "llm-source-rates")

    def draw(part: Column) -> Column:
        u = uniform(seed, part.cast("string"), ident)
        return F.size(F.filter("_cdf", lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(0), F.col("_parts") - 1), F.lit(0), lambda n, part: n + draw(part))
    copies = (
        base.join(rates, F.col(f"`{source_col}`").eqNullSafe(F.col("_source")))
        .withColumn("n_copies", count)
        .filter("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
        .withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit("order"), F.lit(seed), "copy", ident).cast("binary")))
    )
    columns = [F.col(f"`{c}`") for c in base.columns]
    # the keys are uniform, so equal ranges of their first 32 bits share the rows evenly: no sample is drawn for the order
    ranges = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * F.lit(ranges)
    return (
        copies.select(*columns, "n_copies", "copy", "shuffle_key")
        .repartitionById(ranges, F.shiftright(place, 32).cast("int"))
        .sortWithinPartitions("shuffle_key", ident, "copy")
    )
