"""Exact per-event sliding windows as running sums ("the sweep").

Visibility rule: event ``x`` is visible to event ``e`` for a window of ``W``
seconds iff they share the key, ``e.t - W <= x.t <= e.t`` and
``(x.t < e.t or x.seq <= e.seq)``.

Every event becomes ``+delta`` at the slot ``(t, seq)`` and ``-delta`` at the
slot ``(t + W + 1, -1 - seq)``; expiry slots sort before the arrivals of the same
second (``seq >= 0``). A running sum in slot order, read at the arrival slot,
is then exactly the windowed aggregate. Distinct counts and entropy reduce to
the same shape: a first running count per ``(key, value)`` turns into change
rows ``f(c_after) - f(c_before)`` that a second running sum per key adds up.

A key is swept whole in one task, which fans its events out behind the exchange: one
narrow row per event and family is shuffled. Keys that are measured to hold many
events (``hot_keys``) never land in one task: their running sums are computed in
levels, a local sum per ``(key, time bucket)`` plus the carried total of all earlier
buckets of the key (a small per-bucket table). Buckets that are measured to hold many
events of a key are split further, into seconds and blocks of arrival numbers, with a
carried total of their own (``hot_buckets``), so a burst inside one bucket, even
inside one second, spreads over tasks as well. All levels are plain window functions
with an unbounded-preceding frame, which Spark evaluates incrementally in one pass
over sorted rows (a bounded RANGE frame would be re-aggregated for every row).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import ROWS_A_TASK, sorted_join

DEFAULT_BUCKET_SECONDS = 3600
HOT_ROWS = 200_000  # events of one key in one bucket from which the bucket is split
HOT_LISTED = 10_000  # so many hot buckets and keys are split at most, the largest ones
WHOLE_KEY = 5  # a key of more than so many times HOT_ROWS events is summed by buckets
ORD_BLOCK = 1 << 16  # arrival numbers that stay together in one second of a hot bucket

BKT = "_bkt"
T = "_t"
ORD = "_ord"
ARRIVAL = "_arrival"
GROUP = "_grp"
PARTS = ["_sec", "_blk"]  # parts of a bucket: 0, 0 unless it is hot


def _carried(totals: DataFrame, over: list[str], order: list[str], values: list[str]) -> list[Column]:
    """Sums of the rows before this one."""
    before = Window.partitionBy(*over).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values]


def running_sum(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    *,
    slot_values: list[str] | tuple[str, ...] = (),
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    hot: Column | None = None,
) -> DataFrame:
    """Add ``<v>_cum`` (running sum of ``v`` per ``keys`` in slot order, peers included)
    for every ``v`` in ``values`` and ``<s>_slot`` (sum over the rows of the same slot).

    ``df`` must carry the slot columns ``_t`` (long seconds) and ``_ord`` (long). Rows for which
    ``hot`` (may read ``_bkt``) holds are summed in parts of their bucket; it must be the same for
    all rows of a key's bucket.
    """
    bucket = [*keys, BKT]
    part = [*bucket, *PARTS] if hot is not None else bucket
    d = df.withColumn(BKT, F.floor(F.col(T) / F.lit(bucket_seconds)))
    if hot is not None:
        second = F.when(hot, F.col(T)).otherwise(F.lit(0))
        d = d.withColumns({"_sec": second.cast("long"), "_blk": F.when(hot, F.floor(F.col(ORD) / ORD_BLOCK)).otherwise(F.lit(0)).cast("long")})
    # sorts compare the first eight bytes of the first column before anything else: a hash tells the groups apart
    # there (the columns behind it decide), where the family or a key's first letters would mostly tie
    d = d.withColumn(GROUP, F.xxhash64(*part))
    part = [GROUP, *part]
    # one exchange serves the local sums and the totals
    d = d.repartition(*part)
    # Default frame with an ORDER BY is RANGE UNBOUNDED PRECEDING .. CURRENT ROW:
    # rows of the same slot are peers and all included.
    w_local = Window.partitionBy(*part).orderBy(T, ORD)
    cols = [F.sum(v).over(w_local).alias(f"_loc_{v}") for v in values]
    if slot_values:
        w_slot = Window.partitionBy(*part, T, ORD)
        cols += [F.sum(s).over(w_slot).alias(f"{s}_slot") for s in slot_values]
    local = d.select("*", *cols)

    sums = [f"_tot_{v}" for v in values]
    carries = [f"_car_{v}" for v in values]
    totals = d.groupBy(*part).agg(*[F.sum(v).alias(t) for v, t in zip(values, sums)])
    if hot is None:
        carry = totals.select(*part, *[c.alias(n) for c, n in zip(_carried(totals, keys, [BKT], sums), carries)])
    else:
        inside = totals.select(*part, *[c.alias(f"_in{n}") for c, n in zip(_carried(totals, bucket, PARTS, sums), carries)])
        whole = totals.groupBy(*bucket).agg(*[F.sum(t).alias(t) for t in sums])
        whole = whole.select(*bucket, *[c.alias(n) for c, n in zip(_carried(whole, keys, [BKT], sums), carries)])
        carry = inside.join(sorted_join(whole), bucket).select(*part, *[(F.col(n) + F.col(f"_in{n}")).alias(n) for n in carries])
    out = local.join(sorted_join(carry), part, "inner")
    keep = [c for c in local.columns if not c.startswith("_loc_") and c not in (BKT, GROUP, *PARTS)]
    return out.select(
        *keep,
        *[(F.col(f"_loc_{v}") + F.col(f"_car_{v}")).alias(f"{v}_cum") for v in values],
    )


@dataclass
class Count:
    """Windowed sum of ``expr`` (a count when ``expr`` is 0/1); ``seconds=None`` = all time."""

    name: str
    seconds: int | None
    expr: Column


@dataclass
class Distinct:
    """Windowed number of distinct values of column ``value``."""

    name: str
    seconds: int
    value: str


@dataclass
class Entropy:
    """Windowed Shannon entropy (log2) of the value distribution of column ``value``."""

    name: str
    seconds: int
    value: str


@dataclass
class FirstSeen:
    """True when the event is the first (all time, slot order) of ``(key, value)``."""

    name: str
    value: str


@dataclass
class Family:
    key: str
    counts: list[Count] = field(default_factory=list)
    distincts: list[Distinct] = field(default_factory=list)
    entropies: list[Entropy] = field(default_factory=list)
    firsts: list[FirstSeen] = field(default_factory=list)


ENTROPY_SCALE = 10**8


def _xlogx(c: Column) -> Column:
    """``c * log2(c)`` in whole units of 1 / ENTROPY_SCALE, so that what enters a running sum leaves it exactly."""
    return F.when(c > 0, F.round(c * F.log2(c) * ENTROPY_SCALE)).otherwise(F.lit(0.0)).cast("long")


def _or_all(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def _bucket_id(fam: Column, key: Column, bucket: Column) -> Column:
    return F.xxhash64(fam.cast("int"), key.cast("string"), bucket.cast("long"))


def hot_buckets(
    ev: DataFrame,
    families: list[Family],
    *,
    t_col: str = "ts_sec",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> list[int]:
    """Hashes of the (family, key, bucket) that get the arrivals or expiries of more than ``hot_rows`` events.

    One aggregate over the events, combined before its exchange; at most ``HOT_LISTED`` of the
    largest groups are returned (a group beyond them is summed as one).
    """
    bucket = F.floor(F.col(t_col) / F.lit(bucket_seconds))
    keys = [F.struct(F.lit(fi).alias("fam"), F.col(f.key).cast("string").alias("key")) for fi, f in enumerate(families)]
    found = (
        ev.select(bucket.alias("b"), F.explode(F.array(*keys)).alias("k"))
        .groupBy("k.fam", "k.key", "b")
        .count()
        .where((F.col("count") > hot_rows) & F.col("key").isNotNull())
        .orderBy(F.desc("count"))
        .limit(HOT_LISTED)
        .collect()
    )
    marked = set()
    for r in found:
        family = families[r.fam]
        windows = {m.seconds for m in (*family.counts, *family.distincts, *family.entropies)} - {None}
        ends = {(r.b * bucket_seconds + w + 1) // bucket_seconds for w in windows}
        marked |= {(r.fam, r.key, b) for b in {r.b} | ends | {e + 1 for e in ends}}
    if not marked:
        return []
    rows = ev.sparkSession.createDataFrame(sorted(marked), "fam int, key string, b long")
    return [r[0] for r in rows.select(_bucket_id(F.col("fam"), F.col("key"), F.col("b"))).collect()]


@dataclass
class Load:
    """What ``measure`` finds: the (family, key) rows of all events, the hot keys and the buckets of theirs to split."""

    rows: int
    keys: list[int] = field(default_factory=list)
    buckets: list[int] = field(default_factory=list)


def _key_id(fam: Column, key: Column) -> Column:
    return F.xxhash64(fam.cast("int"), key.cast("string"))


def measure(
    ev: DataFrame,
    families: list[Family],
    *,
    t_col: str = "ts_sec",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> Load:
    """Rows of all families, and the keys of more than ``WHOLE_KEY * hot_rows`` events (a key beyond the ``HOT_LISTED``
    largest is swept whole). One aggregate over the events, combined before its exchange; more only if there is a hot key."""
    limit = WHOLE_KEY * hot_rows
    keys = [F.struct(F.lit(fi).alias("fam"), F.col(f.key).cast("string").alias("key")) for fi, f in enumerate(families)]
    counts = ev.select(F.explode(F.array(*keys)).alias("k")).where("k.key is not null").groupBy("k.fam", "k.key").count()
    rows, most = counts.agg(F.sum("count"), F.max("count")).first()
    if not rows or most <= limit:
        return Load(rows or 0)
    large = counts.where(F.col("count") > limit).orderBy(F.desc("count")).limit(HOT_LISTED)
    found = [r[0] for r in large.select(_key_id(F.col("fam"), F.col("key"))).collect()]
    return Load(rows, found, hot_buckets(ev, families, t_col=t_col, bucket_seconds=bucket_seconds, hot_rows=hot_rows))


def sweep(
    ev: DataFrame,
    families: list[Family],
    *,
    t_col: str = "ts_sec",
    seq_col: str = "seq",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    load: Load,
) -> DataFrame:
    """All windowed measures of several key families in one pass.

    Returns one row per event: ``seq`` and one column per measure (counts and
    sums as long, distinct counts as long, entropy as double rounded to 3
    places, first-seen flags as boolean). Measure names must be unique across
    families. ``load`` comes from ``measure``.

    Plan shape: one row per event and family, dealt by (family, key), is fanned out in its task into the rows of
    both stages: stage 1 = one running count per ``(family, key, measure, value)`` (distinct / entropy / first-seen);
    stage 2 = one running sum per ``(family, key)`` over the count rows and the stage-1 change rows. The hot keys of
    ``load`` are fanned out before their exchanges, one per stage, which deal them by bucket as well. One aggregate by
    ``seq`` then folds the per-family rows together. Rows are narrow: a value is its 64-bit hash, and families share
    the columns of their sums.
    """
    counts: list[tuple[int, Count]] = []
    dims: list[tuple[int, str, str, int | None, str]] = []  # (fam, name, value col, seconds, kind)
    flags: list[tuple[int, str, int]] = []  # (fam, flag name, number of its dim)
    for fi, fam in enumerate(families):
        for c in fam.counts:
            counts.append((fi, c))
        for e in fam.entropies:
            counts.append((fi, Count(f"{e.name}__n", e.seconds, F.lit(1))))
        for d in fam.distincts:
            dims.append((fi, d.name, d.value, d.seconds, "distinct"))
        for e in fam.entropies:
            dims.append((fi, e.name, e.value, e.seconds, "entropy"))
        for f in fam.firsts:
            host = next((k for k, d in enumerate(dims) if d[0] == fi and d[2] == f.value), None)
            if host is None:
                host = len(dims)
                dims.append((fi, f"{f.name}__dim", f.value, None, "first"))
            flags.append((fi, f.name, host))

    # families share the columns m0, m1, ... (sums) and f0, f1, ... (flags)
    place: dict[str, tuple[int, str]] = {}
    for fi in range(len(families)):
        names = [c.name for f2, c in counts if f2 == fi] + [d[1] for d in dims if d[0] == fi and d[4] != "first"]
        place |= {n: (fi, f"m{k}") for k, n in enumerate(names)}
        place |= {n: (fi, f"f{k}") for k, n in enumerate(f[1] for f in flags if f[0] == fi)}
    sums = sorted({c for _, c in place.values() if c[0] == "m"}, key=lambda c: int(c[1:]))
    marks = sorted({c for _, c in place.values() if c[0] == "f"})

    # one projection holds every input of the fan-out: time, seq, keys, measure values, dim values
    value_cols = sorted({d[2] for d in dims})
    base = ev.select(
        F.col(t_col).cast("long").alias("_tv"),
        F.col(seq_col).cast("long").alias("_sv"),
        *[F.col(fam.key).cast("string").alias(f"_k{fi}") for fi, fam in enumerate(families)],
        *[c.expr.cast("long").alias(f"_m{j}") for j, (_, c) in enumerate(counts)],
        *[F.when(F.col(v).isNotNull(), F.xxhash64(F.col(v).cast("string"))).alias(f"_v_{v}") for v in value_cols],
    )
    shape = _Shape(families, counts, dims, flags, place, sums, marks)
    is_hot = _key_id(F.col("_fam"), F.col("_key")).isin(load.keys) if load.keys else None
    arrivals = _sweep_whole(base, shape, is_hot, load.rows, bucket_seconds)
    if is_hot is not None:
        arrivals = arrivals.unionByName(_sweep_buckets(base, shape, is_hot, load.buckets, bucket_seconds))

    # ---------------- fold the per-family arrival rows by seq ----------------
    aggs = [F.sum(F.when(F.col("_fam") == fi, F.col(f"{c}_{'cum' if c[0] == 'm' else 'slot'}"))).alias(n) for n, (fi, c) in place.items()]
    # dealt out before the aggregate: a partial one would combine nothing and send all families' columns
    folded = arrivals.repartition("_seq").groupBy(F.col("_seq").alias(seq_col)).agg(*aggs)

    out = [F.col(seq_col)]
    for fam in families:
        for c in fam.counts:
            out.append(F.col(c.name))
        for d in fam.distincts:
            out.append(F.col(d.name).cast("long"))
        for e in fam.entropies:
            n = F.col(f"{e.name}__n").cast("double")
            h = F.when(n > 0, F.log2(n) - F.col(e.name) / F.lit(float(ENTROPY_SCALE)) / n).otherwise(F.lit(0.0))
            out.append((F.greatest(F.round(h, 3), F.lit(0.0)) + F.lit(0.0)).alias(e.name))
        for f in fam.firsts:
            out.append((F.col(f.name) > 0).alias(f.name))
    return folded.select(*out)


@dataclass
class _Shape:
    """The measures of a sweep and the columns they go to."""

    families: list[Family]
    counts: list[tuple[int, Count]]
    dims: list[tuple[int, str, str, int | None, str]]
    flags: list[tuple[int, str, int]]
    place: dict[str, tuple[int, str]]
    sums: list[str]
    marks: list[str]

    def arrival_columns(self) -> list[str]:
        return ["_fam", "_seq", *[f"{c}_cum" for c in self.sums], *[f"{c}_slot" for c in self.marks]]

    def windows(self, fi: int) -> list[int]:
        return sorted({c.seconds for f2, c in self.counts if f2 == fi and c.seconds is not None})

    def moved(self) -> dict[str, Column]:
        """Per column what a stage-1 row (of a dim, with its running counts) adds to it; columns that no dim goes to are left out."""
        after, before = F.col("d_cum"), F.col("d_cum") - F.col("d")
        change = {
            "distinct": (after >= 1).cast("long") - (before >= 1).cast("long"),
            "entropy": _xlogx(after.cast("double")) - _xlogx(before.cast("double")),
        }
        # the value of the row's own dim, among those that go to a column
        into = {c: [(k, change[d[4]]) for k, d in enumerate(self.dims) if d[4] != "first" and self.place[d[1]][1] == c] for c in self.sums}
        first = ((F.col("d") == 1) & (F.col("ever_cum") == 1)).cast("long")
        # several flags may hang on one dim of a family, each in a column of its own
        into |= {c: [(host, first) for _, name, host in self.flags if self.place[name][1] == c] for c in self.marks}
        out = {}
        for column, values in into.items():
            for k, value in values:
                out[column] = F.when(F.col("dim") == k, value).otherwise(out.get(column, F.lit(0).cast("long")))
        return {c: v.cast("long") for c, v in out.items()}


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in fields.items()) + ")"


def _sweep_whole(base: DataFrame, shape: _Shape, is_hot: Column | None, rows: int, bucket_seconds: int) -> DataFrame:
    """The arrival rows of all keys but the hot ones. As in ``_sweep_buckets``, a sum is null up to the first value
    of its bucket that isn't, and events without a time come before all others (they get no row)."""
    sums, marks = shape.sums, shape.marks
    mine = [[j for j, (f2, _) in enumerate(shape.counts) if f2 == fi] for fi in range(len(shape.families))]
    values = [list(dict.fromkeys(d[2] for d in shape.dims if d[0] == fi)) for fi in range(len(shape.families))]
    n_counts, n_values = max(map(len, mine)), max(map(len, values))
    heads, fans = [], []
    for fi in range(len(shape.families)):
        head = {"_fam": f"{fi}", "_key": f"_k{fi}", "_tv": "_tv", "_sv": "_sv"}
        head |= {f"_c{i}": f"_m{mine[fi][i]}" if i < len(mine[fi]) else "0L" for i in range(n_counts)}
        head |= {f"_w{i}": f"_v_{values[fi][i]}" if i < len(values[fi]) else "CAST(NULL AS BIGINT)" for i in range(n_values)}
        heads.append(_struct(**head))

        def row(t: str, order: str, arrival: int, dim: int = -1, val: str = "0L", d: int = 0, ever: int = 0, given: dict[str, str] | None = None) -> str:
            cells = {c: (given or {}).get(c, "0L") for c in (*sums, *marks)}
            return _struct(dim=f"{dim}", val=val, **{T: t, ORD: order, ARRIVAL: f"{arrival}"}, d=f"{d}", ever=f"{ever}", **cells)

        fan = []
        for k, (f2, _name, value, seconds, _kind) in enumerate(shape.dims):
            if f2 == fi:
                val = f"_w{values[fi].index(value)}"
                fan.append(row("_tv", "_sv", 0, k, val, 1, 1))
                if seconds is not None:
                    fan.append(row(f"_tv + {seconds + 1}L", "-1L - _sv", 0, k, val, -1))
        at = {shape.counts[j][1].name: i for i, j in enumerate(mine[fi])}
        seconds_of = {shape.counts[j][1].name: shape.counts[j][1].seconds for j in mine[fi]}
        fan.append(row("_tv", "_sv", 1, given={shape.place[n][1]: f"_c{i}" for n, i in at.items()}))
        for w in shape.windows(fi):
            fan.append(row(f"_tv + {w + 1}L", "-1L - _sv", 0, given={shape.place[n][1]: f"-_c{i}" for n, i in at.items() if seconds_of[n] == w}))
        fans.append(f"WHEN _fam = {fi} THEN array({', '.join(fan)})")

    d = base.select(F.expr(f"explode(array({', '.join(heads)}))").alias("r")).select("r.*").where("_key is not null")
    if is_hot is not None:
        d = d.where(~is_hot)
    # as many tasks as the rows need: the fan-out behind the exchange isn't seen in its size
    cores = base.sparkSession.sparkContext.defaultParallelism
    d = d.repartition(max(cores, -(-rows // (ROWS_A_TASK * len(shape.families)))), "_fam", "_key")
    d = d.select("_fam", "_key", F.col("_sv").alias("_seq"), F.expr(f"explode(CASE {' '.join(fans)} END)").alias("r")).select("_fam", "_key", "_seq", "r.*")
    cells = [F.col(c) for c in (*sums, *marks)]
    if shape.dims:
        # a group's hash before it: sorts compare the first eight bytes before anything else
        group = ["_fam", "_key", "dim", "val"]
        d = d.where("val is not null").withColumn(GROUP, F.xxhash64(*group))
        running = Window.partitionBy(GROUP, *group).orderBy(T, ORD)
        d = d.select("*", F.sum("d").over(running).alias("d_cum"), F.sum("ever").over(running).alias("ever_cum"))
        moved = shape.moved()
        cells = [F.when(F.col("dim") < 0, F.col(c)).otherwise(moved.get(c, F.lit(0))).cast("long").alias(c) for c in (*sums, *marks)]
    d = d.select("_fam", "_key", "_seq", T, ORD, ARRIVAL, "dim", *cells)
    if shape.dims:
        d = d.where((F.col("dim") < 0) | (F.col(T).isNotNull() & _or_all([F.col(c) != 0 for c in moved])))
    d = d.withColumns({GROUP: F.xxhash64("_fam", "_key"), BKT: F.floor(F.col(T) / F.lit(bucket_seconds))})
    running = Window.partitionBy(GROUP, "_fam", "_key").orderBy(T, ORD)
    slot = Window.partitionBy(GROUP, "_fam", "_key", T, ORD)
    missing = {shape.place[c.name][1] for j, (_, c) in enumerate(shape.counts) if base.schema[f"_m{j}"].nullable}

    def total(c: str) -> Column:
        value = F.sum(c).over(running)
        return F.when(F.max(F.when(F.col(c).isNotNull(), F.col(BKT))).over(running) == F.col(BKT), value) if c in missing else value

    d = d.select("_fam", "_seq", T, ARRIVAL, *[total(c).alias(f"{c}_cum") for c in sums], *[F.sum(c).over(slot).alias(f"{c}_slot") for c in marks])
    return d.where((F.col(ARRIVAL) == 1) & F.col(T).isNotNull()).select(*shape.arrival_columns())


def _sweep_buckets(base: DataFrame, shape: _Shape, is_hot: Column, buckets: list[int], bucket_seconds: int) -> DataFrame:
    """The arrival rows of the hot keys, summed by buckets; ``buckets`` are the ones to split."""
    sums, marks = shape.sums, shape.marks
    split = _bucket_id(F.col("_fam"), F.col("_key"), F.col(BKT)).isin(buckets) if buckets else None

    # ---------------- stage 1: running counts per (family, key, measure, value) ----------------
    change_rows = None
    if shape.dims:
        structs = []
        for k, (fi, _name, value, seconds, _kind) in enumerate(shape.dims):
            head = {"_fam": f"{fi}", "_key": f"_k{fi}", "dim": f"{k}", "val": f"_v_{value}"}
            structs.append(_struct(**head, **{T: "_tv", ORD: "_sv"}, d="1", ever="1"))
            if seconds is not None:
                structs.append(_struct(**head, **{T: f"_tv + {seconds + 1}L", ORD: "-1L - _sv"}, d="-1", ever="0"))
        s1 = base.select(F.expr(f"explode(array({', '.join(structs)}))").alias("r")).select("r.*").where("_key is not null and val is not null").where(is_hot)
        s1 = running_sum(s1, ["_fam", "_key", "dim", "val"], ["d", "ever"], bucket_seconds=bucket_seconds, hot=split)
        moved = shape.moved()
        sel = [F.col("_fam"), F.col("_key"), F.col(T), F.col(ORD), F.lit(0).alias(ARRIVAL), F.lit(None).cast("long").alias("_seq")]
        change_rows = s1.select(*sel, *[moved.get(c, F.lit(0).cast("long")).alias(c) for c in (*sums, *marks)]).where(_or_all([F.col(c) != 0 for c in moved]))

    # ---------------- stage 2: running sums per (family, key) ----------------
    structs = []
    for fi in range(len(shape.families)):
        mine = {j: c for j, (f2, c) in enumerate(shape.counts) if f2 == fi}

        def row(t: str, order: str, arrival: int, seq: str, given: dict[str, str]) -> str:
            head = {"_fam": f"{fi}", "_key": f"_k{fi}", T: t, ORD: order, ARRIVAL: f"{arrival}", "_seq": seq}
            return _struct(**head, **{c: given.get(c, "0L") for c in (*sums, *marks)})

        structs.append(row("_tv", "_sv", 1, "_sv", {shape.place[c.name][1]: f"_m{j}" for j, c in mine.items()}))
        for w in shape.windows(fi):
            given = {shape.place[c.name][1]: f"-_m{j}" for j, c in mine.items() if c.seconds == w}
            structs.append(row(f"_tv + {w + 1}L", "-1L - _sv", 0, "CAST(NULL AS BIGINT)", given))
    s2 = base.select(F.expr(f"explode(array({', '.join(structs)}))").alias("r")).select("r.*").where("_key is not null").where(is_hot)
    if change_rows is not None:
        s2 = s2.unionByName(change_rows)
    s2 = running_sum(s2, ["_fam", "_key"], sums, slot_values=marks, bucket_seconds=bucket_seconds, hot=split)
    return s2.where(F.col(ARRIVAL) == 1).select(*shape.arrival_columns())
