"""Ordered computations that keep no whole group in one task.

Every ordered operator here works in two levels. The caller names a *bucket*: one or more
expressions that never decrease along the order. Rows are windowed inside (key, bucket); the
small table of bucket totals is windowed over (key); both are joined on (key, bucket). A key
that holds a third of all rows is therefore spread over its buckets, and the raw rows are
shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlytics.functions.columns import col, is_finite

_B = "_bucket"


def index_bucket(c: str | Column, size: int = 4096) -> Column:
    """Bucket for an integer index that is unique within the key: at most ``size`` rows each."""
    return F.floor(col(c) / F.lit(size))


def value_bucket(c: str | Column, per_octave: int = 512) -> Column:
    """Bucket for a double of unknown range: non-decreasing in the value, finer near zero."""
    v = col(c).cast("double")
    size = F.floor(F.log2(1.0 + F.abs(v) * 1e6) * F.lit(per_octave))
    return F.when(v < 0, -size).otherwise(size)


def hash_bucket(c: str | Column, digits: int = 2) -> Column:
    """Bucket for a hexadecimal hash: 16**digits even ranges in hash order."""
    return F.substring(col(c), 1, digits)


def cut_points(df: DataFrame, value: str, parts: int = 256) -> list[float]:
    """At most ``parts`` cut values of a column (bounded driver state, one partial-agg pass)."""
    probs = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 10 * parts).alias("c")).first()
    return sorted(set(row["c"] or []))


def cut_bucket(value: str | Column, cuts: Sequence[float], tie: str | Column) -> list[Column]:
    """Order buckets for (value, hash tie). A value that is itself a cut gets buckets of its own,
    which the hash splits further, so a heavily repeated value is spread as well."""
    v = col(value).cast("double")
    if not cuts:
        return [F.lit(0), hash_bucket(tie)]
    # lower bound by halving steps over the cuts padded to 2**m - 1
    m = len(cuts).bit_length()
    padded = [float(c) for c in cuts] + [float("inf")] * (2**m - 1 - len(cuts))
    edges = F.lit(padded)
    steps = F.lit([2**i for i in range(m - 1, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda pos, s: F.when(F.element_at(edges, pos + s) < v, pos + s).otherwise(pos))
    on = F.array_contains(edges, v)
    return [2 * below + on.cast("int"), F.when(on, hash_bucket(tie)).otherwise(F.lit(""))]


def _as_list(b) -> list[Column]:
    many = b if isinstance(b, (list, tuple)) else [b]
    return [F.expr(x) if isinstance(x, str) else x for x in many]


_AT, _KEY = "_at", "_key"


def _placed(df: DataFrame, keys: Sequence[str], bucket) -> tuple[DataFrame, list[Column]]:
    """df with the struct of its keys and buckets, which is equal to itself where a key or bucket is null; the bucket fields.

    Windows, totals and their join all use this one column, so the raw rows are shuffled once."""
    exprs = _as_list(bucket)
    names = [f"{_B}{i}" for i in range(len(exprs))]
    fields = [*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[e.alias(n) for e, n in zip(exprs, names)]]
    return df.withColumn(_AT, F.struct(*fields)), [F.col(_AT)[n] for n in names]


def _per_key(totals: DataFrame, n_keys: int) -> DataFrame:
    """Bucket totals with the struct of their keys alone."""
    return totals.withColumn(_KEY, F.struct(F.lit(0), *[F.col(_AT)[f"k{i}"] for i in range(n_keys)]))


#: Rows of one partition of ``dealt_rows``.
DEALT_ROWS = 500_000


def dealt_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt by many small keys into partitions of about DEALT_ROWS rows. An aggregate per key then holds that many rows
    in a task, however few bytes they had before they were exploded or joined."""
    return df.repartition(df.count() // DEALT_ROWS + 1, *keys)


def dealt_by(df: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    """``dealt_rows`` by a bound of the number of rows that is known without counting them, such as the rows of the table read;
    never fewer partitions than cores."""
    return df if rows is None else df.repartition(max(rows // DEALT_ROWS + 1, df.sparkSession.sparkContext.defaultParallelism), *keys)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality join on named columns in which a null key meets a null key; right must not repeat other names of left."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket,
    order: Sequence[str | Column],
    specs: dict[str, tuple[str, str | Column]],
    *,
    exclusive: bool = False,
) -> DataFrame:
    """Running aggregates along ``order`` within ``keys``.

    ``specs``: name -> (kind, column), kind in sum | count | max | min | last (last ignores nulls),
    or total_sum | total_max | total_min | total_first over the whole key, which cost no further join.
    ``exclusive`` leaves the current row out of the running kinds. Null keys are one key, null buckets come first.
    """
    staged, buckets = _placed(df, keys, bucket)
    order_cols = [col(o) for o in order]
    hi = -1 if exclusive else 0
    w = Window.partitionBy(_AT).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, hi)
    wo = Window.partitionBy(_KEY).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(_KEY)
    in_order = whole.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    local_cols, total_aggs, off_cols, merged = {}, [], {}, {}
    key_struct = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order_cols)])
    for name, (kind, c) in specs.items():
        c = col(c)
        ln, tn, on = f"_l_{name}", f"_t_{name}", f"_o_{name}"
        if kind in ("sum", "count"):
            c = c if kind == "sum" else F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
            local_cols[ln] = F.sum(c).over(w)
            total_aggs.append(F.sum(c).alias(tn))
            off_cols[on] = F.sum(tn).over(wo)
            zero = F.lit(0).cast("bigint") if kind == "count" else F.lit(0.0)
            merged[name] = F.coalesce(F.col(ln), zero) + F.coalesce(F.col(on), zero)
        elif kind in ("max", "min"):
            agg, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            local_cols[ln] = agg(c).over(w)
            total_aggs.append(agg(c).alias(tn))
            off_cols[on] = agg(tn).over(wo)
            merged[name] = pick(F.col(ln), F.col(on))
        elif kind == "last":
            local_cols[ln] = F.last(c, ignorenulls=True).over(w)
            total_aggs.append(F.max_by(c, F.when(c.isNotNull(), key_struct)).alias(tn))
            off_cols[on] = F.last(tn, ignorenulls=True).over(wo)
            merged[name] = F.coalesce(F.col(ln), F.col(on))
        elif kind in ("total_sum", "total_max", "total_min"):
            agg = {"total_sum": F.sum, "total_max": F.max, "total_min": F.min}[kind]
            total_aggs.append(agg(c).alias(tn))
            off_cols[on] = agg(tn).over(whole)
            merged[name] = F.col(on)
        elif kind == "total_first":
            total_aggs.append(F.min_by(c, key_struct).alias(tn))
            off_cols[on] = F.first(tn).over(in_order)
            merged[name] = F.col(on)
        else:
            raise ValueError(f"unknown running kind {kind!r}")
    totals = _per_key(staged.groupBy(_AT).agg(*total_aggs), len(keys)).withColumns(off_cols).select(_AT, *off_cols)
    local = staged.withColumns(local_cols) if local_cols else staged
    return local.join(totals, _AT).select(*df.columns, *[m.alias(n) for n, m in merged.items()])


def grouped_rank(
    df: DataFrame, keys: Sequence[str], bucket, order: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """One-based row number along ``order`` within ``keys`` (ties must be broken by ``order``)."""
    return running(df, keys, bucket, order, {name: ("count", F.lit(1))})


def previous(
    df: DataFrame, keys: Sequence[str], bucket, order: Sequence[str | Column], cols: dict[str, str | Column], *, rows: int | None = None
) -> DataFrame:
    """Values of the preceding row along ``order`` (nulls of that row included). Null keys are one key.

    ``rows``: a known bound of the number of rows, by which they are dealt into partitions of about DEALT_ROWS."""
    staged, buckets = _placed(df, keys, bucket)
    order_cols = [col(o) for o in order]
    payload = F.struct(*[col(c).alias(n) for n, c in cols.items()])
    w = Window.partitionBy(_AT).orderBy(*order_cols)
    wo = Window.partitionBy(_KEY).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    key_struct = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order_cols)])
    totals = _per_key(staged.groupBy(_AT).agg(F.max_by(payload, key_struct).alias("_t")), len(keys))
    totals = totals.withColumn("_o", F.last("_t").over(wo)).select(_AT, "_o")
    local = dealt_by(staged, [_AT], rows).withColumn("_p", F.lag(payload).over(w))
    picked = F.coalesce(F.col("_p"), F.col("_o"))
    return local.join(totals, _AT).select(*df.columns, *[picked[n].alias(n) for n in cols])


def integrated(
    df: DataFrame,
    keys: Sequence[str],
    bucket,
    order: Sequence[str | Column],
    cols: Sequence[str],
    steps: Callable[[Column, Column], dict[str, Column]],
    cumulative: dict[str, str],
) -> DataFrame:
    """Steps between neighbouring rows and their running sums in one scan.

    ``steps(previous, current)`` gives named expressions of two rows' ``cols`` (structs), zero for the first row of a key;
    ``cumulative`` maps a new column to the step it sums. The step into a bucket is taken from the bucket table, which
    knows the last row before it, so the rows are shuffled once.
    """
    staged, buckets = _placed(df, keys, bucket)
    order_cols = [col(o) for o in order]
    w = Window.partitionBy(_AT).orderBy(*order_cols)
    key_struct = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order_cols)])
    local = staged.withColumn("_row", F.struct(*cols)).withColumn("_p", F.lag("_row").over(w))
    names = list(steps(F.col("_p"), F.col("_row")))
    inner = steps(F.col("_p"), F.col("_row"))
    local = local.withColumns({f"_s_{n}": F.when(F.col("_p").isNotNull(), F.coalesce(inner[n], F.lit(0.0))) for n in names})
    sums = {c: F.sum(F.coalesce(F.col(f"_s_{n}"), F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c, n in cumulative.items()}
    local = local.withColumns({f"_c_{c}": v for c, v in sums.items()})
    before = Window.partitionBy(_KEY).orderBy(*buckets)
    totals = local.groupBy(_AT).agg(
        F.min_by("_row", key_struct).alias("_first"), F.max_by("_row", key_struct).alias("_last"),
        *[F.sum(F.coalesce(F.col(f"_s_{n}"), F.lit(0.0))).alias(f"_t_{n}") for n in names],
    )
    totals = _per_key(totals, len(keys)).withColumn("_q", F.lag("_last").over(before))
    edge = steps(F.col("_q"), F.col("_first"))
    totals = totals.withColumns({f"_e_{n}": F.when(F.col("_q").isNotNull(), F.coalesce(edge[n], F.lit(0.0))).otherwise(F.lit(0.0)) for n in names})
    gone = before.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns(
        {f"_b_{c}": F.coalesce(F.sum(F.col(f"_t_{n}") + F.col(f"_e_{n}")).over(gone), F.lit(0.0)) + F.col(f"_e_{n}") for c, n in cumulative.items()}
    )
    kept = totals.select(_AT, *[f"_e_{n}" for n in names], *[f"_b_{c}" for c in cumulative])
    return local.join(kept, _AT).select(
        *df.columns,
        *[F.coalesce(F.col(f"_s_{n}"), F.col(f"_e_{n}")).alias(n) for n in names],
        *[(F.col(f"_c_{c}") + F.col(f"_b_{c}")).alias(c) for c in cumulative],
    )


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: dict[str, tuple[str, float]],
    *,
    bucket: Column | None = None,
    count_not_finite: bool = False,
) -> DataFrame:
    """Exact order statistics per key without holding a group in memory.

    ``picks``: name -> (mode, p). Modes: ``linear`` (interpolated percentile), ``higher``
    (smallest value at or above the interpolated position), ``rank`` (the value of one-based rank
    ``ceil((n + 1) p)``, null when that rank exceeds n), ``higher_rank`` (``higher`` at the level
    ``min(1, ceil((n + 1) p) / n)``). Nulls are left out, and so are NaN and infinities: with
    ``count_not_finite`` a column n_not_finite counts those, and keys with nothing else keep their row (n = 0).
    Equal values are counted first, so repeated values never travel as rows.
    """
    keys = list(keys)
    usable = F.when(is_finite(value), F.col(value)).alias(value)
    counted = df.filter(F.col(value).isNotNull()).select(*keys, usable).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_rows"))
    good = F.col(value).isNotNull()
    counted = counted.withColumn("_n", F.when(good, F.col("_rows")).otherwise(F.lit(0)))
    joined = running(
        counted, keys, value_bucket(value) if bucket is None else bucket, [value],
        {
            "_cum": ("sum", F.col("_n")), "_size": ("total_sum", F.col("_n")),
            "_bad": ("total_sum", F.when(good, F.lit(0)).otherwise(F.col("_rows"))),
        },
    ).withColumn("_cum", F.col("_cum").cast("bigint"))
    first, last = F.col("_cum") - F.col("_n") + 1, F.col("_cum")
    aggs, outs = [], []
    for name, (mode, p) in picks.items():
        if mode == "linear":
            pos = F.lit(1.0) + F.lit(float(p)) * (F.col("_size") - 1)
            lo, hi = F.floor(pos), F.ceil(pos)
            aggs += [
                F.max(F.when((first <= lo) & (lo <= last), F.col(value))).alias(f"_lo_{name}"),
                F.max(F.when((first <= hi) & (hi <= last), F.col(value))).alias(f"_hi_{name}"),
                F.max(pos - lo).alias(f"_w_{name}"),
            ]
            a, b, t = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_w_{name}")
            outs.append((a + (b - a) * t).alias(name))
            continue
        n, level = F.col("_size"), F.lit(float(p))
        if mode == "higher":
            k = F.ceil(level * (n - 1)) + 1
        elif mode == "higher_rank":
            k = F.ceil(F.least(F.lit(1.0), F.ceil((n + 1) * level) / n) * (n - 1)) + 1
        elif mode == "rank":
            k = F.ceil((n + 1) * level)
        else:
            raise ValueError(f"unknown order statistic mode {mode!r}")
        aggs.append(F.max(F.when((first <= k) & (k <= last), F.col(value))).alias(name))
        outs.append(F.col(name))
    aggs += [F.max("_size").alias("n"), F.max("_bad").alias("n_not_finite")]
    found = joined.groupBy(*keys).agg(*aggs)
    if count_not_finite:
        return found.select(*keys, "n", "n_not_finite", *outs)
    return found.filter("n > 0").select(*keys, "n", *outs) if keys else found.select("n", *outs)
