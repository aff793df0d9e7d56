"""Exact ranks, positions and quantiles without putting a whole group into one task.

Per-feature or per-run statistics group the data by a handful of keys, so one
group may hold a third of all rows. A plain ``Window.partitionBy(group)``
would sort that whole group in one task. Here every ordered computation is
split into value buckets:

* ``hash_positions`` numbers rows by a uniform 52-bit hash. Buckets are the
  top bits of the hash, so they are balanced by construction.
* ``value_positions`` first collapses rows to distinct values (partial
  aggregation merges hot values map-side), then deals them out by ranges of
  (group, value). Offsets of the ranges come from a small aggregate; inside a
  range a window sorts at most about ``rows_per_bucket`` distinct values.
* ``exact_quantiles`` needs no order of a large group: sketches narrow a bracket
  per (group, probability), what lies below it is counted, and only the values
  inside the last brackets are shuffled and ranked.

All give exact results; buckets and brackets only bound the work per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2_000_000
HASH_BUCKET_BITS = 16
BROADCAST_MAX_ROWS = 2_000_000


def small_side(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only after checking that its row count is bounded."""
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage: partition ids are then fixed."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that are worth a task of their own in a table that is scanned many times, and rows that fill one.
SPREAD_ROWS, FULL_ROWS = 4096, 1 << 18


def spread(df: DataFrame, gathered: bool = False) -> DataFrame:
    """``checkpointed``, and dealt out anew where its partitions are fewer than the cores that have rows to scan; with ``gathered`` also
    where they are over twice as many as it takes, for scans whose tasks each send sums of their own."""
    rows = checkpointed(df)
    n, have = rows.count(), rows.rdd.getNumPartitions()
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, n // SPREAD_ROWS)
    most = max(tasks, n // FULL_ROWS, 1)
    if gathered and have > 2 * most:
        return checkpointed(rows.repartition(most))
    return checkpointed(rows.repartition(tasks)) if have < tasks else rows


def _cols(cols) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def bucket_bits_for(max_group_rows: int | None, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hash bits needed so that a group of ``max_group_rows`` rows falls into buckets of
    at most ``rows_per_bucket`` rows (16 bits when the size is unknown)."""
    if max_group_rows is None:
        return HASH_BUCKET_BITS
    return max(0, min(24, math.ceil(math.log2(max(1.0, max_group_rows / rows_per_bucket)))))


def hash_positions(df: DataFrame, group_cols, hash_col: str, tie_col: str, out: str = "pos",
                   bucket_bits: int | None = None, max_group_rows: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, ordered by (hash_col, tie_col).

    ``hash_col`` must be a uniform non-negative 52-bit integer (``portable.hash52``).
    Its top bits cut every group into 2**bits balanced buckets, bits chosen from
    ``max_group_rows`` when the caller knows the group sizes (16 bits otherwise:
    1e12 rows → ~1.5e7 per bucket). Bucket offsets come from a groups × buckets count
    table joined on (group, bucket), the same key the window needs, so the rows are
    shuffled once. Groups small enough for one task use a plain window. No action is run.
    """
    group_cols = _cols(group_cols)
    bits = bucket_bits if bucket_bits is not None else bucket_bits_for(max_group_rows)
    if bits == 0:
        w = Window.partitionBy(*(group_cols or [F.lit(0)])).orderBy(hash_col, tie_col)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    b = df.withColumn("_bkt", F.shiftright(F.col(hash_col), 52 - bits))
    counts = b.groupBy(*group_cols, "_bkt").agg(F.count(F.lit(1)).alias("_bn"))
    wo = Window.partitionBy(*(group_cols or [F.lit(0)])).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_bn").over(wo), F.lit(0)))
    offsets = offsets.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col("_bkt").alias("_g_bkt"), "_off")
    w = Window.partitionBy(*group_cols, "_bkt").orderBy(hash_col, tie_col)
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group_cols] + [F.col("_bkt") == F.col("_g_bkt")]
    return (b.join(offsets, on)
            .withColumn(out, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint"))
            .drop("_bkt", "_off", "_g_bkt", *[f"_g_{c}" for c in group_cols]))


def value_positions(df: DataFrame, group_cols, value_col: str, sum_cols=(),
                    rows_per_bucket: int = ROWS_PER_BUCKET, max_group_rows: int | None = None) -> DataFrame:
    return value_positions_info(df, group_cols, value_col, sum_cols, rows_per_bucket, max_group_rows)[0]


def value_positions_info(df: DataFrame, group_cols, value_col: str, sum_cols=(),
                         rows_per_bucket: int = ROWS_PER_BUCKET,
                         max_group_rows: int | None = None) -> tuple[DataFrame, int]:
    """One row per (group, distinct non-null value) with exact running counts.

    Columns: group cols, ``value``, ``cnt`` (rows with this value), ``cum`` (rows
    with a smaller value), ``k`` (0-based index among distinct values), and for
    each name ``c`` in ``sum_cols``: ``s_c`` (sum at this value) and ``cum_c``
    (sum over smaller values).
    """
    group_cols = _cols(group_cols)
    sum_cols = list(sum_cols)
    aggs = [F.count(F.lit(1)).alias("cnt")] + [F.sum(c).alias(f"s_{c}") for c in sum_cols]
    d = (df.where(F.col(value_col).isNotNull())
         .groupBy(*group_cols, F.col(value_col).alias("value")).agg(*aggs))
    if max_group_rows is not None and max_group_rows <= rows_per_bucket:
        # the caller knows every group is small (e.g. one held-out fold): no sizing pass needed
        largest, n_groups = max_group_rows, BROADCAST_MAX_ROWS
    else:
        info = d.groupBy(*group_cols).count().agg(F.max("count"), F.count(F.lit(1)), F.sum("count")).first()
        largest, n_groups, n_values = (info[0] or 0), (info[1] or 0), (info[2] or 0)
    run_cols = ["cnt"] + [f"s_{c}" for c in sum_cols]
    if largest <= rows_per_bucket:
        d = d.withColumn("_bkt", F.lit(0))
        offsets = None
    else:
        # Range partitioning on (group, value) deals the distinct values out in order, a group over as many partitions as
        # it needs; a partition is then a bucket, and its offset comes from a small partitions x groups table. No cut
        # table and no array of cuts travels with the rows. The dealt rows are written once, so that every later pass
        # sees the same partitions.
        parts = max(2, math.ceil(n_values / rows_per_bucket))
        d = (d.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in group_cols], "value")
             .withColumn("_bkt", F.spark_partition_id()))
        d = checkpointed(d)
        bt = d.groupBy(*group_cols, "_bkt").agg(
            *[F.sum(c).alias(f"_b_{c}") for c in run_cols], F.count(F.lit(1)).alias("_b_nd"))
        wo = Window.partitionBy(*(group_cols or [F.lit(0)])).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
        offsets = bt.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col("_bkt").alias("_g_bkt"),
                            *[F.coalesce(F.sum(f"_b_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                              for c in run_cols + ["nd"]])
        on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group_cols] + [F.col("_bkt") == F.col("_g_bkt")]
        d = d.join(small_side(offsets), on).drop("_g_bkt", *[f"_g_{c}" for c in group_cols])
    w = Window.partitionBy(*group_cols, "_bkt").orderBy("value")
    wp = w.rowsBetween(Window.unboundedPreceding, -1)

    def off(c):
        return F.col(f"_o_{c}") if offsets is not None else F.lit(0)

    out = d.select(
        *group_cols, "value", *run_cols,
        (off("cnt") + F.coalesce(F.sum("cnt").over(wp), F.lit(0))).cast("bigint").alias("cum"),
        *[(off(f"s_{c}") + F.coalesce(F.sum(f"s_{c}").over(wp), F.lit(0))).alias(f"cum_{c}")
          for c in sum_cols],
        (off("nd") + F.row_number().over(w) - 1).cast("bigint").alias("k"),
    )
    return out, n_groups


#: Cuts asked of a sketch inside a bracket, and the sketch's accuracy (its rank error is far below the cuts' distance).
BRACKET_CUTS, SKETCH_ACCURACY = 64, 2000


def exact_quantiles(df: DataFrame, group_cols, value_col: str, probs, out: str = "q",
                    rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Linear-interpolation quantiles (numpy 'linear', SQL quantile_cont) per group.

    Returns group cols, ``prob``, ``out``. NULL values are ignored; a group with
    no value gives no row. Groups of at most ``rows_per_bucket`` rows are ranked
    whole. Where a group is larger, each wanted rank gets a bracket of values that
    a sketch narrows round by round; what lies below a bracket is only counted, and
    just the values inside the last one are shuffled and ranked. Exact either way.
    """
    keys = _cols(group_cols)
    probs = sorted({float(p) for p in probs})
    x = df.where(F.col(value_col).isNotNull()).select(*keys, F.col(value_col).alias("value"))
    if not keys:
        x = x.withColumn("_all", F.lit(0))
    groups = keys or ["_all"]
    sizes = x.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= rows_per_bucket:
        res = _ranked_whole(x, groups, probs, out)
    else:
        res = _ranked_in_brackets(x, groups, probs, out, rows_per_bucket)
    return res if keys else res.drop("_all")


def _between(low, high, h, lo):
    return low + (high - low) * (h - lo)


def _ranked_whole(x: DataFrame, groups, probs, out: str) -> DataFrame:
    counted = x.groupBy(*groups, "value").agg(F.count(F.lit(1)).alias("cnt"))
    whole = Window.partitionBy(*groups)
    ranked = (counted.withColumn("_n", F.sum("cnt").over(whole))
              .withColumn("cum", F.coalesce(F.sum("cnt").over(whole.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    aggs = []
    for i, p in enumerate(probs):
        h = F.lit(p) * (F.col("_n") - 1).cast("double")
        for name, r in (("l", F.floor(h).cast("bigint")), ("u", F.ceil(h).cast("bigint"))):
            hit = (F.col("cum") <= r) & (r < F.col("cum") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, F.col("value"))).alias(f"_{name}{i}"))
    found = ranked.groupBy(*groups).agg(F.max("_n").alias("_n"), *aggs)
    rows = []
    for i, p in enumerate(probs):
        h = F.lit(p) * (F.col("_n") - 1).cast("double")
        rows.append(F.struct(F.lit(p).alias("prob"), _between(F.col(f"_l{i}"), F.col(f"_u{i}"), h, F.floor(h).cast("double")).alias(out)))
    return found.select(*groups, F.inline(F.array(*rows)))


def _ranked_in_brackets(x: DataFrame, groups, probs, out: str, limit: int) -> DataFrame:
    """One bracket per (group, prob): [low, high] with ``below`` rows under it and ``inside`` rows in it."""
    def with_brackets(t: DataFrame) -> DataFrame:
        side = t.select(*[F.col(c).alias(f"_t_{c}") for c in groups], *[c for c in t.columns if c not in groups])
        return x.join(small_side(side), [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in groups]).drop(*[f"_t_{c}" for c in groups])

    info = x.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    t = info.withColumn("prob", F.explode(F.array(*[F.lit(p) for p in probs])))
    h = F.col("prob") * (F.col("n") - 1).cast("double")
    t = checkpointed(t.select(*groups, "prob", "n", "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), F.lit(False).alias("last")))
    cut_at = F.array(*[F.lit(i / BRACKET_CUTS) for i in range(BRACKET_CUTS + 1)])
    while True:
        wide = t.where((F.col("inside") > limit) & (F.col("low") < F.col("high")) & ~F.col("last"))
        if not wide.limit(1).count():
            break
        ids = [*groups, "prob"]
        held = with_brackets(wide).where(F.col("value").between(F.col("low"), F.col("high")))
        cuts = held.groupBy(*ids, "n", "low", "high", "below", "inside").agg(F.percentile_approx("value", cut_at, SKETCH_ACCURACY).alias("_c"))
        spot = F.floor((F.floor(h) - F.col("below")) / F.col("inside") * BRACKET_CUTS).cast("int")  # cell of the wanted rank
        low2 = F.when(spot - 1 <= 0, F.col("low")).otherwise(F.element_at("_c", spot))
        high2 = F.when(spot + 3 >= BRACKET_CUTS, F.col("high")).otherwise(F.element_at("_c", spot + 4))
        narrow = checkpointed(cuts.select(*ids, "n", "low", "high", "below", "inside", low2.alias("low2"), high2.alias("high2")))
        value = F.col("value")
        counted = (with_brackets(narrow).where(value.between(F.col("low"), F.col("high2")))
                   .groupBy(*ids, "n", "low", "high", "below", "inside", "low2", "high2")
                   .agg(F.count(F.when(value < F.col("low2"), 1)).alias("_under"), F.count(F.when(value >= F.col("low2"), 1)).alias("_in")))
        under, inside = F.col("below") + F.col("_under"), F.col("_in")
        good = (F.floor(h) >= under) & (F.ceil(h) < under + inside)  # else the old bracket stays and is ranked as it is
        slow = inside * 2 > F.col("inside")  # few values hold most rows: counting them is cheap
        t = checkpointed(t.where(~((F.col("inside") > limit) & (F.col("low") < F.col("high")) & ~F.col("last"))).unionByName(
            counted.select(*ids, "n", F.when(good, F.col("low2")).otherwise(F.col("low")).alias("low"),
                           F.when(good, F.col("high2")).otherwise(F.col("high")).alias("high"),
                           F.when(good, under).otherwise(F.col("below")).alias("below"),
                           F.when(good, inside).otherwise(F.col("inside")).alias("inside"), (~good | slow).alias("last"))))
    cells = with_brackets(t).where(F.col("value").between(F.col("low"), F.col("high")))
    counted = cells.groupBy(*groups, "prob", "n", "below", "value").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy(*groups, "prob").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("cum", F.col("below") + F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    hit = lambda r: (F.col("cum") <= r) & (r < F.col("cum") + F.col("cnt"))
    found = ranked.groupBy(*groups, "prob").agg(F.max("n").alias("n"), F.max(F.when(hit(F.floor(h).cast("bigint")), F.col("value"))).alias("_l"),
                                                F.max(F.when(hit(F.ceil(h).cast("bigint")), F.col("value"))).alias("_u"))
    return found.select(*groups, "prob", _between(F.col("_l"), F.col("_u"), h, F.floor(h).cast("double")).alias(out))


def exact_quantile_grid(df: DataFrame, group_cols, value_col: str, m: int, out: str = "q") -> DataFrame:
    """Quantiles at the evenly spaced probabilities i / (m − 1), i = 0…m−1, per group.

    Instead of joining every distinct value with all 2m target ranks, each
    distinct value row works out which grid indices i have their lower or upper
    rank inside the row's rank interval [cum, cum + cnt) and emits only those
    (a Generate over a short index range, checked exactly with the same double
    arithmetic as ``exact_quantiles``). Work is O(distinct values + m) per group.
    """
    group_cols = _cols(group_cols)
    pos = value_positions(df, group_cols, value_col)
    n = pos.groupBy(*group_cols).agg(F.sum("cnt").alias("_n"))
    d = pos.join(n, group_cols)  # one row per group on the right; joined on the group key
    mm1 = float(m - 1)
    scale = (F.col("_n") - 1).cast("double")
    # candidate i range from the inverse map, widened by one on both sides, then filtered exactly
    lo_i = F.greatest(F.lit(0), F.floor((F.col("cum") - 1).cast("double") * mm1 / F.greatest(scale, F.lit(1.0))) - 1)
    hi_i = F.least(F.lit(m - 1), F.ceil((F.col("cum") + F.col("cnt")).cast("double") * mm1 / F.greatest(scale, F.lit(1.0))) + 1)
    cand = d.withColumn("_i", F.explode(F.sequence(lo_i.cast("int"), hi_i.cast("int"))))
    p = F.col("_i").cast("double") / F.lit(mm1)
    h = p * scale
    cand = (cand.withColumn("prob", p).withColumn("_h", h)
            .withColumn("_lo", F.floor("_h").cast("bigint")).withColumn("_hi", F.ceil("_h").cast("bigint")))
    inside_lo = (F.col("_lo") >= F.col("cum")) & (F.col("_lo") < F.col("cum") + F.col("cnt"))
    inside_hi = (F.col("_hi") >= F.col("cum")) & (F.col("_hi") < F.col("cum") + F.col("cnt"))
    hits = cand.where(inside_lo | inside_hi)
    res = hits.groupBy(*group_cols, "prob", "_h", "_lo").agg(
        F.max(F.when(inside_lo, F.col("value"))).alias("_vlo"),
        F.max(F.when(inside_hi, F.col("value"))).alias("_vhi"))
    dd = F.col("_h") - F.col("_lo").cast("double")
    return res.select(*group_cols, "prob", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * dd).alias(out))


def quantile_columns(df: DataFrame, group_cols, value_col: str, probs: dict[str, float]) -> DataFrame:
    """Like ``exact_quantiles`` but one column per named probability."""
    group_cols = _cols(group_cols)
    q = exact_quantiles(df, group_cols, value_col, list(probs.values()))
    return q.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("q"))).alias(name) for name, p in probs.items()])


def average_ranks(pos: DataFrame) -> Column:
    """Average (tie-corrected) 1-based rank of a distinct value row from ``value_positions``."""
    return F.col("cum").cast("double") + (F.col("cnt").cast("double") + 1.0) / 2.0
