"""Seeds, stratified splits, bootstraps and folds (SP-*).

All draws are md5 hashes of (id, seed, purpose), so a split is a pure
function of the data and the seed: a retried task, a different partitioning
or an SQL engine give the same rows. Positions inside a class come from
``hash_positions`` (bucketed by hash bits), never from a window over a whole class.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.portable import hash52
from .positions import hash_positions


def generate_seeds(init: int, n: int) -> list[int]:
    """SP-1: n == 1 → [init]; else n unsigned 32-bit draws from md5(init|k)."""
    if n == 1:
        return [int(init)]
    return [int(hashlib.md5(f"{init}|{k}".encode()).hexdigest()[:8], 16) for k in range(n)]


def seeds_frame(spark, init: int, n: int) -> DataFrame:
    """SP-1 as a DataFrame (seed BIGINT), computed by Spark from the same md5 rule."""
    if n == 1:
        return spark.range(1).select(F.lit(int(init)).cast("bigint").alias("seed"))
    return spark.range(n).select(
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(init)), F.col("id").cast("string"))), 1, 8), 16, 10)
        .cast("bigint").alias("seed"))


def with_seeds(df: DataFrame, seeds) -> DataFrame:
    """SP-4: one copy of the rows per seed (all seeds in one job)."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in seeds])))


def _seed_keys(df: DataFrame) -> list[str]:
    return [c for c in ("seed", "boot") if c in df.columns]


def _largest_remainder(cls: DataFrame, keys, class_col: str, total_col: str, out: str) -> DataFrame:
    """Share ``total_col`` over classes in proportion to n_c; remainders to the largest fractions."""
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    exact = F.col(total_col).cast("double") * F.col("n_c").cast("double") / F.col("_n").cast("double")
    c = (cls.withColumn("_n", F.sum("n_c").over(wk))
         .withColumn("_exact", exact)
         .withColumn("_fl", F.floor("_exact").cast("bigint"))
         .withColumn("_short", F.col(total_col) - F.sum("_fl").over(wk)))
    wr = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(
        F.desc(F.col("_exact") - F.col("_fl")), F.asc(class_col))
    return (c.withColumn(out, F.col("_fl") + F.when(F.row_number().over(wr) <= F.col("_short"), 1).otherwise(0))
            .drop("_n", "_exact", "_fl", "_short"))


def class_quotas(df: DataFrame, test_frac: float, target: str = "target", stratify: bool = True) -> DataFrame:
    """Test rows per (seed, class): n_test = ceil(frac · n), shared by largest remainder."""
    keys = _seed_keys(df)
    strata = [target] if stratify else []
    cls = df.groupBy(*keys, *strata).agg(F.count(F.lit(1)).alias("n_c"))
    if not stratify:
        cls = cls.withColumn("_cls", F.lit(0))
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    cls = cls.withColumn("_ntest", F.ceil(F.lit(float(test_frac)) * F.sum("n_c").over(wk).cast("double")))
    return _largest_remainder(cls, keys, target if stratify else "_cls", "_ntest", "quota").drop("_ntest")


#: Classes (times seeds) a stratified split works with; more means the target is no class.
MAX_CLASSES = 100_000


def _null_safe(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def hash_cuts(d: DataFrame, groups, sizes: list, hash_col: str, key: str) -> DataFrame:
    """(groups…, _cut_h, _cut_k): hash and key of the last of the first ``quota`` rows of every group, by (hash, key).

    ``sizes`` holds rows with the group columns, n_c and quota. The hash is uniform, so the cut lies within a few
    standard deviations of quota / n · 2^52: one pass counts the rows under that bracket and ranks the few inside it.
    A group whose cut is not there (the odds are negligible) gets the whole range as its bracket.
    """
    spark, span = d.sparkSession, 1 << 52
    schema = d.select(*groups).schema
    for name in ("quota", "_low", "_high"):
        schema = schema.add(name, T.LongType())

    def ask(wide: bool, rows):
        out = []
        for r in rows:
            n, q = r["n_c"], r["quota"]
            margin = 8 * math.sqrt(q * (n - q) / n) + 16 if n else 0
            low = 0 if wide else max(0, int((q - margin) / n * span))
            high = span if wide else min(span, int((q + margin) / n * span) + 1)
            out.append((*[r[g] for g in groups], q, low, high))
        b = spark.createDataFrame(out, schema).select(*[F.col(g).alias(f"_b_{g}") for g in groups], "quota", "_low", "_high")
        x = d.select(*groups, F.col(hash_col).alias("_h"), F.col(key).alias("_k"))
        on = [_null_safe(g, f"_b_{g}") for g in groups]
        near = x.join(F.broadcast(b), on if on else F.lit(True)).where(F.col("_h") < F.col("_high"))
        gs = [F.col(f"_b_{g}").alias(g) for g in groups]
        under = near.groupBy(*[f"_b_{g}" for g in groups]).agg(F.count(F.when(F.col("_h") < F.col("_low"), 1)).alias("_under"))
        w = Window.partitionBy(*([f"_b_{g}" for g in groups] or [F.lit(0)])).orderBy("_h", "_k")
        inside = near.where(F.col("_h") >= F.col("_low")).withColumn("_i", F.row_number().over(w))
        on2 = [_null_safe(f"_b_{g}", f"_u_{g}") for g in groups]
        u = under.select(*[F.col(f"_b_{g}").alias(f"_u_{g}") for g in groups], "_under")  # groups rows
        hit = inside.join(F.broadcast(u), on2 if on2 else F.lit(True)).where(F.col("_i") + F.col("_under") == F.col("quota"))
        return hit.select(*gs, F.col("_h").alias("_cut_h"), F.col("_k").alias("_cut_k")).collect()

    wanted = [r for r in sizes if r["quota"] > 0]
    found = ask(False, wanted) if wanted else []
    have = {tuple(r[g] for g in groups) for r in found}
    missing = [r for r in wanted if tuple(r[g] for g in groups) not in have]
    if missing:
        found += ask(True, missing)
    out = d.select(*groups).schema.add("_cut_h", T.LongType()).add("_cut_k", d.schema[key].dataType)
    return spark.createDataFrame([tuple(r) for r in found], out)


def stratified_split(df: DataFrame, test_frac: float, seed: int | None = None, key: str = "id",
                     target: str = "target", stratify: bool = True) -> DataFrame:
    """SP-2 / SP-3 / SP-4: add ``part`` ∈ {train, test}.

    Per (seed, class) the rows are ordered by md5(id|seed) (ties by id); the
    first ``quota`` rows are test. With a ``seed`` column the split runs for all
    seeds at once; otherwise ``seed`` is the literal seed. Rows with a missing
    class are a class of their own. No row is moved: the quota-th hash of every
    (seed, class) is found first, and a projection compares with it.
    """
    if not 0.0 < test_frac < 1.0:
        raise ValueError("test_frac must lie in (0, 1)")
    own_seed = "seed" not in df.columns
    d = df.withColumn("seed", F.lit(int(seed)).cast("bigint")) if own_seed else df
    groups = [*_seed_keys(d), *([target] if stratify else [])]
    quotas = class_quotas(d, test_frac, target, stratify).select(*groups, "n_c", "quota")
    rows = quotas.limit(MAX_CLASSES + 1).collect()  # seeds × classes
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {target!r}: split a continuous target without strata")
    d = d.withColumn("_h", hash52(F.col(key), F.col("seed")))
    cuts = hash_cuts(d, groups, rows, "_h", key)
    c = F.broadcast(cuts.select(*[F.col(g).alias(f"_c_{g}") for g in groups], "_cut_h", "_cut_k"))
    on = [_null_safe(g, f"_c_{g}") for g in groups]
    first = (F.col("_h") < F.col("_cut_h")) | ((F.col("_h") == F.col("_cut_h")) & (F.col(key) <= F.col("_cut_k")))
    out = (d.join(c, on if on else F.lit(True), "left")
           .withColumn("part", F.when(F.coalesce(first, F.lit(False)), F.lit("test")).otherwise(F.lit("train")))
           .drop("_h", "_cut_h", "_cut_k", *[f"_c_{g}" for g in groups]))
    return out.drop("seed") if own_seed else out


def random_split(df: DataFrame, test_frac: float, seed: int | None = None, key: str = "id") -> DataFrame:
    """SP-3: split without classes (regression)."""
    return stratified_split(df, test_frac, seed, key, stratify=False)


def _chunked_sequence(groups: DataFrame, keys, count_col: str, out: str, chunk: int = 1_000_000) -> DataFrame:
    """Rows k = 0..count-1 per group, generated in chunks so no task expands a huge count alone."""
    c = (groups.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                         F.greatest(F.ceil(F.col(count_col) / chunk) - 1, F.lit(0)).cast("bigint"))))
         .where(F.col(count_col) > 0))
    n_chunks = max(1, groups.sparkSession.sparkContext.defaultParallelism)
    c = c.repartition(n_chunks, *keys, "_chunk")
    lo = F.col("_chunk") * chunk
    hi = F.least(lo + chunk, F.col(count_col)) - 1
    return c.withColumn(out, F.explode(F.sequence(lo, hi))).drop("_chunk")


def stratified_bootstrap(df: DataFrame, seed: int, boot: int = 0, test_frac: float = 0.3,
                         key: str = "id", target: str = "target") -> DataFrame:
    """SP-5: draw floor((1-frac)·n) rows with replacement, class shares kept.

    Per class: m_c draws (largest remainder), draw k picks the row at position
    md5(seed|boot|class|k) mod n_c, positions ordered by md5(id|seed|boot).
    Returns the drawn rows, repeated as often as drawn, with columns
    ``seed``, ``boot`` added.
    """
    d = df.withColumn("seed", F.lit(int(seed)).cast("bigint")).withColumn("boot", F.lit(int(boot)).cast("bigint"))
    cls = d.groupBy("seed", "boot", target).agg(F.count(F.lit(1)).alias("n_c"))
    wk = Window.partitionBy("seed", "boot")
    cls = cls.withColumn("_m", F.floor(F.lit(1.0 - float(test_frac)) * F.sum("n_c").over(wk).cast("double")))
    cls = _largest_remainder(cls, ["seed", "boot"], target, "_m", "m_c").drop("_m")
    crow = cls.collect()  # classes of one (seed, boot): tiny
    cls = d.sparkSession.createDataFrame(crow, cls.schema)
    largest = max((r["n_c"] for r in crow), default=0)
    draws = _chunked_sequence(cls, ["seed", "boot", target], "m_c", "k")
    draws = draws.withColumn(
        "_pos", F.pmod(hash52(F.col("seed"), F.col("boot"), F.col(target), F.col("k")), F.col("n_c")))
    drawn = draws.groupBy(F.col(target).alias("_cls"), F.col("_pos").alias("_at")).agg(F.count(F.lit(1)).alias("_times"))
    # only (key, class) is numbered; the rows themselves meet their count once, on the key
    ids = d.select(key, target, hash52(F.col(key), F.col("seed"), F.col("boot")).alias("_h"))
    ids = hash_positions(ids, [target], "_h", key, out="_pos", max_group_rows=largest)
    times = ids.join(drawn, _null_safe(target, "_cls") & (F.col("_pos") == F.col("_at"))).select(F.col(key).alias("_key"), "_times")
    hit = d.join(times, F.col(key) == F.col("_key"))
    return (hit.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
            .drop("_key", "_times", "_rep"))


def out_of_bag(df: DataFrame, drawn: DataFrame, key: str = "id") -> DataFrame:
    """SP-6: rows never drawn (test part of a bootstrap)."""
    return df.join(drawn.select(key).distinct(), key, "left_anti")


def repeated_stratified_kfold(df: DataFrame, n_splits: int = 3, n_repeats: int = 10, seed: int = 0,
                              key: str = "id", target: str = "target", stratify: bool = True) -> DataFrame:
    """SP-7 / SP-8: one row per (repeat, row) with ``fold``; classes spread evenly over folds.

    Inside each (repeat, class) rows are ordered by md5(id|seed|repeat) and dealt
    to folds round-robin (position mod n_splits).
    """
    strata = [target] if stratify else []
    largest = df.groupBy(*strata).count().agg(F.max("count")).first()[0] if strata else df.count()
    # only (id, class) is numbered, once per repeat; the folds of a row come back to it as one array
    ids = df.select(key, *strata).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_repeats - 1).cast("bigint"))))
    ids = ids.withColumn("_h", hash52(F.col(key), F.lit(str(int(seed))), F.col("repeat")))
    ids = hash_positions(ids, ["repeat", *strata], "_h", key, out="_pos", max_group_rows=largest)
    folds = ids.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(
        "repeat", F.pmod(F.col("_pos"), F.lit(n_splits)).cast("bigint").alias("fold"))).alias("_folds"))  # n_repeats entries
    return df.join(folds, F.col(key) == F.col("_key")).select(*df.columns, F.inline("_folds"))


def kfold(df: DataFrame, n_splits: int = 5, seed: int = 0, key: str = "id") -> DataFrame:
    """SP-8: plain k folds (regression), one repeat."""
    return repeated_stratified_kfold(df, n_splits, 1, seed, key, stratify=False)
