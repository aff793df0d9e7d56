"""Oversampling on exact nearest neighbours (OS-2…8); the search itself is ``nearest.knn``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.portable import hash52, hash_unit
from .nearest import knn
from .positions import checkpointed, hash_positions, small_side


# ---------------------------------------------------------------- SMOTE family
def _minority(train: DataFrame, target: str):
    counts = {r[target]: r["count"] for r in train.groupBy(target).count().collect()}  # classes: tiny
    minority = min(counts, key=lambda c: (counts[c], c))
    majority = max(counts, key=lambda c: (counts[c], -c))
    return minority, counts[minority], counts[majority]


def _synthesize(base: DataFrame, minority_rows: DataFrame, nn: DataFrame, features, target, cls, seed, key, tag):
    """New rows x + u·(neighbour − x) for each (draw k, base row, neighbour rank) in ``base``."""
    pick = base.join(nn.select(F.col("qid").alias(key), "rid", "rank"), [key, "rank"])
    x = minority_rows.select(key, *features)
    nb = minority_rows.select(F.col(key).alias("rid"), *[F.col(f).alias(f"n_{f}") for f in features])
    j = pick.join(x, key).join(nb, "rid")
    u = hash_unit(F.lit(str(seed)), F.lit(tag + "-u"), F.col("k"))
    return j.select(F.col("k").alias("draw"), F.col(key).alias("base_id"), F.col("rid").alias("neighbour_id"),
                    *[(F.col(f) + u * (F.col(f"n_{f}") - F.col(f))).alias(f) for f in features],
                    F.lit(float(cls)).alias(target))


def smote(train: DataFrame, features, target: str = "target", k: int = 5, seed: int = 0, key: str = "id") -> DataFrame:
    """OS-2: synthetic minority rows until the classes are equal. Draw k picks the base row at hash
    position md5(seed|smote|k) mod n_min and its neighbour of rank md5(seed|nn|k) mod k + 1."""
    cls, n_min, n_maj = _minority(train, target)
    mino = train.where(F.col(target) == cls).select(key, *features).cache()
    need = n_maj - n_min
    spark = train.sparkSession
    if need <= 0:
        return spark.createDataFrame([], _schema(features, target, key))
    if n_min <= k:
        raise ValueError(f"{k} neighbours need at least {k + 1} minority rows; there are {n_min}")
    nn = knn(mino, mino, features, k, key, seed=seed)
    d = mino.withColumn("_h", hash52(F.col(key), F.lit(str(seed)), F.lit("smote")))
    d = hash_positions(d, [], "_h", key, out="_pos", max_group_rows=n_min).select(key, "_pos")
    draws = (spark.range(need).withColumnRenamed("id", "k")
             .withColumn("_pos", F.pmod(hash52(F.lit(str(seed)), F.lit("smote"), F.col("k")), F.lit(n_min)))
             .withColumn("rank", F.pmod(hash52(F.lit(str(seed)), F.lit("nn"), F.col("k")), F.lit(min(k, n_min - 1))) + 1))
    base = draws.join(d, "_pos").select("k", key, "rank")
    return _synthesize(base, mino, nn, features, target, cls, seed, key, "smote")


def _schema(features, target, key):
    return f"draw bigint, base_id bigint, neighbour_id bigint, {', '.join(f'{f} double' for f in features)}, {target} double"


def borderline_smote(train: DataFrame, features, target: str = "target", k: int = 5, m: int = 10, seed: int = 0,
                     key: str = "id") -> DataFrame:
    """OS-3 (kind 1): only minority rows in danger (at least half but not all of their m nearest rows
    of any class are majority) are bases; neighbours are the k nearest minority rows."""
    cls, n_min, n_maj = _minority(train, target)
    mino = train.where(F.col(target) == cls).select(key, *features).cache()
    allr = train.select(key, target, *features)
    spark = train.sparkSession
    need = n_maj - n_min
    nn_all = knn(mino, allr, features, m, key, seed=seed)
    lab = allr.select(F.col(key).alias("rid"), F.col(target).alias("_y"))
    maj = (nn_all.join(lab, "rid").groupBy("qid")
           .agg(F.sum((F.col("_y") != F.lit(float(cls))).cast("int")).alias("n_maj")))
    danger = maj.where((F.col("n_maj") * 2 >= m) & (F.col("n_maj") < m)).select(F.col("qid").alias(key)).cache()
    n_d = danger.count()
    if need <= 0 or n_d == 0:
        return spark.createDataFrame([], _schema(features, target, key))
    nn = knn(mino, mino, features, k, key, seed=seed)
    d = danger.withColumn("_h", hash52(F.col(key), F.lit(str(seed)), F.lit("border")))
    d = hash_positions(d, [], "_h", key, out="_pos", max_group_rows=n_d).select(key, "_pos")
    draws = (spark.range(need).withColumnRenamed("id", "k")
             .withColumn("_pos", F.pmod(hash52(F.lit(str(seed)), F.lit("border"), F.col("k")), F.lit(n_d)))
             .withColumn("rank", F.pmod(hash52(F.lit(str(seed)), F.lit("nn"), F.col("k")), F.lit(min(k, n_min - 1))) + 1))
    base = draws.join(d, "_pos").select("k", key, "rank")
    return _synthesize(base, mino, nn, features, target, cls, seed, key, "border")


def adasyn(train: DataFrame, features, target: str = "target", k: int = 5, seed: int = 0, key: str = "id") -> DataFrame:
    """OS-7: minority row i gets round(r_i / Σr · G) synthetic rows, r_i = share of majority rows among
    its k nearest rows of any class, G = n_majority − n_minority; neighbours are minority rows."""
    cls, n_min, n_maj = _minority(train, target)
    mino = train.where(F.col(target) == cls).select(key, *features).cache()
    allr = train.select(key, target, *features)
    spark = train.sparkSession
    g = n_maj - n_min
    nn_all = knn(mino, allr, features, k, key, seed=seed)
    lab = allr.select(F.col(key).alias("rid"), F.col(target).alias("_y"))
    ratio = (nn_all.join(lab, "rid").groupBy("qid")
             .agg((F.sum((F.col("_y") != F.lit(float(cls))).cast("double")) / k).alias("r")))
    tot = ratio.agg(F.sum("r")).first()[0] or 0.0
    if g <= 0 or tot == 0:
        return spark.createDataFrame([], _schema(features, target, key))
    # half-to-even rounding of each row's share of G
    quota = ratio.select(F.col("qid").alias(key), F.bround(F.col("r") / F.lit(tot) * F.lit(float(g)), 0).cast("bigint").alias("n_i"))
    per = quota.where("n_i > 0").withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_i") - 1)))
    per = per.withColumn("k", hash52(F.col(key), F.col("j")))  # draw id from (base row, draw number)
    per = per.withColumn("rank", F.pmod(hash52(F.lit(str(seed)), F.lit("nn"), F.col(key), F.col("j")),
                                        F.lit(min(k, n_min - 1))) + 1)
    nn = knn(mino, mino, features, k, key, seed=seed)
    return _synthesize(per.select("k", key, "rank"), mino, nn, features, target, cls, seed, key, "adasyn")


def _mode_of_neighbours(nn: DataFrame, rows: DataFrame, col: str, key: str) -> DataFrame:
    """(qid, col): most frequent value of ``col`` among each query's neighbours (smallest value on ties)."""
    v = nn.join(rows.select(F.col(key).alias("rid"), F.col(col).alias("_v")), "rid")
    c = v.groupBy("qid", "_v").agg(F.count(F.lit(1)).alias("_c"))
    return c.groupBy("qid").agg(F.max(F.struct(F.col("_c"), (-F.col("_v")).alias("_nv"))).alias("_b")).select(
        "qid", (-F.col("_b._nv")).alias(col))


def smotenc(train: DataFrame, numeric, categorical, target: str = "target", k: int = 5, seed: int = 0,
            key: str = "id") -> DataFrame:
    """OS-6: SMOTE on mixed features. Distance: Euclidean on the numeric features plus, per
    categorical mismatch, the median of the minority's numeric standard deviations squared, whatever the
    number of levels. Numeric values are interpolated; a categorical value is the most frequent one
    among the base row's k nearest minority neighbours."""
    cls, n_min, n_maj = _minority(train, target)
    mino = checkpointed(train.where(F.col(target) == cls).select(key, *numeric, *categorical))
    stds = mino.agg(*[F.stddev_samp(f).alias(f) for f in numeric]).first()
    med = float(np.median([stds[f] or 0.0 for f in numeric])) if numeric else 1.0
    nn = checkpointed(knn(mino, mino, list(numeric) + list(categorical), k, key, seed=seed, mismatch={c: med for c in categorical}))
    need = n_maj - n_min
    spark = train.sparkSession
    if need <= 0:
        return spark.createDataFrame([], _schema(list(numeric) + list(categorical), target, key))
    d = mino.withColumn("_h", hash52(F.col(key), F.lit(str(seed)), F.lit("smotenc")))
    d = hash_positions(d, [], "_h", key, out="_pos", max_group_rows=n_min).select(key, "_pos")
    draws = (spark.range(need).withColumnRenamed("id", "k")
             .withColumn("_pos", F.pmod(hash52(F.lit(str(seed)), F.lit("smotenc"), F.col("k")), F.lit(n_min)))
             .withColumn("rank", F.pmod(hash52(F.lit(str(seed)), F.lit("nn"), F.col("k")), F.lit(min(k, n_min - 1))) + 1))
    base = draws.join(d, "_pos").select("k", key, "rank")
    syn = _synthesize(base, mino, nn, list(numeric), target, cls, seed, key, "smotenc")
    for c in categorical:
        syn = syn.join(_mode_of_neighbours(nn, mino, c, key).withColumnRenamed("qid", "base_id"), "base_id")
    return syn


def smoten(train: DataFrame, categorical, target: str = "target", k: int = 5, seed: int = 0,
           key: str = "id") -> DataFrame:
    """OS-5: SMOTE for categorical features. The value difference metric with r = 2 is the
    Euclidean distance between per-value class-share vectors, so each value is embedded as its
    class shares and the exact kNN applies; each new value is the most frequent value among the
    base row's k nearest minority neighbours."""
    cls, n_min, n_maj = _minority(train, target)
    classes = sorted(r[target] for r in train.select(target).distinct().collect())
    emb = train.select(key, target, *categorical)
    names = []
    for c in categorical:
        share = train.groupBy(c).agg(*[(F.sum((F.col(target) == F.lit(y)).cast("double")) / F.count(F.lit(1))).alias(
            f"_s_{c}_{i}") for i, y in enumerate(classes)])
        emb = emb.join(small_side(share), c, "left")  # one row per category level
        names += [f"_s_{c}_{i}" for i in range(len(classes))]
    mino_emb = checkpointed(emb.where(F.col(target) == cls))
    nn = checkpointed(knn(mino_emb, mino_emb, names, k, key, seed=seed))
    need = n_maj - n_min
    spark = train.sparkSession
    mino = train.where(F.col(target) == cls).select(key, *categorical)
    if need <= 0:
        return spark.createDataFrame([], f"draw bigint, base_id bigint, {', '.join(f'{c} double' for c in categorical)}")
    d = mino.withColumn("_h", hash52(F.col(key), F.lit(str(seed)), F.lit("smoten")))
    d = hash_positions(d, [], "_h", key, out="_pos", max_group_rows=n_min).select(key, "_pos")
    draws = (spark.range(need).withColumnRenamed("id", "k")
             .withColumn("_pos", F.pmod(hash52(F.lit(str(seed)), F.lit("smoten"), F.col("k")), F.lit(n_min))))
    out = draws.join(d, "_pos").select(F.col("k").alias("draw"), F.col(key).alias("base_id"))
    for c in categorical:
        out = out.join(_mode_of_neighbours(nn, mino, c, key).withColumnRenamed("qid", "base_id"), "base_id")
    return out.withColumn(target, F.lit(float(cls)))


def _generate(base: DataFrame, rows: DataFrame, nn: DataFrame, features, target, cls, seed, key, tag, step):
    """x + step·u·(neighbour − x) for each (k, key, rank) in ``base`` (step < 0 extrapolates away)."""
    pick = base.join(nn.select(F.col("qid").alias(key), "rid", "rank"), [key, "rank"])
    x = rows.select(key, *features)
    nbr = rows.select(F.col(key).alias("rid"), *[F.col(f).alias(f"n_{f}") for f in features])
    j = pick.join(x, key).join(nbr, "rid")
    u = F.lit(float(step)) * hash_unit(F.lit(str(seed)), F.lit(tag + "-u"), F.col("k"))
    return j.select(F.col("k").alias("draw"), F.col(key).alias("base_id"), F.col("rid").alias("neighbour_id"),
                    *[(F.col(f) + u * (F.col(f"n_{f}") - F.col(f))).alias(f) for f in features],
                    F.lit(float(cls)).alias(target))


def _draws_over(spark, rows: DataFrame, n_rows: int, count: int, seed: int, tag: str, k_nn: int, key: str, offset: int = 0):
    """``count`` draws (k = offset…) of a base row (hash position mod n_rows) and a neighbour rank."""
    d = rows.select(key).withColumn("_h", hash52(F.col(key), F.lit(str(seed)), F.lit(tag)))
    d = hash_positions(d, [], "_h", key, out="_pos", max_group_rows=n_rows).select(key, "_pos")
    draws = (spark.range(offset, offset + count).withColumnRenamed("id", "k")
             .withColumn("_pos", F.pmod(hash52(F.lit(str(seed)), F.lit(tag), F.col("k")), F.lit(n_rows)))
             .withColumn("rank", F.pmod(hash52(F.lit(str(seed)), F.lit("nn"), F.col("k")), F.lit(k_nn)) + 1))
    return draws.join(d, "_pos").select("k", key, "rank")


def svm_smote(train: DataFrame, features, target: str = "target", k: int = 5, m: int = 10, out_step: float = 0.5,
              seed: int = 0, key: str = "id") -> DataFrame:
    """OS-4: bases are the minority support vectors of a linear SVM (minority rows on or inside the
    margin, y·f(x) ≤ 1). Among a base's m nearest rows of any class: all majority → noise (dropped);
    at least half majority → danger, new rows interpolate towards minority neighbours; otherwise safe,
    new rows extrapolate away from them (step −out_step). The danger share of the new rows is a
    Beta(10, 10) draw fixed by the seed."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import vector_to_array
    from .models import assemble
    cls, n_min, n_maj = _minority(train, target)
    spark = train.sparkSession
    need = n_maj - n_min
    empty = spark.createDataFrame([], _schema(features, target, key))
    if need <= 0:
        return empty
    lab = train.select(key, target, *features).withColumn("_y", (F.col(target) == F.lit(float(cls))).cast("double"))
    svm = LinearSVC(featuresCol="_x", labelCol="_y", maxIter=100).fit(assemble(lab, features, "_x"))
    margin = vector_to_array(F.col("rawPrediction"))[1]
    sv = (svm.transform(assemble(lab, features, "_x")).where((F.col("_y") == 1) & (margin <= 1.0))
          .select(key, *features).cache())
    if sv.count() == 0:
        return empty
    allr = train.select(key, target, *features)
    nn_all = knn(sv, allr, features, m, key, seed=seed)
    maj = (nn_all.join(allr.select(F.col(key).alias("rid"), F.col(target).alias("_t")), "rid").groupBy("qid")
           .agg(F.sum((F.col("_t") != F.lit(float(cls))).cast("int")).alias("n_maj")))
    kind = maj.select(F.col("qid").alias(key), F.when(F.col("n_maj") >= m, "noise")
                      .when(F.col("n_maj") * 2 >= m, "danger").otherwise("safe").alias("kind")).cache()
    mino = train.where(F.col(target) == cls).select(key, *features).cache()
    nn = knn(mino, mino, features, k, key, seed=seed)
    frac = float(np.random.default_rng(seed).beta(10, 10))
    danger = kind.where("kind = 'danger'").select(key)
    safe = kind.where("kind = 'safe'").select(key)
    n_d, n_s = danger.count(), safe.count()
    n_danger = int(frac * (need + 1)) if n_s else need
    n_danger = need if n_s == 0 else (0 if n_d == 0 else n_danger)
    out = empty
    k_nn = min(k, n_min - 1)
    if n_danger > 0 and n_d > 0:
        out = out.unionByName(_generate(_draws_over(spark, danger, n_d, n_danger, seed, "svm-d", k_nn, key),
                                        mino, nn, features, target, cls, seed, key, "svm", 1.0))
    if need - n_danger > 0 and n_s > 0:
        out = out.unionByName(_generate(_draws_over(spark, safe, n_s, need - n_danger, seed, "svm-s", k_nn, key, n_danger),
                                        mino, nn, features, target, cls, seed, key, "svm", -out_step))
    return out


def kmeans_smote(train: DataFrame, features, target: str = "target", k: int = 5, n_clusters: int = 8, seed: int = 0,
                 key: str = "id") -> DataFrame:
    """OS-8: k-means over all rows; clusters whose minority share is at least the overall minority share
    and that hold more than k minority rows are oversampled. A cluster's weight is its sparsity
    (RMS distance between its minority rows, from moments, to the power of the feature count, over its
    minority count), normalised; SMOTE then runs inside each cluster. Within-cluster neighbours are
    exact: the clusters are searched one by one."""
    from pyspark.ml.clustering import KMeans
    from .models import assemble
    cls, n_min, n_maj = _minority(train, target)
    spark = train.sparkSession
    need = n_maj - n_min
    empty = spark.createDataFrame([], _schema(features, target, key))
    if need <= 0:
        return empty
    x = assemble(train.select(key, target, *features), features, "_x")
    km = KMeans(k=n_clusters, seed=seed, featuresCol="_x", predictionCol="cluster").fit(x)
    lab = km.transform(x).select(key, target, "cluster", *features).cache()
    share = n_min / float(n_min + n_maj)
    is_min = (F.col(target) == F.lit(float(cls))).cast("double")
    cs = lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(is_min).alias("n_min"),
                                    *[F.var_pop(F.when(is_min == 1, F.col(f))).alias(f"v_{f}") for f in features])
    p = len(features)
    rows = [r for r in cs.collect() if r["n_min"] > k and r["n_min"] / r["n"] >= share]  # ≤ n_clusters rows
    if not rows:
        return empty
    weights = {}
    for r in rows:
        nm = r["n_min"]
        rms = (2.0 * nm / (nm - 1) * sum((r[f"v_{f}"] or 0.0) for f in features)) ** 0.5  # RMS pairwise distance
        weights[r["cluster"]] = (rms ** p) / nm if rms > 0 else 0.0
    tot = sum(weights.values())
    if tot <= 0:
        return empty
    keep = list(weights)
    mino = lab.where((F.col(target) == F.lit(float(cls))) & F.col("cluster").isin(keep)).cache()
    nn = None
    for c in sorted(keep):  # at most n_clusters
        rows_c = mino.where(F.col("cluster") == c)
        one = knn(rows_c, rows_c, features, k, key, seed=seed)
        nn = one if nn is None else nn.unionByName(one)
    out = empty
    offset = 0
    for c in sorted(keep):
        cnt = int(round(weights[c] / tot * need))
        if cnt <= 0:
            continue
        rows_c = mino.where(F.col("cluster") == c)
        n_c = int([r["n_min"] for r in rows if r["cluster"] == c][0])
        base = _draws_over(spark, rows_c, n_c, cnt, seed, f"kms-{c}", min(k, n_c - 1), key, offset)
        out = out.unionByName(_generate(base, mino, nn, features, target, cls, seed, key, "kms", 1.0))
        offset += cnt
    return out


OVERSAMPLERS = {
    "binary_classification": ("smoten", "smotenc", "svmsmote", "borderlinesmote", "randomoversampler"),
    "regression": ("adasyn", "smote", "kmeanssmote", "randomoversampler"),
}


def oversample(train: DataFrame, method: str, features, task: str = "binary_classification", target: str = "target",
               seed: int = 0, key: str = "id", categorical=(), bins: int = 4) -> DataFrame:
    """The oversampler of a task by name; unknown pairs are refused. Synthetic rows (or the drawn copies).

    A regression target is balanced over its quantile bins (``bins`` classes, column ``_bin``): the method sees the bin as
    the class, and the target as one more coordinate of the rows, so that synthetic rows carry a target between those
    of their neighbours.
    """
    name = method.lower()
    if name not in OVERSAMPLERS.get(task, ()):
        raise ValueError(f"unknown oversampler {method!r} for {task}; known: {OVERSAMPLERS.get(task, ())}")
    features, label = list(features), target
    if task == "regression":
        from .positions import exact_quantiles
        cuts = sorted({r["q"] for r in exact_quantiles(train, [], target, [i / bins for i in range(1, bins)]).collect()})
        label = "_bin"
        train = train.withColumn(label, sum(((F.col(target) > c).cast("double") for c in cuts), F.lit(0.0)))
        features = [*features, target]
    if name == "randomoversampler":
        from .resample import random_oversample
        return random_oversample(train, seed, label, key)
    if name == "smoten":
        return smoten(train, features, label, seed=seed, key=key)
    if name == "smotenc":
        return smotenc(train, [f for f in features if f not in categorical], list(categorical), label, seed=seed, key=key)
    fn = {"svmsmote": svm_smote, "borderlinesmote": borderline_smote, "adasyn": adasyn, "smote": smote, "kmeanssmote": kmeans_smote}[name]
    return fn(train, features, label, seed=seed, key=key)
