"""Nearest-neighbour oversampling queries (OS-2, OS-3, OS-7) with brute-force oracle SQL on the
W1 train minority (small at the checked scale; the Spark side never forms all pairs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.portable import r6
from ..operators import models_select as ms
from ..operators import nearest
from ..operators import neighbours as nb
from ..operators.evaluate import roc_auc
from ..operators.frames import to_long
from ..operators.impute import impute
from ..operators.split import stratified_split
from ..sources.fixtures import W1_FEATURES, doc_features, vec_long, with_fixtures
from . import sqlgen
from .flagship import VAR_P, prepared_sql
from .q_models import model_data
from .registry import query

SEED = 42
S = "'42'"
THR = f"CAST('{VAR_P * (1 - VAR_P)!r}' AS DOUBLE)"


def _train(spark, sf_dir):
    _, feats, train, _ = model_data(spark, sf_dir)
    return train.select("id", "target", *feats).cache(), feats


def _long_out(syn, feats):
    return (to_long(syn, ["draw", "base_id", "neighbour_id"], feats)
            .select("draw", "base_id", "neighbour_id", "feature", r6("value").alias("value")))


BASE = prepared_sql() + [
    ("kept", f"SELECT feature FROM imp WHERE part = 'train' GROUP BY feature HAVING var_pop(value) > {THR}"),
    ("tr", "SELECT id, target, feature, value FROM imp WHERE part = 'train' AND feature IN (SELECT feature FROM kept)"),
    ("cnt", "SELECT target, count(DISTINCT id) AS n FROM tr GROUP BY target"),
    ("cls", "SELECT min({'n': n, 't': target}).t AS minority, min(n) AS n_min, max(n) AS n_maj FROM cnt"),
    ("mino", "SELECT * FROM tr WHERE target = (SELECT minority FROM cls)"),
]


def _dist(a: str, b: str) -> str:
    return (f"SELECT x.id AS qid, y.id AS rid, sqrt(sum((x.value - y.value) * (x.value - y.value))) AS dist FROM {a} x "
            f"JOIN {b} y ON x.feature = y.feature AND x.id <> y.id GROUP BY x.id, y.id")


def _synth_sql(base_rows: str, tag: str) -> list[tuple[str, str]]:
    """(k, id, rank) draws in ``base_rows`` → synthetic rows in long form."""
    return [
        ("nn", f"SELECT qid, rid, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM ({_dist('mino', 'mino')})"),
        ("picks", f"SELECT b.k, b.id AS base_id, n.rid AS neighbour_id FROM {base_rows} b JOIN nn n ON n.qid = b.id AND n.rank = b.rank"),
        ("syn", f"SELECT p.k AS draw, p.base_id, p.neighbour_id, x.feature, "
                f"round(x.value + (CAST({sqlgen.h52(S, repr(tag + '-u'), 'p.k')} AS DOUBLE) / 4503599627370496.0) "
                f"* (y.value - x.value), 6) + 0.0 AS value "
                f"FROM picks p JOIN mino x ON x.id = p.base_id JOIN mino y ON y.id = p.neighbour_id AND y.feature = x.feature"),
    ]


SMOTE_SQL = with_fixtures("SELECT * FROM syn", "w1", extra=BASE + [
    ("mpos", f"SELECT id, row_number() OVER (ORDER BY {sqlgen.h13('id', S, repr('smote'))}, id) - 1 AS pos "
             "FROM (SELECT DISTINCT id FROM mino)"),
    ("draws", f"SELECT k, {sqlgen.h52(S, repr('smote'), 'k')} % (SELECT n_min FROM cls) AS pos, "
              f"{sqlgen.h52(S, repr('nn'), 'k')} % least(5, (SELECT n_min FROM cls) - 1) + 1 AS rank "
              "FROM range(0, (SELECT n_maj - n_min FROM cls)) t(k)"),
    ("based", "SELECT d.k, m.id, d.rank FROM draws d JOIN mpos m ON m.pos = d.pos"),
] + _synth_sql("based", "smote"))


@query("os_smote", SMOTE_SQL)
def os_smote(spark, sf_dir):
    train, feats = _train(spark, sf_dir)
    return _long_out(nb.smote(train, feats, seed=SEED), feats)


BORDER_SQL = with_fixtures("SELECT * FROM syn", "w1", extra=BASE + [
    ("nall", f"SELECT qid, rid, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM ({_dist('mino', 'tr')})"),
    ("danger", "SELECT n.qid AS id FROM nall n JOIN (SELECT DISTINCT id, target FROM tr) l ON l.id = n.rid WHERE n.rank <= 10 "
               "GROUP BY n.qid HAVING sum(CASE WHEN l.target <> (SELECT minority FROM cls) THEN 1 ELSE 0 END) * 2 >= 10 "
               "AND sum(CASE WHEN l.target <> (SELECT minority FROM cls) THEN 1 ELSE 0 END) < 10"),
    ("dpos", f"SELECT id, row_number() OVER (ORDER BY {sqlgen.h13('id', S, repr('border'))}, id) - 1 AS pos FROM danger"),
    ("draws", f"SELECT k, {sqlgen.h52(S, repr('border'), 'k')} % (SELECT count(*) FROM danger) AS pos, "
              f"{sqlgen.h52(S, repr('nn'), 'k')} % least(5, (SELECT n_min FROM cls) - 1) + 1 AS rank "
              "FROM range(0, (SELECT n_maj - n_min FROM cls)) t(k)"),
    ("based", "SELECT d.k, m.id, d.rank FROM draws d JOIN dpos m ON m.pos = d.pos"),
] + _synth_sql("based", "border"))


@query("os_borderline_smote", BORDER_SQL)
def os_borderline_smote(spark, sf_dir):
    train, feats = _train(spark, sf_dir)
    return _long_out(nb.borderline_smote(train, feats, seed=SEED), feats)


ADASYN_SQL = with_fixtures("SELECT * FROM syn", "w1", extra=BASE + [
    ("nall", f"SELECT qid, rid, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM ({_dist('mino', 'tr')})"),
    ("ratio", "SELECT n.qid AS id, sum(CASE WHEN l.target <> (SELECT minority FROM cls) THEN 1.0 ELSE 0.0 END) / 5 AS r "
              "FROM nall n JOIN (SELECT DISTINCT id, target FROM tr) l ON l.id = n.rid WHERE n.rank <= 5 GROUP BY n.qid"),
    ("quota", "SELECT id, CAST(round_even(r / (SELECT sum(r) FROM ratio) * CAST((SELECT n_maj - n_min FROM cls) AS DOUBLE), 0) "
              "AS BIGINT) AS n_i FROM ratio"),
    ("based", f"SELECT {sqlgen.h52('id', 'j')} AS k, id, {sqlgen.h52(S, repr('nn'), 'id', 'j')} % least(5, (SELECT n_min FROM cls) - 1) "
              "+ 1 AS rank FROM (SELECT id, unnest(generate_series(0, n_i - 1)) AS j FROM quota WHERE n_i > 0)"),
] + _synth_sql("based", "adasyn"))


@query("os_adasyn", ADASYN_SQL)
def os_adasyn(spark, sf_dir):
    train, feats = _train(spark, sf_dir)
    return _long_out(nb.adasyn(train, feats, seed=SEED), feats)


def _modes(nn: str, values: str, cols: list[str]) -> str:
    """(qid, feature, value): the most frequent value of each categorical feature among a row's neighbours, the least on ties."""
    names = ", ".join(repr(c) for c in cols)
    return (f"SELECT qid, feature, value FROM (SELECT n.qid, v.feature, v.value, row_number() OVER (PARTITION BY n.qid, v.feature ORDER BY count(*) DESC, v.value) AS r "
            f"FROM {nn} n JOIN {values} v ON v.id = n.rid WHERE n.rank <= 5 AND v.feature IN ({names}) GROUP BY n.qid, v.feature, v.value) WHERE r = 1")


SMOTENC_CAT = ["lang_no"]
SMOTENC_SQL = with_fixtures(
    "SELECT * FROM syn WHERE feature <> 'lang_no' UNION ALL SELECT p.k, p.base_id, p.neighbour_id, m.feature, round(m.value, 6) + 0.0 "
    "FROM picks p JOIN modes m ON m.qid = p.base_id", "w1", extra=BASE + [
        ("medstd", "SELECT median(s) AS m FROM (SELECT coalesce(stddev_samp(value), 0) AS s FROM mino WHERE feature <> 'lang_no' GROUP BY feature)"),
        ("mpos", f"SELECT id, row_number() OVER (ORDER BY {sqlgen.h13('id', S, repr('smotenc'))}, id) - 1 AS pos FROM (SELECT DISTINCT id FROM mino)"),
        ("draws", f"SELECT k, {sqlgen.h52(S, repr('smotenc'), 'k')} % (SELECT n_min FROM cls) AS pos, "
                  f"{sqlgen.h52(S, repr('nn'), 'k')} % least(5, (SELECT n_min FROM cls) - 1) + 1 AS rank FROM range(0, (SELECT n_maj - n_min FROM cls)) t(k)"),
        ("based", "SELECT d.k, m.id, d.rank FROM draws d JOIN mpos m ON m.pos = d.pos"),
        ("nn", "SELECT qid, rid, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM (SELECT x.id AS qid, y.id AS rid, "
               "sqrt(sum(CASE WHEN x.feature <> 'lang_no' THEN (x.value - y.value) * (x.value - y.value) WHEN x.value <> y.value THEN (SELECT m * m FROM medstd) ELSE 0 END)) AS dist "
               "FROM mino x JOIN mino y ON x.feature = y.feature AND x.id <> y.id GROUP BY x.id, y.id)"),
        *_synth_sql("based", "smotenc")[1:],
        ("modes", _modes("nn", "mino", SMOTENC_CAT))])


@query("os_smotenc", SMOTENC_SQL)
def os_smotenc(spark, sf_dir):
    """OS-6: the third feature (lang_no) treated as categorical, as in the reference's setting."""
    train, feats = _train(spark, sf_dir)
    num = [f for f in feats if f not in SMOTENC_CAT]
    return _long_out(nb.smotenc(train, num, SMOTENC_CAT, seed=SEED), [*num, *SMOTENC_CAT])


SMOTEN_COLS = ["lang_no", "toxic"]
SMOTEN_SQL = with_fixtures(
    "SELECT d.k AS draw, p.id AS base_id, m.feature, m.value FROM draws d JOIN mpos p ON p.pos = d.pos JOIN modes m ON m.qid = p.id", "w1", extra=[
        ("sp", sqlgen.split("w1", 0.3, S, [], ["target"])),
        ("tr", "SELECT id, target, lang_no, toxic FROM sp WHERE part = 'train'"),
        ("long", sqlgen.unpivot("tr", ["id", "target"], SMOTEN_COLS)),
        ("cnt", "SELECT target, count(*) AS n FROM tr GROUP BY target"),
        ("cls", "SELECT min({'n': n, 't': target}).t AS minority, min(n) AS n_min, max(n) AS n_maj FROM cnt"),
        ("shares", "SELECT feature, value, y.target AS y, sum(CASE WHEN l.target = y.target THEN 1.0 ELSE 0.0 END) / count(*) AS share "
                   "FROM long l, (SELECT target FROM cnt) y GROUP BY feature, value, y.target"),
        ("mino", "SELECT * FROM long WHERE target = (SELECT minority FROM cls)"),
        ("emb", "SELECT m.id, m.feature, s.y, s.share FROM mino m JOIN shares s ON s.feature = m.feature AND s.value = m.value"),
        ("nn", "SELECT qid, rid, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rank FROM (SELECT x.id AS qid, y.id AS rid, "
               "round(sqrt(sum((x.share - y.share) * (x.share - y.share))), 9) AS dist FROM emb x JOIN emb y ON x.feature = y.feature AND x.y = y.y AND x.id <> y.id GROUP BY x.id, y.id)"),
        ("mpos", f"SELECT id, row_number() OVER (ORDER BY {sqlgen.h13('id', S, repr('smoten'))}, id) - 1 AS pos FROM (SELECT DISTINCT id FROM mino)"),
        ("draws", f"SELECT k, {sqlgen.h52(S, repr('smoten'), 'k')} % (SELECT n_min FROM cls) AS pos FROM range(0, (SELECT n_maj - n_min FROM cls)) t(k)"),
        ("modes", _modes("nn", "mino", SMOTEN_COLS))])


@query("os_smoten", SMOTEN_SQL)
def os_smoten(spark, sf_dir):
    """OS-5: all-categorical oversampling over the low-cardinality columns."""
    w1 = stratified_split(doc_features(spark, sf_dir), 0.3, SEED).where(F.col("part") == "train")
    out = nb.smoten(w1.select("id", "target", *SMOTEN_COLS), SMOTEN_COLS, seed=SEED)
    return to_long(out, ["draw", "base_id"], SMOTEN_COLS).select("draw", "base_id", "feature", F.col("value").cast("double").alias("value"))


@query("os_svm_smote")
def os_svm_smote(spark, sf_dir):
    train, feats = _train(spark, sf_dir)
    return _long_out(nb.svm_smote(train, feats, seed=SEED), feats)


@query("os_kmeans_smote")
def os_kmeans_smote(spark, sf_dir):
    train, feats = _train(spark, sf_dir)
    return _long_out(nb.kmeans_smote(train, feats, n_clusters=4, seed=SEED), feats)


# ---------------------------------------------------------------- kNN over 64 dimensions, kNN imputation, univariate grid
K_VECTORS = 5


@query("knn_vectors", with_fixtures(
    f"SELECT qid, rid, CAST(rank AS BIGINT) AS rank FROM (SELECT qid, rid, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rank FROM ("
    "SELECT a.id AS qid, b.id AS rid, round(sqrt(sum((CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE)) * (CAST(a.x AS DOUBLE) - CAST(b.x AS DOUBLE)))), 9) AS d "
    f"FROM w4 a JOIN w4 b ON a.j = b.j AND a.id <> b.id GROUP BY a.id, b.id)) WHERE rank <= {K_VECTORS}", "w4"))
def knn_vectors(spark, sf_dir):
    """The nearest rows of every 64-dimensional vector."""
    long = vec_long(spark, sf_dir)
    n = long.agg(F.max("j")).first()[0] + 1
    feats = [f"x{j}" for j in range(n)]
    wide = long.groupBy("id").pivot("j", list(range(n))).agg(F.first(F.col("x").cast("double"))).toDF("id", *feats)
    return nearest.knn(wide, wide, feats, K_VECTORS).select("qid", "rid", "rank")


N_W1 = len(W1_FEATURES)
IMP_KNN_SQL = with_fixtures(
    "SELECT l.id, l.part, l.feature, round(coalesce(l.value, f.fill, m.mean, 0), 6) + 0.0 AS value FROM l LEFT JOIN fill f USING (id, feature) "
    "LEFT JOIN (SELECT feature, avg(value) AS mean FROM l WHERE part = 'train' GROUP BY feature) m USING (feature)", "w1", extra=[
        ("sp", sqlgen.split("w1", 0.3, "'42'", [], ["target"])),
        ("l", sqlgen.unpivot("sp", ["id", "part"], W1_FEATURES)),
        ("holes", "SELECT DISTINCT id FROM l WHERE value IS NULL"),
        ("dist", f"SELECT a.id, b.id AS donor, round(sqrt(sum((a.value - b.value) * (a.value - b.value)) * ({N_W1}.0 / count(*))), 9) AS d "
                 "FROM l a JOIN holes h ON h.id = a.id JOIN l b ON a.feature = b.feature AND b.part = 'train' "
                 "WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.id, b.id"),
        ("ranked", "SELECT x.id, x.feature, y.value, row_number() OVER (PARTITION BY x.id, x.feature ORDER BY d.d, d.donor) AS r "
                   "FROM l x JOIN dist d ON d.id = x.id JOIN l y ON y.id = d.donor AND y.feature = x.feature "
                   "WHERE x.value IS NULL AND y.value IS NOT NULL"),
        ("fill", "SELECT id, feature, avg(value) AS fill FROM ranked WHERE r <= 5 GROUP BY id, feature")])


@query("imp_knn", IMP_KNN_SQL)
def imp_knn(spark, sf_dir):
    """IMP-4 on the documents' study table, in long form."""
    split = stratified_split(doc_features(spark, sf_dir), 0.3, 42)
    out = impute(split, "knn_impute", W1_FEATURES)
    return to_long(out, ["id", "part"], W1_FEATURES).select("id", "part", "feature", r6("value").alias("value"))


def _univariate_sql(repeats: int = 10, splits: int = 3) -> list[tuple[str, str]]:
    """FS-9 in SQL: folds, class means of the other folds, held-out AUC by ranks, and the penalty rule."""
    grid = ", ".join(f"('{p}', {c!r}, {r!r})" for p, r in (("l1", 1.0), ("l2", 0.0), ("elasticnet", ms.L1_RATIO)) for c in ms.STRENGTHS)
    return [
        ("ids", "SELECT DISTINCT id, target FROM tr"),
        ("folds", f"SELECT id, repeat, (row_number() OVER (PARTITION BY repeat, target ORDER BY {sqlgen.h13('id', S, 'repeat')}, id) - 1) % {splits} AS fold "
                  f"FROM (SELECT ids.*, CAST(r AS BIGINT) AS repeat FROM ids, range(0, {repeats}) t(r))"),
        ("rws", "SELECT t.feature, t.id, t.target, t.value, f.repeat, f.fold FROM tr t JOIN folds f USING (id) WHERE t.value IS NOT NULL"),
        ("g", "SELECT o.feature, o.repeat, o.fold, count(*) / 4.0 * (avg(CASE WHEN r.target = 1 THEN r.value END) - avg(CASE WHEN r.target = 0 THEN r.value END)) AS g "
              "FROM (SELECT DISTINCT feature, repeat, fold FROM rws) o JOIN rws r ON r.feature = o.feature AND r.repeat = o.repeat AND r.fold <> o.fold "
              "GROUP BY o.feature, o.repeat, o.fold"),
        ("rk", "SELECT feature, repeat, fold, target, rank() OVER w + (count(*) OVER (PARTITION BY feature, repeat, fold, value) - 1) / 2.0 AS r FROM rws "
               "WINDOW w AS (PARTITION BY feature, repeat, fold ORDER BY value)"),
        ("aucs", "SELECT feature, repeat, fold, (sum(CASE WHEN target = 1 THEN r END) - p * (p + 1) / 2.0) / nullif(p * n, 0) AS auc FROM ("
                 "SELECT *, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) OVER w AS p, sum(CASE WHEN target = 0 THEN 1 ELSE 0 END) OVER w AS n FROM rk "
                 "WINDOW w AS (PARTITION BY feature, repeat, fold)) GROUP BY feature, repeat, fold, p, n"),
        ("grid", f"SELECT * FROM (VALUES {grid}) t(penalty, c, r)"),
        ("cell", "SELECT feature, penalty, c, avg(CASE WHEN auc IS NULL THEN NULL WHEN abs(g) * c <= r THEN 0.5 WHEN g > 0 THEN auc WHEN g < 0 THEN 1 - auc ELSE 0.5 END) AS m "
                 "FROM aucs JOIN g USING (feature, repeat, fold), grid GROUP BY feature, penalty, c"),
    ]


@query("fs_univariate_ranking", with_fixtures("SELECT feature, round(max(m), 6) AS score FROM cell GROUP BY feature", "w1", extra=BASE + _univariate_sql()))
def fs_univariate_ranking(spark, sf_dir):
    train, feats = _train(spark, sf_dir)
    return ms.univariate_ranking(train, feats, seed=SEED).select("feature", r6("score").alias("score"))


def _bijection_sql(n: str, repeats: int) -> list[tuple[str, str]]:
    """The keyed bijection in SQL: (k, feature, rep, pos, cur): the position that a row's value of a feature goes to."""
    keys = ", ".join(f"({j * repeats + r}, '{f}', {r}, {', '.join(map(str, ms.bijection_keys(SEED, f, r)))})" for j, f in enumerate(W1_FEATURES) for r in range(repeats))
    name = [f"k{i}" for i in range(ms.ROUNDS)]
    step = ("(SELECT s.pos, s.r AS l, CAST(xor(s.l, (((xor((s.r + s.{k}) * 362437, ((s.r + s.{k}) * 362437) >> 11)) * 69069) >> 7) & (SELECT mask FROM size)) AS BIGINT) AS r, "
            "s.* EXCLUDE (pos, l, r) FROM {src} s)")

    def network(src: str) -> str:
        for k in name:
            src = step.format(k=k, src=src)
        return src

    whole = "(SELECT pos, CAST({v} >> (SELECT h FROM size) AS BIGINT) AS l, CAST({v} & (SELECT mask FROM size) AS BIGINT) AS r, {rest} FROM {src})"
    rest = "k, feature, rep, " + ", ".join(name)
    out = f"CAST((l << (SELECT h FROM size)) | r AS BIGINT) AS cur, {rest}"
    return [
        ("keys", f"SELECT * FROM (VALUES {keys}) t(k, feature, rep, {', '.join(name)}) WHERE feature IN (SELECT feature FROM kept)"),
        ("size", f"SELECT n, h, (CAST(1 AS BIGINT) << h) - 1 AS mask FROM (SELECT n, greatest(1, CAST((length(bin(greatest(n - 1, 1))) + 1) // 2 AS INTEGER)) AS h FROM (SELECT {n} AS n))"),
        ("walk", f"SELECT pos, {out} FROM {network(whole.format(v='pos', rest=rest, src='rws, keys'))} "
                 f"UNION ALL SELECT pos, {out} FROM {network(whole.format(v='cur', rest=rest, src='(SELECT * FROM walk WHERE cur >= (SELECT n FROM size))'))}"),
        ("sent", "SELECT k, feature, rep, pos, cur FROM walk WHERE cur < (SELECT n FROM size)"),
    ]


PERMUTED_REPEATS = 2
PERMUTED_SQL = with_fixtures(
    "SELECT feature, CAST(rep AS BIGINT) AS rep, round((sum(CASE WHEN target = 1 THEN r END) - p * (p + 1) / 2.0) / nullif(p * q, 0), 6) AS auc FROM ("
    "SELECT *, sum(CASE WHEN target = 1 THEN 1 ELSE 0 END) OVER w AS p, sum(CASE WHEN target = 0 THEN 1 ELSE 0 END) OVER w AS q FROM ranks WINDOW w AS (PARTITION BY feature, rep)) "
    "GROUP BY feature, rep, p, q", "w1", extra=BASE + [
        ("rws", f"SELECT id, target, CAST(row_number() OVER (ORDER BY {sqlgen.h13('id', S)}, id) - 1 AS BIGINT) AS pos FROM (SELECT DISTINCT id, target FROM tr)"),
        *_bijection_sql("(SELECT count(*) FROM rws)", PERMUTED_REPEATS),
        ("moved", "SELECT s.feature, s.rep, o.target, t.value FROM sent s JOIN rws x ON x.pos = s.pos JOIN tr t ON t.id = x.id AND t.feature = s.feature JOIN rws o ON o.pos = s.cur"),
        ("ranks", "SELECT feature, rep, target, rank() OVER (PARTITION BY feature, rep ORDER BY value) + (count(*) OVER (PARTITION BY feature, rep, value) - 1) / 2.0 AS r FROM moved")],
    recursive=True)


@query("fs_permuted_auc", PERMUTED_SQL)
def fs_permuted_auc(spark, sf_dir):
    """FS-3's permutation itself: the AUC of every permuted feature, by repeat."""
    train, feats = _train(spark, sf_dir)
    base = ms.with_positions(train, ["id", "target", *feats], SEED)
    both = base.join(ms.permuted_values(base, feats, PERMUTED_REPEATS, SEED), "pos")
    names = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).cast("bigint").alias("rep")) for f in feats for r in range(PERMUTED_REPEATS)])
    each = both.select("id", F.col("target").cast("int").alias("y_true"), F.inline(F.arrays_zip(names.alias("run"), F.col("values").alias("score"))))
    auc = roc_auc(each.select("run.feature", "run.rep", "id", "y_true", "score"), ["feature", "rep"])
    return auc.select("feature", "rep", r6("roc_auc").alias("auc"))
