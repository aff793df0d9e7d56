"""Pairwise moments and correlations of feature columns.

All pairs of columns are summarised in ONE scan: each partition turns its
rows into numpy blocks and emits the pairwise-complete sums of every column
pair (n, Σa, Σb, Σa², Σb², Σab, of values less their column's centre) — p² small
rows per partition — which a group-by adds up. Work is O(rows · p²) in vectorised numpy, the shuffle is
O(partitions · p²), independent of the row count, and no row pairs or column
self-joins are formed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.portable import corr_from_moments
from .frames import to_long
from .positions import checkpointed, value_positions

MOMENT_SCHEMA = "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double"


def column_centers(df: DataFrame, cols) -> dict[str, float]:
    """A value near each column's mean, from one aggregate; a constant column's own value. Sums taken about it do not cancel."""
    cols = list(cols)
    x = [F.col(c).cast("double") for c in cols]
    row = df.agg(*[e for i, c in enumerate(x) for e in (F.avg(c).alias(f"m{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}"))]).first()
    return {c: float(row[f"l{i}"] if row[f"l{i}"] == row[f"h{i}"] else row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0
            for i, c in enumerate(cols)}


def _pair_sums(cols, centers, with_diag: bool):
    p = len(cols)
    shift = np.array([centers[c] for c in cols])

    def fn(batches):
        n = np.zeros((p, p))
        s = np.zeros((p, p))
        ss = np.zeros((p, p))
        sab = np.zeros((p, p))
        seen = False
        for pdf in batches:
            if len(pdf) == 0:
                continue
            seen = True
            x = pdf[cols].to_numpy(dtype="float64", na_value=np.nan) - shift
            m = (~np.isnan(x)).astype("float64")
            x0 = np.where(m > 0, x, 0.0)
            n += m.T @ m
            s += x0.T @ m          # s[a, b] = Σ x_a over rows where b present too
            ss += (x0 * x0).T @ m
            sab += x0.T @ x0
        if not seen:
            return
        rows = []
        for i in range(p):
            for j in range(i if with_diag else i + 1, p):
                rows.append((cols[i], cols[j], n[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], sab[i, j]))
        yield pd.DataFrame(rows, columns=["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"])

    return fn


def pair_moments(df: DataFrame, cols, with_diag: bool = False, centers: dict[str, float] | None = None) -> DataFrame:
    """(a, b, n, sa, sb, saa, sbb, sab) for every pair a before b in ``cols`` (pairwise complete).

    The sums are of values less their column's ``centers`` (found by one aggregate unless given), so that a large
    offset costs no digits; add the centers back where raw means are needed.
    """
    cols = list(cols)
    centers = centers or column_centers(df, cols)
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    part = x.mapInPandas(_pair_sums(cols, centers, with_diag), MOMENT_SCHEMA)
    return part.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ["n", "sa", "sb", "saa", "sbb", "sab"]])


def pair_corr(df: DataFrame, cols, method: str = "pearson", key: str = "id") -> DataFrame:
    """(a, b, r) Pearson, Spearman or Kendall (tau-b) correlation for every pair a before b; NULL for constant columns."""
    cols = list(cols)
    if method == "spearman":
        df = rank_transform(df, key, cols)
    elif method == "kendall":
        return kendall(df, cols, key=key)
    elif method != "pearson":
        raise ValueError("method must be pearson, spearman or kendall")
    m = pair_moments(df, cols)
    r = F.when(F.col("n") >= 2, corr_from_moments(F.col("n"), F.col("sa"), F.col("sb"), F.col("saa"),
                                                   F.col("sbb"), F.col("sab")))
    return m.select("a", "b", r.alias("r"))


def corr_columns(x, y):
    """(n, r) aggregates over rows where both are present; engine-side central moments, NULL when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(a).cast("double")
    va, vb = F.var_pop(a), F.var_pop(b)
    r = F.try_divide(F.covar_pop(a, b), F.sqrt(va) * F.sqrt(vb))
    return n, F.when((n >= 2) & (va > 0) & (vb > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def corr_with(df: DataFrame, cols, target: str = "target", method: str = "pearson", key: str = "id") -> DataFrame:
    """(feature, r): correlation of each column with the target (pairwise complete)."""
    cols = [c for c in cols if c != target]
    pc = pair_corr(df, cols + [target], method, key)
    return pc.where(F.col("b") == target).select(F.col("a").alias("feature"), "r")


#: A value is heavy from so many rows on, or from this share of the table's rows; heavy values are at most 1 / share a column.
HEAVY_ROWS, HEAVY_SHARE = 100_000, 1e-4


def rank_transform(df: DataFrame, key: str, cols) -> DataFrame:
    """Replace each column by its average rank among the column's non-null values (ties averaged).

    Cells meet the rank of their value by (column, value). A heavy value (a constant column is one) would be one task,
    so the ranks of heavy values are broadcast and only the other cells are shuffled.
    """
    cols = list(cols)
    long = to_long(df, [key], cols)
    pos = checkpointed(value_positions(long, ["feature"], "value"))
    heavy = max(HEAVY_ROWS, int(HEAVY_SHARE * df.count()))
    ranked = pos.select("feature", "value", "cnt", (F.col("cum").cast("double") + (F.col("cnt") + 1) / 2.0).alias("rank"))
    often = F.broadcast(ranked.where(F.col("cnt") > heavy).select("feature", "value", F.col("rank").alias("often")))
    cells = long.where(F.col("value").isNotNull()).join(often, ["feature", "value"], "left")
    rest = cells.where(F.col("often").isNull()).join(ranked.where(F.col("cnt") <= heavy).select("feature", "value", "rank"), ["feature", "value"])
    joined = cells.where(F.col("often").isNotNull()).select(key, "feature", F.col("often").alias("rank")).unionByName(rest.select(key, "feature", "rank"))
    wide = joined.groupBy(key).pivot("feature", cols).agg(F.first("rank"))
    return (df.select(F.col(key).alias("_key")).join(wide, F.col("_key") == F.col(key), "left")
            .select(F.col("_key").alias(key), *[F.col(c).cast("double").alias(c) for c in cols]))


def distances(df: DataFrame, cols) -> DataFrame:
    """EX-5: Euclidean distance between columns over rows where both are present."""
    centers = column_centers(df, cols)
    m = pair_moments(df, cols, centers=centers)
    at = F.create_map(*[x for c, v in centers.items() for x in (F.lit(c), F.lit(v))])
    apart = at[F.col("a")] - at[F.col("b")]
    d2 = (F.col("saa") + F.col("sbb") - 2 * F.col("sab") + 2 * apart * (F.col("sa") - F.col("sb")) + F.col("n") * apart * apart)
    return m.select("a", "b", F.sqrt(F.greatest(d2, F.lit(0.0))).alias("distance"))


# ---------------------------------------------------------------- Kendall
#: Ranks are compared digit by digit in this base.
RADIX = 32
#: Rows that are counted at once inside a task.
BLOCK_ROWS = 8192


def inversions(y: np.ndarray, w: np.ndarray) -> float:
    """Σ w_i w_j over i < j with y_i > y_j: halves are counted against each other by sorted search."""
    if len(y) <= 48:
        return float((np.triu(y[:, None] > y[None, :], 1) * w[:, None] * w[None, :]).sum())
    m = len(y) // 2
    order = np.argsort(y[:m], kind="stable")
    ranked, total = y[:m][order], np.concatenate([[0.0], np.cumsum(w[:m][order])])
    above = total[-1] - total[np.searchsorted(ranked, y[m:], side="right")]
    return inversions(y[:m], w[:m]) + inversions(y[m:], w[m:]) + float((above * w[m:]).sum())


class _DigitCounter:
    """Σ w · w' over rows of one group, the later with the greater digit and the smaller y, from rows in order of (group, y falling).

    ``held`` has the weight of each digit in the group that goes on; ``edges`` the totals of the first and last group.
    """

    def __init__(self):
        self.group, self.held, self.first, self.edges, self.local = None, np.zeros(RADIX), True, [], {}

    def block(self, p, g, digit, y, w) -> None:
        """Rows that end where a value of y ends."""
        n = len(p)
        own = np.zeros((n + 1, RADIX))
        own[np.arange(1, n + 1), digit] = w
        upto = np.cumsum(own, axis=0)
        new = np.r_[True, (p[1:] != p[:-1]) | (g[1:] != g[:-1])]
        tie = np.flatnonzero(new | np.r_[True, y[1:] != y[:-1]])
        tie = np.repeat(tie, np.diff(np.r_[tie, n]))
        starts = np.flatnonzero(new)
        goes_on = self.group == (int(p[0]), int(g[0]))
        base = upto[starts].copy()
        if goes_on:
            base[0] = -self.held
        above = np.cumsum(upto[tie] - base[np.cumsum(new) - 1], axis=1)
        each = w * np.where(digit > 0, above[np.arange(n), np.maximum(digit - 1, 0)], 0.0)
        for which in np.unique(p).tolist():
            self.local[which] = self.local.get(which, 0.0) + float(each[p == which].sum())
        ends = np.r_[starts[1:], n]
        for k in sorted({0, len(starts) - 1}):
            total = upto[ends[k]] - base[k]
            here = (int(p[starts[k]]), int(g[starts[k]]))
            if self.group is not None and here != self.group and self.first:  # the partition's first group is done
                self.edges.append((*self.group, self.held))
                self.first = False
            if k == 0 and len(starts) > 1 and self.first:
                self.edges.append((*here, total))
                self.first = False
            self.group, self.held = here, total

    def close(self) -> None:
        if self.group is not None:
            self.edges.append((*self.group, self.held))


def _digit_discordance(points: DataFrame, place: int, parts: int) -> dict[int, float]:
    """For each column pair the weight of row pairs whose x agree above the digit ``place`` and differ in it, and whose y go the
    other way. Groups may span any number of tasks: what crosses tasks follows from their totals."""
    x = F.col("x")
    unit = RADIX ** place
    dealt = (points.select("p", F.floor(x / (unit * RADIX)).alias("g"), F.pmod(F.floor(x / unit), F.lit(RADIX)).cast("int").alias("digit"), "y", "w")
             .groupBy("p", "g", "digit", "y").agg(F.sum("w").alias("w")))
    order = ["p", "g", F.col("y").desc()]
    dealt = dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext
        counter, rest = _DigitCounter(), None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            while len(rest) > BLOCK_ROWS:
                key = rest[["p", "g", "y"]].to_numpy()
                cut = BLOCK_ROWS
                while cut and (key[cut] == key[cut - 1]).all():
                    cut -= 1
                if not cut:  # a value has at most one row a digit
                    break
                _count(counter, rest[:cut])
                rest = rest[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            _count(counter, rest)
        counter.close()
        part = TaskContext.get().partitionId()
        rows = [(part, p, 0, v, None) for p, v in counter.local.items()] + [(part, p, g, None, t.tolist()) for p, g, t in counter.edges]
        yield pd.DataFrame(rows, columns=["part", "p", "g", "local", "totals"])

    out: dict[int, float] = {}
    edges: dict[tuple[int, int], np.ndarray] = {}
    for r in sorted(dealt.mapInPandas(run, "part int, p int, g long, local double, totals array<double>").collect(), key=lambda r: r["part"]):
        if r["totals"] is None:
            out[r["p"]] = out.get(r["p"], 0.0) + r["local"]
            continue
        mine, before = np.array(r["totals"]), edges.get((r["p"], r["g"]), np.zeros(RADIX))  # tasks before have greater y
        out[r["p"]] = out.get(r["p"], 0.0) + float((mine[1:] * np.cumsum(before)[:-1]).sum())
        edges[r["p"], r["g"]] = before + mine
    return out


def _count(counter: _DigitCounter, rows: pd.DataFrame) -> None:
    counter.block(*(rows[c].to_numpy() for c in ("p", "g", "digit", "y")), rows["w"].to_numpy(dtype=float))


def kendall(df: DataFrame, cols, rows_per_range: int = 50_000, key: str = "id") -> DataFrame:
    """(a, b, r): tau-b of every pair of columns over the rows that have both; NULL for constant columns.

    No row pairs are formed. Two rows are discordant where the ranks of one column first differ in some digit and the other column
    goes the other way: for each digit, rows that agree in the digits above are a group, sorted by the other column
    and dealt by ranges of about ``rows_per_range`` rows, however large the group; running weights of the digits count the pairs
    inside a range, the ranges' totals those across. Equal ranks never differ in a digit, so ties crowd nothing.
    Up to ``rows_per_range`` rows are merged in one task a pair of columns.
    """
    cols = list(cols)
    n = df.count()
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    ranked = rank_transform(df, key, cols).select(*[(2 * F.col(c)).alias(c) for c in cols])

    def cells(batches):
        for pdf in batches:
            for p, (a, b) in enumerate(pairs):
                both = pdf[[a, b]].dropna()
                if len(both):
                    out = pd.DataFrame({"p": p, "x": both[a].astype("int64"), "y": both[b].astype("int64")})
                    yield out.groupby(["p", "x", "y"], sort=False).size().rename("w").reset_index()

    points = checkpointed(ranked.mapInPandas(cells, "p int, x long, y long, w long").groupBy("p", "x", "y").agg(F.sum("w").alias("w")))
    discordant: dict[int, float] = {}
    if n <= rows_per_range:
        def within(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["x", "y"])
            return pd.DataFrame({"p": [int(pdf["p"].iat[0])], "d": [inversions(pdf["y"].to_numpy(), pdf["w"].to_numpy(dtype=float))]})
        discordant = {r["p"]: r["d"] for r in points.groupBy("p").applyInPandas(within, "p int, d double").collect()}
    else:
        parts, place = max(1, -(-points.count() // rows_per_range)), 0
        while RADIX ** place <= 2 * n:
            for p, d in _digit_discordance(points, place, parts).items():
                discordant[p] = discordant.get(p, 0.0) + d
            place += 1
    ties = [{r["p"]: r["t"] for r in points.groupBy("p", *by).agg(F.sum("w").alias("s")).groupBy("p")
             .agg(F.sum(F.col("s").cast("double") * (F.col("s") - 1) / 2).alias("t")).collect()} for by in (("x",), ("y",), ("x", "y"), ())]
    out = []
    for p, (a, b) in enumerate(pairs):
        tx, ty, txy, n0 = (t.get(p, 0.0) for t in ties)
        den = math.sqrt(n0 - tx) * math.sqrt(n0 - ty)
        out.append((a, b, (n0 - tx - ty + txy - 2 * discordant.get(p, 0.0)) / den if den > 0 else None))
    return df.sparkSession.createDataFrame(out, "a string, b string, r double")
