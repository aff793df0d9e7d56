"""Small SQL text builders for the oracle queries (plain SQL as DuckDB runs it).

They write the same definitions the Spark operators use: long form by
UNION ALL, md5-ordered stratified splits with largest-remainder quotas,
quantile_cont quantiles, moment-based correlations.
"""

from __future__ import annotations


def unpivot(src: str, keys: list[str], features: list[str]) -> str:
    """Long form (keys..., feature, value DOUBLE) keeping NULL values."""
    k = ", ".join(keys)
    k = k + ", " if k else ""
    return "\nUNION ALL\n".join(
        f"SELECT {k}'{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src}" for f in features)


def h13(*parts: str) -> str:
    """First 13 hex digits of md5 of '|'-joined SQL expressions (orders like hash52)."""
    inner = ", '|', ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"substr(md5(concat({inner})), 1, 13)"


def h52(*parts: str) -> str:
    return f"CAST(('0x' || {h13(*parts)}) AS BIGINT)"


def largest_remainder(cls: str, keys: list[str], strata: list[str], total: str, out: str) -> str:
    """Share ``total`` (an expression of n = Σ n_c per keys) over the classes of ``cls``
    (keys…, strata…, n_c) in proportion to n_c; leftover units to the largest fractions, ties by class."""
    kk = ", ".join(keys + strata)
    pk = ("PARTITION BY " + ", ".join(keys)) if keys else ""
    cls_col = strata[0] if strata else "0"
    return f"""SELECT {kk + ', ' if kk else ''}n_c, CAST(fl + CASE WHEN row_number() OVER ({pk} ORDER BY ex - fl DESC, {cls_col}) <= nt - sum(fl) OVER ({pk}) THEN 1 ELSE 0 END AS BIGINT) AS {out}
FROM (SELECT *, floor(ex) AS fl FROM (
  SELECT *, CAST(nt AS DOUBLE) * CAST(n_c AS DOUBLE) / CAST(n AS DOUBLE) AS ex FROM (
    SELECT *, {total} AS nt FROM (SELECT *, sum(n_c) OVER ({pk}) AS n FROM {cls}))))"""


def quotas(src: str, frac: float, keys: list[str], strata: list[str]) -> str:
    """Per (keys, class) test quota: ceil(frac·n) shared by largest remainder (ties by class)."""
    grp = keys + strata
    sel = ", ".join(grp) + ", " if grp else ""
    cls = f"(SELECT {sel}count(*) AS n_c FROM {src}" + (f" GROUP BY {', '.join(grp)})" if grp else ")")
    return largest_remainder(cls, keys, strata, f"ceil({float(frac)!r} * CAST(n AS DOUBLE))", "quota")


def split(src: str, frac: float, seed_expr: str, keys: list[str], strata: list[str], key: str = "id") -> str:
    """Rows of ``src`` with ``part``: first quota rows per (keys, class) by md5(id|seed), id."""
    kk = keys + strata
    pk = "PARTITION BY " + ", ".join(kk) if kk else ""
    on = " AND ".join(f"r.{c} = q.{c}" for c in kk) or "TRUE"
    return f"""SELECT r.* EXCLUDE (_pos), CASE WHEN r._pos < q.quota THEN 'test' ELSE 'train' END AS part
FROM (SELECT *, row_number() OVER ({pk} ORDER BY {h13(key, seed_expr)}, {key}) - 1 AS _pos FROM {src}) r
JOIN ({quotas(src, frac, keys, strata)}) q ON {on}"""


def corr() -> str:
    """Pearson r from ``moments``; NULL when a side is constant."""
    return "CASE WHEN n >= 2 AND vx > 0 AND vy > 0 THEN r END"


def moments(x: str, y: str) -> str:
    """n, both variances and the engine's own correlation of two expressions (rows where both are present)."""
    return (f"CAST(count(*) AS DOUBLE) AS n, var_pop({x}) AS vx, var_pop({y}) AS vy, "
            f"CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN corr({x}, {y}) END AS r")


def pair_moments(long: str, key: str = "id", extra_keys: list[str] | None = None) -> str:
    """Pairwise-complete moments for feature pairs a < b (by position column ``fpos``) of a long table."""
    ek = extra_keys or []
    on = " AND ".join([f"x.{key} = y.{key}"] + [f"x.{c} = y.{c}" for c in ek])
    sel = ", ".join(f"x.{c}" for c in ek)
    sel = sel + ", " if sel else ""
    grp = ", ".join(f"x.{c}" for c in ek)
    grp = grp + ", " if grp else ""
    return f"""SELECT {sel}x.feature AS a, y.feature AS b, {moments("x.value", "y.value")}
FROM {long} x JOIN {long} y ON {on} AND x.fpos < y.fpos
WHERE x.value IS NOT NULL AND y.value IS NOT NULL
GROUP BY {grp}x.feature, y.feature"""


def positions(features: list[str]) -> str:
    """VALUES table (feature, fpos) giving column order."""
    rows = ", ".join(f"('{f}', {i})" for i, f in enumerate(features))
    return f"SELECT * FROM (VALUES {rows}) t(feature, fpos)"
