"""Registry pairing each Spark query with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixtures import CTES


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: str


REGISTRY: dict[str, Query] = {}


def with_ctes(body: str, names: str) -> str:
    """Prefix ``body`` with the named shared table definitions, in dependency order."""
    wanted: list[str] = []

    def add(name: str) -> None:
        deps, _ = CTES[name]
        for d in deps.split():
            add(d)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    if not wanted:
        return body
    head = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in wanted)
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"


def _standard_counts(sql: str) -> str:
    """``count_if(x)`` -> ``count(*) FILTER (WHERE x)``, which yields BIGINT."""
    mark = "count_if("
    while mark in sql:
        start = sql.index(mark)
        depth, end = 1, start + len(mark)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[start + len(mark):end - 1]
        sql = f"{sql[:start]}count(*) FILTER (WHERE {inner}){sql[end:]}"
    return sql


def query(name: str, covers: str, sql: str | None = None, *, ctes: str = "", floats: str = "",
          digits: int = 9, longs: str = ""):
    """Register a query; ``floats`` are rounded and ``longs`` cast alike on both sides."""
    floats_, longs_ = floats.split(), longs.split()
    # Averages of short decimals fall exactly half way between two roundings, where the
    # order of a sum decides; the nudge, far below the last digit, keeps both sides alike.
    nudge = 3.7 * 10.0 ** -(digits + 3)

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            changed = {c: F.round(F.col(c).cast("double") + nudge, digits) for c in floats_}
            changed.update({c: F.col(c).cast("bigint") for c in longs_})
            return df.withColumns(changed) if changed else df

        full = None
        if sql is not None:
            full = _standard_counts(with_ctes(sql, ctes))
            parts = [f"round(CAST({c} AS DOUBLE) + {nudge!r}::DOUBLE, {digits}) + 0.0 AS {c}" for c in floats_]
            parts += [f"CAST({c} AS BIGINT) AS {c}" for c in longs_]
            if parts:
                full = f"SELECT * REPLACE ({', '.join(parts)}) FROM (\n{full}\n)"
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(run, full, covers)
        return fn

    return wrap


def sql_norm_sf(x: str) -> str:
    """Upper normal tail by series and continued fraction; independent of the Column form."""
    a = f"abs({x})"
    phi = f"(exp(-({x})*({x})/2.0)/sqrt(2*pi()))"
    series = (f"(0.5 - {phi}*{a}*list_reduce(list_prepend(1.0::DOUBLE, "
              f"list_transform(range(60,0,-1), lambda k: k::DOUBLE)), "
              f"lambda acc, k: 1.0 + acc*({x})*({x})/(2*k+1)))")
    fraction = (f"({phi}/list_reduce(list_prepend({a}::DOUBLE, "
                f"list_transform(range(100,0,-1), lambda k: k::DOUBLE)), "
                f"lambda acc, k: {a} + k/acc))")
    return f"(CASE WHEN ({x})>=0 THEN 1 ELSE -1 END * CASE WHEN {a}<2.5 THEN {series} ELSE {fraction} END " \
           f"+ CASE WHEN ({x})>=0 THEN 0 ELSE 1 END)"


def sql_two_sided(z: str) -> str:
    return f"(2.0*{sql_norm_sf(f'abs({z})')})"


def sql_norm_ppf(p: str) -> str:
    """Normal quantile: the published rational form, written out as SQL text."""
    from ..functions import distributions as D

    def poly(v, cs):
        out = repr(cs[-1])
        for c in reversed(cs[:-1]):
            out = f"({out}*{v}+({c!r}::DOUBLE))"
        return out

    q = f"(({p})-0.5)"
    mr = f"(0.180625-{q}*{q})"
    r = f"sqrt(-ln(least({p},1.0-({p}))))"
    nr, fr = f"({r}-1.6)", f"({r}-5.0)"
    tail = (f"(CASE WHEN {r}<=5.0 THEN {poly(nr, D.PPF_NEAR_NUM)}/{poly(nr, D.PPF_NEAR_DEN)} "
            f"ELSE {poly(fr, D.PPF_FAR_NUM)}/{poly(fr, D.PPF_FAR_DEN)} END)")
    return (f"(CASE WHEN ({p})<=0 OR ({p})>=1 THEN NULL WHEN abs{q}<=0.425 THEN "
            f"{q}*{poly(mr, D.PPF_MID_NUM)}/{poly(mr, D.PPF_MID_DEN)} "
            f"ELSE sign{q}*{tail} END)")


def sql_acat(p: str) -> str:
    """Equal-weight ACAT aggregate."""
    t = (f"avg(CASE WHEN {p} IS NULL THEN NULL WHEN {p}=0 THEN NULL "
         f"WHEN {p}<1e-15 THEN 1.0/({p}*pi()) ELSE tan((0.5-{p})*pi()) END)")
    return (f"(CASE WHEN bool_or({p}=0) THEN 0.0 WHEN bool_and({p}=1) THEN 1.0 "
            f"WHEN {t}>1e15 THEN 1.0/({t}*pi()) WHEN {t}<-1e15 THEN 1.0 ELSE 0.5-atan({t})/pi() END)")


def sql_bh(source: str, keys: str, p: str, *, suffix: str = "", fdr: float = 0.05) -> str:
    """Corrected copy of ``source``: q, strict flags and the threshold per ``keys``."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""
SELECT * EXCLUDE (n_, rn_, raw_, q_), q_ AS qvalue{suffix},
       coalesce(q_ < {fdr}, false) AS significant_fdr{suffix},
       0.05::DOUBLE/nullif(n_,0) AS bonferroni_threshold{suffix},
       coalesce({p} < 0.05::DOUBLE/nullif(n_,0), false) AS significant_bonferroni{suffix}
FROM (SELECT *, CASE WHEN {p} IS NOT NULL THEN least(1.0, min(raw_) OVER ({part} ORDER BY rn_ DESC
             ROWS UNBOUNDED PRECEDING)) END AS q_
      FROM (SELECT *, {p}*n_/rn_ AS raw_
            FROM (SELECT *, count({p}) OVER ({part}) AS n_,
                         row_number() OVER ({part} ORDER BY {p} NULLS LAST, gene) AS rn_ FROM {source})))"""
