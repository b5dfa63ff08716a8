"""Queries: best weights of grids too large to list, over the suppliers' regions and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comoments as C
from ..operators import grid as G
from ..operators import simplex as S
from ..operators import walkforward as K
from ..operators.align import common_dates, returns_only, with_returns
from ..operators.bars import bucket_start
from . import panels as P
from .oracle import sql
from .q_portfolio import cov, mu
from .q_risk import r6
from .q_walkforward import STRATEGIES, _parts
from .registry import query

UNITS, MONTHS, TRAIN, TEST = 4, 12, 36, 12


def build_nations(spark, sf):
    """Monthly volume-weighted prices by the supplier's nation on the months all nations have, with returns."""
    s, n = P.table(spark, sf, "supplier"), P.table(spark, sf, "nation")
    nation = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", F.col("n_name").alias("symbol"))
    li = P.table(spark, sf, "lineitem")
    bars = li.join(nation, li.l_suppkey == F.col("s_suppkey")).groupBy("symbol", bucket_start("l_shipdate", "month").alias("ts")).agg(
        F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("close"))
    return with_returns(common_dates(bars))


def nations(spark, sf):
    return P.lake(spark, sf, "nations", build_nations)


def moments(spark, sf):
    """Means and covariances of each training window; window 0 is the whole history in ``whole``."""
    return K.window_moments(nations(spark, sf), TRAIN, TEST, MONTHS)


def whole(spark, sf):
    def build(sp, d):
        r = nations(sp, d).where("pos > 1")
        a, b = r.select("ts", F.col("symbol").alias("symbol_row"), F.col("r").alias("x")), r.select("ts", F.col("symbol").alias("symbol_col"), F.col("r").alias("y"))
        c = a.join(b, "ts").groupBy("symbol_row", "symbol_col").agg((F.covar_samp("x", "y") * MONTHS).alias("value"))
        return G.universe(r.groupBy("symbol").agg((F.avg("r") * MONTHS).alias("mean_return")), c)

    return P.lake(spark, sf, "nations_universe", build)


def members(spark, sf):
    return whole(spark, sf).first()["symbols"]


_PANEL = """np AS (SELECT n_name AS symbol, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts, sum(l_extendedprice) / sum(l_quantity) AS close
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
    na AS (SELECT * FROM np WHERE ts IN (SELECT ts FROM np GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM np))),
    nr AS (SELECT symbol, ts, row_number() OVER w AS pos, ln(close / lag(close) OVER w) AS r FROM na WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    sy AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS i FROM (SELECT DISTINCT symbol FROM np)), nk AS (SELECT count(*) AS k FROM sy)"""
#: All multisets of four symbols with equal parts, their measures by the moments m (g, i, mean) and c (g, i, j, value).
_ALL = """cd AS (SELECT a.i AS i1, b.i AS i2, c.i AS i3, d.i AS i4, row_number() OVER () AS id FROM sy a JOIN sy b ON a.i <= b.i JOIN sy c ON b.i <= c.i JOIN sy d ON c.i <= d.i),
    ch AS (SELECT id, unnest([i1, i2, i3, i4]) AS i FROM cd), cw AS (SELECT id, i, count(*) / 4.0::DOUBLE AS w FROM ch GROUP BY 1, 2),
    nm AS (SELECT id, array_to_string(list_transform(range(1, (SELECT k FROM nk) + 1), lambda x: len(list_filter([i1, i2, i3, i4], lambda y: y = x))), '-') AS candidate FROM cd),
    sm AS (SELECT g, id, cw.i, w, mean, (SELECT value FROM c WHERE c.g = m.g AND c.i = cw.i AND c.j = cw.i) AS own FROM cw JOIN m ON m.i = cw.i),
    sw AS (SELECT c.g, a.id, a.i, sum(c.value * b.w) AS s FROM cw a JOIN cw b ON a.id = b.id JOIN c ON c.i = a.i AND c.j = b.i GROUP BY 1, 2, 3),
    s1 AS (SELECT g, id, sum(w * mean) AS er, sum(w * s) AS var, sum(w * sqrt(own)) AS ow FROM sm JOIN sw USING (g, id, i) GROUP BY 1, 2),
    s2 AS (SELECT g, id, greatest(max(abs(w * s / var - 1 / k::DOUBLE)), CASE WHEN count(*) < any_value(k) THEN 1 / any_value(k)::DOUBLE ELSE 0 END) AS gap
      FROM sm JOIN sw USING (g, id, i) JOIN s1 USING (g, id), nk GROUP BY 1, 2),
    sc AS (SELECT g, id, candidate, er, var, sqrt(var) AS vol, (er - 0.05) / sqrt(var) AS sharpe, ow / sqrt(var) AS div, gap FROM s1 JOIN s2 USING (g, id) JOIN nm USING (id)),
    bs AS (SELECT g, unnest(['max_sharpe', 'min_variance', 'max_diversification', 'risk_parity']) AS objective,
      unnest([arg_max(id, sharpe), arg_min(id, var), arg_max(id, div), arg_min(id, gap)]) AS id FROM sc GROUP BY g)"""
_WHOLE = f"""{_PANEL}, m AS (SELECT 0 AS g, i, avg(r) * 12 AS mean FROM nr JOIN sy USING (symbol) WHERE pos > 1 GROUP BY 2),
    c AS (SELECT 0 AS g, x.i, y.i AS j, covar_samp(a.r, b.r) * 12 AS value FROM nr a JOIN nr b ON a.ts = b.ts JOIN sy x ON x.symbol = a.symbol JOIN sy y ON y.symbol = b.symbol
      WHERE a.pos > 1 GROUP BY 2, 3), {_ALL}"""
_MEASURES = ("objective", "candidate", "expected_return", "volatility", "sharpe", "diversification", "risk_imbalance", "gap")
_SCORES = "objective, candidate, #er# AS expected_return, #vol# AS volatility, #sharpe# AS sharpe, #div# AS diversification, #gap# AS risk_imbalance, 0.0::DOUBLE AS gap"


def _out(df):
    return r6(df.select(*_MEASURES), "objective", "candidate")


_FINE = "mg AS (SELECT 0 AS g, symbol, mu AS mean FROM mu), cg AS (SELECT 0 AS g, * FROM cov), " + _parts("g", "mg", "cg", units=40)


@query("j7_search_regions", sql(f"WITH {_FINE} SELECT objective, cand AS candidate, #er# AS expected_return, #vol# AS volatility, #sharpe# AS sharpe, "
                                "#div# AS diversification, #gap# AS risk_imbalance, 0.0::DOUBLE AS gap FROM bs JOIN sc USING (g, cand)"))
def _(spark, sf):
    """Steps of 2.5 %: the search finds what listing all 135,751 candidates finds."""
    return _out(S.search(G.universe(mu(spark, sf), cov(spark, sf)), 40, nodes=512))


@query("j7_search_nations", sql(f"WITH {_WHOLE} SELECT {_SCORES} FROM bs JOIN sc USING (g, id)"))
def _(spark, sf):
    return _out(S.search(whole(spark, sf), UNITS, nodes=512))


@query("j8_search_constrained", sql(f"""WITH {_WHOLE}, ok AS (SELECT id FROM cw JOIN sy USING (i) GROUP BY id
      HAVING max(w) <= 0.5 AND sum(CASE WHEN symbol < 'G' THEN w ELSE 0 END) <= 0.25 AND max(CASE WHEN i = (SELECT k FROM nk) THEN w ELSE 0 END) >= 0.25),
    cb AS (SELECT unnest(['max_sharpe', 'min_variance']) AS objective, unnest([arg_max(id, sharpe), arg_min(id, var)]) AS id FROM sc JOIN ok USING (id))
    SELECT {_SCORES} FROM cb JOIN sc USING (id)"""))
def _(spark, sf):
    """At most half in one nation, a quarter in all those before G, a quarter at least in the last one."""
    names = members(spark, sf)
    return _out(S.search(whole(spark, sf), UNITS, ["max_sharpe", "min_variance"], lower={names[-1]: 0.25}, upper=dict.fromkeys(names, 0.5),
                         groups=[([n for n in names if n < "G"], 0.25)], nodes=512))


_AVERSIONS = [0.0, 1.0, 5.0, 25.0]


@query("j9_search_frontier", sql(f"""WITH {_WHOLE}, av AS (SELECT unnest({_AVERSIONS})::DOUBLE AS aversion),
    fr AS (SELECT aversion, arg_max(id, er - aversion * var) AS id FROM sc, av GROUP BY 1)
    SELECT aversion, candidate, #er# AS expected_return, #vol# AS volatility, 0.0::DOUBLE AS gap FROM fr JOIN sc USING (id)"""))
def _(spark, sf):
    d = S.efficient(whole(spark, sf), UNITS, _AVERSIONS, nodes=512)
    return r6(d.select("aversion", "candidate", "expected_return", "volatility", "gap"), "aversion", "candidate")


@query("k3_search_weights", sql(f"""WITH {_PANEL}, wn AS (SELECT unnest(range(0, (max(pos) - {TRAIN + TEST}) // {TEST} + 1)) AS g FROM nr),
    m AS (SELECT g, i, avg(r) * 12 AS mean FROM nr JOIN sy USING (symbol) JOIN wn ON pos > g * {TEST} + 1 AND pos <= g * {TEST} + {TRAIN} GROUP BY 1, 2),
    c AS (SELECT g, x.i, y.i AS j, covar_samp(a.r, b.r) * 12 AS value FROM nr a JOIN nr b ON a.ts = b.ts JOIN sy x ON x.symbol = a.symbol JOIN sy y ON y.symbol = b.symbol
      JOIN wn ON a.pos > g * {TEST} + 1 AND a.pos <= g * {TEST} + {TRAIN} GROUP BY 1, 2, 3), {_ALL}
    SELECT g AS window_id, objective AS strategy, symbol, #w# AS weight FROM bs JOIN cw USING (id) JOIN sy USING (i) WHERE objective <> 'risk_parity'"""))
def _(spark, sf):
    m, c = moments(spark, sf)
    chosen = S.search_weights(m, c, UNITS, [s for s in STRATEGIES if s != "risk_parity"], nodes=512)
    return r6(chosen.where("weight > 0"), "window_id", "strategy", "symbol")


@query("f10_tiled_covariance", sql(f"""WITH {_PANEL} SELECT a.symbol AS symbol_row, b.symbol AS symbol_col, #covar_samp(a.r, b.r) * 12# AS value
    FROM nr a JOIN nr b ON a.ts = b.ts WHERE a.pos > 1 GROUP BY 1, 2"""))
def _(spark, sf):
    """Tiles of 8 nations and blocks of 32 months, so that several of each meet."""
    return r6(C.covariance(nations(spark, sf).where("pos > 1"), MONTHS, tile=8, block=32), "symbol_row", "symbol_col")


@query("f11_tiled_correlation", sql(f"""WITH {_PANEL} SELECT a.symbol AS symbol_row, b.symbol AS symbol_col,
    CASE WHEN a.symbol = b.symbol THEN 1.0::DOUBLE ELSE #corr(a.r, b.r)# END AS value FROM nr a JOIN nr b ON a.ts = b.ts WHERE a.pos > 1 GROUP BY 1, 2"""))
def _(spark, sf):
    return r6(C.correlation(nations(spark, sf).where("pos > 1"), tile=8, block=32), "symbol_row", "symbol_col")


@query("g5_tiled_correlation", sql(f"""WITH {_PANEL} SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.ts, CASE WHEN a.pos > 12 THEN
    #corr(a.r, b.r) OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.ts ROWS 11 PRECEDING)#4# END AS correlation
    FROM nr a JOIN nr b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.pos > 1"""))
def _(spark, sf):
    """Correlation of all pairs of nations over 12 months."""
    d = C.rolling_correlation(returns_only(nations(spark, sf)), 12, tile=8, block=32)
    return r6(d, "symbol_a", "symbol_b", "ts", places=4)


@query("j7_search_fine")
def _(spark, sf):
    """Steps of 1 % over all nations: a grid of C(124, 24) vectors; the gap bounds what may be missed. tests/test_simplex.py checks it."""
    return S.search(whole(spark, sf), 100, nodes=96, max_cells=64, levels=3).select(
        "objective", "candidate", "expected_return", "volatility", "sharpe", "diversification", "risk_imbalance", "score", "bound", "gap")
