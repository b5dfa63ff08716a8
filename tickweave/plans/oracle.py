"""Named SQL pieces that the check queries are put together from."""

from __future__ import annotations

import re

PIECES = {
    "geo": """SELECT s_suppkey, r_name AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "trades": "SELECT l.*, g.symbol FROM lineitem l JOIN geo g ON l.l_suppkey = g.s_suppkey",
    "panel": """SELECT symbol, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS ts,
        sum(l_extendedprice) / sum(l_quantity) AS close, max(l_extendedprice / l_quantity) AS high,
        min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume FROM trades GROUP BY 1, 2""",
    "raw": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM panel",
    "aligned": """SELECT * FROM panel WHERE ts IN (SELECT ts FROM panel GROUP BY ts
        HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM panel))""",
    "silver": """SELECT *, row_number() OVER w AS pos, ln(close / lag(close) OVER w) AS r,
        close / lag(close) OVER w - 1 AS s FROM aligned WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "ret": "SELECT symbol, ts, pos - 1 AS pos, close, r, s FROM silver WHERE pos > 1",
    "cnt": "SELECT count(DISTINCT symbol) AS n FROM ret",
    "mu": "SELECT symbol, avg(r) * 365 AS mu, stddev_samp(r) * sqrt(365) AS vol FROM ret GROUP BY 1",
    "prs": """SELECT a.ts, a.pos, a.symbol AS symbol_a, b.symbol AS symbol_b, a.r AS x_a, b.r AS x_b
        FROM ret a JOIN ret b ON a.ts = b.ts""",
    "cov": """SELECT symbol_a AS symbol_row, symbol_b AS symbol_col, covar_samp(x_a, x_b) * 365 AS value
        FROM prs GROUP BY 1, 2""",
    "tw": "SELECT symbol, sum(volume) / (SELECT sum(volume) FROM panel) AS weight FROM panel GROUP BY 1",
    "bookv": """SELECT l_returnflag || '-' || l_linestatus AS portfolio, symbol, sum(l_extendedprice) AS v
        FROM trades GROUP BY 1, 2""",
    "books": "SELECT portfolio, symbol, v / sum(v) OVER (PARTITION BY portfolio) AS weight FROM bookv",
    "pr": "SELECT ts, pos, sum(weight * r) AS r FROM ret JOIN tw USING (symbol) GROUP BY 1, 2",
    "ent": "SELECT symbol, ts, pos, r FROM ret UNION ALL SELECT 'portfolio', ts, pos, r FROM pr",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r) AS k, count(*) OVER (PARTITION BY symbol) AS n,
        avg(r) OVER (PARTITION BY symbol) AS m, stddev_samp(r) OVER (PARTITION BY symbol) AS sd,
        stddev_pop(r) OVER (PARTITION BY symbol) AS sp FROM ent""",
    "mkt": "SELECT ts, pos, avg(r) AS m FROM ret GROUP BY 1, 2",
    "bars_d": """SELECT event_type AS symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts,
        arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""",
    "bars_h6": """SELECT event_type AS symbol, time_bucket(INTERVAL '6 hours', ts) AS ts,
        arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
        arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2""",
}
NEEDS = {
    "trades": ["geo"], "panel": ["trades"], "raw": ["panel"], "aligned": ["panel"], "silver": ["aligned"],
    "ret": ["silver"], "cnt": ["ret"], "mu": ["ret"], "prs": ["ret"], "cov": ["prs"], "tw": ["panel"],
    "bookv": ["trades"], "books": ["bookv"], "pr": ["ret", "tw"], "mkt": ["ret"],
    "ent": ["ret", "pr"], "ranked": ["ent"],
}


def sql(body: str, *, recursive: bool = False) -> str:
    """A statement with the named pieces it mentions put in front of it.

    ``#x#`` rounds to 6 places, ``#x#k#`` to k; adding 0.0 turns a negative zero into zero.
    """
    own = re.match(r"\s*WITH\s+(.*)", body, re.S)
    body = re.sub(r"#([^#]+)#(\d)#", r"(round(\1, \2) + 0.0)", body)
    body = re.sub(r"#([^#]+)#", r"(round(\1, 6) + 0.0)", body)
    used: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in used:
            used.append(name)

    for name in PIECES:
        if re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", body):
            need(name)
    head = ",\n".join(f"{n} AS (\n{PIECES[n]})" for n in used)
    word = "WITH RECURSIVE " if recursive else "WITH "
    if own:
        rest = re.match(r"\s*WITH\s+(.*)", body, re.S).group(1)
        return word + (head + ",\n" if head else "") + rest
    return word + head + "\n" + body if head else body
