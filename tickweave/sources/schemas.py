"""Fixed table layouts."""

BARS = "ts TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"
SYMBOL_META = (
    "symbol STRING, name STRING, sector STRING, category STRING, launch_year INT, market_cap_rank INT, "
    "is_stablecoin STRING, consensus STRING"
)
PORTFOLIO_CONFIG = "sector_classification MAP<STRING, ARRAY<STRING>>"
CANDLE_EVENT = (
    "e STRING, s STRING, k STRUCT<t: BIGINT, s: STRING, o: STRING, h: STRING, l: STRING, c: STRING, "
    "v: STRING, x: BOOLEAN>"
)
DEPTH_EVENT = (
    "stream STRING, s STRING, E BIGINT, data STRUCT<E: BIGINT, bids: ARRAY<ARRAY<STRING>>, asks: ARRAY<ARRAY<STRING>>>, "
    "bids ARRAY<ARRAY<STRING>>, asks ARRAY<ARRAY<STRING>>"
)
