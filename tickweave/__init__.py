"""Market-data analytics as Spark jobs: bars, returns, risk, signals, portfolios, walk-forward tests."""
