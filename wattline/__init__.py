"""wattline: a Spark-native warehouse, point-in-time panel and forecast-evaluation library for market time series.

Everything is a DataFrame in and a DataFrame out.  Sub-packages:

functions   column expressions (clock, calendar, numeric, quantile, name tokens)
sources     readers and Parquet layout for the raw feeds
operators   reusable relational operators (time weighting, as-of, runs, scoring, resampling, sparse algebra)
models      forecasting models that run as distributed jobs
plans       composed jobs: derived tables, panel, folds, backtests, post-processing, trading, path pricing, registry
streaming   Structured Streaming twins of the batch operators
checks      queries over the shared test tables and their SQL counterparts
"""

from wattline.session import build_session, cut_lineage, tune

__all__ = ["build_session", "cut_lineage", "tune"]
