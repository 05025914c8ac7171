"""salespanel: a Spark-native weekly sales panel engine.

Ingests store / feature / sales tables into one (Store, Dept, Date) panel,
profiles it, lists record-level anomalies, derives and enforces a data
contract, builds leakage-safe lag and rolling features, and trains and
scores ridge and random-forest forecasts on a chronological split.

Every step is a lazy DataFrame transformation; nothing passes whole through
the driver. Only scalars (a cutoff date, contract bounds, verdicts, metric
rows) are ever collected.
"""

__version__ = "0.1.0"
