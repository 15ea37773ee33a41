"""quarry: corpus topic analytics expressed as Spark DataFrame jobs.

Sub-packages
------------
functions   Column expressions (text normalisation, parsing, vectors).
operators   DataFrame -> DataFrame operators (terms, similarity, stats,
            clustering, trends, dedupe, summaries).
sources     Readers and writers (tables, CSV/Parquet, landed payloads).
plans       Registered queries and their DuckDB oracle SQL.
streaming   Incremental landing and dedupe with Structured Streaming.
"""

from quarry.session import build_session, checkpoint_dir, reliable_checkpoint

__all__ = ["build_session", "checkpoint_dir", "reliable_checkpoint"]
