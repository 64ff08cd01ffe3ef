"""plumbline: score-evaluation and dataset-integrity analytics for PySpark."""

from plumbline.session import build_session, settle

__all__ = ["build_session", "settle"]
