"""Transaction-fraud detection and evaluation as Spark DataFrame transforms."""

from ledgerwatch.session import build_session, prepare_session

__all__ = ["build_session", "prepare_session"]
