"""rollcall: entity/item analytics as Spark DataFrame jobs."""

from rollcall.session import build_session, settle, shared_dir

__all__ = ["build_session", "settle", "shared_dir"]
