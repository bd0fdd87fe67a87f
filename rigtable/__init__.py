"""RGB-D vision and robot-perception data as Spark tables."""

from rigtable.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
