"""Incremental scoring of files as they land (the batch operators are stateless per row)."""

from stratus.streaming.scoring import score_files_stream

__all__ = ["score_files_stream"]
