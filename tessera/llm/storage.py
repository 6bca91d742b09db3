"""Shared storage, as the rest of the package uses it."""

from __future__ import annotations

from ..sources.storage import release, scratch, settled, shared_dir, temporary

__all__ = ["release", "scratch", "settled", "shared_dir", "temporary"]
