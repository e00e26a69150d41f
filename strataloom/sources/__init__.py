"""Readers and writers for the engine's tables."""

from strataloom.sources.tables import current_files, load

__all__ = ["current_files", "load"]
