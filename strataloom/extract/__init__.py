"""What source texts declare: declarations, callables, imports, calls, comments, headings and keys."""

from strataloom.extract.parse import Parsed, parse
from strataloom.extract.tables import extracted

__all__ = ["Parsed", "extracted", "parse"]
