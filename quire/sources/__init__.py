"""Sources: bytes of files to rows. ``text_items`` reads every portable format."""

from quire.sources.catalog import inspect_files, read_files
from quire.sources.items import text_items

__all__ = ["inspect_files", "read_files", "text_items"]
