"""The Markdown parser: pure Python, one document at a time, run inside Arrow batches."""

from folio.kernel.block import Options, parse

__all__ = ["Options", "parse"]
