"""Structured Streaming drivers.

The reference has no stream operators (no watermarks, windows or state); its
report refresh is event-driven: a new snapshot lands, the latest view and the
report are rebuilt, and the published dataset is refreshed incrementally.
``snapshot_refresh`` expresses exactly that chain as a streaming query over
the snapshot folder whose micro-batches run the batch operators.
"""

from .refresh import snapshot_refresh

__all__ = ["snapshot_refresh"]
