"""Tables that cut lineage, under the name that the operators use, and the size of Arrow batches."""

from __future__ import annotations

from tessera.sources.store import arrow_batches, shared_folder
from tessera.sources.store import saved as kept

__all__ = ["arrow_batches", "kept", "shared_folder"]
