"""Python workers import the package from where the driver has it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pathweave.session import reachable as reachable

#: Texts of a batch that are Python objects at once.
AT_ONCE = 128


def each_text(texts: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 of a batch's texts one after the other, a few copied out of the batch at a time."""
    texts = texts.cast(pa.large_binary())
    for at in range(0, len(texts), AT_ONCE):
        yield from texts.slice(at, AT_ONCE).to_pylist()
