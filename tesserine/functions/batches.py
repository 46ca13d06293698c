"""Arrow arrays of texts, read in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text that are Python strings at one time.
PART_BYTES = 4 << 20


def parts(texts: pa.Array, limit: int = PART_BYTES) -> Iterator[list[str | None]]:
    """The texts as Python strings, about ``limit`` bytes at a time; a longer one stands alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    start = size = 0
    for row, n in enumerate(sizes):
        if row > start and size + n > limit:
            yield texts.slice(start, row - start).to_pylist()
            start, size = row, 0
        size += n + 64
    if len(sizes) > start:
        yield texts.slice(start).to_pylist()


def joined(made: list[pa.Array], kind: pa.DataType) -> pa.Array:
    """What was made of the parts, as one array."""
    return pa.concat_arrays(made) if made else pa.array([], kind)
