"""Arrow batches in small pieces, so that what Python makes of one never holds a whole batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of a piece, about: what Python makes of texts takes several times their size.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about ``most`` bytes, a row at least; nothing is copied."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= most:
            yield batch
        else:
            half = batch.num_rows // 2
            yield from pieces((batch.slice(0, half), batch.slice(half)), most)
