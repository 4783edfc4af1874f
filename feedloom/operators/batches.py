"""Arrow batches within tasks, handed on in pieces of bounded size."""

from __future__ import annotations


def in_pieces(batches, column: int, most: int):
    """Batches cut by rows so that lists, or texts, of a column hold `most` values, or bytes, in all; a larger row is alone.

    A batch is bounded by its rows and bytes, what a worker makes of it is not: it takes a piece at a time.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        c = batch.column(column)
        size = pc.list_value_length(c) if pa.types.is_list(c.type) or pa.types.is_large_list(c.type) else pc.binary_length(c)
        ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            to = max(at + 1, to)
            yield batch.slice(at, to - at)
            at = to
