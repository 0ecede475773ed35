"""Arrow batches from rows."""

from __future__ import annotations

import pyarrow as pa

#: Rows that an operator holds before it hands them on.
ROWS_PER_BATCH = 20_000


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
