"""Functions of pandas frames over rows of any length: few rows are in Python at once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows that are turned into Python objects at once; a batch of Spark has 10,000, however long their texts are.
ROWS = 200


def map_frames(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What a function gives for frames of ROWS rows at most."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    made, rows = to_arrow_schema(StructType.fromDDL(schema)), ROWS

    def each(batches):
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield pa.RecordBatch.from_pandas(run(b.slice(at, rows).to_pandas(integer_object_nulls=True)), made, preserve_index=False)

    return df.mapInArrow(each, schema)
