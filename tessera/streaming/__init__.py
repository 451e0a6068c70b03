"""Fitted workflows over streams.

A fitted graph without row-collapsing or order-dependent operators is stateless:
lookups become stream-static joins.  The reference has no streaming; this is an
extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import DifferenceLag, Groupby
from ..workflow import Workflow


def transform_stream(workflow: Workflow, stream: DataFrame) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a stream")
    for n in workflow.output_node.walk():
        if isinstance(n.op, (Groupby, DifferenceLag)):
            raise ValueError(f"{n.op.label} needs whole groups; it cannot run row by row on a stream")
    return workflow.transform(stream)


def write_stream(workflow: Workflow, stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends transformed rows to Parquet, exactly once, and stops at the end of what is there."""
    return transform_stream(workflow, stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
