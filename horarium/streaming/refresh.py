"""An extension: refresh occurrences from a stream of captured documents.

Each micro-batch is evaluated like a daily run and replaces the rows of the
sources that it accepts in a table of versions; a source that fails keeps its last
good rows, and a batch that is repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import versions


def refresh(captures: DataFrame, evaluate: Callable[[DataFrame], tuple[DataFrame, DataFrame]], root: str, checkpoint: str, writer: str = "refresh") -> StreamingQuery:
    """`evaluate` gives rows and verdicts (source_id, lane) of a batch; `root` is the table, `writer` names this stream in it."""

    def batch(docs: DataFrame, number: int) -> None:
        rows, verdicts = evaluate(docs)
        accepted = verdicts.filter(F.col("lane") == "auto_accept").select("source_id")
        versions.replace_sources(rows.join(accepted, "source_id", "left_semi"), accepted, root, writer, number)

    return captures.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
