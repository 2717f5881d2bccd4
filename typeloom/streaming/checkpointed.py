"""New source files checked once as they arrive: the one incremental step of corpus curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.programs import TypeChecker, typecheck
from ..sources.io import Checkpoint


def check_new_files(files: DataFrame, done: Checkpoint, checker: TypeChecker, state: str, once: bool = True) -> StreamingQuery:
    """Check every file of a stream whose key has no result yet, and append the results.

    A batch that is run again after a failure finds its finished keys and skips them. Rows without a
    verdict (no compiler) are not recorded, so they stay pending.
    """

    def batch(rows: DataFrame, _: int) -> None:
        fresh = done.pending(rows.dropDuplicates([done.key]))
        done.append(typecheck(fresh, done.key, checker).where("ok is not null"))

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", state)
    return (writer.trigger(availableNow=True) if once else writer).start()
