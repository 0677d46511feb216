"""Log sink with running summary, and the resumable drill."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import session_summary
from ..operators.practice import ENOUGH, MAX_FOLLOWUP


def drain(writer, checkpoint: str, seconds: int | None = None) -> None:
    """Run a stream writer over what is there now and stop; ``seconds``, if given, is a limit."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if query.awaitTermination(seconds) is False:
            raise TimeoutError(f"stream not drained in {seconds} s")
    finally:
        query.stop()


def append_stream(rows: DataFrame, sink: str, checkpoint: str) -> None:
    """Append log rows exactly once (file sink with checkpoint)."""
    drain(rows.writeStream.outputMode("append").format("parquet").option("path", sink), checkpoint)


def summarise_stream(rows: DataFrame, sink: str, checkpoint: str) -> None:
    """Keep the session summary up to date: a batch adds a version of the sessions it changed, no more.

    :func:`read_summary` takes each session's last version. The rows of a version count once its mark
    is written, which names the attempt, so a batch that broke off or runs again is never seen in part.
    """
    _publish(session_summary(rows.sparkSession.createDataFrame([], rows.schema)), sink, -1)
    drain(session_summary(rows).writeStream.outputMode("update").foreachBatch(lambda batch, n: _publish(batch, sink, n)), checkpoint)


def _publish(changed: DataFrame, sink: str, version: int) -> None:
    attempt = f"a{uuid.uuid4().hex}"
    changed.write.parquet(f"{sink}/rows/version={version}/attempt={attempt}")
    changed.sparkSession.range(1).select(F.lit(attempt).alias("attempt")).write.mode("overwrite").parquet(f"{sink}/done/version={version}")


def read_summary(spark: SparkSession, sink: str) -> DataFrame:
    """The running summary: one row per session."""
    rows, done = spark.read.parquet(f"{sink}/rows"), spark.read.parquet(f"{sink}/done")
    values = [c for c in rows.columns if c not in ("session", "version", "attempt")]
    return (rows.join(done, ["version", "attempt"]).groupBy("session")
            .agg(F.max_by(F.struct(*values), "version").alias("last")).select("session", "last.*"))


DRILLED = "qid long, depth int, n_missing int, ratio double, done boolean"
_DRILL_STATE = "covered array<string>, done boolean"


def _fold(text: str) -> str:
    return re.sub(r"[\s,]", "", text).lower()


def _drill(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    covered, done = (list(state.get[0]), state.get[1]) if state.exists else ([], False)
    out = []
    for row in pd.concat(list(frames)).sort_values("depth").itertuples(index=False):
        if done:
            break
        said = _fold(row.answer or "")
        covered += [f for f in row.facts if f not in covered and _fold(f) in said]
        missing = [f for f in row.facts if f not in covered]
        ratio = len(covered) / len(row.facts) if len(row.facts) else 1.0
        number = any(re.match(r"[0-9]", f) for f in missing)
        done = row.depth >= MAX_FOLLOWUP or (not number and ratio >= ENOUGH)
        out.append((key[0], row.depth, len(missing), ratio, done))
    state.update((covered, done))
    yield pd.DataFrame(out, columns=["qid", "depth", "n_missing", "ratio", "done"])


def drill_stream(turns: DataFrame) -> DataFrame:
    """A drill that goes on with every answer that arrives: ``qid, facts, depth, answer`` in,
    one row per judged turn out, nothing after the drill is done."""
    return turns.groupBy("qid").applyInPandasWithState(_drill, DRILLED, _DRILL_STATE, "append", GroupStateTimeout.NoTimeout)
