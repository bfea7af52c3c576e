"""The change feed as a stream: what happened to paths, told by the hash that each had last."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGED = "path string, change string, content_hash string, ts timestamp"
HELD = "content_hash string"


def _told(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = state.get[0] if state.exists else None
    known, out = state.exists, []
    # a micro-batch's rows of one path come in any order
    rows = pd.concat(list(frames)).sort_values(["ts", "op", "content_hash"], kind="stable", na_position="first")
    for op, now, ts in zip(rows["op"], rows["content_hash"], rows["ts"], strict=True):
        if op == "remove":
            if known:
                out.append((key[0], "deleted", None, ts))
            known, held = False, None
        elif not known or now != held:
            out.append((key[0], "modified" if known else "created", now, ts))
            known, held = True, now
    if known:
        state.update((held,))
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["path", "change", "content_hash", "ts"])


def change_stream(rows: DataFrame) -> DataFrame:
    """A stream (path, op, content_hash, ts) -> (path, change, content_hash, ts).

    ``op`` is upsert or remove. An unchanged hash tells nothing; removing an unknown path tells nothing.
    The state is one hash a path, kept by path in the state store and checkpointed, so a restart goes on.
    """
    return rows.filter("path is not null").groupBy("path").applyInPandasWithState(_told, CHANGED, HELD, "append", GroupStateTimeout.NoTimeout)


def follow(changed: DataFrame, checkpoint: str, apply: Callable[[DataFrame, DataFrame], None], once: bool = False):
    """Start a query that gives each batch's changes to ``apply``(upserts, deletes), the last of each path."""
    from quarry.sources.files import last_of_each

    def each(batch: DataFrame, number: int) -> None:
        last = last_of_each(batch, "path", "ts")
        apply(last.filter("change <> 'deleted'"), last.filter("change = 'deleted'"))

    writer = changed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()
