"""Collection runs: as one step, and as micro-batches that go on from the last state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedweave.operators import clusters, reports
from feedweave.operators.components import cut
from feedweave.operators.dedupe import dedupe
from feedweave.operators.items import ITEM
from feedweave.operators.retention import Budgets, retain
from feedweave.functions.text import feed_millis
from feedweave.sources.files import drop_old_versions, read_versions, write_shards


def latest_first() -> list[Column]:
    """Latest publication, latest collection; then what the items say: first the fields that
    are shown, then all of them, so that only equal items tie."""
    shown = F.to_json(F.struct("id", "title", "url", "summary"))
    return [F.desc(feed_millis("publishedAt")), F.desc(feed_millis("collectedAt")), F.asc(shown), F.asc(F.to_json(F.struct(*ITEM.fieldNames())))]


@dataclass
class Run:
    items: DataFrame
    stories: DataFrame
    new_items: int
    status: str


def prepare(existing: DataFrame, collected: DataFrame, now: Column, attempted: int, succeeded: int, failed: int, budgets: Budgets = Budgets(), keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> Run:
    """Union, duplicate resolution, classification, retention, counts and stories, in this order."""
    retained = retain(keep(dedupe(existing.unionByName(collected, allowMissingColumns=True))), now, budgets, latest_first())
    items = cut(retained.select(*ITEM.fieldNames()))
    new = reports.new_items(items, existing).first()["new_items"]
    status = "failed" if attempted == 0 or succeeded == 0 else "partial" if failed else "success"
    return Run(items, clusters.build(items), int(new), status)


def persist(run: Run, root: str) -> str:
    """Items and stories in a new version, and one pointer to both when they are written, so
    a run that fails at any step leaves the last one in place."""
    return write_shards(run.items, f"{root}/items", run.stories)


def window(now: datetime, last: datetime | None, backfill_days: int | None = None, overlap: timedelta = timedelta(hours=24)) -> tuple[datetime, datetime]:
    """What a run asks for: from the last run less an overlap, or some days back."""
    start = now - timedelta(days=backfill_days) if backfill_days is not None else (last or now) - overlap
    if start >= now:
        raise ValueError("the window's start isn't before its end")
    return start, now


def collector_states(previous: dict, results: dict[str, dict], totals: dict[str, int], news: dict[str, int], now: str) -> dict:
    """State of each collector after a run: one that wasn't tried keeps its time and gets its
    new total, one that failed keeps its time."""
    out = dict(previous)
    for name, r in results.items():
        old = previous.get(name)
        if r["attempted"] == 0:
            out[name] = {**old, "totalItems": totals.get(name, 0)} if old else {"lastCollectedAt": now, "lastRunStatus": "never", "lastRunNewItems": 0, "totalItems": totals.get(name, 0)}
            continue
        status = "failed" if r["succeeded"] == 0 else "partial" if r["failed"] else "success"
        out[name] = {"lastCollectedAt": old["lastCollectedAt"] if status == "failed" and old else now, "lastRunStatus": status, "lastRunNewItems": news.get(name, 0), "totalItems": totals.get(name, 0)}
    return out


def blocking_failures(collectors: list[tuple[str, dict, bool]]) -> list[str]:
    """Names of collectors that hold up a run and finished nothing that they tried."""
    return [name for name, r, blocks in collectors if blocks and r["attempted"] > 0 and r["succeeded"] == 0]


def stream_items(landed: DataFrame, root: str, checkpoint: str, now: Callable[[], Column] = F.current_timestamp, budgets: Budgets = Budgets(), keep_versions: int = 2):
    """A streaming query that folds landed items into the versions under `root`, batch by
    batch, with their stories.  What it rewrites is the retained items, which the budgets
    bound, whatever has ever landed; all but the newest versions are deleted.  A batch that
    is tried again gives the same items, for what it adds are duplicates by then; an empty
    one writes nothing."""

    def fold(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        if batch.isEmpty():
            return
        existing = read_versions(spark, root).drop("shard_date")
        items = dedupe(existing.unionByName(batch, allowMissingColumns=True))
        kept = cut(retain(items, now(), budgets, latest_first()))
        write_shards(kept, root, clusters.build(kept))
        drop_old_versions(spark, root, keep_versions)

    return landed.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_first_seen(events: DataFrame, key: str, time: str, id: str, late: str = "90 days") -> DataFrame:
    """(key, time, id) in update mode: the first event of each key, by time, then id.  A key
    has another row when an earlier event of it arrives, so its least row holds; keys are
    forgotten `late` after their time."""
    from pyspark.sql import types as T
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kept = events.withWatermark(time, late).select(key, time, id)
    out = T.StructType([kept.schema[c] for c in (key, time, id)])
    state = T.StructType([T.StructField("ms", T.LongType()), out[2]])

    def first(of: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).dropna(subset=[time]).sort_values([time, id]).head(1)
        if rows.empty:
            return
        mine = rows[time].iloc[0].value // 1000, rows[id].iloc[0].item() if hasattr(rows[id].iloc[0], "item") else rows[id].iloc[0]
        if not held.exists or mine < tuple(held.get):
            held.update(mine)
            held.setTimeoutTimestamp(max(mine[0] // 1000, held.getCurrentWatermarkMs() + 1))
            yield rows

    return kept.groupBy(key).applyInPandasWithState(first, out, state, "update", GroupStateTimeout.EventTimeTimeout)
