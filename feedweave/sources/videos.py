"""Paged lists of videos as a data source, and what is looked up for them.

    spark.dataSource.register(VideoPages)
    spark.read.format("video_pages").options(folder=..., kind="uploads", lists='["UU1", "UU2"]', after="2026-01-01T00:00:00Z").load()

Each list is a partition, whose pages are asked for one after the other as each names the next.
Uploads come newest first, so a page with a video before the cut-off is the last of its list.
`landed` answers requests from a folder of responses; another client has the same form.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from feedweave.sources.connectors import DETAIL_BATCH, chunks

#: Pages of a list at most, by kind.
MOST = {"uploads": 5, "search": 2}
# The fields of responses that are read.
_TEXT = T.StringType()


def _record(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SNIPPET = _record(title=_TEXT, description=_TEXT, channelId=_TEXT, channelTitle=_TEXT, publishedAt=_TEXT, tags=T.ArrayType(_TEXT), liveBroadcastContent=_TEXT)
SEARCH_ROW = _record(id=_record(videoId=_TEXT), snippet=SNIPPET)
UPLOAD_ROW = _record(contentDetails=_record(videoId=_TEXT, videoPublishedAt=_TEXT), status=_record(privacyStatus=_TEXT))
DETAIL_ROW = _record(id=_TEXT, snippet=SNIPPET, contentDetails=_record(duration=_TEXT), status=_record(uploadStatus=_TEXT, privacyStatus=_TEXT), liveStreamingDetails=T.MapType(_TEXT, _TEXT))
CHANNEL_ROW = _record(id=_TEXT, contentDetails=_record(relatedPlaylists=_record(uploads=_TEXT)))


def landed(folder: str) -> Callable[[str], str]:
    """A client that answers a request with the text of the file or files in the folder of its name, in any
    store that pyarrow opens; a request without an answer is an error."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

    def fetch(request: str) -> str:
        found = files.get_file_info(fs.FileSelector(f"{root}/request={request}", allow_not_found=True))
        parts = sorted(i.path for i in found if i.is_file and not i.base_name.startswith(("_", ".")))
        if not parts:
            raise OSError(f"no answer to {request}")
        texts = []
        for p in parts:
            with files.open_input_stream(p) as stream:
                texts.append(stream.read().decode())
        return "".join(texts)

    return fetch


def shelved(folder: str, shelf: Callable[[str], str]) -> Callable[[list[str]], str]:
    """A client for `looked_up` of responses that are landed by shelves: files of JSON lines, an item with an
    `id` each, under the request that `shelf` names for an id.  It holds the one shelf that it read last; a shelf
    that isn't there holds nothing."""
    fetch = landed(folder)

    @lru_cache(maxsize=1)
    def items(request: str) -> dict[str, dict]:
        try:
            return {i["id"]: i for i in map(json.loads, filter(None, fetch(request).split("\n")))}
        except OSError:
            return {}

    return lambda ids: json.dumps({"items": [found for i in ids if (found := items(shelf(i)).get(i))]})


def _instant(text: str | None) -> datetime | None:
    if not text:
        return None
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


def request_name(kind: str, name: str, token: str | None) -> str:
    return f"{kind}-{name}-{token or 'first'}"


@dataclass
class _List(InputPartition):
    name: str


class VideoPages(DataSource):
    """Options: folder, kind (uploads or search), lists (JSON array of names), pages (most a list), after and
    before (instants, for uploads), pushdown (true where the session has
    spark.sql.python.filterPushdown.enabled: a lower bound of publishedAt in a query is then the cut-off)."""

    @classmethod
    def name(cls) -> str:
        return "video_pages"

    def schema(self) -> str:
        return "list string, page int, videoId string, channelId string, publishedAt timestamp, privacyStatus string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (_PushingReader if self.options.get("pushdown") == "true" else _Reader)(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.kind = options["folder"], options.get("kind", "uploads")
        self.lists = json.loads(options["lists"])
        self.most = int(options.get("pages", MOST[self.kind]))
        self.after, self.before = _instant(options.get("after")), _instant(options.get("before"))

    def partitions(self) -> list[InputPartition]:
        return [_List(name) for name in dict.fromkeys(self.lists)]

    def read(self, partition: _List) -> Iterator[tuple]:
        """Rows of one list.  A page that can't be had or read ends its list; rows without an id or,
        of uploads, without a time are left out, as are private ones."""
        fetch, token = landed(self.folder), None
        for page in range(1, self.most + 1):
            try:
                body = json.loads(fetch(request_name(self.kind, partition.name, token)))
                items, token = body.get("items") or [], body.get("nextPageToken")
            except (OSError, ValueError, AttributeError):
                return
            last = False
            for item in items:
                row = self._row(item)
                if row is None:
                    continue
                video, channel, published, privacy = row
                if self.kind == "uploads":
                    if published is None:
                        continue
                    if self.after and published < self.after:
                        last = True
                        continue
                    if (self.before and published >= self.before) or privacy not in (None, "public"):
                        continue
                yield partition.name, page, video, channel, published, privacy
            if last or not token:
                return

    def _row(self, item: dict) -> tuple | None:
        try:
            if self.kind == "uploads":
                details = item["contentDetails"]
                return (details["videoId"], None, _instant(details.get("videoPublishedAt")), (item.get("status") or {}).get("privacyStatus")) if details["videoId"] else None
            return (item["id"]["videoId"], item["snippet"].get("channelId"), _instant(item["snippet"].get("publishedAt")), None) if item["id"]["videoId"] else None
        except (KeyError, TypeError):
            return None


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("publishedAt",):
                at = f.value if f.value.tzinfo else f.value.replace(tzinfo=UTC)
                self.after = max(self.after or at, at)
                if isinstance(f, GreaterThanOrEqual) and self.kind == "uploads":
                    continue  # the source does all that it asks for
            yield f


def observed(rows: DataFrame, prefix: str = "") -> DataFrame:
    """(videoId, queries): the lists in which each video was seen, sorted."""
    return rows.groupBy("videoId").agg(F.sort_array(F.collect_set(F.concat(F.lit(prefix), "list"))).alias("queries"))


def looked_up(ids: DataFrame, client: Callable[[], Callable[[list[str]], str]], row: T.StructType, column: str = "videoId", batch: int = DETAIL_BATCH, place: Callable[[Column], Column] | None = None) -> DataFrame:
    """`ids` with a struct `found` of the response's item of that id, null where there is none.

    At most `batch` ids are asked for at once; `client` makes in each worker the function that answers them with
    a response's text.  A batch without a readable answer finds nothing, others do.  Null and repeated
    ids aren't asked for.  `place` says of an id (as text) where its answer is kept: ids of a place are asked for
    by one task, one after the other, so that a client need not open a place again for each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch, held = client(), []

        def ask(names: list[str]) -> pd.DataFrame:
            try:
                items = json.loads(fetch(names)).get("items") or []
            except (OSError, ValueError, AttributeError):
                items = []
            found = {i["id"]: json.dumps(i, ensure_ascii=False) for i in items if isinstance(i, dict) and isinstance(i.get("id"), str)}
            return pd.DataFrame({column: names, "body": [found.get(n) for n in names]})

        for frame in frames:
            held += frame[column].tolist()
            full = len(held) - len(held) % batch
            for names in chunks(held[:full], batch):
                yield ask(names)
            held = held[full:]
        if held:
            yield ask(held)

    asked = ids.select(F.col(column).cast("string").alias(column)).where(F.col(column).isNotNull()).distinct()
    if place is not None:
        asked = asked.withColumn("_place", place(F.col(column))).repartition("_place").sortWithinPartitions("_place").drop("_place")
    bodies = asked.mapInPandas(run, f"{column} string, body string")
    return ids.join(bodies.select(F.col(column).alias("_id"), F.from_json("body", row).alias("found")), F.col(column).cast("string") == F.col("_id"), "left").drop("_id")
