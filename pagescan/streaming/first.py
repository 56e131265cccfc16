"""Each location once, on a stream: keyed state that expires."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagescan.schema import PAGES


def first_of_location_stream(pages: DataFrame, time: str, late: str = "1 hour", expire: str = "7 days") -> DataFrame:
    """The first page of each location as ``pages(page_id, location, content)``, from a stream with a column ``time``.

    A location is remembered for ``expire`` after the last page of it that came, in the time of the pages; copies within
    that are left out, also after a restart from the same checkpoint.  After it the location counts as new.  Of the pages of a
    location in one micro-batch the one with the lowest page_id stays, and of those the one with the least content.  Pages
    later than ``late`` behind the newest are dropped by the watermark.  NULL is a location like others.
    """
    seconds = int(pages.sparkSession.sql(f"SELECT CAST(INTERVAL {expire} AS INTERVAL SECOND) AS s").first().s.total_seconds())

    def first(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        best, newest = None, 0
        for frame in frames:
            newest = max(newest, int(frame["_ms"].max()))
            row = frame.sort_values(["page_id", "content"], na_position="last").iloc[0]
            order = (pd.isna(row.page_id), row.page_id, row.content or "")
            if best is None or order < best[0]:
                best = order, row
        if not state.exists and best is not None:
            yield pd.DataFrame([[best[1].page_id, best[1].location, best[1].content]], columns=["page_id", "location", "content"])
        last = max(newest, state.get[0] if state.exists else 0)
        state.update((last,))
        # A state may not time out before the watermark.
        state.setTimeoutTimestamp(max(last + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    timed = pages.withWatermark(time, late).select("page_id", "location", "content", F.unix_millis(time).alias("_ms"), time,
                                                    F.coalesce("location", F.lit("\u0000NULL")).alias("_key"))
    return timed.groupBy("_key").applyInPandasWithState(
        first, PAGES, "last LONG", "append", GroupStateTimeout.EventTimeTimeout)
