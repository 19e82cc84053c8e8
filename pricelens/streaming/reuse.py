"""M2: recent-search suppression as a stateful stream, right for requests in any order.

A request for a cache key is a *hit* if the key was last computed less than the
TTL ago (event time); otherwise it is a *miss* and becomes the new computation
time. The rule is sequential in event time, so a request is decided once no
earlier one can come: the watermark, ``order_within`` behind the newest request
seen, says when.

The state is kept by slice of keys (``SLICES``, by hash), not by key: waiting requests as Arrow
tables, each of one segment of event time (``SEGMENT_TTLS``), and the last computation times that still count.
A slice's rows are put into the state in blocks of ``BLOCK_ROWS`` and have one timer, so what a
trigger costs follows its blocks and segments; a state entry and a timer for each request would
cost more than deciding it. The timer drains what is due, segment by segment in time order: no
frame holds more of a slice than a segment. What is due is counted in buckets of ``bucket_seconds``.
A request that comes behind the watermark is kept: it is decided at once, a hit
if it lies within the TTL of the last computation, else a miss that moves that
time forward only. The last computation time leaves the state a TTL later.

The watermark is declared on the request time, but the operator gets a copy of
the column, because the engine drops rows by the declared one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import rules

OUTPUT_SCHEMA = "cache_key string, event_id long, ts timestamp, hit boolean"
BUCKET_SECONDS = 60
SLICES = 64
BLOCK_ROWS = 200_000
SEGMENT_TTLS = 24
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the one that has timers and maps


def decide(times: np.ndarray, last: int | None, ttl: int) -> tuple[np.ndarray, int | None]:
    """Hits of ascending request times, and the last computation time after them. A miss starts a
    new TTL window: the walk jumps straight to the first request at or after its end."""
    hits = np.ones(len(times), dtype=bool)
    i = 0 if last is None else int(np.searchsorted(times, last + ttl, side="left"))
    while i < len(times):
        hits[i] = False
        last = int(times[i])
        i = int(np.searchsorted(times, last + ttl, side="left"))
    return hits, last


NEVER = -(1 << 62)  # no computation known


def decide_all(code: np.ndarray, times: np.ndarray, last: np.ndarray, ttl: int) -> np.ndarray:
    """``decide`` for many keys at once: rows sorted by ``code`` (a key's place in ``last``) and time; ``last`` is
    moved on. A step takes each key's next miss, so there are as many as the key with most misses has."""
    base, span = int(times.min()), int(times.max()) - int(times.min()) + 1
    hits = np.ones(len(times), dtype=bool)
    keys, first = np.unique(code, return_index=True)
    end = np.append(first[1:], len(code))
    at = (np.searchsorted(keys, code) * span) + (times - base)  # ascending, as a segment is short
    order = np.arange(len(keys))
    while len(order):
        after = np.clip(last[keys[order]] + ttl - base, 0, span)
        i = np.searchsorted(at, order * span + after, side="left")
        open_ = i < end[order]
        order, i = order[open_], i[open_]
        hits[i] = False
        last[keys[order]] = times[i]
    return hits


def _pack(frame: pd.DataFrame) -> bytes:
    t = pa.Table.from_pandas(frame, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(data)).read_all().to_pandas()


class RecentSearches(StatefulProcessor):
    def __init__(self, ttl_seconds: int, bucket_seconds: int):
        self.ttl, self.bucket = ttl_seconds * 1_000_000, bucket_seconds * 1_000_000
        self.segment = -(-SEGMENT_TTLS * self.ttl // self.bucket) * self.bucket  # whole buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "segment long, block long", "rows binary")
        self.last = handle.getValueState("last", "rows binary")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        block, n = [], 0
        for frame in rows:
            block.append(pd.DataFrame({"k": frame["cache_key"], "t": frame["ts"].astype("datetime64[us]").astype("int64"), "e": frame["event_id"].astype("int64")}))
            n += len(frame)
            if n >= BLOCK_ROWS:
                yield from self._take(pd.concat(block), timerValues.getCurrentWatermarkInMs())
                block, n = [], 0
        if n:
            yield from self._take(pd.concat(block), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.due.exists() and self.due.get()[0] != expiredTimerInfo.getExpiryTimeInMs():
            return  # an earlier one took its place
        self.due.clear()
        watermark = timerValues.getCurrentWatermarkInMs()
        places, nxt = {}, []
        for s, block in self.waiting.keys():
            places.setdefault(s, []).append(block)
        for s in sorted(places):
            if (s * self.segment + self.bucket) // 1000 > watermark:
                nxt.append((s * self.segment + self.bucket) // 1000)
                break
            held = pd.concat([_unpack(self.waiting.getValue((s, block))[0]) for block in places[s]])
            for block in places[s]:
                self.waiting.removeKey((s, block))
            end = (held["t"] // self.bucket + 1) * self.bucket // 1000
            if (end > watermark).any():
                self.waiting.updateValue((s, 0), (_pack(held[end > watermark]),))
                nxt.append(int(end[end > watermark].min()))
            if (end <= watermark).any():
                yield self._decided(held[end <= watermark], s * self.segment)
        if self.last.exists():
            known = _unpack(self.last.get()[0])
            forget = -(-(known["t"] + self.ttl) // self.bucket) * self.bucket // 1000
            known, forget = known[forget > watermark], forget[forget > watermark]
            if len(known):
                self.last.update((_pack(known),))
                nxt.append(int(forget.min()))
            else:
                self.last.clear()
        if nxt:
            self._wake(min(nxt))

    def _wake(self, ms: int) -> None:
        """The slice's one timer, no later than this."""
        now = self.due.get()[0] if self.due.exists() else None
        if now is None or ms < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def _take(self, rows: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        end = (rows["t"] // self.bucket + 1) * self.bucket // 1000
        late, rows, end = rows[end <= watermark], rows[end > watermark], end[end > watermark]
        if len(rows):
            self._wake(int(end.min()))
            for s, part in rows.groupby(rows["t"] // self.segment, sort=False):
                block = 0
                while self.waiting.containsKey((int(s), block)):
                    block += 1
                self.waiting.updateValue((int(s), block), (_pack(part),))
        if len(late):
            known = self._known()
            before = late["t"] < late["k"].map(known).fillna(NEVER).astype("int64")  # earlier than what is known: misses that change nothing
            yield self._out(late[before], np.zeros(int(before.sum()), dtype=bool))
            late = late[~before]
            for _, part in late.groupby(late["t"] // self.segment, sort=True):
                yield self._decided(part)

    def _known(self) -> pd.Series:
        """Last computation times by key."""
        known = _unpack(self.last.get()[0]) if self.last.exists() else pd.DataFrame({"k": [], "t": np.array([], np.int64)})
        return pd.Series(known["t"].to_numpy(), index=known["k"].to_numpy(), dtype="int64")

    def _decided(self, rows: pd.DataFrame, forget: int | None = None) -> pd.DataFrame:
        rows = rows.sort_values(["k", "t", "e"])
        keys, code = np.unique(rows["k"].to_numpy().astype(object), return_inverse=True)
        known = self._known()
        if forget is not None:  # times that no longer count then
            known = known[known + self.ttl > forget]
        last = known.reindex(keys, fill_value=NEVER).to_numpy().copy()
        hits = decide_all(code, rows["t"].to_numpy(), last, self.ttl)
        known = pd.concat([known[~known.index.isin(keys)], pd.Series(last, index=keys, dtype="int64")])
        self.last.update((_pack(pd.DataFrame({"k": known.index.to_numpy(), "t": known.to_numpy()})),))
        self._wake(int((-(-(last + self.ttl) // self.bucket) * self.bucket // 1000).min()))  # forget it then
        return self._out(rows, hits)

    @staticmethod
    def _out(rows: pd.DataFrame, hits: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"cache_key": rows["k"].to_numpy(), "event_id": rows["e"].to_numpy(), "ts": rows["t"].to_numpy().astype("datetime64[us]"), "hit": hits})

    def close(self) -> None:
        pass


def suppress_stream(requests: DataFrame, order_within: str = "1 hour", ttl_seconds: int = rules.CACHE_TTL_SECONDS, bucket_seconds: int = BUCKET_SECONDS,
                    slices: int = SLICES) -> DataFrame:
    """(cache_key, event_id, ts) stream -> the same rows with ``hit``, each once it is decided.
    Requests may come in any order; the rule holds exactly for those at most ``order_within`` behind
    the newest. Rows without a key or a time are left out. The session's state store must be ``STATE_STORE``."""
    timed = (requests.where("cache_key IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", order_within)
             .select(F.pmod(F.xxhash64("cache_key"), F.lit(slices)).alias("slice"), "cache_key", "event_id", F.timestamp_micros(F.unix_micros("ts")).alias("ts")))
    return timed.groupBy("slice").transformWithStateInPandas(
        statefulProcessor=RecentSearches(ttl_seconds, bucket_seconds), outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode="EventTime")


def suppress_batch_sql() -> str:
    """The same rule as a batch SQL statement (DuckDB), over ``requests(cache_key, event_id, ts)``."""
    ttl = rules.CACHE_TTL_SECONDS * 1_000_000
    return f"""SELECT cache_key, r.id AS event_id, make_timestamp(r.t) AS ts, r.hit AS hit FROM (
  SELECT cache_key, unnest(list_reduce(evs, lambda acc, x: CASE
      WHEN acc.last IS NOT NULL AND x.t - acc.last < {ttl}
      THEN struct_pack(last := acc.last, out := list_append(acc.out, struct_pack(id := x.id, t := x.t, hit := TRUE)))
      ELSE struct_pack(last := x.t, out := list_append(acc.out, struct_pack(id := x.id, t := x.t, hit := FALSE))) END,
    struct_pack(last := NULL::BIGINT, out := []::STRUCT(id BIGINT, t BIGINT, hit BOOLEAN)[])).out) AS r
  FROM (SELECT cache_key, list(struct_pack(id := event_id, t := epoch_us(ts)) ORDER BY ts, event_id) AS evs
        FROM requests GROUP BY cache_key) g) s"""
