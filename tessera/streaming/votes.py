"""Frames of a scanner as a stream: hashes are matched with an index, and a session's matches vote for a record."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tessera.functions.hashing import distance, hash_bands
from tessera.operators.aggregates import vote
from tessera.operators.places import spread
from tessera.sources.shared import written

VOTES, MAX_DISTANCE = 60, 16
MATCHES = "session long, ts timestamp, candidate long, distance int"
WINNER = "session long, candidate long, votes long, score double"


#: Rows of the index that a byte has at a place in one tile.
TILE = 1 << 14


def match_stream(frames: DataFrame, index: DataFrame, max_distance: int = MAX_DISTANCE, tile: int = TILE) -> DataFrame:
    """Matches (session, ts, candidate, distance) of frames(session, ts, hash), static or streaming, with index(candidate, hash).

    Both meet at equal bytes, each pair at its first one. The index is static: bytes that many of its rows share at a place are
    cut in tiles, to all of which a frame goes, so that no task holds more of the index than a tile a byte. Of static frames, each
    different hash meets the index once, and frames take what their hash has met.
    """
    if not frames.isStreaming:
        near = _near(frames.select("hash").distinct(), index, max_distance, tile)
        return frames.select("session", "ts", "hash").join(near.hint("shuffle_hash"), "hash").select("session", "ts", "candidate", "distance")
    return _near(frames.select("session", "ts", "hash"), index, max_distance, tile).select("session", "ts", "candidate", "distance")


def _near(frames: DataFrame, index: DataFrame, max_distance: int, tile: int) -> DataFrame:
    """Frames (hash and any columns) with candidate and distance, a row for each match."""
    banded = index.select("candidate", F.col("hash").alias("i_hash"), F.posexplode(hash_bands(F.col("hash"))).alias("place", "byte"))
    # 2,048 rows at most
    cuts = banded.groupBy("place", "byte").agg(F.ceil(F.count("*") / tile).cast("int").alias("__tiles"))
    tiled = banded.join(F.broadcast(cuts), ["place", "byte"]).withColumn("__tile", F.pmod(F.xxhash64("candidate", "i_hash"), F.col("__tiles")).cast("int")).drop("__tiles")
    asked = frames.select("*", F.posexplode(hash_bands(F.col("hash"))).alias("place", "byte"))
    asked = asked.join(F.broadcast(cuts), ["place", "byte"]).select(*frames.columns, "place", "byte", F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1)).alias("__tile"))
    differ = F.col("hash").bitwiseXOR(F.col("i_hash"))
    # frames pass by the index and aren't sorted
    met = asked.join(tiled.hint("shuffle_hash"), ["place", "byte", "__tile"])
    near = met.where((F.bit_count(differ) <= max_distance) & (F.array_position(hash_bands(differ), F.lit(0)) == F.col("place") + 1))
    return near.select(*frames.columns, "candidate", distance(F.col("hash"), F.col("i_hash")).alias("distance"))


def vote_batch(matches: DataFrame, window: str = "1 hour") -> DataFrame:
    """The batch twin: one vote per session and tumbling window of event time."""
    held = written(matches, "matches")
    rows = held.select("session", F.window("ts", window)["start"].alias("start"), "candidate", "distance")
    return vote(spread(rows, ["session", "start"], held.count()), ["session", "start"], "candidate", "distance")


def vote_counts(matches: DataFrame, votes: int = VOTES, reset_ms: int | None = None) -> DataFrame:
    """T2's batch twin: every full `votes` matches of a session, in order of time, give a winner, numbered by `block` from 0.

    With reset_ms, a match that comes more than that after the one before it begins a new run, and what the last run had is
    dropped; then (session, run, block) name a vote.
    """
    held = written(matches, "matches")
    w = Window.partitionBy("session").orderBy("ts", "candidate", "distance")
    # all windows have one order, and all groups are in their session's part: rows are shuffled and sorted once
    by, rows = ["session"], spread(held, ["session"], held.count()).withColumn("__place", F.row_number().over(w))
    start = F.lit(1)
    if reset_ms is not None:
        by, at, before = ["session", "run"], F.unix_micros(F.col("ts").cast("timestamp")), w.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__idle", F.coalesce(at - F.lag(at).over(w) > reset_ms * 1000, F.lit(False)))
        rows = rows.withColumns({"run": F.sum(F.col("__idle").cast("int")).over(before), "__start": F.max(F.when(F.col("__idle"), F.col("__place"))).over(before)})
        start = F.coalesce("__start", F.lit(1))
    rows = rows.withColumn("block", F.floor((F.col("__place") - start) / votes))
    scores = rows.groupBy(*by, "block", "candidate").agg((F.avg("distance") / F.count("*")).alias("score"), F.count("*").alias("votes"))
    won = scores.groupBy(*by, "block").agg(F.sum("votes").alias("__n"), F.min(F.struct("score", "candidate", "votes")).alias("w"))
    return won.where(F.col("__n") == votes).select(*by, "block", "w.*")


def vote_windows(matches: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sums per session, window and candidate, for streams: rows later than `late` are dropped with their state. The winner of a
    window is the least of avg / count, as in vote_batch."""
    marked = matches.withWatermark("ts", late)
    sums = marked.groupBy("session", F.window("ts", window).alias("w"), "candidate").agg(F.sum("distance").alias("total"), F.count("*").alias("votes"))
    return sums.select("session", F.col("w.start").alias("start"), "candidate", "votes", (F.col("total") / F.col("votes") / F.col("votes")).alias("score"))


class Votes(StatefulProcessor):
    """Collects a session's matches until there are enough, gives the winner and begins anew. A match that comes more than
    reset_ms of event time after the one before it begins anew, too; a timer drops what the watermark has left behind so far."""

    def __init__(self, votes: int = VOTES, reset_ms: int | None = 1000):
        self.votes, self.reset_ms = votes, reset_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "candidate long", "n long, total long")
        self.last = handle.getValueState("last", "micros long")

    def _rows(self) -> dict[int, tuple[int, int]]:
        return {k[0]: (v[0], v[1]) for k, v in self.seen.iterator()} if self.seen.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._rows(), []
        count = sum(n for n, _ in held.values())
        last = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values(["ts", "candidate", "distance"])
        micros = (batch["ts"].astype("datetime64[us]").astype("int64")).tolist()
        for at, candidate, d in zip(micros, batch["candidate"].tolist(), batch["distance"].tolist(), strict=True):
            if self.reset_ms is not None and last is not None and at - last > self.reset_ms * 1000:
                held, count = {}, 0
            last = at if last is None else max(at, last)
            n, total = held.get(int(candidate), (0, 0))
            held[int(candidate)] = (n + 1, total + int(d))
            count += 1
            if count >= self.votes:
                score, winner, n = min((t / n / n, c, n) for c, (n, t) in held.items())
                out.append((key[0], winner, n, score))
                held, count = {}, 0
        self.seen.clear()
        for candidate, (n, total) in held.items():
            self.seen.updateValue((candidate,), (n, total))
        if self.reset_ms is not None:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.reset_ms + 1)
        yield pd.DataFrame(out, columns=["session", "candidate", "votes", "score"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.last.clear()
        yield pd.DataFrame(columns=["session", "candidate", "votes", "score"])

    def close(self) -> None:
        pass


def vote_stream(matches: DataFrame, votes: int = VOTES, reset_ms: int | None = 1000, late: str = "10 seconds") -> DataFrame:
    """(session, candidate, votes, score) whenever a session has enough matches; needs the RocksDB state store.

    A session that has been idle for more than reset_ms of event time begins anew (None: it waits for ever, and no timers are
    kept). Matches more than `late` behind the newest are dropped; those that come in order of time give what vote_counts gives.
    """
    if reset_ms is not None:
        matches = matches.withWatermark("ts", late)
    return matches.groupBy("session").transformWithStateInPandas(
        statefulProcessor=Votes(votes, reset_ms), outputStructType=WINNER, outputMode="append", timeMode="none" if reset_ms is None else "eventTime"
    )
