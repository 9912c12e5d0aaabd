"""Dialogue sessions as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = ("session string, turn long, accepted boolean, from_codes string, to_ids string, departure_dates string, "
          "duration_id string, rooms int, reason string")
PAYLOAD = "from_codes array<string>, to_ids array<string>, departure_dates array<string>, duration_id string, rooms int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _present(value) -> list:
    return [] if value is None else list(value)


class SessionFold(StatefulProcessor):
    """Merges turns in the order of their numbers.

    The payload so far is one value; turns that came early are entries of a
    map by number, each written once and removed once, so a batch touches only
    the turns that it brings or releases. A timer ends an idle session.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.merged = handle.getValueState("merged", f"turn long, timer long, {PAYLOAD}")
        self.early = handle.getMapState("early", "turn long", PAYLOAD)

    def _refused(self, session, number: int, expected: int) -> tuple:
        return (session, number, False, None, None, None, None, None, f"expected turn {expected}")

    def _report(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"rooms": "Int32"})

    def _give_up(self, session, turn: int) -> list[tuple]:
        """Report and forget the turns that still wait."""
        waiting = sorted(int(k[0]) for k in self.early.keys())
        for number in waiting:
            self.early.removeKey((number,))
        return [self._refused(session, n, turn + 1) for n in waiting]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session, out = key[0], []
        turn, timer, origins, places, dates, duration, rooms = self.merged.get() if self.merged.exists() else (-1, None, [], [], [], None, None)
        origins, places, dates = list(origins), list(places), list(dates)
        for chunk in rows:
            for row in chunk.itertuples():
                number = int(row.turn)
                if number <= turn or self.early.containsKey((number,)):
                    out.append(self._refused(session, number, turn + 1))
                    continue
                count = int(row.rooms) if row.rooms is not None and not pd.isna(row.rooms) else None
                said = (_present(row.from_codes), _present(row.to_ids), _present(row.departure_dates), row.duration_id, count)
                if number > turn + 1:
                    self.early.updateValue((number,), said)
                    continue
                while said is not None:
                    turn += 1
                    more_origins, more_places, own_dates, own_duration, own_rooms = said
                    origins = list(dict.fromkeys(origins + list(more_origins)))
                    places = list(dict.fromkeys(places + list(more_places)))
                    dates, duration = list(own_dates) or dates, own_duration or duration
                    rooms = rooms if own_rooms is None else own_rooms
                    out.append((session, turn, True, ",".join(origins), ",".join(places), ",".join(dates), duration, rooms, None))
                    said = None
                    if self.early.containsKey((turn + 1,)):
                        said = self.early.getValue((turn + 1,))
                        self.early.removeKey((turn + 1,))
        if self.ttl_ms is None:
            out += self._give_up(session, turn)
        else:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms
            self.handle.registerTimer(timer)
        self.merged.update((turn, timer, origins, places, dates, duration, rooms))
        yield from self._report(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._give_up(key[0], int(self.merged.get()[0])) if self.merged.exists() else []
        self.merged.clear()
        yield from self._report(out)

    def close(self) -> None:
        pass


def fold_stream(turns: DataFrame, ttl: str | None = "1 hour") -> DataFrame:
    """Merge turns per session as they arrive, one output row per turn.

    Turns apply in order of their number. A turn that comes early waits in the
    state until the gap before it closes, however turns are chunked; one that
    comes again is reported. Idle sessions end after `ttl`, which bounds the
    state, and turns that still wait then are reported as missing their
    predecessor. A finite feed (trigger availableNow) takes ttl=None, because
    timers keep such a run going: what is early at the end of a batch is
    reported, so such a feed comes as one batch (files_per_trigger=None). The
    keyed state needs the RocksDB store, which is chosen where the session names another.
    """
    spark = turns.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    ttl_ms = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)
    return turns.groupBy("session").transformWithStateInPandas(
        statefulProcessor=SessionFold(ttl_ms), outputStructType=OUTPUT, outputMode="Append",
        timeMode="None" if ttl is None else "ProcessingTime")
