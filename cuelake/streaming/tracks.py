"""Track rules on unbounded streams.

Samples may arrive in any order.  They wait in state until event time has passed them and then go through the rules in
order of (time, number), so a stream gives what the batch operators give wherever the watermark's delay covers the
disorder.  Rows behind the watermark are not dropped: they go through the rules as soon as they arrive and get a new
time after the last accepted one.  State lives in the state store, so a restart resumes where it stopped; a track's
state is its rows of the last ``delay`` and a few values.  Tracks share the store's keys by groups.
"""

from __future__ import annotations

import json
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, StringType, StructType

from cuelake.functions.text import fold_text
from cuelake.operators.runs import log_sanitise, stage_classify
from cuelake.operators.sampling import BEFORE_FIRST, gate_walk, repair_times

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = StructType().add("json", StringType())
PIECE = StructType().add("rows", BinaryType())
HALF_SECOND_US = 500_000


def use_rocksdb(spark) -> None:
    """The stateful operators below need this provider on the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: Groups of tracks, at most; each is one key of the state store.
GROUPS = 1024
#: Rows of one element of the waiting list, at most; as many are walked at once.
PIECE_ROWS = 16384
#: The group of rows without a track, and the ``n`` of rows without a number: a missing value would turn whole numbers to floats.
NO_TRACK = -1
NO_NUMBER = -(1 << 63)


class _InOrder(StatefulProcessor):
    """Lets rows wait until the watermark has passed them, then walks each track's rows in order.

    Every call to the state store is a round trip, so the tracks of a group share a key: one list of waiting rows (in
    packed pieces) and one timer, at the earliest waiting row or at what else a walk waits for.  A subclass names the
    columns of a row (``ts_us`` and ``n`` first), the columns it gives and the start of its walk's state, and walks
    rows of one track at a time.
    """

    columns: dict[str, pa.DataType] = {}
    gives: list[str] = []
    start: dict = {}

    def init(self, handle):
        self._handle = handle
        self._state = handle.getValueState("tracks", STATE)
        self._waiting = handle.getListState("waiting", PIECE)
        self._row = pa.schema([("track_id", pa.int64()), *self.columns.items()])

    def close(self):
        pass

    def walk(self, state, rows, done):
        """Take the next rows of a track (tuples in order of ``columns``); append what is final to ``done``."""
        raise NotImplementedError

    def passed(self, state, watermark_ms, done):
        """Event time has passed ``watermark_ms`` and no row up to there waits."""

    def wakes_at(self, state):
        """Event time in milliseconds at which ``passed`` has something to do without new rows, or None."""
        return None

    def _load(self):
        known = self._state.get()
        return json.loads(known[0]) if known is not None else {"timer": None, "next": None, "walks": []}

    def handleInputRows(self, key, rows, timerValues):
        arrived = pa.concat_tables([pa.Table.from_pandas(pdf, self._row, preserve_index=False) for pdf in rows])
        # A row without a number is no sample.
        arrived = arrived.filter(pc.not_equal(arrived["n"], NO_NUMBER)).replace_schema_metadata()
        if arrived.num_rows:
            yield from self._go_on(key, self._load(), timerValues.getCurrentWatermarkInMs(), arrived)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self._load()
        if state["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            state["timer"] = None
            yield from self._go_on(key, state, timerValues.getCurrentWatermarkInMs(), self._row.empty_table())

    def _go_on(self, key, state, watermark_ms, arrived):
        """Walk what event time has passed; rows go to the store only if they have to wait."""
        walks, found, rows = dict(state["walks"]), [], arrived
        stored = state["next"] is not None and state["next"] // 1000 < watermark_ms
        if stored:
            rows, state["next"] = pa.concat_tables([*(_unpacked(piece) for (piece,) in self._waiting.get()), arrived]), None
        is_due = pc.less(rows["ts_us"], watermark_ms * 1000)
        for track, due in self._in_order(rows.filter(is_due)):
            self._tell(found, track, self.walk, walks.setdefault(track, dict(self.start)), due)
            if len(found) >= PIECE_ROWS:
                yield self._frame(key, found)
                found.clear()
        self._keep(rows.filter(pc.invert(is_due)), state, afresh=stored)
        for track, walk in walks.items():
            self._tell(found, track, self.passed, walk, watermark_ms)
        # A track that begins anew needs no state.
        state["walks"] = [(track, walk) for track, walk in walks.items() if walk != self.start]
        self._wake(state)
        self._state.update((json.dumps(state),))
        if found:
            yield self._frame(key, found)

    def _in_order(self, rows):
        """Tracks and their rows in order of (time, number), of a long track a piece at a time."""
        rows = rows.sort_by([("track_id", "ascending"), ("ts_us", "ascending"), ("n", "ascending")])
        for at in range(0, rows.num_rows, PIECE_ROWS):
            columns = [rows[name].slice(at, PIECE_ROWS).to_pylist() for name in self._row.names]
            for track, same in groupby(zip(*columns), key=itemgetter(0)):
                yield track, [row[1:] for row in same]

    @staticmethod
    def _tell(found, track, step, *given):
        done = []
        step(*given, done)
        found += [(track, *row) for row in done]

    def _keep(self, rest, state, afresh):
        """Store rows that wait, beside the stored ones or in their place."""
        if afresh and not rest.num_rows:
            self._waiting.clear()
        for at in range(0, rest.num_rows, PIECE_ROWS):
            (self._waiting.put if afresh and at == 0 else self._waiting.appendList)([(_packed(rest.slice(at, PIECE_ROWS)),)])
        state["next"] = min((x for x in (state["next"], pc.min(rest["ts_us"]).as_py()) if x is not None), default=None)

    def _wake(self, state):
        times = [None if state["next"] is None else state["next"] // 1000, *(self.wakes_at(walk) for _, walk in state["walks"])]
        wake = min((x + 1 for x in times if x is not None), default=None)
        if wake != state["timer"]:
            if state["timer"] is not None:
                self._handle.deleteTimer(state["timer"])
            if wake is not None:
                self._handle.registerTimer(wake)
            state["timer"] = wake

    def _frame(self, key, found):
        columns = dict(zip(("track_id", *self.gives), zip(*found)))
        if key[0] == NO_TRACK:
            columns["track_id"] = [None] * len(found)
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()})


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(piece: bytes) -> pa.Table:
    return pa.ipc.open_stream(piece).read_all()


def _by_track(samples: DataFrame, processor: _InOrder, schema: str, delay: str) -> DataFrame:
    # The watermark's column does not reach the operator: rows behind the watermark would be dropped before it.
    timed = samples.withColumn("_at", F.timestamp_micros("ts_us")).withWatermark("_at", delay)
    # A row without a time is behind every watermark.
    given = {"ts_us": F.coalesce("ts_us", F.lit(-1)), "n": F.coalesce("n", F.lit(NO_NUMBER))}
    group = F.when(F.col("track_id").isNull(), NO_TRACK).otherwise(F.pmod(F.xxhash64("track_id"), F.lit(GROUPS)))
    return (timed.select(group.alias("group"), F.coalesce("track_id", F.lit(NO_TRACK)).alias("track_id"),
                         *(given.get(c, F.col(c)).alias(c) for c in processor.columns))
            .groupBy("group").transformWithStateInPandas(processor, f"track_id long, {schema}", "append", "eventTime"))


class _Gate(_InOrder):
    """``newest`` is the latest arrival time walked, ``last`` the last given time, ``kept`` that of the last kept row."""

    columns = {"ts_us": pa.int64(), "n": pa.int64(), "pts_ms": pa.float64(), "fps": pa.float64(), "changed": pa.bool_()}
    gives = ["n", "ts_us", "repaired", "kept", "late"]
    start = {"newest": None, "last": BEFORE_FIRST, "kept": None}

    def __init__(self, interval_us):
        self.interval_us = interval_us

    def walk(self, state, rows, done):
        times, repaired, state["last"] = repair_times([(n - 1, -1 if pts is None else pts, fps) for _, n, pts, fps, _ in rows], state["last"])
        kept, state["kept"] = gate_walk(zip(times, (bool(row[4]) for row in rows)), state["kept"], self.interval_us)
        newest = state["newest"]
        for (at, n, *_), time, again, keep in zip(rows, times, repaired, kept):
            late = newest is not None and [at, n] < newest
            newest = newest if late else [at, n]
            done.append((n, time, again, keep, late))
        state["newest"] = newest


def stream_ocr_gate(samples: DataFrame, interval_us: int, delay: str = "0 seconds") -> DataFrame:
    """Time repair and gate of samples (``track_id, n, ts_us, pts_ms, fps, changed``) in order of ``ts_us``.

    Gives ``n, ts_us, repaired, kept, late``.  A sample leaves when event time has passed its ``ts_us`` by ``delay``;
    one that comes later than that is taken after those before it (``late``) and so gets a new time; none is dropped.
    """
    return _by_track(samples, _Gate(interval_us), "n long, ts_us long, repaired boolean, kept boolean, late boolean", delay)


def stream_late_audit(gated: DataFrame) -> DataFrame:
    """Samples, re-timed samples and late samples per track, live, chained to the gate's stream."""
    return gated.groupBy("track_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if("repaired").alias("repaired"),
                                         F.count_if("late").alias("late"))


class _Cues(_InOrder):
    """Gate, backdating, intervals and merging as one walk over a track's samples.

    ``event`` is the last event, whose end is not known yet; ``cue`` is the cue that may
    still grow; ``before`` is the key of the event before ``event``, null after an empty one.
    """

    columns = {"ts_us": pa.int64(), "n": pa.int64(), "text": pa.string(), "changed": pa.bool_()}
    gives = ["cue_n", "start_us", "end_us", "text", "given_us"]
    start = {"sample": None, "n": None, "kept": None, "event": None, "before": None, "cue": None}

    def __init__(self, interval_us, tail_us, idle_us):
        self.interval_us, self.tail_us, self.idle_us = interval_us, tail_us, idle_us

    def walk(self, state, rows, done):
        for row in rows:
            self._take(state, *row, done)

    def _take(self, state, time, n, text, changed, done):
        if state["sample"] is not None and (time, n) <= (state["sample"], state["n"]):
            # Behind what was accepted already: one sample step after it, and told.
            time, given = state["sample"] + self.tail_us, time
            done.append((n, time, time, text, given))
        elif state["sample"] is not None and time > state["sample"] + self.idle_us:
            self._finish(state, done)
        self._sample(state, n, time, text or "", bool(changed), done)

    def wakes_at(self, state):
        return None if state["sample"] is None else (state["sample"] + self.idle_us) // 1000

    def passed(self, state, watermark_ms, done):
        if state["sample"] is not None and (state["sample"] + self.idle_us) // 1000 < watermark_ms:
            self._finish(state, done)

    def _finish(self, state, done):
        if state["event"]:
            self._end_event(state, state["sample"] + self.tail_us, done)
        self._close(state, done)
        state.update(self.start)

    def _sample(self, state, n, time, text, changed, done):
        prior, state["sample"], state["n"] = state["sample"], time, n
        (keep,), clock = gate_walk([(time, changed)], state["kept"], self.interval_us)
        if not keep:
            return
        prior_kept, state["kept"] = state["kept"], clock
        event, at, word = state["event"], time, fold_text(text)
        if event:
            if word != event["key"] and not changed:
                at = max(prior_kept, round((prior + time) / 2))
            self._end_event(state, at, done)
        state["event"] = {"n": n, "at": at, "text": text, "key": word}

    def _end_event(self, state, end, done):
        event, cue = state["event"], state["cue"]
        end = event["at"] + HALF_SECOND_US if end <= event["at"] else end
        if event["text"] == "":
            self._close(state, done)
            state["before"] = None
            return
        if cue and state["before"] == event["key"]:
            cue["end"] = end
        else:
            self._close(state, done)
            state["cue"] = {"n": event["n"], "start": event["at"], "end": end, "text": event["text"]}
        state["before"] = event["key"]

    def _close(self, state, done):
        cue, state["cue"] = state["cue"], None
        if cue:
            done.append((cue["n"], cue["start"], cue["end"], cue["text"], None))


def stream_cue_rows(samples: DataFrame, interval_us: int, tail_us: int = HALF_SECOND_US, *, idle_us: int,
                    delay: str = "0 seconds") -> DataFrame:
    """Finished cues of a sample stream (``track_id, n, ts_us, text, changed``), and its late samples beside them.

    A cue leaves when its text changes, or when event time has passed the track's last sample by ``idle_us``; a track
    that goes on after that starts anew.  Event time is the latest ``ts_us`` of all tracks less ``delay``; samples
    wait for it, so they may arrive in any order.  A sample that is not after the last one taken is taken ``tail_us``
    (one sample step) after it; such a sample is also given as a row of its own: its number and text, its new time,
    and in ``given_us``, which is null for cues, the time it came with.  A row without ``n`` is no sample and only
    moves event time.
    """
    return _by_track(samples, _Cues(interval_us, tail_us, idle_us),
                     "cue_n long, start_us long, end_us long, text string, given_us long", delay)


def stream_cues(samples: DataFrame, interval_us: int, tail_us: int = HALF_SECOND_US, *, idle_us: int,
                delay: str = "0 seconds") -> DataFrame:
    """The cues of ``stream_cue_rows``."""
    return stream_cue_rows(samples, interval_us, tail_us, idle_us=idle_us, delay=delay).where("given_us IS NULL").drop("given_us")


def stream_progress(lines: DataFrame) -> DataFrame:
    """Highest percent and number of understood lines per run, live."""
    known = stage_classify(log_sanitise(lines)).where("stage is not null")
    return known.groupBy("run_id").agg(F.max("percent").cast("long").alias("percent"),
                                       F.count(F.lit(1)).alias("lines"))
