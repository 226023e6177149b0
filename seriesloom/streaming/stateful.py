"""Stateful streams: ticks, keyframes, change detection and the monitor.

Each stream keeps a few numbers per series and settles whole stretches of rows at once, with the same
closed forms as the batch side, so both give the same rows. Whole-series facts (spreads, means,
policies) come in as columns joined from a static calibration table. The rows of a series are
numbered without gaps: rows that arrive before an earlier number wait in the state until it is there,
so the order of arrival does not matter.

A row with ``closing = true`` ends a series; what still waits is then settled in order. With an
event time, the watermark bounds all state: a row waits for missing numbers only while they could still
come in time, a series that is silent for ``patience`` ends by itself, and the mark of an ended series goes as
soon as a replay of it would be late. Without one, marks and waiting rows stay for ``ttl`` of processing time,
or for ever if that isn't given either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seriesloom.operators.health import ADDRESS, CUSUM_SLACK, EVENTS, LATCHED, _clean, monitor_close, monitor_step, reflected
from seriesloom.operators.keyframes import two_rail_rule


def _struct(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


LONG, DOUBLE, STRING, DOUBLES = T.LongType(), T.DoubleType(), T.StringType(), T.ArrayType(T.DoubleType())
TICKS = _struct(n=LONG, h=DOUBLE, step_rows=LONG)
KEYS = _struct(n=LONG, rail=STRING)
WALK = _struct(n=LONG, s=DOUBLE, w=DOUBLE, alarm=T.BooleanType())
PLACE = _struct(next=LONG, ended=T.BooleanType(), newest=LONG, due=LONG)


@dataclass(frozen=True)
class Carry:
    """The state of a walk as typed columns, and how to get from one to the other."""

    schema: T.StructType
    to_row: Callable[[list], dict]
    from_row: Callable[[dict], list]


class SeriesWalk(StatefulProcessor):
    """Settles the rows of a series in the order of ``n``.

    State of a series: its place (next number, newest time, when it is due to end), the walk's carry, and a map of
    the rows that wait for a missing number.
    """

    def __init__(self, keys, rows, emits, carry, walk, close, first, event_time, patience, ttl) -> None:
        self.keys, self.emits, self.carry, self.walk, self.close_series = keys, emits, carry, walk, close
        self.first, self.event_time, self.patience, self.ttl = first, event_time, patience, ttl
        self.held = T.StructType([f for f in rows if f.name not in (*keys, "n", "closing")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE, self.ttl)
        self.state = handle.getValueState("carry", self.carry.schema, self.ttl)
        self.waiting = handle.getMapState("waiting", _struct(n=LONG), self.held, self.ttl)

    # -- pieces of state ----------------------------------------------------------------------
    def _recall(self) -> list | None:
        if not self.state.exists():
            return None
        row = dict(zip(self.carry.schema.fieldNames(), self.state.get()))
        return self.carry.from_row({k: list(v) if isinstance(v, (list, tuple, np.ndarray)) else v for k, v in row.items()})

    def _remember(self, state: list) -> None:
        row = self.carry.to_row(state)
        self.state.update(tuple(row.get(name) for name in self.carry.schema.fieldNames()))

    def _waiting_rows(self) -> pd.DataFrame:
        if not self.waiting.exists():
            return pd.DataFrame(columns=["n", *self.held.fieldNames()])
        return pd.DataFrame([(*n, *row) for n, row in self.waiting.iterator()], columns=["n", *self.held.fieldNames()])

    def _forget(self) -> None:
        for state in (self.place, self.state, self.waiting):
            state.clear()

    @staticmethod
    def _plain(value):
        if isinstance(value, np.ndarray):
            return value.tolist()
        if isinstance(value, pd.Timestamp):
            return value.to_pydatetime()
        return value.item() if isinstance(value, np.generic) else value

    def _ms(self, times: pd.Series) -> np.ndarray:
        return pd.to_datetime(times, utc=True).dt.as_unit("ms").astype("int64").to_numpy()

    def _named(self, key: tuple, parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in parts if len(p)]
        if parts:
            pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
            yield pd.DataFrame({**dict(zip(self.keys, key)), **{name: pdf[name].array for name in self.emits.fieldNames()}})

    def _ended(self, parts: list[pd.DataFrame], state: list | None) -> list[pd.DataFrame]:
        if self.close_series:
            parts.append(self.close_series(state))
        return parts

    # -- rows and timers ----------------------------------------------------------------------
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Every look at the state is a call to the JVM, so a series that begins and ends here makes two.
        come = list(rows)
        come = pd.concat(come, ignore_index=True) if len(come) > 1 else come[0]
        known = self.place.exists()
        nxt, ended, newest, due = self.place.get() if known else (self.first, False, None, None)
        if ended:
            return  # a replay
        closing = come["closing"].astype(bool).to_numpy()
        ends = bool(closing.any())
        last = int(self._ms(come[self.event_time]).max()) if self.event_time else None
        new = ~closing & (come["n"] >= nxt).to_numpy(dtype=bool)
        count = int(new.sum())
        come = come.iloc[:count] if new[:count].all() else come[new]
        held: set = set()
        if known and len(old := self._waiting_rows()):
            held = set(old["n"])
            come = pd.concat([old, come[list(old)]] if len(come) else [old], ignore_index=True)
        if (np.diff(come["n"].to_numpy()) <= 0).any():
            come = come.drop_duplicates("n").sort_values("n", ignore_index=True)
        ready = len(come) if ends else int(np.logical_and.accumulate(come["n"].to_numpy() == nxt + np.arange(len(come))).sum())
        state = self._recall() if known and (ready or ends) else None
        parts, nxt, state = self._settle(come, ready, nxt, state)
        if ends:
            parts = self._ended(parts, state)
            if known:
                self._forget()
            self.place.update((nxt, True, last, last))
            if self.event_time:
                self.handle.registerTimer(last + 1)
        else:
            self._settled(come, ready, held, state)
            if ready < len(come):
                self._wait(come[["n", *self.held.fieldNames()]].iloc[ready:], held)
            newest = last if newest is None else max(newest, last or newest)
            if self.patience is not None and due != newest + self.patience:
                if due is not None:
                    self.handle.deleteTimer(due)
                due = newest + self.patience
                self.handle.registerTimer(due)
            self.place.update((nxt, False, newest, due))
        yield from self._named(key, parts)

    def _settle(self, come: pd.DataFrame, ready: int, nxt: int, state: list | None) -> tuple[list[pd.DataFrame], int, list | None]:
        if not ready:
            return [], nxt, state
        after, out = self.walk(state, come.iloc[:ready] if ready < len(come) else come)
        return [out], int(come["n"].iloc[ready - 1]) + 1, state if after is None else after

    def _settled(self, come: pd.DataFrame, ready: int, held: set, state: list | None) -> None:
        """Keep what a series that goes on needs of its settled rows."""
        if ready and state is not None:
            self._remember(state)
        for n in held.intersection(come["n"].iloc[:ready]):
            self.waiting.removeKey((int(n),))

    def _wait(self, rest: pd.DataFrame, held: set) -> None:
        new = rest[~rest["n"].isin(held)]
        for row in new.itertuples(index=False):
            self.waiting.updateValue((int(row[0]),), tuple(self._plain(v) for v in row[1:]))
        if self.event_time and len(new):
            for at in np.unique(self._ms(new[self.event_time])):
                self.handle.registerTimer(int(at) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.place.exists():
            return
        nxt, ended, newest, due = self.place.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if ended:
            if newest is not None and now > newest:
                self._forget()
            return
        over = self.patience is not None and newest + self.patience <= now
        rows = self._waiting_rows().sort_values("n", ignore_index=True)
        parts: list[pd.DataFrame] = []
        state = self._recall() if len(rows) or over else None
        if len(rows):
            # What should have come before a row whose time is over can't come any more.
            past = np.flatnonzero(self._ms(rows[self.event_time]) < now)
            ready = len(rows) if over else int(past[-1]) + 1 if len(past) else 0
            while ready < len(rows) and ready and rows["n"].iloc[ready] == rows["n"].iloc[ready - 1] + 1:
                ready += 1
            parts, nxt, state = self._settle(rows, ready, nxt, state)
            if not over:
                self._settled(rows, ready, set(rows["n"]), state)
        if over:
            parts = self._ended(parts, state)
            self._forget()
        else:
            self.place.update((nxt, False, newest, due))
        yield from self._named(key, parts)


def keyed_stream(
    rows: DataFrame,
    keys: list[str],
    emits: T.StructType,
    carry: Carry,
    walk: Callable[[list | None, pd.DataFrame], tuple[list | None, pd.DataFrame]],
    close: Callable[[list | None], pd.DataFrame] | None = None,
    first: int = 0,
    event_time: str | None = None,
    patience: str | None = None,
    ttl: str | None = None,
) -> DataFrame:
    """Run ``walk(state, rows in order of n)`` over each key; the first row of a series has n = ``first``.

    ``event_time`` names a column with a watermark, which every row (a closing one too) has; ``patience`` is how long a
    series may be silent by it before it ends. ``ttl`` is for streams without event time. A task holds the rows of
    one key in one micro-batch and those that wait for a missing number.
    """
    if patience is not None and event_time is None:
        raise ValueError("patience goes by event time")
    span = lambda text: None if text is None else int(pd.Timedelta(text).total_seconds() * 1000)
    schema = T.StructType([rows.schema[k] for k in keys] + list(emits))
    kept = None if event_time else span(ttl)
    processor = SeriesWalk(keys, rows.schema, emits, carry, walk, close, first, event_time, span(patience), kept)
    mode = "EventTime" if event_time else "ProcessingTime" if kept else "None"
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", mode)


# -- ticks --------------------------------------------------------------------------------------
def _ticks(carry: dict, da: np.ndarray, di: np.ndarray, n: np.ndarray, edge: np.ndarray) -> pd.DataFrame:
    """Settle rows with known gradients: climb, crossings of the step, and the queue of pending ticks."""
    h = carry["h"] + np.cumsum(np.hypot(da / carry["s_a"], di / carry["s_i"]))
    crossed = np.diff(np.floor(np.concatenate([[carry["h"]], h]) / carry["eps"]))
    queue = reflected(carry["queue"], crossed - 1.0)
    fires = np.concatenate([[carry["queue"]], queue[:-1]]) + crossed >= 1.0
    at = np.flatnonzero(fires | edge)
    out = pd.DataFrame({"n": n[at], "h": h[at], "step_rows": np.diff(n[at], prepend=carry["last"])})
    carry.update(h=float(h[-1]), queue=float(queue[-1]), last=int(n[at[-1]]) if len(at) else carry["last"])
    return out


def tick_walk(state: list | None, pdf: pd.DataFrame) -> tuple[list, pd.DataFrame]:
    """Two carried rows and the new ones give the gradients of all rows but the last."""
    if state is None:
        carry = {c: float(pdf[c].iloc[0]) for c in ("s_a", "s_i", "eps")}
        carry.update(h=0.0, queue=0.0, last=0, n=[], a=[], i=[])
    else:
        carry = state[0]
    opening = len(carry["n"]) < 2
    n, a, i = (np.concatenate([carry[c], pdf[c].to_numpy(dtype=float)]) for c in ("n", "a", "i"))
    carry.update(n=n[-2:].tolist(), a=a[-2:].tolist(), i=i[-2:].tolist())
    slopes = [(v[2:] - v[:-2]) / 2.0 for v in (a, i)]
    if opening and len(n) > 1:
        slopes = [np.concatenate([[v[1] - v[0]], s]) for v, s in zip((a, i), slopes)]
    if not len(slopes[0]):
        return [carry], pd.DataFrame(columns=TICKS.fieldNames())
    rows = n[len(n) - 1 - len(slopes[0]) : -1].astype(np.int64)
    edge = np.zeros(len(rows), bool)
    edge[0] = opening
    return [carry], _ticks(carry, *slopes, rows, edge)


def tick_close(state: list | None) -> pd.DataFrame:
    if state is None:
        return pd.DataFrame(columns=TICKS.fieldNames())
    carry = state[0]
    slopes = [np.diff(carry[c]) if len(carry["n"]) > 1 else np.zeros(1) for c in ("a", "i")]
    return _ticks(carry, *slopes, np.array(carry["n"][-1:], dtype=np.int64), np.ones(1, bool))


TICK_CARRY = Carry(
    _struct(s_a=DOUBLE, s_i=DOUBLE, eps=DOUBLE, h=DOUBLE, queue=DOUBLE, last=LONG, n=DOUBLES, a=DOUBLES, i=DOUBLES),
    lambda state: state[0],
    lambda row: [row],
)


def tick_stream(rows: DataFrame, keys: list[str], **times: str) -> DataFrame:
    """Equal-energy ticks of ``n, a, i, closing, s_a, s_i, eps``; ``times`` as in ``keyed_stream``."""
    return keyed_stream(rows, keys, TICKS, TICK_CARRY, tick_walk, tick_close, **times)


# -- keyframes ----------------------------------------------------------------------------------
def keyframe_walk(state: list | None, pdf: pd.DataFrame) -> tuple[list, pd.DataFrame]:
    out, state = two_rail_rule(pdf, state)
    return state, out


KEY_CARRY = Carry(_struct(key=DOUBLES, drift=DOUBLES, before=DOUBLES), lambda state: dict(zip(("key", "drift", "before"), state)), lambda row: list(row.values()))


def keyframe_stream(rows: DataFrame, keys: list[str], **times: str) -> DataFrame:
    """Two-rail keyframes of ``n, za, zi, closing, tau_event, tau_max, leak``; ``times`` as in ``keyed_stream``."""
    return keyed_stream(rows, keys, KEYS, KEY_CARRY, keyframe_walk, **times)


# -- change detection ---------------------------------------------------------------------------
def cusum_walk(threshold: float, slack: float = CUSUM_SLACK):
    def walk(state: list | None, pdf: pd.DataFrame) -> tuple[list, pd.DataFrame]:
        s, w = state or (0.0, 0.0)
        z = pdf["z"].to_numpy(dtype=float)
        s, w = reflected(s, z - slack), reflected(w, z)
        out = pd.DataFrame({"n": pdf["n"].to_numpy(), "s": s, "w": w, "alarm": s >= threshold})
        return [float(s[-1]), float(w[-1])], out

    return walk


WALK_CARRY = Carry(_struct(s=DOUBLE, w=DOUBLE), lambda state: {"s": state[0], "w": state[1]}, lambda row: [row["s"], row["w"]])


def cusum_stream(
    rows: DataFrame, keys: list[str], threshold: float, slack: float = CUSUM_SLACK, first: int = 0, **times: str
) -> DataFrame:
    """Both walks of ``n, z, closing``; ``times`` as in ``keyed_stream``."""
    return keyed_stream(rows, keys, WALK, WALK_CARRY, cusum_walk(threshold, slack), first=first, **times)


# -- monitor ------------------------------------------------------------------------------------
MONITOR_CARRY = Carry(
    _struct(
        kind=STRING, mu=DOUBLE, sigma=DOUBLE, s=DOUBLE, w=DOUBLE, onset=DOUBLE, t_detect_h=DOUBLE, detect_rev=LONG, t_onset_h=DOUBLE,
        **dict(zip(ADDRESS, (STRING, DOUBLE, DOUBLE, DOUBLE))), t=DOUBLES, d=DOUBLES,
    ),
    lambda state: {"kind": state[0], **(state[1] if len(state) > 1 else {})},
    lambda row: LATCHED if row["kind"] == LATCHED[0] else [row.pop("kind"), row],
)


def monitor_stream(rows: DataFrame, keys: list[str], first: int = 0, **times: str) -> DataFrame:
    """Defect events of snapshots ``n, rev_t, rev_bits, rev_base, mu, sigma, closing`` (plus address); ``times`` as in
    ``keyed_stream``."""

    def walk(state: list | None, pdf: pd.DataFrame) -> tuple[list | None, pd.DataFrame]:
        out: list[dict] = []
        for row in pdf.to_dict("records"):
            state, event = monitor_step(state, _clean(row))
            out += [event] if event else []
        return state, pd.DataFrame(out, columns=EVENTS.names)

    def close(state: list | None) -> pd.DataFrame:
        return pd.DataFrame(monitor_close(state), columns=EVENTS.names)

    return keyed_stream(rows, keys, EVENTS.schema, MONITOR_CARRY, walk, close, first, **times)


# -- running a stream ---------------------------------------------------------------------------
def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Process everything the source holds now and return what was written.

    Progress and state live below ``folder``, so running it again only adds new input.
    """
    out, progress = f"{folder}/rows", f"{folder}/progress"
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
