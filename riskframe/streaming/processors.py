"""Keyed state machines for transformWithStateInPandas.

All of them work on event time: rows of a key are ordered inside a batch, and
an event-time timer clears the state once it can no longer matter, so state
does not grow with the number of keys ever seen. Rows behind the watermark are
dropped by Spark and counted in the query progress.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from riskframe import lexicons as lx


def _micros(ts: pd.Series) -> pd.Series:
    stamps = pd.to_datetime(ts)
    if stamps.dt.tz is not None:
        stamps = stamps.dt.tz_convert("UTC").dt.tz_localize(None)
    return stamps.astype("datetime64[us]").astype("int64")


class _Ordered(StatefulProcessor):
    """Base: sorts a key's rows of the batch by time and row id."""

    ts, row_id = "ts", "id"

    def ordered(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf["_us"] = _micros(pdf[self.ts])
        return pdf.sort_values(["_us", self.row_id], kind="stable", ignore_index=True)

    def forget_after(self, until_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until_ms)

    def close(self) -> None:
        pass


class Spilled:
    """Frames of one key and batch, kept in the state store while only their times are in memory.

    A key with many rows comes as many frames. All but the last are written to the store, one entry each, and read back
    one at a time; a key with one frame never touches it.
    """

    def __init__(self, store) -> None:
        self.store, self.count, self.last = store, 0, None

    def add(self, pdf: pd.DataFrame) -> None:
        if self.last is not None:
            self.store.updateValue((self.count - 1,), (bytearray(pickle.dumps(self.last, protocol=5)),))
        self.last, self.count = pdf, self.count + 1

    def frames(self) -> Iterator[tuple[int, pd.DataFrame]]:
        """Number and frame, once; the store is empty afterwards."""
        for k in range(self.count - 1):
            yield k, pickle.loads(bytes(self.store.getValue((k,))[0]))
            self.store.removeKey((k,))
        if self.last is not None:
            yield self.count - 1, self.last


FRAME_KEY = T.StructType([T.StructField("frame", T.IntegerType())])
FRAME = T.StructType([T.StructField("rows", T.BinaryType())])


class Cooldown(_Ordered):
    """Pass a row when none was passed for its key within the interval.

    With ``content`` a row is only held back by a passed row of equal content. ``key`` names the column with the key's digest
    where many keys share a group; without it a group is one key. The group's passed rows are one value of the state, read and
    written once a batch; those the watermark has made harmless are left out. Of a group's rows in a batch only time, id, key
    number and a hash of the content are in memory together; the rows themselves wait in the state store.
    """

    def __init__(self, seconds: float, ts: str = "ts", row_id: str = "id", content: str | None = None, key: str | None = None,
                 helpers: tuple[str, ...] = ()) -> None:
        self.step, self.ts, self.row_id, self.content, self.key = int(seconds * 1_000_000), ts, row_id, content, key
        self.helpers = list(helpers)  # columns that do not come out

    def init(self, handle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", T.StructType([T.StructField("keys", T.BinaryType())]))
        self.waiting = handle.getMapState("waiting", FRAME_KEY, FRAME)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = pickle.loads(bytes(self.passed.get()[0])) if self.passed.exists() else {}  # digest: time and content
        number = {digest: k for k, digest in enumerate(last)}
        held = dict(enumerate(last.values()))
        spilled, times, ids, keys, contents, frames = Spilled(self.waiting), [], [], [], [], []
        for pdf in rows:
            times.append(_micros(pdf[self.ts]).to_numpy())
            ids.append(pdf[self.row_id].to_numpy())
            digests = pdf[self.key] if self.key else [b""] * len(pdf)
            keys.append(np.array([number.setdefault(bytes(x), len(number)) for x in digests], dtype=np.int64))
            texts = (xxhash.xxh3_64_intdigest(str(x)) for x in pdf[self.content]) if self.content else [0] * len(pdf)
            contents.append(np.array([*texts], dtype=np.uint64))
            frames.append(len(pdf))
            spilled.add(pdf)
        us, ids, keys, contents = (np.concatenate(x) for x in (times, ids, keys, contents))
        order = np.lexsort((ids, us, keys))
        kept = np.zeros(len(us), dtype=bool)
        for i, k, at, own in zip(order.tolist(), keys[order].tolist(), us[order].tolist(), contents[order].tolist()):
            before = held.get(k)
            if before is None or at - before[0] >= self.step or own != before[1]:
                held[k], kept[i] = (at, own), True
        self.keep({digest: held[k] for digest, k in number.items()}, timerValues)
        begins = np.cumsum([0, *frames])
        for k, pdf in spilled.frames():
            own = kept[begins[k]:begins[k + 1]]
            if own.any():
                yield pdf.loc[own].drop(columns=self.helpers)

    def keep(self, last: dict, timerValues) -> None:
        """Store what may still hold a row back; a timer clears the rest with the newest of it."""
        if timerValues is not None:
            gone = timerValues.getCurrentWatermarkInMs() * 1000
            last = {digest: row for digest, row in last.items() if row[0] + self.step > gone}
        if not last:
            self.passed.clear()
            return
        self.passed.update((bytearray(pickle.dumps(last, protocol=5)),))
        self.forget_after((max(at for at, _ in last.values()) + self.step) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.passed.clear()
        return iter([])


class Claims(_Ordered):
    """Who may process a file: first claimer wins, a pending claim lapses.

    Input ``uri, ts, id, kind, layer`` with kind CLAIM, CAPTURED or PROCESSED;
    emits every claim with the decision.
    """

    def __init__(self, seconds: float = 10) -> None:
        self.step = int(seconds * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", T.StructType([
            T.StructField("us", T.LongType()), T.StructField("layer", T.StringType()), T.StructField("state", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times, ids, kinds, layers = [], [], [], []
        names: dict[str, int] = {}  # kinds and layers are few; rows hold their numbers
        for pdf in rows:
            times.append(_micros(pdf["ts"]).to_numpy())
            ids.append(pdf["id"].to_numpy())
            kinds.append(np.array([names.setdefault(x, len(names)) for x in pdf["kind"]], dtype=np.int32))
            layers.append(np.array([names.setdefault(x, len(names)) for x in pdf["layer"]], dtype=np.int32))
        us_, ids_, kinds_, layers_ = (np.concatenate(x) for x in (times, ids, kinds, layers))
        name = list(names)
        held = self.claim.get() if self.claim.exists() else None
        out = []
        columns = ["uri", "id", "ts", "layer", "granted", "holder"]
        for i in np.lexsort((ids_, us_)).tolist():
            us, row_id, kind, layer = int(us_[i]), int(ids_[i]), name[kinds_[i]], name[layers_[i]]
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
            if held is not None and held[2] == "PENDING_CAPTURE" and us - held[0] > self.step:
                held = None  # the pending claim has lapsed
            if kind == "CLAIM":
                granted = held is None
                if granted:
                    held = (int(us), layer, "PENDING_CAPTURE")
                out.append((key[0], row_id, pd.Timestamp(us, unit="us"), layer, granted, held[1]))
            elif kind == "CAPTURED" and held is not None:
                held = (held[0], held[1], "CAPTURED")
            elif kind == "PROCESSED":
                held = None
        if held is None:
            self.claim.clear()
        else:
            self.claim.update(held)
            if held[2] == "PENDING_CAPTURE":
                self.forget_after((held[0] + self.step) // 1000 + 1)
        yield pd.DataFrame(out, columns=columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.claim.exists() and self.claim.get()[2] == "PENDING_CAPTURE":
            self.claim.clear()
        return iter([])


class WeightAdapter(_Ordered):
    """Adapt the ensemble weights of a tenant to its feedback."""

    def init(self, handle) -> None:
        self.handle = handle
        self.weights = handle.getValueState("weights", T.StructType([
            T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        from riskframe.functions.fusion import weight_step

        pdf = self.ordered(rows)
        start = ([lx.DEFAULT_WEIGHTS[c] for c in lx.COMPONENTS], 0)
        w, n = self.weights.get() if self.weights.exists() else start
        for verdict, scores, correct in zip(pdf["verdict"], pdf["sub_scores"], pdf["is_correct"]):
            w, n = weight_step(w, scores, verdict, bool(correct)), n + 1
        w = [float(x) for x in w]
        self.weights.update((w, n))
        yield pd.DataFrame({"tenant": [key[0]], "weights": [w], "events": [n]})


class RecentBuffer(_Ordered):
    """The newest ``size`` events of a key, re-emitted when they change."""

    def __init__(self, size: int = 500) -> None:
        self.size = size

    def init(self, handle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("recent", T.StructType([
            T.StructField("us", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.buffer.get())
        for pdf in rows:  # never more than the buffer and one frame
            kept = sorted([*kept, *((int(a), int(b), float(c)) for a, b, c in zip(_micros(pdf["ts"]), pdf["id"], pdf["score"]))])[-self.size:]
        self.buffer.put(kept)
        yield pd.DataFrame({
            "tenant": [key[0]], "events": [len(kept)], "mean_score": [sum(k[2] for k in kept) / len(kept)], "newest_id": [kept[-1][1]]})


class IntentMatch(StatefulProcessor):
    """Gives each file the primed intent it may use, and every intent to one file.

    Both inputs arrive as one table (``intent_rows``). What arrives is only stored; once the watermark has passed a moment,
    nothing older can come, so everything up to it is handled in the order of event time: an intent replaces the older one
    of its package, a file takes the first live intent of its packages, and a file without one goes out alone. State holds
    what lies within the watermark delay, and intents for as long as they live.
    """

    def __init__(self, seconds: float) -> None:
        self.life = int(seconds * 1_000_000)

    def init(self, handle) -> None:
        self.handle = handle
        event = [("us", T.LongType()), ("is_file", T.BooleanType()), ("row_id", T.LongType()), ("package", T.StringType()),
                 ("packages", T.ArrayType(T.StringType())), ("intent_type", T.StringType())]
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField(n, t) for n, t in event]))
        self.primed = handle.getMapState("primed", T.StructType([T.StructField("package", T.StringType())]), T.StructType([
            T.StructField("us", T.LongType()), T.StructField("row_id", T.LongType()), T.StructField("intent_type", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[1] is None:
            return iter([])
        for pdf in rows:
            us = _micros(pdf["ts"])
            lists = [None if x is None else [str(p) for p in x] for x in pdf["packages"]]
            self.waiting.appendList([
                (int(a), bool(f), int(i), p, ps, k) for a, f, i, p, ps, k in
                zip(us, pdf["is_file"], pdf["row_id"], pdf["package"], lists, pdf["intent_type"])])
            self.handle.registerTimer(int(us.min()) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for event in self.waiting.get() if self.waiting.exists() else ():
            (due if event[0] <= passed else later).append(event)
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        primed = {k[0]: tuple(v) for k, v in self.primed.iterator()}
        before, out = dict(primed), []
        for us, is_file, row_id, package, packages, kind in sorted(due, key=lambda e: (e[0], e[1], e[2])):
            if not is_file:
                primed[package] = (us, row_id, kind)
                continue
            live = next((p for p in packages or () if p in primed and us - primed[p][0] <= self.life), None)
            intent = primed.pop(live) if live else (None, None, None)
            out.append((row_id, pd.Timestamp(us, unit="us"), intent[1], live, intent[2], None if live is None else pd.Timestamp(intent[0], unit="us")))
        primed = {p: v for p, v in primed.items() if v[0] + self.life >= passed}
        for p in before.keys() - primed.keys():
            self.primed.removeKey((p,))
        for p, v in primed.items():
            if before.get(p) != v:
                self.primed.updateValue((p,), v)
        again = [e[0] for e in later] + [v[0] + self.life for v in primed.values()]
        if again:
            self.handle.registerTimer(max(min(again) // 1000, timerValues.getCurrentWatermarkInMs()) + 1)
        if out:
            frame = pd.DataFrame(out, columns=["file_id", "file_ts", "intent_id", "package", "intent_type", "intent_ts"])
            frame["intent_id"] = frame["intent_id"].astype("Int64")
            frame["intent_ts"] = pd.to_datetime(frame["intent_ts"])
            yield frame.assign(tenant=key[0])[["tenant", *frame.columns]]

    def close(self) -> None:
        pass


INTENT_OUTPUT = "tenant long, file_id long, file_ts timestamp, intent_id long, package string, intent_type string, intent_ts timestamp"
CLAIM_OUTPUT = "uri string, id long, ts timestamp, layer string, granted boolean, holder string"
WEIGHT_OUTPUT = "tenant long, weights array<double>, events long"
BUFFER_OUTPUT = "tenant long, events long, mean_score double, newest_id long"


def run_processor(df: DataFrame, keys: list[str], processor: StatefulProcessor, output, mode: str = "append",
                  time_mode: str = "EventTime") -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode=mode, timeMode=time_mode)
