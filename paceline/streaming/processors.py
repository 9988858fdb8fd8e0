"""Stateful processors, shipped to Python workers by value.

Rows of one micro-batch reach a processor in no particular order, so each one
sorts its batch first.  State is keyed by camera or race; everything that needs
no state (geometry, validation, joins) stays outside as Column expressions.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

EMISSION = (
    "race_id bigint, camera_id string, track_id bigint, cross_ord bigint, "
    "finish_time_ms double, finish_wall_time double, emit_ord bigint, bib_number string, "
    "racer_name string"
)
_UNIT = 10**9


def _batch(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


_PERSON = ("track_id", "det_seq", "crossed")
_READ = ("track_id", "det_seq", "bib_read", "ocr_conf")


def _frames(batch: pd.DataFrame) -> Iterator[dict]:
    """Rows as plain values, which survive JSON unchanged."""
    for row in batch.itertuples(index=False):
        yield {
            "frame_ord": int(row.frame_ord),
            "video_ms": float(row.video_ms),
            "wall_ts": float(row.wall_ts),
            "persons": _structs(row.persons, _PERSON),
            "reads": _structs(row.reads, _READ),
        }


def _structs(values, names: tuple[str, ...]) -> list[dict]:
    return [] if values is None else [{n: v[n] for n in names} for v in values]


def _det_seq(item: dict) -> int:
    return item["det_seq"]


class TrackProcessor(StatefulProcessor):
    """Tracks of one camera: crossing, hold, emission, and the bib tally.

    Frames are processed in dense order from ``first_ord``; a frame that comes early
    waits in state.  Once a frame ``gap`` numbers ahead has come, missing ones are
    given up: they are passed over, and ignored should they come later.  With
    ``dense=False`` the frames of a batch are taken in order as they are.

    A batch reads the states of the tracks it holds, and of those that have crossed
    and are not sent yet, which the hold bounds.  A track that has not been seen for
    ``forget`` frames at least (two times that at most) is dropped, with the note that
    it was sent: tracks are listed by the stretch of ``forget`` frames they were last
    seen in, and the lists of old stretches are worked off.
    """

    def __init__(self, hold, read_len, read_conf, lock_conf, first_ord, dense, gap, forget):
        self.hold, self.read_len, self.read_conf = hold, read_len, read_conf
        self.lock_conf, self.first_ord, self.dense = lock_conf, first_ord, dense
        self.gap, self.forget = gap, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next_ord = handle.getValueState("next_ord", "due bigint, top bigint")
        self.waiting = handle.getMapState("waiting", "frame_ord bigint", "frame string")
        self.tracks = handle.getMapState(
            "tracks",
            "track_id bigint",
            "cross_ord bigint, video_ms double, wall_ts double, tally string, sent boolean, stretch bigint",
        )
        self.crossed = handle.getValueState("crossed", "ids string")
        self.stretches = handle.getMapState("stretches", "stretch bigint", "ids string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list = []
        self.held: dict = {}  # states that this batch has read
        self.pending = json.loads(self.crossed.get()[0]) if self.crossed.exists() else []
        before, last = list(self.pending), None
        for frame in self._ready(rows):
            self._frame(frame, out)
            last = frame["frame_ord"]
        if last is not None:
            self._write(last)
        if self.pending != before:
            self.crossed.update((json.dumps(self.pending),))
        if out:
            done = pd.DataFrame(
                out,
                columns=[
                    "track_id", "cross_ord", "finish_time_ms", "finish_wall_time",
                    "emit_ord", "bib_number", "racer_name",
                ],
            )
            done.insert(0, "camera_id", key[1])
            done.insert(0, "race_id", key[0])
            yield done

    def _ready(self, rows) -> Iterator[dict]:
        frames = _frames(_batch(rows, ["frame_ord"]))
        if not self.dense:
            yield from frames
            return
        due, top = self.next_ord.get() if self.next_ord.exists() else (self.first_ord, self.first_ord - 1)
        early = {}
        for frame in frames:
            if frame["frame_ord"] == due:
                yield frame
                due += 1
            elif frame["frame_ord"] > due:
                early[frame["frame_ord"]] = frame
            top = max(top, frame["frame_ord"])
        while due <= top:
            if due in early:
                yield early.pop(due)
            elif self.waiting.containsKey((due,)):
                yield json.loads(self.waiting.getValue((due,))[0])
                self.waiting.removeKey((due,))
            elif self.gap is not None and top - due >= self.gap:
                due = min([*early, *(k[0] for k in self.waiting.keys())]) - 1
            else:
                break
            due += 1
        for ord_, frame in early.items():
            self.waiting.updateValue((ord_,), (json.dumps(frame),))
        self.next_ord.update((due, top))

    def _track(self, track: int) -> dict | None:
        """A track's state, read once a batch."""
        if track not in self.held:
            state = self.tracks.getValue((track,)) if self.tracks.containsKey((track,)) else None
            if state is not None:
                state = {
                    "cross": None if state[0] is None else list(state[:3]), "tally": json.loads(state[3]),
                    "sent": state[4], "stretch": state[5], "seen": None,
                }
            self.held[track] = state
        return self.held[track]

    def _frame(self, frame: dict, out: list) -> None:
        at = frame["frame_ord"]
        # A track seen twice in one frame keeps its last box.
        seen = {p["track_id"]: p for p in sorted(frame["persons"], key=_det_seq)}
        for track in list(self.pending):
            if track not in seen or at >= self._track(track)["cross"][0] + self.hold:
                self._send(track, at, out)
        for track, person in seen.items():
            state = self._track(track)
            if state is None:
                tally = {"lock": None, "votes": {}}
                state = self.held[track] = {"cross": None, "tally": tally, "sent": False, "stretch": None}
            state["seen"] = at
            if not state["sent"] and state["cross"] is None and person["crossed"]:
                state["cross"] = [at, frame["video_ms"], frame["wall_ts"]]
                self.pending.append(track)
        for read in sorted(frame["reads"], key=_det_seq):
            state = self._track(read["track_id"])
            if state is not None and not state["sent"]:
                state["seen"] = at
                self._read(state["tally"], read["bib_read"], read["ocr_conf"])

    def _read(self, tally: dict, bib: str, conf: float) -> None:
        if tally["lock"] is not None:
            return
        if conf > self.lock_conf:
            tally["lock"] = bib
        elif self.read_len[0] <= len(bib) <= self.read_len[1] and conf > self.read_conf:
            tally["votes"][bib] = tally["votes"].get(bib, 0) + round(conf * _UNIT)

    def _send(self, track: int, at: int, out: list) -> None:
        state = self._track(track)
        self.pending.remove(track)
        (cross, video, wall), votes = state["cross"], state["tally"]["votes"]
        bib = state["tally"]["lock"] or (max(votes, key=votes.get) if votes else f"Unknown-{track}")
        out.append([track, cross, video, wall, at, bib, f"Racer {track}"])
        # The note that it was sent needs no tally.
        state |= {"cross": None, "tally": {}, "sent": True, "seen": at}

    def _write(self, last: int) -> None:
        """Write the states that changed, and drop tracks not seen for long."""
        entered: dict = {}
        for track, state in self.held.items():
            if state is None or state["seen"] is None:
                continue
            stretch = state["seen"] // self.forget if self.forget else 0
            if self.forget and stretch != state["stretch"]:
                entered.setdefault(stretch, []).append(track)
            value = (*(state["cross"] or (None, None, None)), json.dumps(state["tally"]), state["sent"], stretch)
            self.tracks.updateValue((track,), value)
        for stretch, ids in entered.items():
            if self.stretches.containsKey((stretch,)):
                ids = json.loads(self.stretches.getValue((stretch,))[0]) + ids
            self.stretches.updateValue((stretch,), (json.dumps(ids),))
        if not self.forget:
            return
        for stretch, ids in [(k[0], v[0]) for k, v in self.stretches.iterator()]:
            if (stretch + 1) * self.forget + self.forget > last:
                continue
            for track in json.loads(ids):
                if self.tracks.containsKey((track,)) and self.tracks.getValue((track,))[5] == stretch and track not in self.pending:
                    self.tracks.removeKey((track,))
            self.stretches.removeKey((stretch,))

    def close(self) -> None:
        pass


class ClockProcessor(StatefulProcessor):
    """Clock of one race: folds clock rows, and stamps each event with the state."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "clock", "race_start_s double, status string, offset_ms double"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, status, offset = (
            self.state.get() if self.state.exists() else (None, "stopped", 0.0)
        )
        batch = _batch(rows, ["ts_s", "row_kind", "seq"])
        states = []
        for kind, action, ts, arg in zip(
            batch["row_kind"], batch["action"], batch["ts_s"], batch["arg_ms"], strict=True
        ):
            if kind == 0:
                if action == "start":
                    start, status = float(ts), "running"
                elif action == "stop":
                    status = "stopped"
                elif action == "reset":
                    start, status, offset = None, "stopped", 0.0
                elif action == "edit":
                    offset = float(arg) - (0.0 if start is None else (ts - start) * 1000)
            states.append((start, status, offset))
        self.state.update((start, status, offset))
        batch[["race_start_s", "status", "offset_ms"]] = pd.DataFrame(
            states, index=batch.index, dtype=object
        )
        batch = batch.astype({"race_start_s": "float64", "offset_ms": "float64"})
        events = batch[batch["row_kind"] == 1]
        if len(events):
            yield events[self.columns]

    def close(self) -> None:
        pass


class IdleProcessor(StatefulProcessor):
    """Idle rule of one camera; keeps the frames that are processed."""

    def __init__(self, steps, after: int):
        self.steps, self.after = steps, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("idle", "state int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, ["frame_ord"])
        state = self.state.get()[0] if self.state.exists() else 0
        kept = []
        for has in batch["has_person"]:
            kept.append(state < self.after)
            state = int(self.steps[int(bool(has)), state])
        self.state.update((state,))
        if any(kept):
            yield batch.loc[kept, ["race_id", "camera_id", "frame_ord"]]

    def close(self) -> None:
        pass


PROCESSED = (
    "race_id bigint, camera_id string, frame_ord bigint, source_ord bigint, video_ms double, "
    "wall_ts double, shown string"
)


class ProcessedProcessor(StatefulProcessor):
    """Idle rule of one camera; numbers the frames it keeps and sends them on whole."""

    def __init__(self, steps, after: int):
        self.steps, self.after = steps, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("processed", "state int, next_ord bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, ["source_ord"])
        state, due = self.state.get() if self.state.exists() else (0, 0)
        kept = []
        for has in batch["has_person"]:
            kept.append(state < self.after)
            state = int(self.steps[int(bool(has)), state])
        batch = batch.loc[kept]
        self.state.update((state, due + len(batch)))
        if len(batch):
            batch = batch.assign(frame_ord=range(due, due + len(batch)))
            yield batch[["race_id", "camera_id", "frame_ord", "source_ord", "video_ms", "wall_ts", "shown"]]

    def close(self) -> None:
        pass


class GenerationProcessor(StatefulProcessor):
    """Stamps changes of a race with their generation: the last reload before each.

    A key holds a share of the race's ids and all of its reloads; share 0 sends those on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("generation", "last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.state.get()[0] if self.state.exists() else 0
        batch = _batch(rows, ["change_seq"])
        batch = batch[batch["change_seq"] > last]  # the others are of an earlier generation
        if not len(batch):
            return
        reload = batch["type"] == "reload"
        own = batch["change_seq"].where(reload, 0).cummax().clip(lower=last)
        if own.iloc[-1] > last:
            self.state.update((int(own.iloc[-1]),))
        sent = batch.assign(generation=own)
        if key[1]:
            sent = sent[~reload]
        if len(sent):
            yield sent.drop(columns="share")

    def close(self) -> None:
        pass


UPSERT = (
    "race_id bigint, id string, generation bigint, seq bigint, version bigint, "
    "deleted boolean, fields string"
)


class UpsertProcessor(StatefulProcessor):
    """One id of a race: merges given fields, keeps a tombstone, ignores what it has seen.

    A reload has no id; it is sent on as a row without one, which tells readers the
    race's generation.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "row", "generation bigint, seq bigint, version bigint, deleted boolean, fields string"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _batch(rows, ["change_seq"])
        held = self.state.get() if self.state.exists() else (0, 0, 0, True, "{}")
        generation, seq, version, deleted = held[:4]
        fields = json.loads(held[4])
        for at, era, kind, given in zip(
            batch["change_seq"], batch["generation"], batch["type"], batch["fields"], strict=True
        ):
            if at <= version:
                continue
            version = int(at)
            if era > generation:
                generation, deleted, fields = int(era), True, {}
            if kind == "delete":
                deleted, fields = True, {}
            elif kind in ("add", "update"):
                seq, deleted = (version if deleted else seq), False
                fields.update(json.loads(given) if given else {})
        if version == held[2]:
            return
        state = (generation, seq, version, deleted, json.dumps(fields))
        self.state.update(state)
        names = ["generation", "seq", "version", "deleted", "fields"]
        out = pd.DataFrame([state], columns=names)
        out.insert(0, "id", key[1])
        out.insert(0, "race_id", key[0])
        yield out

    def close(self) -> None:
        pass
