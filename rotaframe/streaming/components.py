"""Components of signal pixels from frames that arrive in order, as a stateful stream.

The state of a sweep is its open components alone: those with a pixel on the last frame. A component is
put out as soon as no later pixel can touch it. A missing frame closes all, and so does a row without a value,
which ends its sweep; a frame that comes late or twice is an error, not late data, since components are
already out by then. The state is a typed, versioned row of the open pixels, so it grows with them alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPOTS = "sweep long, n_signal long, total long, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int, c_x double, c_y double, c_z double"
#: The state: the last frame, and of each open pixel its component and place.
STATE = "version int, frame int, component array<int>, z array<int>, y array<int>, x array<int>, value array<long>"
VERSION = 1
NAMES = ["sweep", "n_signal", "total", "x0", "x1", "y0", "y1", "z0", "z1", "c_x", "c_y", "c_z"]


class Open:
    """Components that may still grow: each a list of pixels (frame, y, x, value); `last` maps the last frame's pixels to theirs."""

    def __init__(self) -> None:
        self.frame: int | None = None
        self.last: dict[tuple[int, int], int] = {}
        self.parts: dict[int, list[tuple[int, int, int, int]]] = {}
        self.next = 0

    def add(self, frame: int, pixels: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
        """Take a frame's pixels (y, x, value); components that are complete come back."""
        if self.frame is not None and frame <= self.frame:
            raise ValueError(f"frame {frame} came after frame {self.frame}")
        done = self.close() if self.frame is not None and frame > self.frame + 1 else []
        now: dict[tuple[int, int], int] = {}
        for y, x, value in sorted(pixels):
            touching = sorted({c for c in (self.last.get((y, x)), now.get((y - 1, x)), now.get((y, x - 1))) if c is not None})
            if not touching:
                touching = [self.next]
                self.parts[self.next] = []
                self.next += 1
            first = touching[0]
            for other in touching[1:]:  # the pixel joins them
                self.parts[first] += self.parts.pop(other)
                for places in (self.last, now):
                    for place, c in places.items():
                        if c == other:
                            places[place] = first
            self.parts[first].append((frame, y, x, value))
            now[y, x] = first
        live = set(now.values())
        done += [self.parts.pop(c) for c in [c for c in self.parts if c not in live]]
        self.frame, self.last = frame, now
        return done

    def packed(self) -> tuple:
        pixels = [(number, *p) for number, part in enumerate(self.parts.values()) for p in part]
        return (VERSION, self.frame, *([p[i] for p in pixels] for i in range(5)))

    @classmethod
    def unpacked(cls, state: tuple) -> Open:
        version, frame, *columns = state
        if version != VERSION:
            raise ValueError(f"state of version {version}, not {VERSION}")
        own = cls()
        own.frame = frame
        for component, *pixel in zip(*columns, strict=True):
            own.parts.setdefault(component, []).append(tuple(pixel))
            if pixel[0] == frame:
                own.last[pixel[1], pixel[2]] = component
        own.next = len(own.parts)
        return own

    def close(self) -> list[list[tuple[int, int, int, int]]]:
        done, self.parts, self.last = list(self.parts.values()), {}, {}
        return done


def measured(sweep: int, pixels: list[tuple[int, int, int, int]]) -> tuple:
    total = sum(p[3] for p in pixels)
    z, y, x = ([p[i] for p in pixels] for i in range(3))
    centre = [sum(p[3] * (p[i] + 0.5) for p in pixels) / total for i in (2, 1)]
    return (sweep, len(pixels), total, min(x), max(x) + 1, min(y), max(y) + 1, min(z) - 1, max(z), centre[0], centre[1], sum(p[3] * (p[0] - 0.5) for p in pixels) / total)


def stream_spots(pixels: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Spots of a streaming DataFrame (sweep, frame, y, x, value).

    Frames of a sweep must arrive in order over micro-batches; within a batch they are put in order here.
    A row with a null value ends its sweep. With timeout_ms, a sweep with no frame for so long is closed too;
    that is for streams that run on, as Spark then tries a batch again and again (a trigger availableNow wouldn't end).
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Open.unpacked(state.get) if state.exists else Open()
        out = []
        if state.hasTimedOut:
            out = held.close()
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["frame", "y", "x"])
            ended = bool(rows["value"].isna().any())
            for frame, own in rows.dropna(subset=["value"]).groupby("frame", sort=True):
                out += held.add(int(frame), [(int(a), int(b), int(c)) for a, b, c in zip(own.y, own.x, own.value, strict=True)])
            if ended:
                out += held.close()
                if state.exists:
                    state.remove()
            else:
                state.update(held.packed())
                if timeout_ms is not None:
                    state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame([measured(int(key[0]), p) for p in out], columns=NAMES)

    waits = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return pixels.groupBy("sweep").applyInPandasWithState(run, SPOTS, STATE, "append", waits)
