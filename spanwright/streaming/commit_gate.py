"""From frame tags to committed spans: votes stride by stride, a commit when the end of a span holds still.

At each stride's end the buffer's complete spans vote.  A span is stable after ``votes`` strides in a row in which it was
seen with terminators no further than ``delta`` frames apart.  The first span of the buffer is committed once stable, or
unready and flagged when the buffer is full; the frontier moves to its terminator, and the buffer is read again until
nothing commits.  Committed frames read as unknown, and a unit under way right at a decoded terminator opens there.

A full buffer without a complete span loses its votes.  An open span that starts more than ``delta`` after the buffer does
is kept for the next buffer, once; else its closed part is committed up to the frame of the middle of the buffer that
looks least like inside, flagged as a cut; else the buffer is dropped.  Neither a cut nor a drop certifies a start.  At the
end of a stream its complete spans are committed and an open one goes.

The same state machine replays whole streams (:func:`replay`, one stream at a time) and runs on a stream of
frames (:func:`stream_commits`, with the machine in Spark's state store).  Streams are independent of one another.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

UNKNOWN, OUT, BEGIN, INSIDE = 0, 1, 2, 3
SCHEMA = "stream_id long, start_frame int, end_frame int, commit_frame int, partial boolean, cap_cut boolean"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Config:
    stride: int = 24
    delta: int = 12
    votes: int = 3
    cap: int = 960
    least: int = 1

    @property
    def cut_window(self) -> tuple[int, int]:
        """Frames of a full buffer, counted from its first, that may end a cut span: the later half without the last votes."""
        return self.cap // 2, self.cap - (self.votes - 1) * self.stride


Vote = tuple[int, int] | None


@dataclass
class CommitGate:
    """The last votes of each candidate span, None where a stride did not see it.

    A history is known by where its span was last seen to start; a span within ``delta`` of that is the same one.
    """

    config: Config
    histories: list[list[Vote]] = field(default_factory=list)

    @staticmethod
    def _last(votes: list[Vote]) -> tuple[int, int]:
        return next(v for v in reversed(votes) if v is not None)

    def _nearest(self, start: int, among) -> int | None:
        """The history among the given ones that is nearest to ``start``, the older one on ties."""
        gaps = {k: abs(self._last(self.histories[k])[0] - start) for k in among}
        near = [k for k, gap in gaps.items() if gap <= self.config.delta]
        return min(near, key=lambda k: (gaps[k], k), default=None)

    def _own(self, span: tuple[int, int]) -> int | None:
        return self._nearest(span[0], range(len(self.histories)))

    def vote(self, spans: list[tuple[int, int]]) -> None:
        """One stride: each span votes in the nearest history that is still free, or opens one; unseen ones age."""
        free, cast = dict.fromkeys(range(len(self.histories))), []
        for span in spans:
            at = self._nearest(span[0], free)
            cast.append((at, span))
            free.pop(at, None)
        by_history = dict(cast)
        aged = [[*votes, by_history.get(k)][-self.config.votes :] for k, votes in enumerate(self.histories)]
        self.histories = [v for v in aged if any(x is not None for x in v)] + [[span] for at, span in cast if at is None]

    def stable(self, span: tuple[int, int]) -> bool:
        at = self._own(span)
        votes = [] if at is None else self.histories[at]
        if len(votes) < self.config.votes or None in votes:
            return False
        ends = [end for _, end in (*votes, span)]
        return max(ends) - min(ends) <= self.config.delta

    def retire(self, span: tuple[int, int]) -> None:
        """The committed span's own history goes, and any last seen to end no later than it does."""
        own = self._own(span)
        self.histories = [v for k, v in enumerate(self.histories) if k != own and self._last(v)[1] > span[1]]


def read_spans(tags: list[int], first: int) -> tuple[list[tuple[int, int]], int | None]:
    """The complete spans of a buffer and the start of the one still open at its end."""
    spans, start, before = [], None, None
    for at, tag in enumerate(tags, first):
        if start is not None and tag != INSIDE:
            spans.append((start, at))
            start = None
        if tag == BEGIN or (start is None and tag == INSIDE and before == OUT):
            start = at
        before = tag
    return spans, start


class Machine:
    """One stream's state: the buffered tags, the frontier and the gate."""

    def __init__(self, config: Config):
        self.config, self.gate = config, CommitGate(config)
        self.tags: list[int] = []
        self.inside: list[float] = []
        self.first = self.frontier = 0
        self.certified = False
        self.last_kept: int | None = None

    @property
    def now(self) -> int:
        return self.first + len(self.tags)

    def _move(self, to: int) -> None:
        drop = to - self.first
        self.tags, self.inside, self.first = self.tags[drop:], self.inside[drop:], to

    def _behind(self, end: int) -> int:
        """Where the next buffer begins: a little before ``end``, and further on than this one in any case."""
        return max(end - self.config.delta, min(end, self.first + 1))

    def _decoded(self) -> list[int]:
        tags = list(self.tags)
        fresh = min(max(self.frontier - self.first, 0), len(tags))
        tags[:fresh] = [UNKNOWN] * fresh
        if self.certified and fresh < len(tags) and tags[fresh] == INSIDE and self.first + fresh == self.frontier:
            tags[fresh] = BEGIN
        return tags

    def _emit(self, span: tuple[int, int], partial: bool, cut: bool) -> tuple:
        row = (*span, self.now, partial, cut)
        self.frontier, self.certified = span[1], not cut
        self._move(self._behind(span[1]))
        return row

    def _full_without_span(self, start: int | None) -> tuple | None:
        c, now = self.config, self.now
        again = start is not None and self.last_kept is not None and abs(start - self.last_kept) <= c.delta
        if start is not None and start - self.first > c.delta and not again:
            self.last_kept = start
            self.certified = self.certified and start - c.delta <= self.frontier
            self._move(start - c.delta)
            return None
        lo, hi = c.cut_window
        window = range(max(lo, 0), min(hi + 1, len(self.tags)))
        if start is not None and now - start >= c.least and window:
            cut = self.first + min(window, key=lambda k: (self.inside[k], k))
            if cut - start >= c.least:
                return self._emit((start, cut), False, True)
        self._move(self._behind(now))
        self.certified = False
        return None

    def _pass(self, vote: bool, drain: bool = False) -> tuple | None:
        full = drain or len(self.tags) >= self.config.cap
        spans, opened = read_spans(self._decoded(), self.first)
        spans = [s for s in spans if s[1] - s[0] >= self.config.least]
        if vote:
            self.gate.vote(spans)
        if spans:
            stable = self.gate.stable(spans[0])
            if not stable and not full:
                return None
            self.gate.retire(spans[0])
            return self._emit(spans[0], not stable, False)
        if full:
            self.gate.histories = []
        return self._full_without_span(opened) if full and not drain else None

    def push(self, tag: int, inside: float | None = None) -> list[tuple]:
        self.tags.append(tag)
        self.inside.append(float(tag == INSIDE) if inside is None else inside)
        on_stride = self.now % self.config.stride == 0
        if not on_stride and len(self.tags) < self.config.cap:
            return []
        out, event = [], self._pass(on_stride)
        while event is not None:
            out.append(event)
            # a cut took the votes with it, so another look could commit nothing
            event = None if event[4] else self._pass(False)
        return out

    def end(self) -> list[tuple]:
        out = []
        while (event := self._pass(False, drain=True)) is not None:
            out.append(event)
        return out


def _frames(rows: pd.DataFrame):
    inside = rows["inside"].tolist() if "inside" in rows else [None] * len(rows)
    return zip(rows["frame"].tolist(), rows["tag"].tolist(), inside, strict=True)


def replay(tags: DataFrame, config: Config) -> DataFrame:
    """Commits of whole streams from (stream_id, frame, tag, inside); frames count from 0 without holes.

    ``inside``, how likely a frame is inside a unit, decides where a full buffer is cut; without it the tag does.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        machine, out = Machine(config), []
        for _, tag, inside in _frames(frame.sort_values("frame")):
            out += machine.push(tag, inside)
        out += machine.end()
        stream = int(frame["stream_id"].iloc[0])
        return pd.DataFrame([(stream, *row) for row in out], columns=COLUMNS)

    return tags.groupBy("stream_id").applyInPandas(run, SCHEMA)


def stream_commits(tags: DataFrame, config: Config) -> DataFrame:
    """The same on a streaming DataFrame; a batch's frames are taken in order and those already past are dropped."""

    def run(key, frames: Iterator[pd.DataFrame], state):
        machine = pickle.loads(state.get[0]) if state.exists else Machine(config)
        rows = pd.concat(list(frames)).sort_values("frame")
        out = []
        for frame, tag, inside in _frames(rows):
            if frame >= machine.now:
                out += machine.push(tag, inside)
        state.update((pickle.dumps(machine),))
        yield pd.DataFrame([(int(key[0]), *row) for row in out], columns=COLUMNS)

    grouped = tags.groupBy("stream_id")
    return grouped.applyInPandasWithState(run, SCHEMA, "machine binary", "append", "NoTimeout")
