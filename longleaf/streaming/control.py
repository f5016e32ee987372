"""How many requests at once, and how large: what a provider's answers say, folded over in their order."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Outcomes that cut, with the factor and the milliseconds until the next cut of that kind; fixed values.
LIMITED, GENERIC = (0.5, 250), (0.75, 2000)
CUTS = {"rate_limited": LIMITED, "timeout": GENERIC, "connect_error": GENERIC, "server_error": GENERIC}
#: Milliseconds between growths, and share of successes that counts as stable; fixed values.
GROW_EVERY, STABLE = 2000, 0.98
#: Answers that a decision looks back on, and milliseconds that their 95th percentile may take.
WINDOW, TARGET = 20, 30_000
#: Of a way of sending: least and most tokens and items of a batch, and items that a success adds; fixed values.
MODES = {"plain": (4000, 32_000, 16, 256, 16), "turbo_text_only": (4000, 32_000, 16, 256, 16), "marker_safe": (2000, 16_000, 8, 128, 8), "run_preserving": (1000, 8000, 4, 64, 4)}


def rank95(latencies: list[int]) -> int | None:
    """The nearest rank at 95 of 100."""
    return sorted(latencies)[max(math.ceil(len(latencies) * 0.95) - 1, 0)] if latencies else None


class Rate:
    """The number of requests at once: cut after refusals, with a pause for each kind, and one more after a stable while."""

    def __init__(self, first: int, window: int = WINDOW, target: int = TARGET, state: tuple | None = None):
        self.least, self.most, self.window, self.target = 1, max(first, 1) * 4, window, target
        now, cuts, grown, seen = state or (first, {}, None, [])
        self.now, self.cuts, self.grown, self.seen = now, dict(cuts), grown, deque(seen, window)

    def observe(self, outcome: str, latency: int, at: int) -> int:
        """The number after one more answer. A slow success never cuts; it only holds growth back."""
        self.seen.append((outcome == "ok", latency))
        if outcome in CUTS:
            factor, pause = CUTS[outcome]
            kind = "limited" if outcome == "rate_limited" else "generic"
            if self.cuts.get(kind) is None or at - self.cuts[kind] >= pause:
                self.cuts[kind], self.now = at, max(math.floor(self.now * factor), self.least)
        elif outcome == "ok" and (self.grown is None or at - self.grown >= GROW_EVERY) and len(self.seen) == self.window:
            good = [x for ok, x in self.seen if ok]
            if len(good) / self.window >= STABLE and (rank95(good) or 0) <= self.target:
                self.grown, self.now = at, min(self.now + 1, self.most)
        return self.now


class Size:
    """Tokens and items of a batch in one mode: more after stable successes, less after cuts, within the mode's bounds."""

    def __init__(self, mode: str, tokens: int, items: int, window: int = WINDOW, target: int = TARGET, pause: int = 2000):
        low, self.most, few, self.many, self.step = MODES[mode]
        self.low, self.few, self.window, self.target, self.pause = max(min(tokens, low), 1), max(min(items, few), 1), window, target, pause
        self.seen: deque = deque(maxlen=window)
        self.grown = self.cut = None
        self._set(tokens, items)

    def _set(self, tokens: int, items: int) -> None:
        self.tokens, self.items = min(max(tokens, self.low), self.most), min(max(items, self.few), self.many)

    def decrease(self, tokens: float, items: float, at: int) -> bool:
        """Less by these factors, unless that was done just now; whether anything changed."""
        if self.cut is not None and at - self.cut < self.pause:
            return False
        before = self.tokens, self.items
        self._set(math.floor(self.tokens * tokens), math.floor(self.items * items))
        self.cut = at
        return (self.tokens, self.items) != before

    def grows(self, at: int) -> bool:
        """Whether the window is full, stable, fast and free of cut or broken answers."""
        if len(self.seen) < self.window or any(kind in ("truncated", "invalid_json") for kind, _ in self.seen):
            return False
        slow = rank95([x for kind, x in self.seen if kind in ("ok", "slow")])
        stable = sum(kind == "ok" for kind, _ in self.seen) / len(self.seen) >= STABLE
        return stable and (slow is None or slow <= self.target) and (self.grown is None or at - self.grown >= GROW_EVERY)

    def success(self, latency: int, at: int) -> None:
        self.seen.append(("ok", latency))
        slow = rank95([x for kind, x in self.seen if kind in ("ok", "slow")])
        if slow is not None and slow > self.target:
            self.decrease(0.85, 1.0, at)
        elif self.grows(at):
            self._set(math.floor(self.tokens * 1.10 + 0.5), self.items + self.step)
            self.grown = at


OUT = "job long, event_id long, at_once int"


def rates(events: DataFrame, first: int = 8, window: int = WINDOW, target: int = TARGET) -> DataFrame:
    """(job, event_id, at_once) for each of events (job, event_id, outcome, latency, at): the number after it. Only a window is held."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job = rate = None
        for f in frames:
            out = []
            for g, outcome, latency, at in zip(f["job"], f["outcome"], f["latency"], f["at"], strict=True):
                if rate is None or g != job:
                    job, rate = g, Rate(first, window, target)
                out.append(rate.observe(outcome, int(latency), int(at)))
            yield pd.DataFrame({"job": f["job"], "event_id": f["event_id"], "at_once": out})

    return events.repartition("job").sortWithinPartitions("job", "event_id").mapInPandas(fold, OUT)


def rate_states(events: DataFrame, first: int = 8, window: int = WINDOW, target: int = TARGET) -> DataFrame:
    """The same of a stream: (job, event_id, at_once) after a job's newest event, with a state of one window a job."""
    state = "now int, limited long, generic long, grown long, ok array<boolean>, latency array<long>"

    def fold(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        old = None
        if held.exists:
            now, limited, generic, grown, ok, latency = held.get
            old = now, {"limited": limited, "generic": generic}, grown, list(zip(ok, latency, strict=True))
        rate, last = Rate(first, window, target, old), -1
        new = pd.concat([f[["event_id", "outcome", "latency", "at"]] for f in frames]).sort_values("event_id")
        for i, outcome, latency, at in new.itertuples(index=False):
            rate.observe(outcome, int(latency), int(at))
            last = int(i)
        held.update((rate.now, rate.cuts.get("limited"), rate.cuts.get("generic"), rate.grown, [bool(o) for o, _ in rate.seen], [int(x) for _, x in rate.seen]))
        yield pd.DataFrame({"job": [key[0]], "event_id": [last], "at_once": [rate.now]})

    return events.groupBy("job").applyInPandasWithState(fold, OUT, state, "update", GroupStateTimeout.NoTimeout)
