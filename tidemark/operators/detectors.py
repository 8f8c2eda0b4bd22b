"""Drift detectors that read one value at a time; the state is a small picklable object.

They follow the published methods: ADWIN (Bifet and Gavalda 2007), DDM (Gama et al. 2004),
EDDM (Baena-Garcia et al. 2006) and the Page-Hinkley test (Page 1954).  Spark partitions
and orders the streams; see ``detect``.
"""

from __future__ import annotations

import math

import numpy as np

SCAN_ROWS = 4_096  # values a scan looks at before it knows whether it restarts


class Detector:
    """Extension point: ``scan`` reads values in order and yields ``(index, state)``.

    ``state`` is "drift" or "warning".  ``width`` and ``estimate`` describe the stretch the
    detector currently regards as one distribution.

    As long as no drift occurs, a detector can also be carried over a chunk without a scan:
    in phase after phase, ``measure`` sums a chunk up, given what the phases before say of the
    state at its start, and ``absorb`` moves the state past it.  So all chunks of one stream
    are summed up at once, and then scanned at once for the first drift (see ``rounds``).
    """

    n_seen = 0
    n_drifts = 0
    #: per phase, the fields of the state that ``absorb`` moves
    carried: tuple[tuple[str, ...], ...] = ((),)

    def skip(self, n: int) -> None:
        """What is known of the state ``n`` values ahead without seeing them, for the first phase."""

    def settle(self) -> None:
        """Do now what a drift leaves for the next value."""

    def measure(self, values: np.ndarray, phase: int) -> tuple:
        raise NotImplementedError

    def absorb(self, summary: tuple, phase: int) -> None:
        raise NotImplementedError

    def scan(self, values: np.ndarray):
        for i, value in enumerate(values.tolist()):
            self.n_seen += 1
            state = self.step(value)
            if state == "drift":
                self.n_drifts += 1
            if state:
                yield i, state

    def step(self, value: float) -> str | None:
        raise NotImplementedError

    @property
    def width(self) -> int:
        raise NotImplementedError

    @property
    def estimate(self) -> float:
        raise NotImplementedError


class Adwin(Detector):
    """Window of adaptive length, kept as buckets of 1, 2, 4, ... values.

    Each bucket is its sum and its sum of squares.  Two old parts of the window that differ
    by more than the bound make the window forget its oldest bucket.
    """

    def __init__(self, delta=0.002, clock=32, max_buckets=5, min_window_length=5, grace_period=10):
        self.delta, self.clock, self.max_buckets = delta, clock, max_buckets
        self.min_length, self.grace = min_window_length, grace_period
        self.levels: list[list[tuple[float, float]]] = [[]]  # level i holds buckets of 2**i values, oldest first
        self.count, self.total, self.squares = 0, 0.0, 0.0

    @property
    def width(self) -> int:
        return self.count

    @property
    def estimate(self) -> float:
        return self.total / self.count if self.count else 0.0

    def scan(self, values: np.ndarray):
        values = np.asarray(values, dtype=float)
        at, n = 0, len(values)
        while at < n:
            # between two checks only the oldest buckets merge, so a run can enter at once
            stop = min(n, at + self.clock - self.n_seen % self.clock)
            self._insert(values[at:stop])
            self.n_seen += stop - at
            at = stop
            if self.n_seen % self.clock == 0 and self.count > self.grace and self._shrink():
                self.n_drifts += 1
                yield at - 1, "drift"

    def _insert(self, run: np.ndarray) -> None:
        squares = run * run
        self.levels[0].extend(zip(run.tolist(), squares.tolist()))
        self.count += len(run)
        self.total += float(run.sum())
        self.squares += float(squares.sum())
        depth = 0
        while depth < len(self.levels):
            level = self.levels[depth]
            pairs = max(0, math.ceil((len(level) - self.max_buckets) / 2))
            if not pairs:
                break
            if depth + 1 == len(self.levels):
                self.levels.append([])
            old = level[: 2 * pairs]
            self.levels[depth + 1].extend((a[0] + b[0], a[1] + b[1]) for a, b in zip(old[::2], old[1::2]))
            del level[: 2 * pairs]
            depth += 1

    def _layout(self, more: int) -> list[int]:
        """Buckets per level after some more values: it depends on their number only."""
        out, entering, depth = [], more, 0
        while depth < len(self.levels) or entering:
            here = (len(self.levels[depth]) if depth < len(self.levels) else 0) + entering
            entering = max(0, math.ceil((here - self.max_buckets) / 2))
            out.append(here - 2 * entering)
            depth += 1
        return out

    def _sizes(self, layout: list[int]) -> np.ndarray:
        """Bucket sizes, oldest first."""
        return np.repeat(1 << np.arange(len(layout) - 1, -1, -1, dtype=np.int64), layout[::-1])

    carried = (("n_seen", "levels", "count", "total", "squares"),)

    def skip(self, n):
        self.levels = [[(0.0, 0.0)] * k for k in self._layout(n)]
        self.count += n

    def measure(self, values, phase):
        """Sums and squares of the chunk per bucket at its end; the first may begin before the chunk."""
        layout, values = self._layout(len(values)), np.asarray(values, dtype=float)
        ends = np.cumsum(self._sizes(layout)) - self.count  # relative to the chunk
        starts = np.append(0, ends[ends > 0][:-1]).astype(np.int64)
        return len(values), np.add.reduceat(values, starts), np.add.reduceat(values * values, starts)

    def absorb(self, summary, phase):
        n, sums, squares = summary
        layout = self._layout(n)
        old = [b for level in reversed(self.levels) for b in level]
        old_ends = np.cumsum([1 << d for d in range(len(self.levels) - 1, -1, -1) for _ in self.levels[d]]).astype(np.int64)
        ends = np.cumsum(self._sizes(layout))
        at, new = 0, 0
        buckets = []
        for end in ends:
            total = square = 0.0
            while at < len(old) and old_ends[at] <= end:
                total, square, at = total + old[at][0], square + old[at][1], at + 1
            if end > self.count:
                total, square, new = total + float(sums[new]), square + float(squares[new]), new + 1
            buckets.append((total, square))
        self.levels, at = [], len(buckets)
        for k in layout:
            self.levels.append(buckets[at - k : at])
            at -= k
        self.count += n
        self.n_seen += n
        self.total += float(sums.sum())
        self.squares += float(squares.sum())

    def _shrink(self) -> bool:
        changed = False
        while self._has_cut():
            changed = True
            depth = len(self.levels) - 1
            while not self.levels[depth]:
                depth -= 1
            total, squares = self.levels[depth].pop(0)
            self.count -= 1 << depth
            self.total -= total
            self.squares -= squares
            while len(self.levels) > 1 and not self.levels[-1]:
                self.levels.pop()
        return changed

    def _has_cut(self) -> bool:
        sums, sizes = [], []
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            sums.extend(b[0] for b in level)
            sizes.extend([1 << depth] * len(level))
        if len(sums) < 2:
            return False
        older = np.cumsum(sizes[:-1], dtype=float)
        newer = self.count - older
        ok = (older >= self.min_length) & (newer >= self.min_length)
        if not ok.any():
            return False
        older, newer, left = older[ok], newer[ok], np.cumsum(sums[:-1])[ok]
        mean = self.total / self.count
        variance = max(0.0, self.squares / self.count - mean * mean)
        strictness = math.log(2.0 * math.log(self.count) / self.delta)
        reciprocal = 1.0 / (older - self.min_length + 1) + 1.0 / (newer - self.min_length + 1)
        bound = np.sqrt(2.0 * reciprocal * variance * strictness) + 2.0 / 3.0 * strictness * reciprocal
        return bool((np.abs(left / older - (self.total - left) / newer) > bound).any())


class Ddm(Detector):
    """Error rate plus its deviation against the best level seen since the last drift."""

    def __init__(self, warm_start=30, warning_threshold=2.0, drift_threshold=3.0):
        self.warm_start, self.warn, self.alarm = warm_start, warning_threshold, drift_threshold
        self._restart()

    def _restart(self):
        self.count, self.errors = 0, 0.0
        self.best, self.best_rate, self.best_dev = math.inf, math.inf, math.inf
        self.fired = False

    carried = (("n_seen", "count", "errors"), ("best", "best_rate", "best_dev"))

    def settle(self):
        if self.fired:
            self._restart()

    def _levels(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rate, deviation, their sum and whether the warm-up is over, after each value."""
        n = self.count + np.arange(1, len(values) + 1)
        rate = np.cumsum(np.append(self.errors, values))[1:] / n
        dev = np.sqrt(rate * (1 - rate) / n)
        return rate, dev, rate + dev, n > self.warm_start

    def scan(self, values):
        values, at = np.asarray(values, dtype=float), 0
        while at < len(values):
            self.settle()
            part = values[at : at + SCAN_ROWS]
            rate, dev, level, warm = self._levels(part)
            held = np.where(warm, level, math.inf)
            least = np.minimum(np.minimum.accumulate(held), self.best)
            # the latest place of the smallest level so far; -1: before this part
            place = np.maximum.accumulate(np.where(warm & (held <= least), np.arange(len(part)), -1))
            best_rate, best_dev = np.where(place < 0, self.best_rate, rate[place]), np.where(place < 0, self.best_dev, dev[place])
            with np.errstate(invalid="ignore"):
                drift = warm & (level > best_rate + self.alarm * best_dev)
                warning = warm & (level > best_rate + self.warn * best_dev)
            stop = int(np.argmax(drift)) if drift.any() else len(part)
            seen, n, errors = self.n_seen, self.count, self.errors
            for i in [*np.flatnonzero(warning[:stop]).tolist(), *([stop] if stop < len(part) else [])]:
                self._move(seen, n, errors, part, i + 1, least, best_rate, best_dev)
                if i == stop:
                    self.n_drifts, self.fired = self.n_drifts + 1, True
                yield at + i, "drift" if i == stop else "warning"
            used = min(stop + 1, len(part))
            self._move(seen, n, errors, part, used, least, best_rate, best_dev)
            at += used

    def _move(self, seen, n, errors, part, used, least, best_rate, best_dev):
        """The state after the first ``used`` values of a part."""
        self.n_seen, self.count, self.errors = seen + used, n + used, errors + float(part[:used].sum())
        self.best, self.best_rate, self.best_dev = float(least[used - 1]), float(best_rate[used - 1]), float(best_dev[used - 1])

    def measure(self, values, phase):
        values = np.asarray(values, dtype=float)
        if phase == 0:
            return len(values), float(values.sum())
        rate, dev, level, warm = self._levels(values)
        if not warm.any():
            return ()
        at = len(level) - 1 - int(np.argmin(np.where(warm, level, math.inf)[::-1]))
        return float(level[at]), float(rate[at]), float(dev[at])

    def absorb(self, summary, phase):
        if phase == 0:
            self.n_seen, self.count, self.errors = self.n_seen + summary[0], self.count + summary[0], self.errors + summary[1]
        elif summary and summary[0] <= self.best:
            self.best, self.best_rate, self.best_dev = summary

    @property
    def width(self):
        return self.count

    @property
    def estimate(self):
        return self.errors / self.count if self.count else 0.0


class Eddm(Detector):
    """Distance between errors: mean plus two deviations against the largest level seen."""

    def __init__(self, warm_start=30, alpha=0.95, beta=0.9):
        self.warm_start, self.alpha, self.beta = warm_start, alpha, beta
        self._restart()

    def _restart(self):
        self.count, self.errors, self.last = 0, 0, 0
        self.distance_sum, self.distance_squares, self.top = 0.0, 0.0, 0.0
        self.zone, self.fired = None, False

    def step(self, value):
        if self.fired:
            self._restart()
        self.count += 1
        if not value:
            return self.zone
        self.errors += 1
        distance, self.last = self.count - self.last, self.count
        self.distance_sum += distance
        self.distance_squares += distance * distance
        mean = self.distance_sum / self.errors
        level = mean + 2 * math.sqrt(max(0.0, self.distance_squares / self.errors - mean * mean))
        self.zone = None
        if self.errors < self.warm_start:
            return None
        self.top = max(self.top, level)
        if level / self.top < self.beta:
            self.fired = True
            return "drift"
        if level / self.top < self.alpha:
            self.zone = "warning"
        return self.zone

    carried = (("n_seen", "count", "errors", "last", "distance_sum", "distance_squares"), ("top", "zone"))

    def settle(self):
        if self.fired:
            self._restart()

    def measure(self, values, phase):
        at = np.flatnonzero(values) + 1
        if phase == 0:
            gaps = np.diff(at).astype(float)
            return len(values), len(at), int(at[0]) if len(at) else 0, int(at[-1]) if len(at) else 0, float(gaps.sum()), float((gaps * gaps).sum())
        if not len(at):
            return ()
        gaps = np.diff(np.append(self.last - self.count, at)).astype(float)
        errors = self.errors + np.arange(1, len(at) + 1)
        mean = (self.distance_sum + np.cumsum(gaps)) / errors
        level = mean + 2 * np.sqrt(np.maximum(0.0, (self.distance_squares + np.cumsum(gaps * gaps)) / errors - mean * mean))
        ready = errors >= self.warm_start
        return (float(level[ready].max()), float(level[-1])) if ready.any() else (0.0, None)

    def absorb(self, summary, phase):
        if phase == 0:
            n, errors, first, last, total, squares = summary
            if errors:
                gap = self.count + first - self.last
                self.errors += errors
                self.distance_sum += gap + total
                self.distance_squares += gap * gap + squares
                self.last = self.count + last
            self.count += n
            self.n_seen += n
        elif summary:
            top, level = summary
            self.top = max(self.top, top)
            self.zone = "warning" if level is not None and level / self.top < self.alpha else None

    @property
    def width(self):
        return self.count

    @property
    def estimate(self):
        return self.distance_sum / self.errors if self.errors else 0.0


class PageHinkley(Detector):
    """Accumulated deviation from the running mean, upwards and downwards."""

    def __init__(self, min_instances=30, delta=0.005, threshold=50.0, alpha=0.9999):
        self.min_instances, self.delta, self.threshold, self.alpha = min_instances, delta, threshold, alpha
        self._restart()

    def _restart(self):
        self.count, self.total = 0, 0.0
        self.up, self.up_min, self.down, self.down_max = 0.0, math.inf, 0.0, -math.inf
        self.fired = False

    def step(self, value):
        if self.fired:
            self._restart()
        self.count += 1
        self.total += value
        gap = value - self.total / self.count
        self.up = self.alpha * self.up + gap - self.delta
        self.down = self.alpha * self.down + gap + self.delta
        self.up_min = min(self.up_min, self.up)
        self.down_max = max(self.down_max, self.down)
        if self.count < self.min_instances:
            return None
        if max(self.up - self.up_min, self.down_max - self.down) > self.threshold:
            self.fired = True
            return "drift"
        return None

    carried = (("n_seen", "count", "total"), ("up", "down"), ("up_min", "down_max"))

    def settle(self):
        if self.fired:
            self._restart()

    def _paths(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both accumulated deviations after each value, piece by piece so that no power overflows."""
        n = self.count + np.arange(1, len(values) + 1)
        gap = values - np.cumsum(np.append(self.total, values))[1:] / n
        paths = []
        for start, step in ((self.up, gap - self.delta), (self.down, gap + self.delta)):
            parts = []
            for a in range(0, len(step), 1_000):
                piece = step[a : a + 1_000]
                power = self.alpha ** np.arange(1, len(piece) + 1)
                parts.append(power * (start + np.cumsum(piece / power)))
                start = parts[-1][-1]
            paths.append(np.concatenate(parts))
        return paths[0], paths[1]

    def measure(self, values, phase):
        values = np.asarray(values, dtype=float)
        if phase == 0:
            return len(values), float(values.sum())
        if phase == 1:  # the end of both paths is linear in their start
            here = PageHinkley(self.min_instances, self.delta, self.threshold, self.alpha)
            here.count, here.total = self.count, self.total
            up, down = here._paths(values)
            return self.alpha ** len(values), float(up[-1]), float(down[-1])
        up, down = self._paths(values)
        return float(up.min()), float(down.max())

    def absorb(self, summary, phase):
        if phase == 0:
            self.n_seen, self.count, self.total = self.n_seen + summary[0], self.count + summary[0], self.total + summary[1]
        elif phase == 1:
            self.up, self.down = summary[0] * self.up + summary[1], summary[0] * self.down + summary[2]
        else:
            self.up_min, self.down_max = min(self.up_min, summary[0]), max(self.down_max, summary[1])

    @property
    def width(self):
        return self.count

    @property
    def estimate(self):
        return self.total / self.count if self.count else 0.0


METHODS = {
    "adwin": Adwin,
    "ddm": Ddm,
    "eddm": Eddm,
    "page_hinkley": PageHinkley,
    "pagehinkley": PageHinkley,
    "ph": PageHinkley,
    "unsupervised": Adwin,
    "unsupervised_adwin": Adwin,
    "confidence": Adwin,
}


def create(method: str, **params) -> Detector:
    try:
        return METHODS[method.lower()](**params)
    except KeyError:
        raise ValueError(f"unknown detector {method!r}; known: {', '.join(sorted(METHODS))}") from None


class DetectorFold:
    """Runs one or more configured detectors over the chunks of one stream."""

    def __init__(self, method: str, grid: dict[str, dict], states: tuple[str, ...]):
        self.detectors = {label: create(method, **params) for label, params in grid.items()}
        self.states = states

    def push(self, chunk):
        """Rows for the wanted states: position inside the chunk and the detector's state."""
        values = chunk["_value"].to_numpy(dtype=float)
        rows = []
        for label, d in self.detectors.items():
            for i, state in d.scan(values):
                if state in self.states:
                    seen = d.n_seen
                    rows.append((i, label, state, seen, d.n_drifts, d.width, d.estimate))
        return rows


class CooldownFold:
    """Keeps a drift only when the last kept one lies at least ``cooldown`` positions back."""

    def __init__(self, cooldown: int):
        self.cooldown, self.last, self.kept = cooldown, -cooldown, 0

    def push(self, chunk):
        rows = []
        for i, pos in enumerate(chunk["_value"].tolist()):
            take = pos - self.last >= self.cooldown
            if take:
                self.last, self.kept = pos, self.kept + 1
            rows.append((i, take, self.kept))
        return rows
