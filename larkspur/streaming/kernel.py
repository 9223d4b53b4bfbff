"""Correlation state of one group, an event at a time, in arrival order.

Pure Python without Spark. Exact for events that arrive out of time order and
at the per-group limits; the batch windows agree with it on sorted input below
the limits. `Engine` runs several correlations over all their groups, with the
limit on groups and the periodic sweep, as one instance does.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, OrderedDict, deque
from dataclasses import dataclass, field

from ..functions.text import I64_MAX, I64_MIN, literal_to_f64
from ..plans.compile import reduce_tokens
from ..plans.model import BEACON_PRESENCE, MAX_SEEN_RULES, WEIGHTS, Correlation, admitted

#: Entries of a group's reorder buffer.
REORDER = 32


@dataclass(frozen=True)
class Caps:
    """Limits and clock rules. The defaults are those of processing order."""

    max_groups: int = 50_000
    max_distinct: int = 10_000
    max_events: int = 4_096
    sweep_s: float = 30.0
    event_time: bool = False
    watermark_s: float = 0.0


#: What the JSON event front end uses: order by event time, two seconds of slack.
EVENT_TIME = Caps(event_time=True, watermark_s=2.0)


def compare(op: str, a, b) -> bool:
    return {"gt": a > b, "lte": a <= b, "lt": a < b, "eq": a == b}.get(op, a >= b)


def truncated(x: float) -> int:
    """A double as a 64-bit integer, towards zero."""
    return I64_MIN if math.isnan(x) else int(max(min(x, float(I64_MAX)), float(I64_MIN))) if abs(x) < 2**63 else (I64_MAX if x > 0 else I64_MIN)


@dataclass
class Group:
    """The state of one group of one correlation; plain data, so it pickles."""

    times: deque = field(default_factory=deque)
    values: deque = field(default_factory=deque)
    distinct: OrderedDict = field(default_factory=OrderedDict)
    seen: dict[int, float] = field(default_factory=dict)
    progress: int = 0
    anchor: float = 0.0
    last_step: float = 0.0
    epochs: dict[int, tuple[int, int]] = field(default_factory=dict)  # slot -> epoch, count
    waiting: list[tuple[float, int]] = field(default_factory=list)
    high: float = 0.0
    merge_n: int = 0
    merge_sum: float = 0.0
    merge_seen: int = 0
    remote: bool = False
    fired_until: float = 0.0
    last_update: float = -math.inf
    due: float = math.inf  # when an engine's sweep looks at the group
    in_order: bool = True  # no event was earlier than the one before it

    def event(self, c: Correlation, ts: float, rule_ids, value: str | None, caps: Caps, stats: Counter) -> int | None:
        """What was observed if the event fires the correlation, else None.

        rule_ids: all rules that matched the event."""
        return self._suppressed(c, ts, self.step(c, ts, rule_ids, value, caps, stats), stats)

    def step(self, c: Correlation, ts: float, rule_ids, value: str | None, caps: Caps, stats: Counter) -> int | None:
        """As `event`, without regard to earlier fires."""
        self.in_order = self.in_order and ts >= self.last_update
        self.last_update = ts
        matched = set(rule_ids)
        hits = [r for r in c.base_rule_ids if r in matched]
        stats["hits_truncated"] += max(0, len(hits) - MAX_SEEN_RULES)
        hits = hits[:MAX_SEEN_RULES]
        if not hits:
            return None
        return getattr(self, "_" + c.type)(c, ts, hits, value, caps, stats)

    def contribution(self, c: Correlation, k: dict, caps: Caps, stats: Counter) -> int | None:
        """Fold in a partial aggregate of another instance (kind, ts, count, numeric,
        value, seen_mask)."""
        ts, kind = float(k.get("ts") or 0.0), k["kind"]
        self.in_order = self.in_order and ts >= self.last_update
        self.last_update, self.remote = ts, True
        observed = None
        if kind == "count":
            self.merge_n += k.get("count") or 1
            self._prune(ts - c.timespan_s)
            if c.type == "event_count":
                n = len(self.times) + self.merge_n
                observed = n if compare(c.op, n, c.count) else None
        elif kind == "sum":
            self.merge_sum += k.get("numeric") or 0.0
            self.merge_n += k.get("count") or 1
            self._prune(ts - c.timespan_s)
            if c.type in ("value_sum", "value_avg"):
                observed = self._aggregate(c)
        elif kind == "distinct":
            if c.type == "value_count" and k.get("value") is not None:
                observed = self._value_count(c, ts, [], k["value"], caps, stats)
        elif kind == "seen":
            self.merge_seen |= (k.get("seen_mask") or 0) & (1 << 64) - 1
            if c.type == "temporal":
                observed = self._temporal(c, ts, [], None, caps, stats)
        return self._suppressed(c, ts, observed, stats)

    def _suppressed(self, c: Correlation, ts: float, observed: int | None, stats: Counter) -> int | None:
        if observed is None:
            return None
        if ts < self.fired_until:
            stats["fires_suppressed"] += 1
            return None
        self.fired_until = ts + float(c.timespan_s)
        return observed

    # -- rings ------------------------------------------------------------------

    def _prune(self, start: float) -> None:
        while self.times and self.times[0] < start:
            self.times.popleft()
            if self.values:
                self.values.popleft()

    def _push(self, ts: float, value: float | None, start: float, caps: Caps, stats: Counter, hot: bool = True) -> None:
        if len(self.times) == caps.max_events:
            oldest = self.times.popleft()
            if value is not None:
                self.values.popleft()
            stats["events_overwritten"] += 1
            if hot and oldest > start + (ts - start) * 0.5:
                stats["hotkey_fallback"] += 1
        self.times.append(ts)
        if value is not None:
            self.values.append(value)
        self._prune(start)

    def _event_count(self, c, ts, hits, value, caps, stats):
        self._push(ts, None, ts - c.timespan_s, caps, stats)
        n = len(self.times) + self.merge_n
        return n if compare(c.op, n, c.count) else None

    def _value_count(self, c, ts, hits, value, caps, stats):
        if value is None:
            return None
        start = ts - c.timespan_s
        if self.in_order:  # the values stand in the order of their times
            while self.distinct and next(iter(self.distinct.values())) < start:
                self.distinct.popitem(last=False)
        else:
            for v in [v for v, t in self.distinct.items() if t < start]:
                del self.distinct[v]
        if value not in self.distinct and len(self.distinct) >= caps.max_distinct:
            self.distinct.popitem(last=False)
            stats["distinct_evicted"] += 1
        self.distinct[value] = ts
        self.distinct.move_to_end(value)
        n = len(self.distinct)
        return n if compare(c.op, n, c.count) else None

    def _number(self, c, ts, value, caps, stats) -> None:
        number = None if value is None else literal_to_f64(value)
        if number is None:
            stats["values_nonnumeric"] += 1
            self._prune(ts - c.timespan_s)
        else:
            self._push(ts, number, ts - c.timespan_s, caps, stats)

    def _aggregate(self, c) -> int | None:
        total = self.merge_sum
        for v in self.values:
            total += v
        if c.type == "value_avg":
            n = len(self.times) + self.merge_n
            if n == 0:
                return None
            total /= n
        return truncated(total) if compare(c.op, total, float(c.count)) else None

    def _value_sum(self, c, ts, hits, value, caps, stats):
        self._number(c, ts, value, caps, stats)
        return self._aggregate(c)

    _value_avg = _value_sum

    def _value_percentile(self, c, ts, hits, value, caps, stats):
        self._number(c, ts, value, caps, stats)
        n = len(self.values)
        if n == 0:
            return None
        v = sorted(self.values)[max(1, (c.rank * n + 99) // 100) - 1]
        return truncated(v) if compare(c.op, v, float(c.count)) else None

    _value_median = _value_percentile

    # -- sequences ----------------------------------------------------------------

    def _record(self, ts: float, hits, start: float, stats: Counter) -> None:
        for r in hits:
            if r in self.seen or len(self.seen) < MAX_SEEN_RULES:
                self.seen[r] = ts
            else:
                stats["seen_truncated"] += 1
        self.seen = {r: t for r, t in self.seen.items() if t >= start}

    def _bits(self, c: Correlation) -> list[bool]:
        return [r in self.seen or bool(self.merge_seen >> i & 1) for i, r in enumerate(c.base_rule_ids[:64])]

    def _condition(self, c: Correlation) -> bool:
        return bool(reduce_tokens(c.condition, self._bits(c), False))

    def _temporal(self, c, ts, hits, value, caps, stats):
        self._record(ts, hits, ts - c.timespan_s, stats)
        holds = self._condition(c) if c.condition else all(self._bits(c))
        return len(c.base_rule_ids) if holds else None

    def _steps(self, c: Correlation, ts: float, hits, start: float, event_time: bool) -> bool:
        order = c.order
        if self.progress and self.anchor < start:
            self.progress, self.anchor, self.last_step = 0, 0.0, 0.0
        while self.progress < len(order) and order[self.progress] in hits:
            if self.progress == 0:
                self.anchor = ts
            elif event_time and ts < self.last_step:
                break
            self.last_step = ts
            self.progress += 1
        if order and self.progress >= len(order):
            self.progress, self.anchor, self.last_step = 0, 0.0, 0.0
            return True
        return False

    def _reordered(self, c: Correlation, ts: float, hits, caps: Caps, stats: Counter) -> bool:
        """Buffers hits and replays them in time order once the slack has passed.
        Ages are judged by the event that triggers the replay."""
        start = ts - c.timespan_s
        if self.high > 0.0 and ts + caps.watermark_s < self.high:
            stats["watermark_late"] += 1
            return self._steps(c, ts, hits, start, True)
        for r in hits:
            if len(self.waiting) >= REORDER:
                oldest = min(range(len(self.waiting)), key=lambda i: self.waiting[i][0])
                self.waiting[oldest] = self.waiting[-1]
                self.waiting.pop()
                stats["watermark_late"] += 1
            at = len(self.waiting)
            while at and self.waiting[at - 1][0] > ts:
                at -= 1
            self.waiting.insert(at, (ts, r))
        self.high = max(self.high, ts)
        cutoff, fired, left = self.high - caps.watermark_s, False, []
        for t, r in self.waiting:
            if t <= cutoff:
                fired = self._steps(c, t, (r,), start, True) or fired
            else:
                left.append((t, r))
        self.waiting = left
        return fired

    def _temporal_ordered(self, c, ts, hits, value, caps, stats):
        if c.condition:
            self._record(ts, hits, ts - c.timespan_s, stats)
        if caps.watermark_s > 0 and caps.event_time:
            fired = self._reordered(c, ts, hits, caps, stats)
        else:
            fired = self._steps(c, ts, hits, ts - c.timespan_s, caps.event_time)
        if fired and c.condition:
            fired = self._condition(c)
        return len(c.base_rule_ids) if fired else None

    # -- beacons --------------------------------------------------------------------

    def _beaconing(self, c, ts, hits, value, caps, stats):
        if c.n_buckets:
            return self._bucketed(c, ts)
        self._push(ts, None, ts - c.timespan_s, caps, stats, hot=False)
        n = len(self.times)
        if n < c.count or n < 3:
            return None
        times = list(self.times)
        return n if regular([b - a for a, b in zip(times, times[1:], strict=False)], c.cv_permille) else None

    def _bucketed(self, c: Correlation, ts: float) -> int | None:
        if ts < 0:
            return None
        nb = c.n_buckets
        now = int(ts / (c.timespan_s / nb)) & 0xFFFFFFFF
        epoch, count = self.epochs.get(now % nb, (0, 0))
        self.epochs[now % nb] = (now, count + 1 if epoch == now else 1)
        first = max(0, now - (nb - 1))
        active = sorted(e for e, n in self.epochs.values() if n and first <= e <= now)
        if len(active) < c.count or len(active) < 3:
            return None
        if len(active) * 1000 < BEACON_PRESENCE * (active[-1] - active[0] + 1):
            return None
        gaps = [float(b - a) for a, b in zip(active, active[1:], strict=False)]
        return 0 if regular(gaps, c.cv_permille) else None


def regular(gaps: list[float], permille: int) -> bool:
    """Whether the gaps' population variance is within the tolerance of their mean."""
    if not gaps:
        return False
    mean = _sum(gaps) / len(gaps)
    if mean <= 0:
        return False
    variance = _sum((g - mean) ** 2 for g in gaps) / len(gaps)
    return variance <= (permille / 1000.0 * mean) ** 2


def _sum(values) -> float:
    """Left to right, as a running sum rounds."""
    total = 0.0
    for v in values:
        total += v
    return total


def fire(c: Correlation, group, observed: int, ts: float, remote: bool) -> dict:
    return {
        "corr_id": c.id, "title": c.title, "type": c.type, "technique": c.mitre, "level": c.level or "medium",
        "tier": c.tier, "weight": WEIGHTS[c.tier], "group_by": list(c.group_by), "group": list(group),
        "observed": observed, "threshold": c.count, "value_field": c.field if c.uses_field else None,
        "base_rule_ids": list(c.base_rule_ids), "remote": remote, "ts": ts,
    }


class Engine:
    """All correlations of one instance, fed one event at a time."""

    def __init__(self, rules, caps: Caps = Caps()):
        self.rules, rejected = admitted(rules)
        self.caps, self.stats = caps, Counter(rejected)
        self.groups: list[OrderedDict] = [OrderedDict() for _ in self.rules]
        self.watching: dict[int, list[int]] = {}
        for i, c in enumerate(self.rules):
            for r in dict.fromkeys(c.base_rule_ids):
                self.watching.setdefault(r, []).append(i)
        self.last_sweep: float | None = None
        # By correlation: (a time, number, key, group), a heap; and the group touched last.
        self.due: list[list] = [[] for _ in self.rules]
        self.unfiled: list[tuple | None] = [None for _ in self.rules]
        self.n_due = 0

    def n_groups(self, i: int | None = None) -> int:
        return sum(map(len, self.groups)) if i is None else len(self.groups[i])

    def sweep(self, now: float) -> None:
        if self.last_sweep is None:
            self.last_sweep = now
        if now - self.last_sweep < self.caps.sweep_s:
            return
        self.last_sweep = now
        for i, (c, groups, due) in enumerate(zip(self.rules, self.groups, self.due, strict=True)):
            start = now - c.timespan_s
            if self.unfiled[i] is not None:
                self._file(i)
            while due and due[0][0] < start:
                filed, _, key, g = heapq.heappop(due)
                if groups.get(key) is not g or g.due != filed:
                    continue
                if g.last_update < start:
                    del groups[key]
                else:
                    self._due(i, key, g)

    def _due(self, i: int, key: tuple, g: Group) -> None:
        g.due = g.last_update
        self.n_due += 1
        heapq.heappush(self.due[i], (g.due, self.n_due, key, g))

    def _file(self, i: int) -> None:
        """Sees to it that the group touched last is due no later than its last update. So
        every group is, and a sweep looks at those alone that may have expired."""
        (key, g), self.unfiled[i] = self.unfiled[i], None
        if g.last_update < g.due:
            self._due(i, key, g)
        if len(self.due[i]) > 2 * len(self.groups[i]) + 1_000:  # most are evicted groups'
            self.due[i] = [(x.due, n, k, x) for t, n, k, x in self.due[i] if self.groups[i].get(k) is x and x.due == t]
            heapq.heapify(self.due[i])

    def _group(self, i: int, key: tuple) -> Group:
        groups = self.groups[i]
        if self.unfiled[i] is not None:
            self._file(i)
        if key in groups:
            groups.move_to_end(key)
        else:
            if len(groups) >= self.caps.max_groups:
                groups.popitem(last=False)
                self.stats["groups_evicted"] += 1
            groups[key] = Group()
        self.unfiled[i] = (key, groups[key])
        return groups[key]

    def event(self, rule_ids, field, ts: float, apply=None) -> list[dict]:
        """Fires of an event that matched rule_ids; field(name) is text or None."""
        rule_ids = list(rule_ids)
        if not rule_ids or not self.rules:
            return []
        self.sweep(ts)
        out, done = [], set()
        for r in rule_ids:
            for i in self.watching.get(r, ()):
                if i in done:
                    continue
                done.add(i)
                c = self.rules[i]
                key = tuple(field(f) for f in c.group_fields(r))
                if any(v is None for v in key):
                    self.stats["event_skipped_missing_field"] += 1
                    continue
                if apply is not None and not apply(c, key):
                    continue
                g = self._group(i, key)
                value = field(c.field) if c.uses_field else None
                observed = g.event(c, ts, rule_ids, value, self.caps, self.stats)
                if observed is not None:
                    out.append(fire(c, key, observed, ts, g.remote))
        return out

    def one(self, i: int, key: tuple, ts: float, rule_ids, value: str | None) -> tuple[int | None, bool]:
        """What correlation i observes if the event fires it in that group, else None;
        and whether the group has had contributions."""
        g = self._group(i, key)
        return g.event(self.rules[i], ts, rule_ids, value, self.caps, self.stats), g.remote

    def contribution(self, k: dict) -> list[dict]:
        if not k.get("corr_id"):
            return []
        ts = float(k.get("ts") or 0.0)
        self.sweep(ts)
        i = next((i for i, c in enumerate(self.rules) if c.id == k["corr_id"]), None)
        if i is None:
            return []
        c, key = self.rules[i], tuple(k.get("group") or ())
        if len(key) != len(c.group_by) or any(v is None for v in key):
            self.stats["event_skipped_missing_field"] += 1
            return []
        g = self._group(i, key)
        observed = g.contribution(c, k, self.caps, self.stats)
        return [] if observed is None else [fire(c, key, observed, ts, True)]
