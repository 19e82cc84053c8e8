"""The reuse stream's state: one entry for many requests, and many keys decided at once as one by one."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd

from pricelens.streaming import reuse as M2


class State:
    """Map and value state of one grouping key, counting calls."""

    def __init__(self):
        self.maps, self.values, self.timers, self.calls = {}, {}, set(), 0

    def _of(self, held, name, has):
        def count(f):
            def g(*a):
                self.calls += 1
                return f(*a)
            return g
        held[name] = {}
        h = held[name]
        ops = {"get": lambda *k: h[k], "put": lambda *kv: h.__setitem__(kv[:-1], kv[-1]), "has": lambda *k: k in h, "drop": lambda *k: h.pop(k, None)}
        return SimpleNamespace(**{n: count(ops[o]) for n, o in has.items()}, keys=lambda: [k[0] for k in list(h)])

    def getMapState(self, name, *_):
        return self._of(self.maps, name, {"getValue": "get", "updateValue": "put", "containsKey": "has", "removeKey": "drop"})

    def getValueState(self, name, *_):
        return self._of(self.values, name, {"get": "get", "update": "put", "exists": "has", "clear": "drop"})

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)


def test_state_calls_follow_segments_not_requests():
    rng = random.Random(1)
    rows = pd.DataFrame([(f"k{rng.randint(0, 300)}", i, 1_700_000_000_000_000 + rng.randint(0, 7_200_000_000)) for i in range(4_000)], columns=["cache_key", "event_id", "t"])
    rows["ts"] = rows.pop("t").astype("datetime64[us]")
    state, p = State(), M2.RecentSearches(3600, 60)
    p.init(state)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    frames = [rows[i:i + 500] for i in range(0, 4_000, 500)]
    assert list(p.handleInputRows((0,), iter(frames), at(0))) == []
    due = min(state.timers)
    out = pd.concat(p.handleExpiredTimer((0,), at(1 << 50), SimpleNamespace(getExpiryTimeInMs=lambda: due)))
    assert len(out) == 4_000 and state.calls < 100
    want, last = {}, {}
    for k, t, e in sorted(zip(rows["cache_key"], rows["ts"].astype("int64"), rows["event_id"])):
        want[e] = k in last and t - last[k] < 3_600_000_000
        if not want[e]:
            last[k] = t
    assert dict(zip(out["event_id"], out["hit"])) == want


def test_many_keys_at_once_as_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n, k = int(rng.integers(1, 200)), int(rng.integers(1, 12))
        code, times = rng.integers(0, k, n), rng.integers(0, 50, n)
        order = np.lexsort((times, code))
        code, times = code[order], times[order]
        last = np.where(rng.random(k) < 0.5, M2.NEVER, rng.integers(-20, 30, k))
        own = last.copy()
        hits = M2.decide_all(code, times, own, 10)
        for c in np.unique(code):
            want, end = M2.decide(times[code == c], None if last[c] == M2.NEVER else int(last[c]), 10)
            assert (hits[code == c] == want).all() and own[c] == (M2.NEVER if end is None else end)
