"""Rules on keyed state that see the rows of a key in the order of their event time, whatever batch they arrive in.

A row waits in the key's list state until the watermark has passed its time; then no earlier row can come any more, an
event-time timer fires and the waiting rows up to the watermark go through the rule in order. So state holds the rows of
one delay and what the rule itself remembers, and results equal those of the batch rule over all rows. What a rule no
longer needs is cleared by a timer as well.

Keys are dealt to BUCKETS buckets by hash, and state is kept per bucket: calls from the Python worker to the state store,
milliseconds each, are made once per bucket and batch and not once per key. What a rule remembers is a map state with the
key in its keys, read once per bucket and written where it changed.

The state store must be RocksDB (``ROCKSDB``); ``live.drain`` sets it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Buckets of keys; a bucket's rows of one batch are held by a task.
BUCKETS = 512


class Rule:
    """What the keys of a bucket remember between rows. ``load`` reads it all, ``turn`` names the key of the next steps;
    ``step`` takes (time in microseconds, values of a row) and returns output values."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def load(self) -> None:
        raise NotImplementedError

    def turn(self, key: str | None) -> None:
        raise NotImplementedError

    def step(self, us: int, row: tuple) -> list[tuple]:
        raise NotImplementedError

    def save(self) -> None:
        raise NotImplementedError

    def forget_at(self) -> dict:
        """Time in milliseconds from which what a key remembers makes no difference, of keys for which there is one."""
        return {}

    def forget(self, key: str | None) -> None:
        raise NotImplementedError


class Ordered(StatefulProcessor):
    def __init__(self, rule: Rule, tie: str, columns: list[str], out: list[str]):
        self.rule, self.tie, self.columns, self.out = rule, tie, columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")  # a value is the waiting rows of one input batch
        self.rule.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = ["event_micros", self.tie, "own_key", *self.columns]
        new = [list(zip(*[[list(x) if hasattr(x, "tolist") and hasattr(x, "__len__") else x for x in pdf[c].tolist()] for c in names])) for pdf in rows if len(pdf)]
        if new:
            self.held.appendList([(pickle.dumps(x),) for x in new])
            self._wake(min(r[0] for x in new for r in x) // 1000 - 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [r for x in self.held.get() for r in pickle.loads(x[0])] if self.held.exists() else []
        ready, rest = [r for r in held if r[0] <= mark * 1000], [r for r in held if r[0] > mark * 1000]
        found = []
        self.rule.load()
        if ready:
            for us, tie, own, *row in sorted(ready, key=lambda r: r[:2]):
                self.rule.turn(own)
                found += [(own, tie, *values) for values in self.rule.step(us, tuple(row))]
            self.rule.save()
            if rest:
                self.held.put([(pickle.dumps(rest),)])
            else:
                self.held.clear()
        waiting = {r[2] for r in rest}
        wake = [min(r[0] for r in rest) // 1000 - 1] if rest else []
        for own, at in self.rule.forget_at().items():
            if own not in waiting and at > mark:
                wake.append(at)
            elif own not in waiting:
                self.rule.forget(own)
        if wake:
            self._wake(min(wake))
        if found:
            yield pd.DataFrame(found, columns=["own_key", self.tie, *self.out])

    def _wake(self, ms: int) -> None:
        self.handle.registerTimer(max(int(ms), 1))

    def close(self) -> None:
        pass


def ordered(df: DataFrame, rule: Rule, key: str, columns: list[str], out: str, delay: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``rule`` over the rows of each key by (ts, tie); ``out`` is the schema of the values it returns. Result: key, tie, values."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    # keys travel as strings, since pandas has no whole numbers beside nulls
    rows = df.select(F.col(key).cast("string").alias("own_key"), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("key_bucket"), ts, tie, *columns,
                     F.unix_micros(ts).alias("event_micros")).withWatermark(ts, delay)
    names = [f.strip().split(" ")[0] for f in out.split(",")] if out else []
    schema = ", ".join(["own_key string", f"{tie} {kind[tie]}", *([out] if out else [])])
    done = rows.groupBy("key_bucket").transformWithStateInPandas(Ordered(rule, tie, columns, names), schema, "Append", "EventTime")
    return done.select(F.col("own_key").cast(kind[key]).alias(key), tie, *names)


class OneValue(Rule):
    """A rule that remembers one number per key."""

    kind = "long"

    def open(self, handle):
        self.state = handle.getMapState("value", "own_key string", f"v {self.kind}")

    def load(self):
        self.before = {k[0]: v[0] for k, v in self.state.iterator()}
        self.values = dict(self.before)

    def turn(self, key):
        self.key = key

    @property
    def v(self):
        return self.values.get(self.key)

    @v.setter
    def v(self, value):
        self.values[self.key] = value

    def save(self):
        for k, v in self.values.items():
            if v is not None and v != self.before.get(k):
                self.state.updateValue((k,), (v,))

    def forget(self, key):
        self.state.removeKey((key,))


class RateLimit(OneValue):
    """Rows at least ``window_ms`` after the last one that passed; forgotten once the window is over."""

    def __init__(self, window_ms: int):
        self.window_ms = window_ms

    def step(self, us, row):
        if self.v is not None and us // 1000 - self.v < self.window_ms:
            return []
        self.v = us // 1000
        return [()]

    def forget_at(self):
        return {k: v + self.window_ms for k, v in self.values.items() if v is not None}


class Sample(OneValue):
    """The first row of every ``mod``."""

    def __init__(self, mod: int):
        self.mod = mod

    def step(self, us, row):
        self.v = (self.v or 0) + 1
        return [()] if self.v % self.mod == 1 % self.mod else []


class Consent(OneValue):
    """Phase and number of consent clicks so far, of which at most ``max_gates`` count."""

    def __init__(self, consent: str, max_gates: int):
        self.consent, self.max_gates = consent, max_gates

    def step(self, us, row):
        gate = row[0] == self.consent
        self.v = min((self.v or 0) + gate, self.max_gates)
        return [(row[0], "gate" if gate else "after" if self.v else "before", self.v)]


class Passthrough(OneValue):
    """Whether the host is listed or failed a handshake before."""

    def __init__(self, hosts: tuple):
        self.hosts = hosts

    def step(self, us, row):
        known = any(h in self.key for h in self.hosts) or (self.v is not None and self.v < us)
        if row[0] and self.v is None:
            self.v = us
        return [(known,)]


class Tokens(Rule):
    """Values captured from inbound texts that outbound texts carry; one automaton pass per text. A value is forgotten
    ``keep_ms`` after its capture, if given."""

    def __init__(self, pattern: str, keep_ms: int | None = None):
        self.pattern, self.keep_ms = pattern, keep_ms

    def open(self, handle):
        self.state = handle.getMapState("tokens", "own_key string, token string", "since long")

    def load(self):
        self.all, self.fresh, self.automata = {}, {}, {}
        for k, v in self.state.iterator():
            self.all.setdefault(k[0], {})[k[1]] = v[0]

    def turn(self, key):
        self.key, self.known = key, self.all.setdefault(key, {})

    def step(self, us, row):
        import re

        import ahocorasick
        role, text = row
        if role == "in":
            for t in re.findall(self.pattern, text or ""):
                if t not in self.known:
                    self.known[t] = self.fresh[self.key, t] = us // 1000
                    self.automata.pop(self.key, None)
            return []
        if not self.known or not text:
            return []
        if self.key not in self.automata:
            self.automata[self.key] = ahocorasick.Automaton()
            for t in self.known:
                self.automata[self.key].add_word(t, t)
            self.automata[self.key].make_automaton()
        found = {t for _, t in self.automata[self.key].iter(text)}
        return [(t,) for t in sorted(found) if self.keep_ms is None or us // 1000 - self.known[t] <= self.keep_ms]

    def save(self):
        for k, ms in self.fresh.items():
            self.state.updateValue(k, (ms,))

    def forget_at(self):
        return {} if self.keep_ms is None else {k: max(known.values()) + self.keep_ms for k, known in self.all.items() if known}

    def forget(self, key):
        for t in self.all[key]:
            self.state.removeKey((key, t))


class Running(Rule):
    """Running sum of rewards and numbers of distinct APIs and activities; names are written only where new."""

    def open(self, handle):
        self.total = handle.getMapState("total", "own_key string", "v double")
        self.seen = handle.getMapState("seen", "own_key string, kind string, name string", "at long")

    def load(self):
        self.sums, self.names, self.touched, self.fresh = {k[0]: v[0] for k, v in self.total.iterator()}, {}, set(), []
        for own, kind, name in self.seen.keys():
            self._names(own)[kind].add(name)

    def _names(self, key):
        return self.names.setdefault(key, {"api": set(), "activity": set()})

    def turn(self, key):
        self.key, self.mine = key, self._names(key)
        self.touched.add(key)

    def step(self, us, row):
        reward, apis, activity = row
        self.sums[self.key] = self.sums.get(self.key, 0.0) + reward
        for kind, names in (("api", apis), ("activity", [activity] if activity and activity != "unknown" else [])):
            for n in names:
                if n not in self.mine[kind]:
                    self.mine[kind].add(n)
                    self.fresh.append(((self.key, kind, n), us // 1000))
        return [(self.sums[self.key], len(self.mine["api"]), len(self.mine["activity"]))]

    def save(self):
        for k in self.touched:
            self.total.updateValue((k,), (float(self.sums[k]),))
        for k, ms in self.fresh:
            self.seen.updateValue(k, (ms,))
