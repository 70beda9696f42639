"""The extension mechanism: providers of capabilities, ranked on the driver, as they are few, with the built-in floor."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Provider:
    """Capabilities by name with quality in [0, 1], latency in ms and cost in millionths."""

    id: str
    capabilities: dict[str, tuple[float, float, int]]
    run: Callable[[str, object], object]
    local: bool = True
    available: Callable[[], bool] = field(default=lambda: True)


class Providers:
    """Providers by id; running falls through to the next one when one fails or takes too long, and every attempt is recorded.

    Whether a provider is available is asked again after `ttl` seconds; changes are told to `listeners`."""

    def __init__(self, ttl: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.by_id: dict[str, Provider] = {}
        self.runs: list[dict] = []
        self.listeners: list[Callable[[str, bool], None]] = []
        self.ttl, self.clock = ttl, clock
        self._seen: dict[str, tuple[float, bool]] = {}

    def register(self, provider: Provider) -> None:
        if not callable(provider.run):
            raise TypeError("a provider needs a function to run")
        self.by_id[provider.id] = provider

    def unregister(self, name: str) -> None:
        self.by_id.pop(name, None)
        self._seen.pop(name, None)

    def available(self, name: str) -> bool:
        at, old = self._seen.get(name, (None, None))
        if at is not None and self.clock() - at < self.ttl:
            return old
        try:
            now = bool(self.by_id[name].available())
        except Exception:  # noqa: BLE001
            now = False
        self._seen[name] = (self.clock(), now)
        if old is not None and old != now:
            for tell in self.listeners:
                tell(name, now)
        return now

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p.id, c, float(q), float(ms), int(cost), p.local) for p in self.by_id.values() for c, (q, ms, cost) in p.capabilities.items()]
        return spark.createDataFrame(rows, "provider string, capability string, quality double, latency double, cost long, local boolean")

    def ranked(self, capability: str, prefer: str = "quality", remote: bool = True, most: int | None = None, deny: tuple[str, ...] = (), first: tuple[str, ...] = (), left: int | None = None) -> list[str]:
        """Ids of the providers of a capability, best first: wanted ids, then by quality, speed, cost or privacy. Those denied,
        remote ones where they aren't allowed, dearer than `most` or than what is `left` of a budget are left out."""
        keys = {"quality": lambda q, ms, cost, p: (-q, ms), "speed": lambda q, ms, cost, p: (ms, -q), "cost": lambda q, ms, cost, p: (cost, -q), "privacy": lambda q, ms, cost, p: (not p.local, -q)}
        rows = [(p, *p.capabilities[capability]) for p in self.by_id.values() if capability in p.capabilities and p.id not in deny and (remote or p.local)]
        rows = [r for r in rows if (most is None or r[3] <= most) and (left is None or not r[3] or r[3] <= left)]
        rank = {name: i for i, name in enumerate(first)}
        return [p.id for p, *_ in sorted(rows, key=lambda r: (rank.get(r[0].id, len(rank)), *keys[prefer](*r[1:], r[0]), r[0].id))]

    def call(self, capability: str, task: object, timeout: float | None = None, **choice) -> dict:
        """provider, result and degraded (a better one failed) of the first provider that can run a task."""
        failed = False
        for name in self.ranked(capability, **choice):
            provider, start, result = self.by_id[name], self.clock(), None
            if not self.available(name):
                status = "unavailable"
            else:
                pool = ThreadPoolExecutor(1)
                try:
                    result, status = pool.submit(provider.run, capability, task).result(timeout), "ok"
                except TimeoutError:
                    status = "timeout"
                except Exception as e:  # noqa: BLE001
                    status = f"error: {e}"
                pool.shutdown(wait=False)
            self.runs.append({"provider": name, "capability": capability, "status": status, "latency_ms": int((self.clock() - start) * 1000), "cost": provider.capabilities[capability][2] if status == "ok" else 0})
            if status == "ok":
                return {"provider": name, "result": result, "degraded": failed}
            failed = True
        raise LookupError(f"no provider could run {capability}")

    def history(self, capability: str | None = None, status: str | None = None, limit: int = 100) -> list[dict]:
        """Recorded runs, newest first."""
        rows = [r for r in reversed(self.runs) if (capability is None or r["capability"] == capability) and (status is None or r["status"].startswith(status))]
        return rows[:limit]

    def coverage(self, capabilities: list[str]) -> dict[str, list[str]]:
        return {c: sorted(p.id for p in self.by_id.values() if c in p.capabilities) for c in capabilities}


def builtin() -> Provider:
    """The floor that needs no model: everything it can do runs on this machine, by rule."""
    from lorestack.functions import text as T
    from lorestack.operators import capture, extract

    tasks: dict[str, Callable[[object], object]] = {
        "summarize": lambda t: [s for _, s, _ in extract.summary_rows(t, 3)], "claims": lambda t: [c[1:] for c in extract.claim_rows(t)], "entities": capture.name_runs, "numbers": extract.numbers,
        "classify": extract.classify, "chunk": capture.chunk, "terms": T.py_content_terms, "sentences": T.py_sentences, "contradict": lambda t: extract.contradiction(*t),
    }
    return Provider("built-in", {name: (0.35, 5.0, 0) for name in tasks}, lambda capability, task: tasks[capability](task))
