"""Results that are kept while no newer round is known."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class _Slot:
    lock: threading.Lock = field(default_factory=threading.Lock)
    as_of: object = None
    result: DataFrame | None = None


class Latest:
    """One result a name, for the newest id it was asked with. Callers that ask for
    the same id share it; while one of them computes it the others wait. A newer id
    replaces the result and lets the old one go; an older id gets the newer result."""

    def __init__(self):
        self._slots: dict[str, _Slot] = {}
        self._lock = threading.Lock()

    def get(self, name: str, as_of, make: Callable[[], DataFrame]) -> DataFrame:
        with self._lock:
            slot = self._slots.setdefault(name, _Slot())
        with slot.lock:
            if slot.result is None or as_of > slot.as_of:
                made = make().persist()
                made.count()  # computed here, once, and not by whoever reads first
                if slot.result is not None:
                    slot.result.unpersist()
                slot.as_of, slot.result = as_of, made
            return slot.result

    def stale(self, name: str) -> DataFrame | None:
        """What is there now, without waiting for anything newer."""
        slot = self._slots.get(name)
        return slot.result if slot else None

    def clear(self) -> None:
        with self._lock:
            for slot in self._slots.values():
                if slot.result is not None:
                    slot.result.unpersist()
            self._slots.clear()
