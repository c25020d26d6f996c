"""Pacing of calls to outside services: a token bucket, and a pool of keys with cool-down."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable


class TokenBucket:
    """At most ``per_minute`` units a minute, refilled continuously; ``acquire`` waits for what it asks for."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most = self.level = float(per_minute)
        self.clock, self.sleep, self.at, self.lock = clock, sleep, clock(), threading.Lock()

    def acquire(self, units: float = 1.0) -> float:
        """Take ``units`` (all of the bucket at most); seconds waited."""
        units, waited = min(units, self.most), 0.0
        while True:
            with self.lock:
                now = self.clock()
                self.level = min(self.most, self.level + (now - self.at) * self.most / 60)
                self.at = now
                if self.level >= units - 1e-9:
                    self.level -= units
                    return waited
                wait = (units - self.level) * 60 / self.most
            self.sleep(wait)
            waited += wait


class KeyPool:
    """Keys in turn; a key that was refused rests, and the next is tried."""

    def __init__(self, keys: list[str], rest: float = 30.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.keys, self.rest, self.clock, self.sleep = list(keys), rest, clock, sleep
        self.until = dict.fromkeys(self.keys, 0.0)
        self.turn, self.lock = 0, threading.Lock()

    def key(self) -> str:
        """The next key that isn't resting, or the one that rests shortest, once it has."""
        with self.lock:
            order = [self.keys[(self.turn + k) % len(self.keys)] for k in range(len(self.keys))]
            now = self.clock()
            best = next((k for k in order if self.until[k] <= now), min(order, key=self.until.__getitem__))
            self.turn = (self.keys.index(best) + 1) % len(self.keys)
            wait = max(0.0, self.until[best] - now)
        if wait:
            self.sleep(wait)
        return best

    def call(self, send: Callable[[str], object], refused: type[Exception], tries: int = 4, wait: float = 2.0):
        """``send(key)``; a refusal rests its key, and every try waits twice as long as the one before."""
        for k in range(tries):
            key = self.key()
            try:
                return send(key)
            except refused:
                with self.lock:
                    self.until[key] = self.clock() + self.rest
                if k == tries - 1:
                    raise
                if len(self.keys) == 1 or all(self.until[x] > self.clock() for x in self.keys):
                    self.sleep(wait)
                    wait *= 2
