"""A minimal perfect hash over a fixed set of byte strings: n keys, n slots, one probe.

Keys are dealt to small buckets; for each bucket, largest first, a displacement is sought that sends
its keys to free slots. Buckets of one key come last and point straight at a slot that is left over.
A lookup takes one hash, one displacement and one comparison.
"""

from __future__ import annotations

import xxhash

BUCKET = 2
_MASK = 0xFFFFFFFFFFFFFFFF


class PerfectHash:
    """Maps each of ``keys`` to its value; anything else to None."""

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n = len(keys)
        self.buckets = max(1, self.n // BUCKET)
        self.displacement = [0] * self.buckets
        self.keys: list[bytes] = [b""] * self.n
        self.values = [0] * self.n
        dealt: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            dealt.setdefault(h % self.buckets, []).append((h, i))
        free = set(range(self.n))
        for bucket, members in sorted(dealt.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                slots = [free.pop()]
                d = -1 - slots[0]
            else:
                d = 0
                while len(free.intersection(slots := [self._slot(h, d) for h, _ in members])) < len(members):
                    d += 1
                free.difference_update(slots)
            self.displacement[bucket] = d
            for s, (_, i) in zip(slots, members, strict=True):
                self.keys[s], self.values[s] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        return -1 - d if d < 0 else (((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & _MASK) >> 24) % self.n

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        s = self._slot(h, self.displacement[h % self.buckets])
        return self.values[s] if self.keys[s] == key else None
