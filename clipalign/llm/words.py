"""What is worked out for words, kept in a worker: some at hand, more of them in compact arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from .tokenfiles import Remembered

#: Words at hand. Results don't depend on it.
AT_HAND = 150_000
#: Words worked out at a time.
BATCH = 2000


class WordMemory:
    """`known` holds the value of each key that was learned last, as `make` gives them for a list of keys; None is a value too.

    Once there are more than `AT_HAND`, they are put away as bytes by their digests, and fetched from there when they come again. What was
    put away is forgotten when it grows over `away` words. With `keep`, those that came again stay at hand, up to half of `AT_HAND`. A smaller
    bound than `AT_HAND` may be given as `at_hand`.
    """

    def __init__(self, make: Callable[[list[str]], list], pack: Callable[[object], bytes] = bytes, unpack: Callable[[bytes], object] = bytes,
                 away: int | None = None, keep: bool = False, at_hand: int | None = None):
        self.make, self.pack, self.unpack, self.limit, self.keep = make, pack, unpack, away, keep
        self.at_hand = at_hand
        self.known: dict[str, object] = {}
        self.common: dict[str, object] = {}
        self.fresh: list[str] = []
        self.away = Remembered()

    def learn(self, keys: Iterable[list[str]]) -> None:
        """Have the values of all these keys at hand."""
        most = min(AT_HAND, self.at_hand or AT_HAND)
        if len(self.known) > most:
            if self.limit and len(self.away.first) + len(self.fresh) > self.limit:
                self.away = Remembered()
            self.away.add({key: self.pack(self.known[key]) for key in self.fresh})
            if len(self.common) > most // 2:
                self.common = {}
            self.fresh, self.known = [], dict(self.common)
        new = list(set().union(*keys).difference(self.known))
        unknown = []
        for key, packed in zip(new, self.away.find(new)):
            if packed is None:
                unknown.append(key)
            else:
                self.known[key] = self.unpack(packed)
                if self.keep:
                    self.common[key] = self.known[key]
        for at in range(0, len(unknown), BATCH):
            part = unknown[at:at + BATCH]
            values = self.make(part)
            self.known.update(zip(part, values))
            self.fresh += [key for key, value in zip(part, values) if value is not None]
