"""Cuts a text where no match of the byte-level BPE pattern can cross, and remembers what a part encodes to.

A single space between two characters that are not white space always begins a match of the pattern, so the
parts from one such space to the next encode independently of each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: White space other than space and line feed, by any library's notion.
_RARE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str) -> list[str]:
    """The parts, in order, each but the first without the space before it; joined by spaces they are the text."""
    odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _RARE.search(text)
    return _CUT.split(text) if odd else text.split(" ")


class Remembered:
    """encode(list of new parts) -> the ids of each as little-endian unsigned 32-bit integers.

    Parts are remembered in two generations of at most limit each: when the young one is full it becomes the
    old one, and what is met again comes back, so that frequent parts stay while memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 300_000) -> None:
        self.encode, self.limit = encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, keys: set[str]) -> None:
        missing = keys.difference(self.young)
        if not missing:
            return
        if len(self.young) + len(missing) > self.limit:
            self.old, self.young, missing = self.young, {}, keys
        young, new = self.young, []
        for k in missing:
            ids = self.old.get(k)
            if ids is None:
                new.append(k)
            else:
                young[k] = ids
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            young.update(zip(some, self.encode([k[1:] if k[:1] == " " else " " + k for k in some]), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids.

        Parts are keyed without the space before them, and none of these begins with a space; a text's first
        part, which has none before it, is keyed with one.
        """
        cut = []
        for t in texts:
            own = parts(t)
            own[0] = " " + own[0]
            cut.append(own)
        self._learn(set().union(*cut))
        known = self.young.__getitem__
        return [b"".join(map(known, own)) for own in cut]


def in_groups(texts: list[str], most: int = 1 << 20):
    """Runs of texts of at most so many characters, or a single text."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class Memo:
    """What make(list of new keys) gives for each key, in two generations of at most limit each, as Remembered has them."""

    def __init__(self, make: Callable[[list[str]], list], limit: int = 200_000) -> None:
        self.make, self.limit = make, limit
        self.young: dict = {}
        self.old: dict = {}

    def of(self, keys: set[str]) -> Callable[[str], object]:
        """A lookup that knows all of these keys, until the next call."""
        missing = keys.difference(self.young)
        if missing and len(self.young) + len(missing) > self.limit:
            self.old, self.young, missing = self.young, {}, keys
        new = []
        for k in missing:
            if k in self.old:
                self.young[k] = self.old[k]
            else:
                new.append(k)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.young.update(zip(some, self.make(some), strict=True))
        return self.young.__getitem__
