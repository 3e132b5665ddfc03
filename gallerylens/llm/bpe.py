"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Over a run of bytes the last token of each prefix's encoding is unique: of the tokens that end there it is the
one that stays apart from the last token before it when both are encoded together.  That makes BPE a
transducer: a state holds the bytes still undecided, a step reads a byte.  A boundary is sent once the
encodings of all prefixes that a later token may still start from run through it, which is after at most the
longest token.  States and steps are compiled from the merges when first met.

Tokens of which each stays apart from the next are the encoding.  A state takes no notice of the token sent
before its bytes, which keeps states few; where a token sent turns out not to stay apart from the one before,
the match is read again by a second machine whose states hold the token sent last.

Decoding walks a machine of its own: states of UTF-8 between characters or inside one, steps by whole token.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, strings, texts
from .pieces import Remembered, in_groups


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Transducer:
    """encode(bytes of one match) -> ids, as merging the adjacent pair of lowest rank again and again would give.

    At most limit states are held; past that they are compiled anew.  A byte without a rank cannot be encoded
    and raises KeyError.  strict: states hold the token sent last.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = 300_000, strict: bool = False) -> None:
        self.ranks, self.limit, self.strict = ranks, limit, None if strict else Transducer(ranks, limit, True)
        self.tokens = {r: t for t, r in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.apart: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.index = {(-1, b""): 0}
        #: token sent last, pending bytes, last token of each prefix of these, where a token may still start
        self.states: list[tuple[int, bytes, tuple, tuple]] = [(-1, b"", (), (0,))]
        self.steps: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]  # byte -> ids sent, next state
        self.ends: list[tuple[int, ...]] = [()]  # ids sent when the match ends

    def encode(self, match: bytes) -> list[int]:
        if len(self.states) > self.limit:
            self._restart()
        out: list[int] = []
        steps, state, apart = self.steps, 0, self.apart
        for b in match:
            step = steps[state].get(b) or self._step(state, b)
            if ids := step[0]:
                if out and self.strict and not (apart[pair] if (pair := (out[-1], ids[0])) in apart else self._stay_apart(*pair)):
                    return self.strict.encode(match)
                out += ids
            state = step[1]
        if ids := self.ends[state]:
            if out and self.strict and not self._stay_apart(out[-1], ids[0]):
                return self.strict.encode(match)
            out += ids
        return out

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together encode to just these two; left -1: to right alone.

        Merges are undone from the latest backwards on either side of the boundary: if ever the two parts
        that touch it would have merged before the merge undone last, the boundary does not stand.
        """
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            known = self.apart[left, right] = self._halves(right) is not None if left < 0 else self._boundary(left, right)
        return known

    def _boundary(self, left: int, right: int) -> bool:
        if self._halves(left) is None or self._halves(right) is None:
            return False
        ranks, tokens, before = self.ranks, self.tokens, 1 << 60
        while True:
            if ranks.get(tokens[left] + tokens[right], before) < before:
                return False
            l, r = self._halves(left), self._halves(right)
            if l and (not r or left > right):
                before, left = left, l[1]
            elif r:
                before, right = right + 1, r[0]  # of merges of one rank the left one is first
            else:
                return True

    def _halves(self, token: int) -> tuple | None:
        """The two tokens that the token's last merge joins; () for a byte; None if its bytes encode otherwise."""
        if token not in self.halves:
            ranks, own = self.ranks, [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            found: tuple | None = ()
            while len(own) > 1:
                low, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(own, own[1:], strict=False)))
                if low == 1 << 60:
                    found = None
                    break
                if len(own) == 2:
                    found = ranks[own[0]], ranks[own[1]]
                own[at : at + 2] = [own[at] + own[at + 1]]
            self.halves[token] = found
        return self.halves[token]

    def _step(self, state: int, b: int) -> tuple[tuple[int, ...], int]:
        sent, pending, lasts, starts = self.states[state]
        text, tokens, ranks = pending + bytes((b,)), self.tokens, self.ranks
        n = len(text)
        for start in starts:
            last = ranks.get(text[start:])
            if last is not None and self._stay_apart(lasts[start - 1] if start else sent, last):
                break
        else:
            raise KeyError(text)
        lasts = (*lasts, last)
        starts = [at for at in starts if text[at:] in self.prefixes]
        ways = {*starts, n}
        while len(ways) > 1:  # the last boundary that all ways share
            at = max(ways)
            ways.discard(at)
            ways.add(at - len(tokens[lasts[at - 1]]))
        at = cut = ways.pop()
        ids = []
        while at:
            ids.append(lasts[at - 1])
            at -= len(tokens[ids[-1]])
        key = (-1 if self.strict else ids[0] if ids else sent, text[cut:])
        if (to := self.index.get(key)) is None:
            to = self.index[key] = len(self.states)
            self.states.append((*key, lasts[cut:], (*(at - cut for at in starts), n - cut)))
            self.steps.append({})
            at, rest = n, []
            while at > cut:
                rest.append(lasts[at - 1])
                at -= len(tokens[rest[-1]])
            self.ends.append(tuple(rest[::-1]))
        self.steps[state][b] = step = (tuple(ids[::-1]), to)
        return step


#: First bytes of UTF-8 by how many bytes follow and the range of the first that follows (RFC 3629).
_LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]


class Utf8Stream:
    """Decodes ids as they come: whole characters go out, the bytes of an unfinished one wait.

    A state is (bytes that must follow, lowest and highest next byte); between characters it is (0, 0, 0).
    Steps are by token: the next state and how many trailing bytes stay unfinished.  Those from between
    characters are compiled at first, the others when first met; a run of tokens that all lead back between
    characters is one chunk.  Ill-formed bytes go out unchanged in the bytes and as U+FFFD in the text.
    """

    REST = (0, 0, 0)

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens, self.steps = tokens, {}
        self.whole = np.zeros(max(tokens, default=-1) + 1, bool)
        for i in tokens:
            self.steps[self.REST, i] = step = self._step(self.REST, i)
            self.whole[i] = step[0] is self.REST

    def _step(self, state: tuple[int, int, int], token: int) -> tuple[tuple[int, int, int], int]:
        open_bytes = 0  # of the unfinished character, in this token
        for b in self.tokens[token]:
            need, low, high = state
            if need and low <= b <= high:
                state = (need - 1, 0x80, 0xBF) if need > 1 else self.REST
                open_bytes = open_bytes + 1 if need > 1 else 0
                continue
            follow = next((x for x in _LEADS if x[0] <= b <= x[1]), None)
            state, open_bytes = ((follow[2], follow[3], follow[4]), 1) if follow else (self.REST, 0)
        return state, open_bytes

    def chunks(self, ids: Sequence[int]) -> Iterator[bytes]:
        """Bytes up to the last whole character of each run of tokens, without empty chunks; at the end what is left."""
        state, held, tokens, at, ids = self.REST, b"", self.tokens.__getitem__, 0, list(ids)
        inside = [*np.flatnonzero(~self.whole[np.asarray(ids, np.int64)]).tolist(), len(ids)]
        upcoming = iter(inside)
        stop = next(upcoming)
        while at < len(ids):
            while stop < at:
                stop = next(upcoming)
            if state is self.REST and stop > at:
                yield b"".join(map(tokens, ids[at:stop]))
                at = stop
                continue
            step = self.steps.get((state, ids[at]))
            if step is None:
                step = self.steps[state, ids[at]] = self._step(state, ids[at])
            token = tokens(ids[at])
            held, at, state = held + token, at + 1, step[0]
            if state is self.REST or step[1] < len(token):  # a character ends in this token
                yield held[: len(held) - step[1]]
                held = held[len(held) - step[1] :]
        if held:
            yield held

    def text(self, ids: Sequence[int]) -> Iterator[str]:
        for chunk in self.chunks(ids):
            yield chunk.decode("utf-8", "replace")


class Codec:
    """A rank file and the pattern that cuts texts into matches."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.machine, self.pattern = Transducer(read_ranks(path)), regex.compile(pattern)
        self.remembered = Remembered(self._encode)
        self.stream = Utf8Stream(self.machine.tokens)

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """One per worker, kept between tasks."""
        return kept(("bpe", path, pattern), lambda: cls(path, pattern))

    def _encode(self, new: list[str]) -> list[bytes]:
        encode, find = self.machine.encode, self.pattern.findall
        return [array("I", [i for m in find(p) for i in encode(m.encode())]).tobytes() for p in new]

    def encode(self, found: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.remembered.ids(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.stream.chunks(array("I", ids)))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids].

    A null or empty text has no ids, and the digests of no bytes; bytes that are not UTF-8 count as U+FFFD.
    Repeated rows, and rows without a doc_id, are kept.  An empty table gives an empty result.
    """

    def run(batches):
        codec = Codec.of(ranks, pattern)
        for batch in batches:
            done: list[tuple] = []
            for group in in_groups(strings(batch.column("text"))):
                for ids in codec.encode(group):
                    done.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest(), *([array("I", ids).tolist()] if with_ids else [])))
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=False)] if done else [pa.array([], t) for t in types[: 3 + with_ids]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give an empty text, an unknown id raises KeyError."""

    def run(batches):
        codec = Codec.of(ranks, pattern)
        for batch in batches:
            found = ["".join(codec.stream.text(ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr(f"{id_col} as doc_id", f"{ids_col} as ids").mapInArrow(run, "doc_id long, text string")
