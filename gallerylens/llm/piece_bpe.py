"""SentencePiece encoding and decoding of models of merges, by backtracking.

Such a model merges, of all neighbours whose joined text is a piece, those of the highest score, the leftmost of
equal ones, again and again.  Whether a merge ever crosses a boundary is decided by the two tokens beside it alone,
because the merges inside a token follow one another in the same order whatever else the text holds.  A sequence of
tokens is therefore the encoding exactly if each two neighbours, merged anew from their characters, come out as
just these two.

One pass of an Aho-Corasick automaton finds the longest piece at each place.  From the left the longest piece is
tried first, then its shorter prefixes; a piece stays if it is compatible with the one before and does not end at a
place that failed.  Where none is left, the place is marked in a bitfield and the token before it is shortened.  The
tokens up to a place are unique, so no place fails twice and the search is linear in the text.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept, strings, texts
from .pieces import Memo, in_groups

SPACE = "▁"
#: From one space that follows another character to the next.
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each-byte", _each_byte)


class Model:
    """Pieces and scores of a model file; of its settings those are taken that leave texts as they are, others raise ValueError."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec, normal = proto.trainer_spec, proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if spec.model_type != spec.BPE or not spec.byte_fallback or spec.treat_whitespace_as_suffix or kinds & {4, 5}:
            raise ValueError("not a model of merges that falls back on bytes")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces:
            raise ValueError("the model changes texts before it cuts them")
        self.names = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]  # 1 normal, 2 unknown, 3 control, 6 byte
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}


class Encoder:
    """encode(text whose spaces are marks) -> ids of its tokens; at most `limit` pairs of neighbours are remembered.

    Inside, a token is a number: its piece's id, or that of no piece, its character's code point above all ids.
    """

    def __init__(self, model: Model, limit: int = 1_000_000) -> None:
        import ahocorasick

        self.ids, self.scores, self.byte, self.limit = model.ids, model.scores, model.byte, limit
        self.names, self.chars = model.names, len(model.names)
        self.finder = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.finder.add_word(piece, i)
        self.finder.make_automaton()
        self.sizes = [len(p) for p in model.names]
        #: The longest shorter piece that begins a piece; at last its first character, piece or not; of a character -1.
        self.shorter = [-1] * self.chars
        for piece, i in self.ids.items():
            self.shorter[i] = next((self.number(piece[:k]) for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.scores or k == 1), -1)
        self.apart: dict[int, bool] = {}
        #: No piece has a space after another character, so that tokens never cross such a place.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        #: A character of no piece: no match crosses it.
        self.between = next(c for c in map(chr, range(0x110000)) if not any(c in p for p in self.scores))

    def number(self, token: str) -> int:
        return self.ids[token] if token in self.ids else self.chars + ord(token)

    def name(self, token: int) -> str:
        return self.names[token] if token < self.chars else chr(token - self.chars)

    def merged(self, text: str) -> list[str]:
        """text by merging: the definition, for short texts."""
        own, score = list(text), self.scores.get
        pairs = [score(a + b, -np.inf) for a, b in zip(own, own[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == -np.inf:
                break
            at = pairs.index(best)
            own[at : at + 2] = [own[at] + own[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(own[at - 1] + own[at], -np.inf)
            if at < len(pairs):
                pairs[at] = score(own[at] + own[at + 1], -np.inf)
        return own

    def compatible(self, left: int, right: int) -> bool:
        """Whether both, merged anew, stay apart; left may be -1, none."""
        if len(self.apart) >= self.limit:
            self.apart.clear()
        own = [self.name(t) for t in (left, right) if t >= 0]
        known = self.apart[left << 21 | right] = self.merged("".join(own)) == own
        return known

    def numbers(self, texts: list[str]) -> list[list[int]]:
        """Each text's tokens. One pass of the automaton goes through all texts, none of whose matches cross."""
        text = self.between.join(texts)
        longest = array("i", [-1]) * (len(text) + 1)  # a character that is no piece is a token of its own
        sizes, shorter, chars, apart, compatible = self.sizes, self.shorter, self.chars, self.apart, self.compatible
        for end, i in self.finder.iter(text):
            longest[end - sizes[i] + 1] = i  # matches come by where they end: the last is the longest
        failed, fails = bytearray(len(text) // 8 + 1), False
        found, begin = [], 0
        for own in texts:
            at, stop, last = begin, begin + len(own), -1
            out: list[int] = []
            token = -1 if not own else longest[at] if longest[at] >= 0 else chars + ord(text[at])
            while at < stop:
                while token >= 0:
                    end = at + (sizes[token] if token < chars else 1)
                    if not (fails and failed[end >> 3] >> (end & 7) & 1):
                        known = apart.get(last << 21 | token)
                        if compatible(last, token) if known is None else known:
                            break
                    token = shorter[token] if token < chars else -1
                if token >= 0:
                    out.append(token)
                    at, last = end, token
                    if at < stop:
                        token = longest[at]
                        if token < 0:
                            token = chars + ord(text[at])
                else:
                    failed[at >> 3] |= 1 << (at & 7)
                    fails = True
                    token = out.pop()
                    at, last = at - (sizes[token] if token < chars else 1), out[-1] if out else -1
                    token = shorter[token] if token < chars else -1
            found.append(out)
            begin = stop + 1
        return found

    def tokens(self, text: str) -> list[str]:
        return [self.name(t) for t in self.numbers([text])[0]]

    def encoded(self, texts: list[str]) -> list[array]:
        """The ids of each text."""
        out, chars = [], self.chars
        for own in self.numbers(texts):
            if own and max(own) >= chars:
                own = [i for t in own for i in ((t,) if t < chars else [self.byte[b] for b in chr(t - chars).encode("utf-8", "replace")])]
            out.append(array("I", own))
        return out

    def encode(self, text: str) -> array:
        return self.encoded([text])[0]


class Decoder:
    """Ids back to text: marks become spaces, the first one goes, runs of byte tokens are read as UTF-8, an ill-formed byte being U+FFFD."""

    def __init__(self, model: Model) -> None:
        surface = {1: lambda p: p.replace(SPACE, " "), 2: lambda p: " ⁇ ", 3: lambda p: "", 6: lambda p: ""}
        self.surface = [surface[k](p) for p, k in zip(model.names, model.kinds, strict=True)]
        self.first = [s[1:] if k == 1 and s[:1] == " " else s for s, k in zip(self.surface, model.kinds, strict=True)]
        self.value = {i: b for b, i in model.byte.items()}
        self.is_byte = np.zeros(len(model.names), bool)
        self.is_byte[list(self.value)] = True

    def text(self, ids: array) -> str:
        out, at, n = [], 0, len(ids)
        while at < n and not out:  # up to the first token that is something
            if self.is_byte[ids[at]]:
                break
            if self.surface[ids[at]]:
                out.append(self.first[ids[at]])
            at += 1
        bytes_at = (np.flatnonzero(self.is_byte[np.frombuffer(ids, np.uint32)[at:]]) + at).tolist() if at < n else []
        run = bytearray()
        surface, value = self.surface.__getitem__, self.value
        for k, place in enumerate(bytes_at):
            if place > at:
                out.append("".join(map(surface, ids[at:place])))
            run.append(value[ids[place]])
            at = place + 1
            if k + 1 == len(bytes_at) or bytes_at[k + 1] != at:
                out.append(run.decode("utf-8", "each-byte"))
                run.clear()
        out.append("".join(map(surface, ids[at:])))
        return "".join(out)


class Codec:
    def __init__(self, path: str) -> None:
        model = Model(path)
        self.encoder, self.decoder = Encoder(model), Decoder(model)
        self.names = [str(i) for i in range(len(model.names))]
        self.memo = Memo(lambda keys: [ids.tobytes() for ids in self.encoder.encoded([SPACE + k for k in keys])])

    @classmethod
    def of(cls, path: str) -> Codec:
        """One per worker, kept between tasks."""
        return kept(("pieces", path), lambda: cls(path))

    def _segments(self, text: str) -> list[str]:
        """The parts that encode independently, each without the mark it begins with."""
        if not text:
            return []
        if not self.encoder.cuts:
            return [text.replace(" ", SPACE)]
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return [s[1:] for s in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def encode(self, found: list[str]) -> list[array]:
        cut = [self._segments(t) for t in found]
        known = self.memo.of(set().union(*cut))
        return [array("I", b"".join(map(known, own))) for own in cut]

    def named(self, ids: Iterable[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.names.__getitem__, ids))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256[, ids].

    A null or empty text has no ids, and the digests of no bytes; a text of spaces is encoded as it is, and bytes that
    are not UTF-8 count as U+FFFD.  A text is cut only where no token can cross, so very long ones are encoded whole.
    Repeated rows, and rows without a doc_id, are kept.  An empty table gives an empty result.
    """

    def run(batches):
        codec = Codec.of(model)
        for batch in batches:
            done: list[tuple] = []
            for group in in_groups(strings(batch.column("text"))):
                for ids in codec.encode(group):
                    done.append((len(ids), _digest(codec.named(ids)), _digest(codec.decoder.text(ids)), *([ids.tolist()] if with_ids else [])))
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=False)] if done else [pa.array([], t) for t in types[: 3 + with_ids]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids)


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give an empty text, an unknown id raises IndexError."""

    def run(batches):
        decoder = Codec.of(model).decoder
        for batch in batches:
            found = [decoder.text(array("I", ids or ())) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr(f"{id_col} as doc_id", f"{ids_col} as ids").mapInArrow(run, "doc_id long, text string")
