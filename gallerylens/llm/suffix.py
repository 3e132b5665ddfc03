"""Removal of repeated byte strings, by merging shard Burrows-Wheeler transforms.

A byte goes when a string of 50 bytes that covers it also starts in a document with a smaller id.

Which windows of 50 bytes are repeated is decided by merged transforms alone, symbol by symbol.  Anchors only
tell which bytes have to meet: a window's anchor is the smallest hash among its 20-byte strings, so equal
windows have equal anchors, and a window whose anchor occurs in one document only is not repeated.  Two anchors
that have one hash by chance bring together bytes that the transforms then find unlike.

* A task takes its texts some MB at a time.  Runs of windows whose anchors occur in several of these texts are
  cut into shards; each shard gets its Burrows-Wheeler transform, and the transforms are merged.  What also
  starts in a smaller document is covered, and anchors of nothing else go no further: a passage that a third of
  all documents share leaves these texts once.
* The other anchors are dealt out by their hash, packed into one block for each bucket.  A window also holds the
  15 bytes after its anchor or the 16 before it; windows for which several documents have the anchor and a hash of
  that side go to the place of the first of them in the smallest document, by regions of 512 bytes, where runs of
  windows overlap and become one part.  Where one anchor and side have over GROUP bytes of runs, these are dealt
  to many places: windows that begin within 4 bytes of each other (with 16 times as much, every window) go to the
  one that the bytes they share name, so that only what agrees in 47 (50) bytes meets.
* At each place the transforms of shards are merged again.  If more meet there than MERGE bytes, they are taken
  in order of documents, and only the windows that no smaller document has wait for the next ones.

Merging refines the interleaving of the shards: a stable pass by the symbols before the suffixes moves each
suffix to its place among those that share one symbol more, and splits the blocks of suffixes that agree so far.
After 50 symbols a block is an interval of common prefix 50 or more, and the smallest document in it decides for
all others.  Refinement starts from the first eight symbols, by which the suffixes of all shards are put in order once;
the other 42 symbols are never compared.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import raw, stored, texts

LENGTH, GRAM = 50, 20
#: Windows that begin up to HALF places before their anchor hold what follows it up to place LENGTH - HALF; the others what is before it.
HALF = 15
#: Bytes that are hashed at a time, that a task looks at together, of a shard, of a merge, of an anchor's runs in one place, of a region.
CHUNK, BLOCK, SHARD, MERGE, GROUP, REGION = 256 << 10, 4 << 20, 128 << 10, 512 << 10, 512 << 10, 512
#: Anchors that are resolved at a time; bytes of a key that are sent.
RESOLVE, KEY_BYTES = 300_000, 6
_LOW = np.uint64((1 << 19) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    """x moved n places to the front, zeros at the end."""
    out = np.zeros_like(x)
    if n < len(x):
        out[: len(x) - n] = x[n:]
    return out


def gram_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 16 and of the GRAM = 16 + 4 bytes from each place."""
    h = _mix((buffer.astype(np.uint64) + np.uint64(1)) * _ODD[0])
    four = h
    for level, n in enumerate((1, 2, 4, 8)):
        h = _mix(h * _ODD[level] + _ahead(h, n))
        four = h if n == 2 else four
    return h, _mix(h * _ODD[5] + _ahead(four, 16))


def _chunks(found: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) of about CHUNK bytes; a longer text is cut, the windows across a cut in the earlier part."""
    held, size = [], 0
    for k, text in enumerate(found):
        for offset in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            part = text[offset : offset + CHUNK + LENGTH - 1]
            if held and size + len(part) > CHUNK:
                yield held
                held, size = [], 0
            held.append((k, offset, part))
            size += len(part)
    if held:
        yield held


def anchors(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each anchor, and rows (text, first window, windows, how far before the anchor the first begins, sides), in order.

    Neighbouring windows of one anchor are one run.  The sides are 8 bits of a hash of what follows the anchor, and of what is before it.
    """
    keys, out = [np.zeros(0, np.uint64)], [np.zeros((5, 0), np.int64)]
    for group in _chunks(found):
        buffer = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
        sizes = np.array([len(t) for _, _, t in group])
        windows = np.maximum(sizes - LENGTH + 1, 0)
        if not windows.any():
            continue
        begin = np.cumsum(sizes) - sizes
        h16, gram = gram_hashes(buffer)
        low = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)  # the first of equals, wherever the window lies
        width, span = LENGTH - GRAM + 1, 1
        while 2 * span <= width:
            low[:-span] = np.minimum(low[:-span], low[span:])
            span *= 2
        low[: len(low) - width + span] = np.minimum(low[: len(low) - width + span], low[width - span :])
        which = np.repeat(np.arange(len(group)), windows)
        at = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[which]
        own = (low[at] & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (which[1:] != which[:-1])]))
        of = which[first]
        text, offset = np.array([k for k, _, _ in group]), np.array([o for _, o, _ in group])
        place = own[first]
        after, ahead = h16[np.minimum(place + LENGTH - HALF - 16, len(h16) - 1)], h16[np.maximum(place - HALF - 1, 0)]
        sides = (after >> np.uint64(56) << np.uint64(8) | ahead >> np.uint64(56)).astype(np.int64)
        keys.append(gram[place])
        out.append(np.stack([text[of], at[first] - begin[of] + offset[of], np.diff(np.append(first, len(at))), place - at[first], sides]))
    return np.concatenate(keys), np.concatenate(out, axis=1)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])) if len(columns[0]) else np.zeros(0, np.int64)


def _spread(at: np.ndarray, n: int) -> np.ndarray:
    """The sizes of groups that start at `at` among n rows."""
    return np.diff(np.append(at, n))


def in_several(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether each row's key occurs with another document too."""
    out = np.zeros(len(keys), bool)
    order = np.argsort(keys)
    own = docs[order]
    at = _starts(keys[order])
    if len(at):
        out[order] = np.repeat(np.minimum.reduceat(own, at) != np.maximum.reduceat(own, at), _spread(at, len(keys)))
    return out


def halves(keys: np.ndarray, start: np.ndarray, n: np.ndarray, lead: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, key, first window, windows, how far before the anchor the first begins) of the windows that hold what follows an anchor, then of those that hold what is before it; equal windows have equal keys."""
    turn = np.clip(lead - HALF, 0, n)  # so many of the first windows hold what is before it
    after, ahead = np.flatnonzero(turn < n), np.flatnonzero(turn > 0)
    of = np.concatenate([after, ahead])
    side = np.concatenate([sides[after] >> 8 | 256, sides[ahead] & 255]).astype(np.uint64)
    return of, _mix(keys[of] + side * _ODD[0]), np.concatenate([(start + turn)[after], start[ahead]]), np.concatenate([(n - turn)[after], turn[ahead]]), np.concatenate([(lead - turn)[after], lead[ahead]])


def _merged(key: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row of each union, start, end) of the unions of intervals of one key that overlap or touch."""
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    order = np.lexsort((start, *key))
    start, end = start[order], end[order]
    fresh = np.zeros(len(start), bool)
    fresh[_starts(*(k[order] for k in key))] = True
    # the running largest end within a key, on a scale where keys do not overlap
    base = (np.cumsum(fresh) - 1) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + base)
    at = np.flatnonzero(fresh | np.concatenate([[True], (start + base)[1:] > reach[:-1]]))
    last = np.append(at[1:] - 1, len(start) - 1)
    return order[at], start[at], (reach - base)[last]


def _packed(symbols: np.ndarray) -> np.ndarray:
    """The eight symbols from each place as one number."""
    k = symbols.astype(np.uint64)
    for n in (1, 2, 4):
        k = k << np.uint64(8 * n) | _ahead(k, n)
    return k


def shard_transform(symbols: np.ndarray, head: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, Burrows-Wheeler transform) of strings that each end with symbol 0, sorted by 64 symbols.

    head: the first eight symbols of each suffix; with it the transform holds the two symbols before each, as one.
    """
    n, width = len(symbols), 1 if head is None else 8
    key = symbols.astype(np.uint64) if head is None else head
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        number = np.cumsum(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]), dtype=np.uint32)
        if width >= 64 or number[-1] == n:
            return order, symbols[order - 1] if head is None else symbols[order - 2].astype(np.uint16) << 8 | symbols[order - 1]
        rank = np.empty(n, np.uint64)
        rank[order] = number
        key = rank << np.uint64(32) | _ahead(rank, width)
        width *= 2


def merge_transforms(transforms: list[np.ndarray], heads: list[np.ndarray] | None = None, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each suffix, block of each suffix) in merged order: suffixes of a block share their first depth symbols.

    heads: for each shard the first eight symbols of its sorted suffixes, by which the interleaving begins; the
    transforms then are of two symbols, and each pass refines by two.
    """
    shard = np.repeat(np.arange(len(transforms)).astype(np.min_scalar_type(len(transforms))), [len(t) for t in transforms])
    every, block = np.concatenate(transforms), np.zeros(len(shard), np.int32)
    if heads is not None:
        head = np.concatenate(heads)
        order = np.argsort(head, kind="stable")
        shard, head = shard[order], head[order]
        block = np.cumsum(np.concatenate([[False], head[1:] != head[:-1]]), dtype=np.int32)
    before = np.empty_like(every)
    for _ in range(depth if heads is None else (depth - 8) // 2):
        before[np.argsort(shard, kind="stable")] = every
        order = np.argsort(before, kind="stable")
        block, shard, symbol = block[order], shard[order], before[order]
        block = np.cumsum(np.concatenate([[False], (block[1:] != block[:-1]) | (symbol[1:] != symbol[:-1])]), dtype=np.int32)
    return shard, block


def repeated(parts: list[bytes], docs: np.ndarray, shard_bytes: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of each window of 50 bytes that also starts in a part of a smaller document."""
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths + 1)
    joined = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    used = np.zeros(256, bool)
    use = np.ones(len(joined), bool)
    use[ends - 1] = False
    used[joined[use]] = True
    kind = np.uint8 if used.sum() < 256 else np.uint16
    symbols = np.where(use, np.cumsum(used).astype(kind)[joined], kind(0))
    cuts = [0]
    for k, end in enumerate(ends.tolist()):
        if k + 1 < len(ends) and ends[k + 1] - cuts[-1] > shard_bytes and end > cuts[-1]:
            cuts.append(end)
    transforms, places, heads = [], [], []
    for a, b in zip(cuts, [*cuts[1:], len(symbols)], strict=True):
        head = _packed(symbols[a:b]) if kind == np.uint8 else None
        order, transform = shard_transform(symbols[a:b], head)
        transforms.append(transform)
        places.append(order + a)
        heads.append(None if head is None else head[order])
    shard, block = merge_transforms(transforms, heads if kind == np.uint8 else None)
    place = np.empty(len(shard), np.int64)
    place[np.argsort(shard, kind="stable")] = np.concatenate(places)
    part = np.repeat(np.arange(len(parts)), lengths + 1)[place]
    whole = place + LENGTH < ends[part]  # the window ends before the part's terminator
    place, part, block = place[whole], part[whole], block[whole]
    at = _starts(block)
    if not len(at):
        return part, place
    own = docs[part]
    late = own > np.repeat(np.minimum.reduceat(own, at), _spread(at, len(block)))
    return part[late], place[late] - (ends[part[late]] - 1 - lengths[part[late]])


class Merge:
    """Parts (doc, mark, start, bytes) that meet, MERGE bytes at a time; parts of one key come in order of documents."""

    def __init__(self, limit: int = MERGE) -> None:
        self.limit, self.parts, self.size, self.waited = limit, [], 0, 0

    def add(self, doc: int, mark: int, start: int, part: bytes) -> None:
        self.parts.append((doc, mark, start, part))
        self.size += len(part) + 1

    @property
    def full(self) -> bool:
        return self.size >= max(self.limit, 2 * self.waited)

    def settled(self, keep_from: int | None = None) -> np.ndarray:
        """Covered intervals (doc, mark, start, end) of the parts; of those from keep_from on, the windows that no smaller document has stay for the next merge."""
        if not self.parts:
            return np.zeros((4, 0), np.int64)
        docs, marks, starts, parts = zip(*self.parts, strict=True)
        docs, marks, starts = (np.array(c, np.int64) for c in (docs, marks, starts))
        part, offset = repeated(list(parts), docs)
        stay = []
        if keep_from is not None:
            begin = np.cumsum([0, *map(len, parts)])
            new = np.ones(begin[-1] + 1, bool)
            for k in range(len(parts)):  # the last 49 places of a part begin no window
                new[max(begin[k], begin[k + 1] - LENGTH + 1) : begin[k + 1]] = False
            new[begin[part] + offset] = False
            new[-1] = False
            edge = np.flatnonzero(np.diff(np.concatenate([[False], new]).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                k = int(np.searchsorted(begin, a, side="right")) - 1
                if k >= keep_from:
                    stay.append((int(docs[k]), int(marks[k]), int(starts[k]) + a - int(begin[k]), parts[k][a - begin[k] : b - begin[k] + LENGTH - 1]))
        self.parts, self.size = stay, sum(len(p[3]) + 1 for p in stay)
        self.waited = self.size
        first, start, end = _merged([marks[part], docs[part]], starts[part] + offset, starts[part] + offset + LENGTH)
        return np.stack([docs[part][first], marks[part][first], start, end])


def text_mark(text: bytes) -> int:
    """Tells rows that share a doc_id apart, as a signed long."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _planes(x: np.ndarray, n: int = 8) -> bytes:
    """The lowest n bytes of 64-bit numbers, one plane after another: planes of zeros compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _unplaned(data: bytes, n: int, rows: int) -> np.ndarray:
    out = np.zeros((rows, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(n, rows).T
    return out.reshape(-1).view(np.uint64)


def pack_block(keys: np.ndarray, docs: np.ndarray, place: np.ndarray) -> bytes:
    """Anchors as bytes: keys (KEY_BYTES of them), documents by difference, places."""
    return len(keys).to_bytes(4, "little") + _planes(keys, KEY_BYTES) + _planes(np.diff(docs, prepend=0).view(np.uint64)) + _planes(place.view(np.uint64))


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    a, b = 4 + KEY_BYTES * n, 4 + (KEY_BYTES + 8) * n
    return _unplaned(data[4:a], KEY_BYTES, n), np.cumsum(_unplaned(data[a:b], 8, n).view(np.int64)), _unplaned(data[b:], 8, n).view(np.int64)


_LOCAL = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("block", pa.binary())])
_FOUND = pa.schema([("width", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def settle(found: list[bytes], docs: np.ndarray, keys: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covered intervals (text, start, end) by smaller documents of these texts, and which anchors hold a window that none of these is seen to have.

    Runs are merged MERGE bytes at a time: what a text of another merge has is found where anchors meet.
    """
    of, half, start, n, _ = halves(keys, *runs[1:])
    several = in_several(half, docs[runs[0][of]])
    if not several.any():
        return np.zeros((3, 0), np.int64), np.ones(len(keys), bool)
    text, start, n = runs[0][of[several]], start[several], n[several]
    first, start, end = _merged([text], start, start + n)
    pieces = -(-(end - start) // SHARD)
    of = np.repeat(np.arange(len(first)), pieces)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    text, start, end = text[first][of], start[of] + piece * SHARD, np.minimum(end[of], start[of] + (piece + 1) * SHARD)
    order = np.argsort(docs[text], kind="stable")
    text, start, end = text[order], start[order], end[order]
    base = np.cumsum([0, *map(len, found)])
    late = np.zeros(base[-1], np.int32)
    begun = np.cumsum(end - start + LENGTH) // MERGE
    for at, stop in itertools.pairwise([*_starts(begun).tolist(), len(text)]):
        own = slice(at, stop)
        part, offset = repeated([found[k][a : b + LENGTH - 1] for k, a, b in zip(text[own].tolist(), start[own].tolist(), end[own].tolist(), strict=True)], docs[text[own]])
        late[base[text[own][part]] + start[own][part] + offset] = 1
    where = np.flatnonzero(late)
    of = np.searchsorted(base, where, side="right") - 1
    first, a, b = _merged([of], where - base[of], where - base[of] + LENGTH)
    total = np.zeros(len(late) + 1, np.int32)
    np.cumsum(late, out=total[1:])
    begin = base[runs[0]] + runs[1]
    return np.stack([of[first], a, b]), total[begin + runs[2]] - total[begin] < runs[2]


def _local(buckets: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        """Covered intervals, and by bucket the packed anchors that are left."""

        def flush(held: list[tuple[int, int, bytes, bytes]]):
            docs, offset = np.array([d for d, *_ in held], np.int64), np.array([o for _, o, *_ in held], np.int64)
            found = [x for _, _, x, _ in held]
            keys, runs = anchors(found)
            (text, start, end), left = settle(found, docs, keys, runs)
            if len(text):
                marks = {k: text_mark(held[k][3]) for k in np.unique(text).tolist()}
                bucket = (_mix((docs[text] + start).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                yield _batch(_LOCAL, bucket, docs[text], [marks[k] for k in text.tolist()], start + offset[text], end + offset[text], [None] * len(text))
            keys, (text, start, n, lead, sides) = keys[left] & np.uint64((1 << 8 * KEY_BYTES) - 1), runs[:, left]
            if not len(keys):
                return
            bucket = (keys % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, bucket, own, place = keys[order], bucket[order], docs[text[order]], ((start + offset[text]) << 26 | sides << 10 | n << 5 | lead)[order]
            at = _starts(bucket)
            none = [None] * len(at)
            yield _batch(_LOCAL, bucket[at], none, none, none, none, [pack_block(keys[a:b], own[a:b], place[a:b]) for a, b in itertools.pairwise([*at.tolist(), len(keys)])])

        held, size = [], 0
        for batch in batches:
            for doc, whole in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), strict=True):
                for offset in range(0, max(1, len(whole) - LENGTH + 1), BLOCK):
                    held.append((doc, offset, whole[offset : offset + BLOCK + LENGTH - 1], whole))
                    size += len(held[-1][2])
                    if size >= BLOCK:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _resolved(keys: np.ndarray, docs: np.ndarray, place: np.ndarray, group: int) -> Iterator[pa.RecordBatch]:
    """Runs of windows that several documents may have: width, key of the place where they meet, document, start, windows << 5 | lead."""
    of, keys, start, n, lead = halves(keys, place >> 26, place >> 5 & 31, place & 31, place >> 10 & 0xFFFF)
    docs, n = docs[of], n << 5 | lead
    several = in_several(keys, docs)
    keys, docs, start, n = keys[several], docs[several], start[several], n[several]
    order = np.lexsort((start, docs, keys))
    keys, docs, start, n = keys[order], docs[order], start[order], n[order]
    at = _starts(keys)
    if not len(at):
        return
    size = _spread(at, len(keys))
    held = size * (2 * LENGTH)
    width = np.where(held <= group, LENGTH, np.where(held <= 16 * group, 4, 1))
    near = _mix(docs[at].view(np.uint64) * _ODD[3] + (start[at] // REGION).view(np.uint64)).view(np.int64)
    near = np.where(width < LENGTH, keys[at].view(np.int64), near)
    yield from _rows(np.repeat(width, size), np.repeat(near, size), docs, start, n)


def _rows(width, near, docs, start, n, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(docs), most):
        own = slice(k, k + most)
        yield _batch(_FOUND, width[own].astype(np.int32), near[own], docs[own], np.zeros_like(docs[own]), start[own], n[own])


def _resolve(group: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        """Rows by bucket: covered intervals pass (width 0, n their end); of anchors those of several documents."""
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            done = batch.filter(batch.column("block").is_null())
            if done.num_rows:
                zero = np.zeros(done.num_rows, np.int32)
                yield _batch(_FOUND, zero, zero.astype(np.int64), *(done.column(c) for c in ("doc_id", "mark", "start", "end")))
            rest = batch.filter(batch.column("block").is_valid())
            for bucket, block in zip(rest.column("bucket").to_pylist(), rest.column("block").to_pylist(), strict=True):
                if size >= RESOLVE and bucket != last:
                    yield from _resolved(*(np.concatenate(c) for c in zip(*held, strict=True)), group)
                    held, size = [], 0
                held.append(unpack_block(block))
                size, last = size + len(held[-1][0]), bucket
        if held:
            yield from _resolved(*(np.concatenate(c) for c in zip(*held, strict=True)), group)

    return run


_PARTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("part", pa.binary())])


def _contexts(batches) -> Iterator[pa.RecordBatch]:
    """Each text's runs of windows that meet others, with their bytes; runs that touch and meet in one place are one part.

    A row may get the places of another row with its doc_id: these bring bytes that turn out unlike.
    """
    for batch in batches:
        found, docs, places = raw(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("places")
        row = np.repeat(np.arange(len(found)), np.diff(places.offsets.to_numpy()))
        width, key, start, n = (places.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "key", "start", "n"))
        anchor, end = start + (n & 31), np.minimum(start + (n >> 5), np.array([len(t) for t in found], np.int64)[row] - LENGTH + 1)
        use = start < end
        row, width, key, start, end, anchor = (c[use] for c in (row, width, key, start, end, anchor))
        whole = width == LENGTH
        first, a, b = _merged([key[whole], row[whole]], start[whole], end[whole])
        out = list(zip(key[whole][first].tolist(), row[whole][first].tolist(), a.tolist(), b.tolist(), strict=True))
        for r, w, k, a, b, p in zip(*(c[~whole].tolist() for c in (row, width, key, start, end, anchor)), strict=True):
            for c in range((p - b + 1) // w, (p - a) // w + 1):
                # windows that begin c * w to c * w + w - 1 places before the anchor all hold these bytes
                core = found[r][p - c * w : p - c * w + LENGTH - w + 1]
                out.append((xxhash.xxh3_64_intdigest(core, k & (1 << 64) - 1) - (1 << 63), r, max(a, p - c * w - w + 1), min(b, p - c * w + 1)))
        marks = {r: text_mark(found[r]) for _, r, *_ in out}
        for k in range(0, len(out), 8192):
            own = out[k : k + 8192]
            yield _batch(_PARTS, [x[0] for x in own], [docs[x[1]] for x in own], [marks[x[1]] for x in own], [x[2] for x in own], [found[r][a : b + LENGTH - 1] for _, r, a, b in own])


_SPANS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _compare(limit: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key, then document, no key divided, to covered intervals."""
        merge, last, since = Merge(limit), None, 0

        def settled(keep_from=None):
            found = merge.settled(keep_from)
            if found.shape[1]:
                yield _batch(_SPANS, *found)

        for batch in batches:
            for key, *row in zip(*(batch.column(n).to_pylist() for n in _PARTS.names), strict=True):
                if merge.full:
                    yield from settled(since if key == last else None)
                    since = 0
                if key != last:
                    last, since = key, len(merge.parts)
                merge.add(*row)
        yield from settled()

    return run


def _removed(batches) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    for batch in batches:
        out = []
        spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
        for doc, text, own in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), spans, strict=True):
            runs: list[list[int]] = []
            mark = text_mark(text) if own else None
            for a, b in sorted((x["start"], x["end"]) for x in own or () if x["mark"] == mark):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            whole = b"".join(kept)
            out.append((doc, len(text), len(text) - len(whole), len(runs), hashlib.sha256(whole).hexdigest(), [{"start": a, "end": b} for a, b in runs]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP, merge_bytes: int = MERGE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of removed runs, in bytes).

    A null or empty text, or one under 50 bytes, loses nothing.  Rows that repeat a doc_id take nothing from each
    other; each is told by its own text and loses what smaller documents have of it.  A null doc_id is neither
    smaller nor larger than another: such rows lose nothing and take nothing.  An empty table gives an empty result.

    group_bytes and merge_bytes bound what one place and one merge hold; they change no result.
    """
    spark = docs.sparkSession
    df = texts(docs, id_col, text_col)
    own = df.where("doc_id is not null")
    buckets = 16 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    local = own.mapInArrow(_local(buckets), "bucket int, doc_id long, mark long, start long, end long, block binary")
    found = stored(local.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_resolve(group_bytes), "width int, key long, doc_id long, mark long, start long, n long"), "anchors")
    places = found.where("width > 0").groupBy("doc_id").agg(F.collect_list(F.struct("width", "key", "start", "n")).alias("places"))
    parts = own.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(_contexts, "key long, doc_id long, mark long, start long, part binary")
    compared = parts.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_compare(merge_bytes), "doc_id long, mark long, start long, end long")
    covered = found.where("width = 0").select("doc_id", "mark", "start", F.col("n").alias("end")).unionAll(compared)
    spans = covered.groupBy("doc_id").agg(F.collect_list(F.struct("mark", "start", "end")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    # both joins deal the texts out alike: their shuffle is written once
    return own.join(spans, "doc_id", "left").mapInArrow(_removed, schema).unionAll(df.where("doc_id is null").mapInArrow(_removed, schema))
