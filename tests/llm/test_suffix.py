import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gallerylens.llm import suffix


def brute_repeats(rows):
    """Each row's mask of removed bytes; a null id is neither smaller nor larger than another."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        for k in range(len(t) - 49) if i is not None else ():
            w = t[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - 49) if i is not None else ():
            if first[t[k : k + 50]] < i:
                mask[k : k + 50] = True
        out.append(mask)
    return out


def expected(rows):
    out = []
    for (i, t), m in zip(rows, brute_repeats(rows), strict=True):
        kept = np.frombuffer(t, np.uint8)[~m].tobytes()
        runs = int((np.diff(np.concatenate([[0], m.astype(int), [0]])) == 1).sum())
        out.append((i, len(t), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_rows(seed, n=70):
    """Texts of few words that share passages, copies, near copies, and one that holds every byte."""
    rng = random.Random(seed)
    word = ["the", "of", "stone", "river", "Über", "naïve", "日本", "clock"]
    passage = [" ".join(rng.choice(word) for _ in range(40)) for _ in range(3)]
    texts = []
    for k in range(n):
        own = [" ".join(rng.choice(word) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 60)))]
        if k % 3:
            own.insert(rng.randint(0, 1), rng.choice(passage))
        texts.append(" ".join(own))
    texts += texts[:20] + [t + " tail" for t in texts[:10]] + ["", "x" * 49, "x" * 50, "x" * 200, "x" * 51]
    found = [t.encode() for t in texts] + [bytes(range(256)) * 2, bytes(range(255, -1, -1)) + bytes(range(256))]
    ids = rng.sample(range(-1000, 1000), len(found))
    return list(zip(ids, found, strict=True))


def as_batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.binary())], ["doc_id", "text"])


def shuffled(batches, schema, *by):
    table = pa.Table.from_batches(list(batches), schema)
    return table.sort_by([(c, "ascending") for c in by]).to_batches(max_chunksize=7)


def run_here(rows, group=suffix.GROUP, limit=suffix.MERGE, tasks=3):
    """The operator's steps in this process, with sorts in place of shuffles."""
    batches = [b for k in range(tasks) for b in suffix._local(4)(iter([as_batch(rows[k::tasks])]))]
    found = pa.Table.from_batches(list(suffix._resolve(group)(iter(shuffled(batches, suffix._LOCAL, "bucket")))), suffix._FOUND).to_pylist()
    spans, places = [x | {"end": x["n"]} for x in found if x["width"] == 0], {}
    for x in found:
        if x["width"]:
            places.setdefault(x["doc_id"], []).append({c: x[c] for c in ("width", "key", "start", "n")})
    kind = pa.list_(pa.struct([("width", pa.int32()), ("key", pa.int64()), ("start", pa.int64()), ("n", pa.int64())]))
    some = [(i, t) for i, t in rows if i in places]
    if some:
        joined = pa.RecordBatch.from_arrays([*as_batch(some).columns, pa.array([places[i] for i, _ in some], kind)], ["doc_id", "text", "places"])
        spans += [x for b in suffix._compare(limit)(iter(shuffled(suffix._contexts(iter([joined])), suffix._PARTS, "key", "doc_id"))) for x in b.to_pylist()]
    own = [[{c: s[c] for c in ("mark", "start", "end")} for s in spans if s["doc_id"] == i] for i, _ in rows]
    whole = pa.RecordBatch.from_arrays([*as_batch(rows).columns, pa.array(own, pa.list_(pa.struct([(c, pa.int64()) for c in ("mark", "start", "end")])))], ["doc_id", "text", "spans"])
    return sorted((tuple(x.values())[:5] for b in suffix._removed(iter([whole])) for x in b.to_pylist()), key=str)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("bits, group, limit, block", [(64, 1 << 18, 1 << 20, 1 << 22), (64, 1, 300, 700), (64, 100, 300, 700), (5, 1 << 18, 2000, 3000), (1, 200, 1, 1)])
def test_repeats_brute_force(monkeypatch, seed, bits, group, limit, block):
    """Also with hashes of few bits, so that unlike anchors meet, and with places and merges that hold little."""
    plain = suffix.gram_hashes
    mask = np.uint64(((1 << bits) - 1) << (64 - bits) | (1 << bits) - 1)
    monkeypatch.setattr(suffix, "gram_hashes", lambda b: tuple(h & mask for h in plain(b)))
    for name in ("CHUNK", "BLOCK", "MERGE", "SHARD", "RESOLVE"):
        monkeypatch.setattr(suffix, name, min(getattr(suffix, name), max(block, 60)))
    rows = made_rows(seed)
    assert run_here(rows, group, limit) == expected(rows)


def test_spark_repeats(spark, docs, rows):
    """Null ids, rows that repeat an id with another text, clashing columns, and splits of one place."""
    extra = [(None, "no id")]
    long = "words that come again and again in more than fifty bytes of text "
    more = [(5000, long * 3), (5001, "other " + long), (5001, "quite another text that is long enough to be looked at " + long), (None, long), (5002, long + "end")]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = expected([(i, (t or "").encode()) for i, t in [*rows, *extra, *more]])
    for group in (suffix.GROUP, 100):
        got = suffix.remove_repeats(df, group_bytes=group).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want


def test_merge_keeps_what_no_smaller_document_has():
    rows = [(d, t) for d, t in sorted(r for r in made_rows(9) if len(r[1]) >= 50)]
    merge, covered = suffix.Merge(400), {}
    for n, (d, t) in enumerate(rows):
        merge.add(d, n, 0, t)
        if merge.full or n == len(rows) - 1:
            for _, mark, a, b in merge.settled(0).T.tolist():
                covered.setdefault(mark, []).append((a, b))
    for n, mask in enumerate(brute_repeats(rows)):
        got = np.zeros(len(mask), bool)
        for a, b in covered.get(n, ()):
            got[a:b] = True
        assert (got == mask).all()


@pytest.mark.parametrize("alphabet, begin", [(4, True), (4, False), (300, False)])
def test_merged_transforms_give_the_sorted_suffixes(alphabet, begin):
    rng = np.random.default_rng(4)
    kind = np.uint8 if alphabet < 256 else np.uint16
    shards = [np.concatenate([np.append(rng.integers(1, alphabet, rng.integers(1, 60)), 0) for _ in range(5)]).astype(kind) for _ in range(3)]
    heads = [suffix._packed(s) if begin else None for s in shards]
    made = [suffix.shard_transform(s, h) for s, h in zip(shards, heads, strict=True)]
    shard, block = suffix.merge_transforms([t for _, t in made], [h[o] for h, (o, _) in zip(heads, made, strict=True)] if begin else None, 50)
    seen, at = [], [0, 0, 0]
    for s in shard:
        place = int(made[s][0][at[s]])
        at[s] += 1
        tail = shards[s][place : place + 50].tolist()
        seen.append(tail[: tail.index(0) + 1] if 0 in tail else tail)
    assert [x[:1] for x in seen] == sorted(x[:1] for x in seen)
    for a, b, same in zip(seen, seen[1:], block[1:] == block[:-1], strict=False):
        if 0 not in a and 0 not in b:
            assert a <= b and (a == b) == same


def test_long_text_is_cut_without_loss(monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 300)
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, 2000).astype(np.uint8))
    _, rows = suffix.anchors([text, b"short", text[100:400]])
    windows = sorted((d, s + k) for d, s, n, *_ in rows.T.tolist() for k in range(n))
    assert windows == [(0, k) for k in range(1951)] + [(2, k) for k in range(251)]


def test_blocks_round_trip():
    rng = np.random.default_rng(6)
    keys, docs, place = rng.integers(0, 1 << 48, 100).astype(np.uint64), rng.integers(-(1 << 62), 1 << 62, 100), rng.integers(0, 1 << 40, 100)
    assert all((a == b).all() for a, b in zip((keys, docs, place), suffix.unpack_block(suffix.pack_block(keys, docs, place)), strict=True))


def test_empty(empty):
    assert suffix.remove_repeats(empty).count() == 0
