"""Which tokens of two tokenizers stand for the same bytes, and in how many documents.

Tokenizer A is byte-level, B is of pieces with a space mark.  Where tokens of both end, their sequences are cut into
groups; tokens that share a group are linked.  A link is one number, the A id in the upper 32 bits and the B id in the
lower, so that pairs are counted, sorted and sought as plain arrays:

1. Each task counts the distinct pairs of each of its documents with ``np.unique`` and sums over documents in bounded
   memory; what it passes on is a row for each pair and task at most (or for each pair and two million of them).
2. These rows are dealt out by ranges of the pair and sorted; equal neighbours are summed in one pass.  Every range is
   a shard of the table of counts, written to the shared folder.
3. To judge documents an executor keeps each shard as a file of its own that all its workers map into memory; a batch
   of documents seeks its distinct pairs there with ``np.searchsorted``.  The table has no more rows than A has ids
   times B, and in practice a few hundred for each A id, whatever the corpus; it is never broadcast or held in heaps.

Documents are encoded once, by the libraries themselves, and their ids stored in as many bytes as the vocabularies
need; groups, links and pairs of a batch are found by array operations over all of its tokens.  Only a group of very
many tokens is taken for itself, by its distinct ids, so that memory follows the pairs and not the links.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from .common import checkpoint_root, kept, stored, strings, texts
from .pieces import in_groups

SPACE = "▁"
#: Pairs that a task holds before it passes them on; rows of a shard; links from which a group is taken for itself.
HELD, SHARD_ROWS, WIDE = 2_000_000, 2_000_000, 1 << 14
_NONE = np.zeros(0, np.int64)


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies spell bytes: printable ones of Latin-1 stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers, and the bytes that their tokens stand for."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        spelled, special = byte_alphabet(), self.a.get_added_tokens_decoder()
        own = {i: t.encode() if i in special else bytes(map(spelled.__getitem__, t)) for t, i in self.a.get_vocab().items()}
        self.a_bytes = [own.get(i, b"") for i in range(max(own) + 1)]
        n, name = self.b.get_piece_size(), self.b.id_to_piece
        self.b_bytes = [bytes([int(name(i)[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else name(i).replace(SPACE, " ").encode() for i in range(n)]
        self.fast = self._ranked(a_path, own, special)

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        """One per worker, kept between tasks."""
        return kept(("alignment", a_path, b_path), lambda: cls(a_path, b_path))

    def _ranked(self, path: str, own: dict[int, bytes], special: dict) -> object | None:
        """An encoder by ranks that gives the same ids, if the vocabulary's ids follow its merges and it is cut by the usual pattern."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        cut, merges, vocab = made["pre_tokenizer"] or {}, made["model"].get("merges", []), made["model"].get("vocab", {})
        joined = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in merges]
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or made["normalizer"] or joined != sorted(set(joined)):
            return None
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in own.items() if i not in special}, special_tokens={})

    def _encode_a(self, text: str) -> list[int]:
        if self.fast is not None and len(text) < 100_000:  # its pattern machine has a stack of its own
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def encode(self, found: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each text by A, with a space before it, and by B; none where their bytes differ from the space and the text."""
        a, b = [], self.b.encode(found, num_threads=1)
        for k, text in enumerate(found):
            whole, own = (" " + text).encode("utf-8", "replace"), self._encode_a(" " + text) if text else []
            if not text or b"".join(map(self.a_bytes.__getitem__, own)) != whole or b"".join(map(self.b_bytes.__getitem__, b[k])) != whole:
                own, b[k] = [], []
            a.append(own)
        return a, b


class Alignment:
    """Groups and links of documents, given each one's ids: all arrays run over the documents one after another."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_sizes: np.ndarray, b_sizes: np.ndarray) -> None:
        self.n_a, self.n_b = (np.array([len(x) for x in own], np.int64) for own in (a, b))
        self.a, self.b = (np.concatenate([_NONE, *own]).astype(np.int64) for own in (a, b))
        # a document has as many bytes by A as by B, so that ends are comparable over documents
        a_ends, b_ends = np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b])
        self.ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(self.ends, a_ends), np.searchsorted(self.ends, b_ends)
        n = len(self.ends)
        self.p, self.q = np.bincount(self.a_group, minlength=n), np.bincount(self.b_group, minlength=n)
        self.a_first, self.b_first = np.cumsum(self.p) - self.p, np.cumsum(self.q) - self.q
        edges = np.concatenate([[0], np.cumsum(self.n_a)])
        self.group_edges = np.concatenate([self.a_group, [n]])[edges]  # each document's first group

    def per_document(self, of_groups: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(of_groups)])[self.group_edges])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links) of each distinct pair of each document, sorted by these."""
        wide = np.flatnonzero(self.p * self.q > WIDE)
        q = np.where(self.p * self.q > WIDE, 0, self.q)[self.a_group]
        left = np.repeat(np.arange(len(self.a)), q)
        right = self.b_first[self.a_group[left]] + np.arange(len(left)) - np.repeat(np.cumsum(q) - q, q)
        a_bits, b_bits = (int(x.max(initial=0)).bit_length() for x in (self.a, self.b))
        doc = np.repeat(np.arange(len(self.n_a)), self.n_a)
        packed, links = np.unique((doc[left] << a_bits | self.a[left]) << b_bits | self.b[right], return_counts=True)
        for g in wide.tolist():
            own, n = np.unique(self.a[self.a_first[g] : self.a_first[g] + self.p[g]], return_counts=True)
            other, m = np.unique(self.b[self.b_first[g] : self.b_first[g] + self.q[g]], return_counts=True)
            more = ((doc[self.a_first[g]] << a_bits | own)[:, None] << b_bits | other[None]).ravel()
            packed, links = summed(np.concatenate([packed, more]), np.concatenate([links, np.outer(n, m).ravel()]))
        return packed >> (a_bits + b_bits), (packed >> b_bits & (1 << a_bits) - 1) << 32 | packed & (1 << b_bits) - 1, links

    def texts(self, names: np.ndarray) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``; names: `names_of` ids."""
        out = np.empty(len(self.a) + len(self.b), np.int64)
        a_last, b_last = self.a_first + self.p - 1, self.b_first + self.q - 1
        a_kind, b_kind = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_kind[a_last], b_kind[b_last] = 1, 2
        out[np.arange(len(self.a)) + self.b_first[self.a_group]] = 3 * self.a + a_kind
        out[np.arange(len(self.b)) + self.a_first[self.b_group] + self.p[self.b_group]] = 3 * self.b + b_kind
        edges = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        whole = names[out].tolist()
        return ["".join(whole[x:y])[:-1] for x, y in zip(edges, edges[1:], strict=False)]


def names_of(n: int) -> np.ndarray:
    """Each id with what follows it: a comma, a bar, a semicolon."""
    return np.array([f"{i}{c}" for i in range(n) for c in ",|;"], object)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def _pairs(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], ["key", "n"])


def encoded(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b), stored: each row's ids by both tokenizers as packed whole numbers, of 2 bytes where the vocabulary allows, else 4."""

    def run(batches):
        aligner = Aligner.of(a, b)
        kinds = [_kind(x) for x in (aligner.a_bytes, aligner.b_bytes)]
        for batch in batches:
            packed: list[list[bytes]] = [[], []]
            for group in in_groups(strings(batch.column("text"))):
                for own, kind, out in zip(aligner.encode(group), kinds, packed, strict=True):
                    out += [np.array(x, kind).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.binary()) for x in packed)], ["doc_id", "a", "b"])

    path = f"{checkpoint_root(docs.sparkSession)}/encoded-{uuid.uuid4().hex}"
    texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, a binary, b binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("doc_id long, a binary, b binary").parquet(path)


def _kind(vocabulary: list) -> type:
    return np.uint16 if len(vocabulary) <= 1 << 16 else np.uint32


#: Tokens that are aligned at once.
TOKENS = 1 << 19


def _alignments(batches: Iterator[pa.RecordBatch], aligner: Aligner) -> Iterator[tuple[pa.RecordBatch, Alignment]]:
    sizes = [np.array([len(x) for x in own]) for own in (aligner.a_bytes, aligner.b_bytes)]
    kinds = [_kind(x) for x in (aligner.a_bytes, aligner.b_bytes)]
    for batch in batches:
        own = [[np.frombuffer(x, kind) for x in batch.column(c).to_pylist()] for c, kind in zip("ab", kinds, strict=True)]
        at, held = 0, 0
        for k in range(batch.num_rows):
            held += len(own[0][k])
            if held >= TOKENS or k + 1 == batch.num_rows:
                yield batch.slice(at, k + 1 - at), Alignment(own[0][at : k + 1], own[1][at : k + 1], *sizes)
                at, held = k + 1, 0


def count_pairs(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n), stored by ranges of key and sorted in each: in how many rows of docs an A and a B id are linked; key is the A id times 2^32 plus the B id.

    Null and empty texts, and those whose tokens' bytes differ from a space and the text, link nothing.  Repeated rows
    count each.  An empty table has no pairs.
    """
    return _counted(encoded(docs, a, b, id_col, text_col), a, b)


def _counted(ids: DataFrame, a: str, b: str) -> DataFrame:
    def partial(batches):
        keys, counts, fresh, size = _NONE, _NONE, [], 0
        for _, made in _alignments(batches, Aligner.of(a, b)):
            fresh.append(made.pairs()[1])
            size += len(fresh[-1])
            if size >= HELD:
                new, n = np.unique(np.concatenate(fresh), return_counts=True)
                keys, counts = summed(np.concatenate([keys, new]), np.concatenate([counts, n]))
                fresh, size = [], 0
                if len(keys) >= HELD:
                    yield from _pairs(keys, counts)
                    keys, counts = _NONE, _NONE
        new, n = np.unique(np.concatenate([_NONE, *fresh]), return_counts=True)
        yield from _pairs(*summed(np.concatenate([keys, new]), np.concatenate([counts, n])))

    def total(batches):
        last_key, last = None, 0
        for batch in batches:
            keys, counts = (batch.column(c).to_numpy() for c in ("key", "n"))
            if not len(keys):
                continue
            keys, counts = summed(keys, counts)
            if last_key == keys[0]:
                counts[0] += last
            elif last_key is not None:
                yield from _pairs(np.array([last_key]), np.array([last]))
            last_key, last = int(keys[-1]), int(counts[-1])  # the run may go on
            yield from _pairs(keys[:-1], counts[:-1])
        if last_key is not None:
            yield from _pairs(np.array([last_key]), np.array([last]))

    some = stored(ids.select("a", "b").mapInArrow(partial, "key long, n long"), "pairs")
    dealt = some.repartitionByRange(max(1, -(-some.count() // SHARD_ROWS)), "key").sortWithinPartitions("key")
    return stored(dealt.mapInArrow(total, "key long, n long"), "counts")


class Shards:
    """The shards of a table of counts below folder, each mapped into memory from a file that the workers of an executor share."""

    def __init__(self, folder: str, root: str, name: str) -> None:
        self.maps = []
        for file in sorted(f for f in os.listdir(folder) if f.endswith(".parquet")):
            own = f"{root}/{name}-{file}.npy"
            if not os.path.exists(own):
                table = pq.read_table(f"{folder}/{file}", columns=["key", "n"])
                made = f"{own}.{os.getpid()}.npy"  # another worker may do the same: the last one stays
                np.save(made, np.stack([table.column(c).to_numpy() for c in ("key", "n")]) if table.num_rows else np.zeros((2, 0), np.int64))
                os.replace(made, own)
            held = np.load(own, mmap_mode="r")
            if held.shape[1]:
                self.maps.append(held)
        self.maps.sort(key=lambda m: m[0, 0])
        self.first = np.array([m[0, 0] for m in self.maps], np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, all of which the table has."""
        out = np.zeros(len(keys), np.int64)
        edges = [*np.searchsorted(keys, self.first).tolist(), len(keys)]
        for held, a, b in zip(self.maps, edges, edges[1:], strict=False):
            if a < b:
                at = np.searchsorted(held[0], keys[a:b])
                out[a:b] = held[1][at]
        return out


def align_documents(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups].

    n_best are the links whose pair is in as many documents as any pair of its A id, count_sum sums the documents over
    links; groups are ``a1,a2|b1;a3|b2,b3``.  Null and empty texts, and those whose tokens' bytes differ from a space
    and the text, have zeros and '' for the digest (of an empty groups column).  Repeated rows, and rows without a
    doc_id, are kept.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ids = encoded(docs, a, b, id_col, text_col)
    table = _counted(ids, a, b)
    best = table.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("n")).toPandas()  # a row for an A id at most
    highest = np.zeros(int(best["a"].max()) + 1 if len(best) else 1, np.int64)
    highest[best["a"].to_numpy(np.int64)] = best["n"]
    shared = spark.sparkContext.broadcast(highest)
    folder = os.path.dirname(next(iter(table.inputFiles()), "")) or None
    where = urlparse(folder or "")
    name = os.path.basename(where.path)
    if folder and where.scheme not in ("", "file"):
        spark.sparkContext.addFile(folder, recursive=True)  # executors fetch it from the store themselves
    mounted = where.path if where.scheme in ("", "file") else None
    fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())] + [("groups", pa.string())] * with_groups

    def judge(batches):
        aligner, top = Aligner.of(a, b), shared.value
        names = kept_names(aligner)
        shards = Shards(mounted or SparkFiles.get(name), SparkFiles.getRootDirectory(), name) if folder else None
        for batch, made in _alignments(batches, aligner):
            doc, pair, links = made.pairs()
            sought, place = np.unique(pair, return_inverse=True)
            n = shards.counts(sought) if len(sought) else _NONE
            sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum([links * (n == top[sought >> 32])[place], links * n[place]], axis=1)], axis=1)
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            said = made.texts(names)
            digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said]
            counts = [made.n_a, made.n_b, np.diff(made.group_edges), made.per_document(made.p * made.q), *np.diff(sums[:, edges], axis=1)]
            columns = [batch.column("doc_id"), *map(pa.array, counts), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(said, pa.string())] * with_groups, [f[0] for f in fields])

    kind = {pa.int64(): "long", pa.string(): "string"}
    return ids.mapInArrow(judge, ", ".join(f"{n} {kind[t]}" for n, t in fields))


def kept_names(aligner: Aligner) -> np.ndarray:
    if not hasattr(aligner, "names"):
        aligner.names = names_of(max(len(aligner.a_bytes), len(aligner.b_bytes)))
    return aligner.names
