"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (a displacement for each
bucket of keys, one slot for each token) resolves a pre-token that is a token as
a whole, after comparing its bytes. Tier two, for the misses: a heap of adjacent
pairs over linked bytes, lowest rank first and leftmost among equals, which takes
n log n for a pre-token of n bytes. A bounded memo holds recent pre-tokens.

The vocabulary has a fixed size, so its tables are broadcast. Defined results:
null and empty texts have no tokens; other columns don't matter; one output row
for each input row, repeated ids included.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from roundwise.llm.common import pieces, table

MASK = (1 << 64) - 1
#: Pre-tokens that a worker keeps (about 200 bytes each): beside other stages, and
#: where nothing else needs the memory; and the longest of them.
MEMO, ROOMY, LONG = 200_000, 600_000, 64


def _mix(h: int, d: int) -> int:
    h ^= (d * 0x9E3779B97F4A7C15) & MASK
    h = (h * 0xFF51AFD7ED558CCD) & MASK
    return h >> 29


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: find(key) is the index of
    key, or -1 if it is none of them."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh64_intdigest(k)
            groups.setdefault(h % self.buckets, []).append((h, i))
        self.shift = [0] * self.buckets
        self.slot = [-1] * n
        self.keys = keys
        free = n - 1
        for b, items in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(items) == 1:  # a lone key takes the next free slot itself
                while self.slot[free] >= 0:
                    free -= 1
                self.slot[free], self.shift[b] = items[0][1], -1 - free
                continue
            d = 0
            while True:
                at = [_mix(h, d) % n for h, _ in items]
                if len(set(at)) == len(at) and all(self.slot[x] < 0 for x in at):
                    break
                d += 1
            self.shift[b] = d
            for x, (_, i) in zip(at, items, strict=True):
                self.slot[x] = i

    def find(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        i = self.slot[-1 - d if d < 0 else _mix(h, d) % self.n]
        return i if self.keys[i] == key else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token that is no token itself: merges over linked bytes."""
    n = len(piece)
    stop = list(range(1, n + 1))  # a part begins at i and ends before stop[i]; -1: merged away
    back = list(range(-1, n - 1))
    get = ranks.get
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if stop[i] != mid or stop[mid] != end:
            continue
        stop[i], stop[mid] = end, -1
        if end < n:
            back[end] = i
            far = stop[end]
            if (r := get(piece[i:far])) is not None:
                heapq.heappush(heap, (r, i, end, far))
        if (p := back[i]) >= 0 and (r := get(piece[p:end])) is not None:
            heapq.heappush(heap, (r, p, i, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : stop[i]]])
        i = stop[i]
    return out


class Memo(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, index: PerfectHash, ids: list[int], ranks: dict[bytes, int]):
        self.index, self.ids, self.ranks = index, ids, ranks

    def __missing__(self, token: str) -> bytes:
        raw = token.encode()
        i = self.index.find(raw)
        out = np.array([self.ids[i]] if i >= 0 else merged(raw, self.ranks), dtype="<u4").tobytes()
        if len(token) <= LONG:
            self[token] = out
        return out


class Codec:
    """Encoder and decoder of one rank file and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        keys = sorted(ranks, key=ranks.__getitem__)
        self.index, self.ids = PerfectHash(keys), [ranks[k] for k in keys]
        size = max(ranks.values(), default=-1) + 1
        self.known, self.length = np.zeros(size, bool), np.zeros(size, np.int64)
        self.known[self.ids], self.length[self.ids] = True, [len(k) for k in keys]
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(keys), np.uint8)  # in the order of ids, as keys are
        self.memo: Memo | None = None

    def __getstate__(self):
        return self.__dict__ | {"memo": None}

    def encode(self, text: str, memo: int = MEMO) -> bytes:
        if self.memo is None:
            self.memo = Memo(self.index, self.ids, self.ranks)
        if len(self.memo) > memo:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, regex.findall(self.pattern, text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all tokens, copied out of one array of the vocabulary."""
        out = []
        for at in range(0, len(ids), 4 << 20):
            i = np.frombuffer(ids[at : at + (4 << 20)], "<u4")
            if not self.known[i].all():
                raise KeyError("an id is not in the vocabulary")
            n = self.length[i]
            end = np.cumsum(n)
            out.append(self.flat[np.repeat(self.start[i] - end + n, n) + np.arange(end[-1])].tobytes())
        return b"".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_loaded: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, built once in a process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(read_ranks(path), pattern)
    return _loaded[path, pattern]


_here: dict[int, Codec] = {}


def encode(docs: DataFrame, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("n_tokens", "ids"), keep: tuple[str, ...] = ("doc_id",), text: str = "text", memo: int = MEMO) -> DataFrame:
    """keep's columns and, of each whole text: n_tokens, ids (binary,
    little-endian unsigned 32-bit), decoded (binary), ids_sha256, decoded_sha256,
    as named in outputs. The rank file is read on the driver."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(codec(ranks_path, pattern))
    kinds = {"n_tokens": "long", "ids": "binary", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    types = dict(docs.dtypes)
    arrow = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sent.id if hasattr(sent, "id") else 0
        mine = _here.get(key)
        if mine is None:
            _here.clear()
            mine = _here[key] = sent.value
        for batch in pieces(batches):
            got: dict[str, list] = {o: [] for o in outputs}
            for value in batch.column(len(keep)):
                ids = mine.encode(value.as_py() or "", memo)
                for o in outputs:
                    if o == "n_tokens":
                        got[o].append(len(ids) // 4)
                    elif o == "ids":
                        got[o].append(ids)
                    elif o == "ids_sha256":
                        got[o].append(hashlib.sha256(ids).hexdigest())
                    elif o == "decoded":
                        got[o].append(mine.decode(ids))
                    else:
                        got[o].append(hashlib.sha256(mine.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(got[o], arrow[kinds[o]]) for o in outputs]], names=[*keep, *outputs])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"{o} {kinds[o]}" for o in outputs]])
    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text_")).mapInArrow(run, schema)


def tokenize(docs: DataFrame, memo: int = MEMO) -> DataFrame:
    import public_tokenizers

    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"), memo=memo)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), ROOMY)
