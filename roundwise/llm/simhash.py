"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of three words
(fewer words: the whole sequence; none: fingerprint zero), XXH64 with seed 42,
bitwise majority. Documents with equal fingerprints are one node, so copies are
never paired with each other. Nodes link at LIMIT or fewer differing bits.

Search: bits are grouped into partitions, correlated bits together. Thresholds
t_i >= -1 with sum(t_i + 1) = LIMIT + 1 are enough: a pair over all of them would
differ in more than LIMIT bits. Dynamic programming picks them, and the number of
partitions, by the estimated number of candidates and probes, from a bounded
sample of fingerprints; the choice decides the cost, never the result. Each node
is indexed by its bits in a partition and probes all values up to t_i bits away;
the join verifies the whole distance. A dense ball doesn't make all its pairs:
probes meet one pivot a bucket, and then only fingerprints that are in different
components by then. Components come from hooking and pointer jumping over the
links, each round written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero and link like
any other; repeated ids are separate rows; a null id never names a component
unless no member has another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundwise.llm.common import pieces, staged, table, unstage
from roundwise.llm.graphs import components, hot_join, hot_keys, one_of_each, row_hash

BITS, LIMIT, SHINGLE = 64, 3, 3
SAMPLE = 2048
#: Into how many parts a hot bucket is split.
PARTS = 32


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    if len(found) < size:
        return xxhash.xxh64_intdigest(b" ".join(found), 42)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(found) - size] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, keep: tuple[str, ...], into: str = "fp", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """keep's columns of docs and the fingerprint as a signed long."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = np.array([fingerprint(x.as_py(), size) for x in batch.column(len(keep))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(got)], names=[*keep, into])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], f"`{into}` long"])
    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text_")).mapInArrow(run, schema)


def grouped_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to parts of nearly equal size, each bit to the part it
    correlates with most, strongest first."""
    if parts == 1:
        return [list(range(BITS))]
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num(np.abs(np.corrcoef(bits, rowvar=False))) if len(sample) > 1 else np.zeros((BITS, BITS))
    np.fill_diagonal(r, 0)
    sizes = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    groups: list[list[int]] = []
    left = set(range(BITS))
    for want in sizes:
        first = max(sorted(left), key=lambda b: r[b, sorted(left)].max())
        group = [first]
        left.remove(first)
        while len(group) < want:
            b = max(sorted(left), key=lambda x: r[x, group].mean())
            group.append(b)
            left.remove(b)
        groups.append(sorted(group))
    return groups


def thresholds(sample: np.ndarray, groups: list[list[int]], nodes: int, limit: int) -> tuple[float, list[int]]:
    """(estimated cost, t_i of each group), by dynamic programming over the
    limit + 1 units to deal. A group with no unit has -1 and isn't used."""
    cost = []
    other = sample[:, None] ^ sample[None, :]
    for bits in groups:
        mask = np.uint64(sum(1 << b for b in bits))
        near = np.bincount(np.bitwise_count(other & mask).ravel().astype(int), minlength=BITS + 1).astype(float)
        near[0] -= len(sample)
        seen = np.cumsum(near) / max(1, len(sample) * (len(sample) - 1))
        row = [0.0]
        for t in range(limit + 1):
            ball = float(sum(comb(len(bits), j) for j in range(t + 1)))
            row.append(nodes * ball + 0.5 * nodes * nodes * max(seen[t], ball / 2.0 ** len(bits)))
        cost.append(row)
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (limit + 1)
    for row in cost:
        best = [min(((best[u - k][0] + row[k], [*best[u - k][1], k - 1]) for k in range(u + 1)), key=lambda x: x[0]) for u in range(limit + 2)]
    return best[limit + 1]


def plan(sample: np.ndarray, nodes: int, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """Partitions that are used: (bits, threshold)."""
    tried = [(g, thresholds(sample, g, nodes, limit)) for parts in range(2, limit + 2) for g in [grouped_bits(sample, parts)]]
    groups, (_, chosen) = min(tried, key=lambda x: x[1][0])
    return [(b, t) for b, t in zip(groups, chosen, strict=True) if t >= 0]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probe(k: int, key: Column):
    return lambda flip: F.xxhash64(F.lit(k), key.bitwiseXOR(flip))


def search(nodes: DataFrame, limit: int) -> tuple[Column, Column]:
    """Arrays of a node's buckets in the index, and of those it probes. Equal
    hashes of unlike buckets only add candidates."""
    n = nodes.count()
    sample = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    held, probes = [], []
    for k, (bits, t) in enumerate(plan(sample, max(n, 1), limit)):
        mask = F.lit(signed(sum(1 << b for b in bits)))
        flips = [signed(sum(1 << b for b in some)) for j in range(t + 1) for some in combinations(bits, j)]
        key = F.col("fp").bitwiseAND(mask)
        held.append(F.xxhash64(F.lit(k), key))
        probes.append(F.transform(F.array(*map(F.lit, flips)), _probe(k, key)))
    return F.array(*held), F.concat(*probes)


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b), a < b, of column fp that differ in at most limit bits, enough
    for the components of all such pairs. Probes first meet the least fingerprint
    of their bucket; then only fingerprints of different components meet. Buckets
    that hold over 1/SHARE of the index are split into PARTS."""
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit)
    pair = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    held, probes = search(nodes, limit)
    index = nodes.select(F.explode(held).alias("bucket"), F.col("fp").alias("a"))
    pivots = index.groupBy("bucket").agg(F.min("a").alias("a"))
    probe = nodes.select(F.explode(probes).alias("bucket"), F.col("fp").alias("b"))
    first = staged(probe.join(pivots, "bucket").where(near).select(*pair).distinct(), "links")
    of = components(first)
    named = staged(nodes.select("fp").join(of.withColumnRenamed("v", "fp"), "fp", "left").withColumn("c", F.coalesce("c", "fp")), "named")
    hot = hot_keys(index, "bucket")
    spread = lambda bucket, parts: F.when(bucket.isin(hot), parts).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    left = named.select("fp", "c", F.explode(held).alias("bucket")).select("bucket", F.get(spread(F.col("bucket"), F.array(F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int"))), F.lit(0)).alias("part"), F.col("fp").alias("a"), "c")
    right = named.select("fp", "c", F.explode(probes).alias("bucket")).select("bucket", F.explode(spread(F.col("bucket"), F.sequence(F.lit(0), F.lit(PARTS - 1)))).alias("part"), F.col("fp").alias("b"), F.col("c").alias("d"))
    rest = staged(left.join(right, ["bucket", "part"]).where((F.col("c") != F.col("d")) & near).select(*pair).distinct(), "links")
    unstage(named)
    unstage(of)
    return first.union(rest)


def classes(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """rows (doc_id, fp) with component_id, the least doc_id reachable (null only
    if no member has another)."""
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("root")), "nodes")
    of = components(links(nodes, limit)).select(F.col("v").alias("fp"), "c")
    linked = nodes.join(of, "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    least = linked.groupBy("c").agg(F.min("root").alias("component_id"))
    named = hot_join(linked, least, "c").select("fp", "component_id")
    return hot_join(rows, named, "fp").select(*rows.columns, "component_id")


def dedup(spark: SparkSession, docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row of each class stays, with the columns of docs; see one_of_each."""
    marked = docs.select("doc_id", "text", row_hash().alias("rid"))
    rows = staged(with_fingerprint(marked, ("doc_id", "rid"), "key"), "fingerprints")
    nodes = staged(rows.select(F.col("key").alias("fp")).distinct(), "nodes")
    of = components(links(nodes, limit))
    out = one_of_each(docs, rows, of)
    for done in (rows, nodes, of):
        unstage(done)
    return out


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(with_fingerprint(table(spark, sf_dir, "documents"), ("doc_id",)), "fingerprints")
    return classes(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
