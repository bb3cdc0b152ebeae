"""Mixing sources to target weights by minimum-cost flow.

Texts are aggregated by membership pattern, the set of sources that hold the same
text. A flow routes each pattern's tokens to its sources' quotas; a further
repetition of a text costs more than the one before (convex), whichever source it
is for, so no text is repeated while something fresh can fill a quota. What a
pattern gives a source comes from that source's own rows of its texts.

The flow holds every pattern of several sources, and the patterns of one source that
share a source with them; the texts of other sources need none. As costs depend on
the repetition only, it is a maximum flow with the arcs of a first taking, then one
with those of the second as well, and so on: what the source of a flow gave once is
never taken back. The driver holds a few numbers for each pattern and source, and
never a document; MAX_PATTERNS, if set, bounds the patterns of several sources.

A pattern that shall give F tokens of its T in a source takes all rows there F // T
times and for the rest a seeded subset: rows in the order of a seeded hash up to a
boundary. Texts of several sources are ordered by the text's hash, rotated so that
the sources take different texts. Rounds of histograms with 256 bins narrow the
boundary until FINE rows or fewer, or rows that all agree, stand at it; of those,
in order, each that still fits is taken; of rows that agree, as many as fit.

Defined results: null and empty texts have size 0 and take 0; a null source is a
source of its own, last in order; reruns agree, whatever the partitions (of rows
that agree in id, text and source, any may be the ones taken).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roundwise.llm.common import free_name, staged, table, unstage, words
from roundwise.llm.graphs import hot_join

WEIGHTS = (5, 2, 1)
REPEATS = 3
MAX_PATTERNS: int | None = None
FINE, BINS = 400, 256
#: Characters of a pattern's name; a longer one is known by its hash.
NAME = 256
#: Keys of a table that is broadcast; larger ones are joined by shuffle.
FEW = 50_000
SPAN = 1 << 40


def targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> dict:
    """Source to target: shares of the whole by weight, in the order of code
    points with null last, none above repeats times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > repeats * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in open_}
        for s in over:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


class Flow:
    """Maximum flow by blocking flows of shortest paths, over real capacities. Arcs
    may be added, or get more room, between runs."""

    def __init__(self, nodes: int):
        self.graph: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def arc(self, a: int, b: int, room: float) -> int:
        for x, y, r in ((a, b, room), (b, a, 0.0)):
            self.graph[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def levels(self, source: int, sink: int, least: float) -> list[int]:
        level = [-1] * len(self.graph)
        level[source], queue = 0, deque([source])
        while queue and level[sink] < 0:
            x = queue.popleft()
            for e in self.graph[x]:
                if self.room[e] > least and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def run(self, source: int, sink: int, least: float = 1e-6) -> None:
        while (level := self.levels(source, sink, least))[sink] >= 0:
            at, path, x = [0] * len(self.graph), [], source
            while True:
                if x == sink:
                    amount = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    first = next(i for i, e in enumerate(path) if self.room[e] <= least)
                    x = self.to[path[first] ^ 1]
                    del path[first:]
                while at[x] < len(self.graph[x]):
                    e = self.graph[x][at[x]]
                    if self.room[e] > least and level[self.to[e]] == level[x] + 1:
                        break
                    at[x] += 1
                else:
                    if x == source:
                        break
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                    continue
                path.append(e)
                x = self.to[e]

    def open_to(self, sink: int, least: float = 1e-6) -> list[bool]:
        """The nodes that could send more to the sink."""
        found, queue = [False] * len(self.graph), deque([sink])
        found[sink] = True
        while queue:
            x = queue.popleft()
            for e in self.graph[x]:
                if self.room[e ^ 1] > least and not found[self.to[e]]:
                    found[self.to[e]] = True
                    queue.append(self.to[e])
        return found


def route(texts: dict[int, int], rows: dict[tuple[int, str | None], int], quota: dict, repeats: int = REPEATS) -> dict[tuple, float]:
    """texts: tokens of each pattern's distinct texts. rows: tokens of its rows in
    each source. Tokens, repetitions counted, that each pattern gives each source:
    at most repeats times its rows there; repetition r of a text costs
    r * (r - 1) / 2 a token."""
    patterns = sorted(texts)
    sources = sorted({s for _, s in rows}, key=lambda s: (s is None, s or ""))
    node = {p: 2 + i for i, p in enumerate(patterns)} | {("source", s): 2 + len(patterns) + j for j, s in enumerate(sources)}
    flow = Flow(2 + len(node))
    room = dict.fromkeys(patterns, 0)
    arcs, ahead = {}, {p: flow.arc(0, node[p], 0.0) for p in patterns}
    for (p, s), n in sorted(rows.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or "")):
        room[p] += repeats * n
        arcs[p, s] = flow.arc(node[p], node["source", s], float(repeats * n))
    for s in sources:
        flow.arc(node["source", s], 1, quota[s])
    left = [p for p in patterns if texts[p] > 0]
    while left := [p for p in left if room[p] > 0]:
        for p in left:
            flow.room[ahead[p]] += min(texts[p], room[p])
            room[p] -= texts[p]
        flow.run(0, 1)
        further = flow.open_to(1)
        left = [p for p in left if further[node[p]]]
    return {k: flow.room[e ^ 1] for k, e in arcs.items()}


def measured(docs: DataFrame, seed: int, into: str) -> DataFrame:
    """docs and a struct: size, t (the text's hash) and h, 40 seeded bits of the row."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 24)
    return docs.withColumn(into, F.struct(F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col("text")).alias("t"), h.alias("h")))


def overlaps(rows: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """rows: source, size, t. (t, pattern) of the texts that several sources hold,
    and the patterns' tokens; patterns are sources as a JSON array, or its hash."""
    held = rows.where("size > 0").groupBy("t").agg(F.collect_set(F.struct("source")).alias("members"), F.max("size").alias("size")).where(F.size("members") > 1)
    named = F.to_json(F.transform(F.array_sort("members"), lambda x: x["source"]), {"ignoreNullFields": "false"})
    named = F.when(F.length(named) > NAME, F.sha2(named, 256)).otherwise(named)
    several = staged(held.select("t", named.alias("pattern"), "size"), "overlaps")
    sizes = several.groupBy("pattern").agg(F.sum("size").alias("size"))
    if MAX_PATTERNS is not None:
        sizes = sizes.orderBy(F.desc("size"), "pattern").limit(MAX_PATTERNS)
    most = sizes.collect()
    if MAX_PATTERNS is not None:
        several = several.where(F.col("pattern").isin([r["pattern"] for r in most]))
    return several.select("t", "pattern"), [(r["pattern"], r["size"]) for r in most]


def key_of(pattern: Column, source: Column) -> Column:
    """The name of what a pattern gives one source; without a pattern, of the source."""
    return F.concat(F.coalesce(pattern, F.lit("")), F.to_json(F.struct(source.alias("s"))))


def few(table_: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table_) if rows <= FEW else table_


def boundary(spark: SparkSession, rows: DataFrame, rest: dict[str, float]) -> list[tuple[str, int, list[tuple[int, int, int, int]]]]:
    """rows: key, size, h. rest: what a subset of each key's rows shall sum up to.
    For each key: low and some (h, size, k, n); the subset is h < low, and k of the
    n rows of each such hash and size."""
    state = {k: [0, SPAN, 0.0] for k, r in rest.items() if r > 0}  # low, high, taken below low
    held = {r["key"]: r["n"] for r in rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    todo = {k for k in state if held[k] > FINE}

    def width(k: str) -> int:
        """Of bins that hold about FINE / 2 documents, BINS of them at most."""
        return -(-(state[k][1] - state[k][0]) // max(2, min(BINS, 2 * held[k] // FINE)))

    def frame(keys) -> DataFrame:
        return few(spark.createDataFrame([(k, state[k][0], state[k][1], width(k)) for k in sorted(keys)], "key string, low long, high long, wide long"), len(keys))

    while todo:
        inside = rows.join(frame(todo), "key").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("high")))
        bins = inside.groupBy("key", F.expr("(h - low) div wide").alias("bin")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        by: dict[str, list] = {}
        for r in sorted(bins, key=lambda r: (r["key"], r["bin"])):
            by.setdefault(r["key"], []).append(r)
        for k in list(todo):
            (low, high, taken), wide = state[k], width(k)
            for r in by.get(k, []):
                if taken + r["size"] > rest[k]:
                    state[k] = [low + r["bin"] * wide, min(high, low + (r["bin"] + 1) * wide), taken]
                    held[k] = r["n"]
                    break
                taken += r["size"]
            else:  # all fit
                state[k], held[k] = [high, high, taken], 0
            if held[k] <= FINE or state[k][1] - state[k][0] <= 1:
                todo.discard(k)
    out = []
    if state:
        near = rows.join(frame(state), "key").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("high")))
        by = {}
        for r in near.groupBy("key", "h", "size").agg(F.count(F.lit(1)).alias("n")).collect():
            by.setdefault(r["key"], []).append((r["h"], r["size"], r["n"]))
        for k, (low, _, taken) in state.items():
            chosen = []
            for h, size, n in sorted(by.get(k, [])):
                some = n if not size else min(n, int((rest[k] - taken) // size))
                if some > 0:
                    taken += some * size
                    chosen.append((h, size, some, n))
            out.append((k, low, chosen))
    return out


@dataclass
class Plan:
    """What each key takes. overlaps: (t, pattern). keys: key, source_size, target,
    turn (of the hash), full, low, chosen; shared: whether some of chosen take only
    a part of equal rows; n: the number of keys."""

    overlaps: DataFrame
    keys: DataFrame
    shared: bool
    n: int


def decide(spark: SparkSession, rows: DataFrame) -> Plan:
    """rows: source, size, t, h."""
    several, most = overlaps(rows)
    texts = dict(most)
    named = rows.join(several, "t", "left") if not texts else hot_join(rows, several, "t", how="left")
    named = staged(named.select(F.col("pattern"), "source", "size", F.when(F.col("pattern").isNull(), F.col("h")).otherwise(F.shiftrightunsigned("t", 24)).alias("h"), key_of(F.col("pattern"), F.col("source")).alias("key")), "units")
    sums = named.groupBy("key", "pattern", "source").agg(F.sum("size").alias("size")).collect()
    sizes: dict = {}
    for r in sums:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    quota = targets(sizes)
    meet = {r["source"] for r in sums if r["pattern"]}
    number: dict = {p: i for i, p in enumerate(sorted(texts))}
    number |= {("alone", s): len(texts) + i for i, s in enumerate(sorted(meet, key=lambda s: (s is None, s or "")))}
    unit = {r["key"]: (number[r["pattern"] or ("alone", r["source"])], r["source"]) for r in sums if r["source"] in meet}
    held = {unit[r["key"]]: r["size"] for r in sums if r["key"] in unit}
    tokens = {number[p]: n for p, n in texts.items()} | {unit[r["key"]][0]: r["size"] for r in sums if r["key"] in unit and not r["pattern"]}
    flow = route(tokens, held, quota) if texts else {}
    out, rest, turn, used = [], {}, {}, {}
    for r in sorted(sums, key=lambda r: r["key"]):
        k, size, s = r["key"], r["size"], r["source"]
        given = flow[unit[k]] if k in unit else quota[s]
        full = min(REPEATS, int((given + 1e-6) // size)) if size else 0
        left = given - full * size if full < REPEATS else 0.0
        if left > 0.5:
            rest[k] = left + 1e-6
        if r["pattern"]:  # the next source goes on where this one ends
            turn[k] = int(used.get(r["pattern"], 0.0) * SPAN) % SPAN
            used[r["pattern"]] = used.get(r["pattern"], 0.0) + (left / size if size else 0.0)
        out.append((k, int(sizes[s]), float(quota[s]), turn.get(k, 0), full))
    schema = "key string, source_size long, target double, turn long, full int"
    turns = spark.createDataFrame([(k, t) for k, t in turn.items() if t], "key string, turn long")
    turned = named.join(few(turns, len(turn)), "key", "left").select("key", "size", F.pmod(F.col("h") - F.coalesce("turn", F.lit(0)), F.lit(SPAN)).alias("h"))
    edge = {k: (low, chosen) for k, low, chosen in boundary(spark, turned, rest)}
    unstage(named)
    keys = spark.createDataFrame([(*x, *edge.get(x[0], (0, []))) for x in out], schema + ", low long, chosen array<struct<h:long,size:long,k:long,n:long>>")
    return Plan(several, keys, any(k < n for _, chosen in edge.values() for *_, k, n in chosen), len(out))


def copied(docs: DataFrame, plan: Plan, into: str, outputs: tuple[str, ...] = ()) -> DataFrame:
    """docs, measured into a struct: now with how often each row is taken in its
    place, and the named columns of the plan's keys."""
    mark = into
    while any(c.lower().startswith(mark.lower()) and c != into for c in docs.columns):
        mark += "_"
    own = [F.col(f"`{c}`") for c in docs.columns if c != into]
    pattern, m, d = F.col(f"`{mark}pattern`"), F.col(f"`{into}`"), F.col(f"`{mark}d`")
    named = docs.withColumn(f"{mark}t", m["t"]).join(plan.overlaps.select(F.col("t").alias(f"{mark}t"), F.col("pattern").alias(f"{mark}pattern")), f"{mark}t", "left")
    named = named.withColumn(f"{mark}key", key_of(pattern, F.col("source")))
    keys = plan.keys.select(F.col("key").alias(f"{mark}key"), F.struct(*plan.keys.columns[1:]).alias(f"{mark}d"))
    found = named.join(F.broadcast(keys), f"{mark}key", "left") if plan.n <= FEW else hot_join(named, keys, f"{mark}key", how="left")
    h = F.pmod(F.when(pattern.isNull(), m["h"]).otherwise(F.shiftrightunsigned(m["t"], 24)) - d["turn"], F.lit(SPAN))
    found = found.withColumn(f"{mark}h", h)
    at = F.get(F.filter(d["chosen"], lambda x: (x["h"] == F.col(f"{mark}h")) & (x["size"] == m["size"])), F.lit(0))
    found = found.withColumn(f"{mark}at", at)
    here = F.col(f"{mark}at")
    copies = lambda more: (d["full"] + more.cast("int")).alias(into)
    extra = [d[o].alias(o) for o in outputs]
    size = [m["size"].alias("size")] if outputs else []
    whole = F.coalesce((F.col(f"{mark}h") < d["low"]) | (here["k"] >= here["n"]), F.lit(False))
    if not plan.shared:
        return found.select(*own, *size, *extra, copies(whole))
    part = F.coalesce(here["k"] < here["n"], F.lit(False))
    some = staged(found.where(part).withColumn(f"{mark}pid", F.spark_partition_id()), "equal")
    group, pid = [F.col(f"{mark}key"), F.col(f"{mark}h"), m["size"]], F.col(f"{mark}pid")
    names = [f"{mark}g{i}" for i in range(3)]
    some = some.select("*", *[g.alias(n) for g, n in zip(group, names, strict=True)])
    counts = some.groupBy(*names, pid).agg(F.count(F.lit(1)).alias(f"{mark}c"))
    before = counts.withColumn(f"{mark}b", F.coalesce(F.sum(f"{mark}c").over(Window.partitionBy(*names).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(f"{mark}c")
    ranked = some.withColumn(f"{mark}r", F.row_number().over(Window.partitionBy(*names, pid).orderBy(F.lit(0)))).join(before, [*names, f"{mark}pid"])
    ranked = ranked.select(*own, *size, *extra, copies(F.col(f"{mark}b") + F.col(f"{mark}r") <= here["k"]))
    return found.where(~part).select(*own, *size, *extra, copies(whole)).unionByName(ranked)


def mix(spark: SparkSession, docs: DataFrame, seed: int = 42) -> DataFrame:
    """docs with every row as often as the mix takes it."""
    into = free_name("_mix", docs)
    plan = decide(spark, staged(measured(docs.select("doc_id", "text", "source"), seed, into).select("source", f"{into}.*"), "sizes"))
    often = copied(measured(docs, seed, into), plan, into)
    return often.where(F.col(into) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(into))).alias(into)).drop(into)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = staged(measured(docs, 42, "_m").select("doc_id", "source", "_m"), "sizes")
    plan = decide(spark, rows.select("source", "_m.*"))
    return copied(rows, plan, "_m", ("source_size", "target")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_m")).alias("taken"))
