"""Personal data by patterns and bootstrapped contexts (DataFrame functions only).

Base kinds (email, ip, card, phone) are regular expressions plus checks. Their
matches seed a bootstrap: the word before an identifier is its lexical pattern.
Patterns and instances make a bipartite graph whose scores Spark iterates (see
scores): trusted patterns make the unseen identifiers after them known, and those
vouch for further patterns. What looks like an identifier after a trusted pattern
is found as kind "id".

Spans are kind:start:end in code points, end exclusive, found over whole texts.
Positions come from the pieces between matches, which split() cuts with the same
expression. The expressions are possessive, or start only where a run starts, so
that long runs take linear time and no stack.

Defined results: null and empty texts have no spans; every row is scanned by
itself, repeated ids too; extra columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundwise.llm.common import staged, table, unstage
from roundwise.llm.graphs import hot_join, hot_keys

KINDS = ("email", "ip", "card", "phone", "id")
#: \G lets a match start inside a run where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must contain for a match, to skip the others cheaply.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CONTEXT = r"(\p{L}{2,20})[ :=#]{1,3}"
IDENTIFIER = r"(?<!\p{L})\p{L}{2,20}[ :=#]{1,3}(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{5,}+"
#: Characters before a match that may hold its context.
BEFORE = 24
HIGH, SEEDS, ROUNDS = 0.7, 3, 6
#: Trusted patterns that are broadcast or written into an expression.
FEW = 10_000
#: Texts to redact are cut into pieces of 2**CHUNK characters.
CHUNK = 10


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, 1).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.right(F.concat(F.lit("00"), x), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(14, 19) & luhn(d)
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op) -> Column:
    """For each element of an array of ints >= 0, op (a sum or the greatest) over
    those before it, in linear time: blocks of 64, blocks of blocks, and above."""
    fold = lambda v, first=None: F.aggregate(v, F.lit(0) if first is None else first, op)
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(v) - 1, 6)), lambda b: fold(F.slice(v, b * 64 + 1, F.lit(64))))
    inside = lambda v, up: F.transform(v, lambda _, i: fold(F.slice(v, i - i.bitwiseAND(F.lit(63)) + 1, i.bitwiseAND(F.lit(63))), F.get(up, F.shiftright(i, 6))))
    top = lambda v: F.transform(v, lambda _, i: fold(F.slice(v, F.lit(1), i)))
    whole = lambda v, s1, s2: let(top(s2), lambda p2: let(inside(s1, p2), lambda p1: inside(v, p1)))
    found = let(values, lambda v: let(blocks(v), lambda s1: let(blocks(s1), lambda s2: whole(v, s1, s2))))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast("array<int>"))


def _located(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, value, before) of each match in found, the text's matches;
    before: the end of the text between the match and the last one."""
    pieces = F.zip_with(F.slice(F.split(text, pattern), F.lit(1), F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("gap"), F.length(v).alias("long"), v.alias("value"), F.right(g, F.lit(BEFORE)).alias("before")))
    placed = lambda p: F.zip_with(p, running(F.transform(p, lambda x: x["gap"] + x["long"]), lambda a, x: a + x), lambda x, at: F.struct(
        (at + x["gap"]).alias("start"), (at + x["gap"] + x["long"]).alias("end"), x["value"].alias("value"), x["before"].alias("before")))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    return F.when(F.size(found) > 0, let(pieces, placed)).otherwise(none)


def with_matches(docs: DataFrame, text: str = "text", into: str = "_pii") -> DataFrame:
    """docs, a struct of arrays of (start, end, value): a field for each base
    kind, and candidates, whose value begins with its context."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    at = lambda k: F.col(f"`{into}{k}`")
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    every = {**PATTERNS, "candidates": IDENTIFIER}
    none = F.array().cast("array<string>")

    def all_of(k: str) -> Column:
        needs = F.contains(t, F.lit(NEEDS[k])) if NEEDS.get(k) else t.rlike("[0-9]")
        return F.when(needs, F.regexp_extract_all(t, F.lit(every[k]), F.lit(0))).otherwise(none)

    out = docs.select(*own, *[all_of(k).alias(f"{into}{k}") for k in every])
    out = out.select(*own, *[_located(t, p, at(k)).alias(f"{into}{k}") for k, p in every.items()])
    checked = {k: F.filter(at(k), _check(k)) for k in PATTERNS}
    return out.select(*own, F.struct(*[c.alias(k) for k, c in checked.items()], at("candidates").alias("candidates")).alias(into))


def _check(kind: str):
    return lambda x: _valid(kind, x["value"])


def scores(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges: distinct (pattern, instance, seed). (pattern, score, known).

    Round by round: a pattern's score is the mean of its instances' scores, with
    one doubtful instance added; it is trusted with HIGH score and SEEDS known
    instances. An instance is known, with score 1, if it is a seed; else its score
    is 1 - product(1 - score) over its trusted patterns, so at least HIGH if it has
    one. What a trusted pattern finds so vouches for further patterns. Rounds end
    when no pattern is newly trusted."""
    pairs = edges.select("pattern", "instance")
    instance = edges.groupBy("instance").agg(F.max("seed").alias("fixed"))
    hot = hot_keys(pairs, "instance")
    found, before = None, -1
    vouched = None
    for _ in range(rounds):
        s = F.when(F.col("fixed"), F.lit(1.0))
        if vouched is None:
            held = instance.select("instance", s.otherwise(0.0).alias("s"))
        else:
            held = instance.join(vouched, "instance", "left").select("instance", s.otherwise(F.coalesce("s", F.lit(0.0))).alias("s"))
        now = staged(hot_join(pairs, held, "instance", hot).groupBy("pattern").agg((F.sum("s") / (F.count(F.lit(1)) + 1)).alias("score"), F.count_if(F.col("s") >= HIGH).alias("known")), "patterns")
        unstage(found)
        found = now
        good = now.where(_TRUSTED).select("pattern", "score")
        n = good.count()
        if n == before:
            break
        before = n
        doubt = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999))))
        vouched = pairs.join(F.broadcast(good) if n <= FEW else good, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("s"))
    return found


_TRUSTED = f"score >= {HIGH} AND known >= {SEEDS}"


def trusted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Column pattern: the contexts of high score over all docs."""
    m = with_matches(docs.select(F.col(f"`{text}`").alias("text")))
    word = lambda x: F.lower(F.regexp_extract(x, CONTEXT + "$", 1))
    seeds = F.flatten(F.array(*[F.transform(F.col("_pii")[k], lambda x: F.struct(word(x["before"]).alias("pattern"), x["value"].alias("instance"), F.lit(True).alias("seed"))) for k in PATTERNS]))
    others = F.transform(F.col("_pii")["candidates"], lambda x: F.struct(F.lower(F.regexp_extract(x["value"], CONTEXT, 1)).alias("pattern"), F.regexp_replace(x["value"], "^" + CONTEXT, "").alias("instance"), F.lit(False).alias("seed")))
    # explode_outer: explode would infer a filter that computes the arrays again
    pairs = m.select(F.explode_outer(F.concat(seeds, others)).alias("x")).select("x.*").where("pattern <> ''")
    edges = staged(pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "contexts")
    out = scores(edges).where(_TRUSTED).select("pattern")
    unstage(edges)
    return out


def _spans(matches: Column, ids: Column) -> Column:
    """Sorted (start, kind's number, end)."""
    parts = [F.transform(ids if k == "id" else matches[k], _span(i)) for i, k in enumerate(KINDS)]
    return F.sort_array(F.concat(*parts))


def _span(number: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"))


def with_spans(docs: DataFrame, patterns: DataFrame, text: str = "text", into: str = "_spans") -> DataFrame:
    """docs and an array of (start, kind's number, end). Up to FEW patterns are
    part of the expression; beyond, candidates are joined with them by row."""
    context = lambda x: F.lower(F.regexp_extract(x["value"], CONTEXT, 1))
    bare = lambda x: F.struct((x["end"] - F.length(F.regexp_replace(x["value"], "^" + CONTEXT, ""))).alias("start"), x["end"].alias("end"))
    mark = into
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    found = with_matches(docs, text, mark)
    own = [F.col(f"`{c}`") for c in docs.columns]
    few = [r[0] for r in patterns.limit(FEW + 1).collect()]
    none = F.array().cast("array<struct<start:int,end:int>>")
    if len(few) <= FEW:
        trusted_here = F.filter(F.col(mark)["candidates"], lambda x: context(x).isin(few)) if few else None
        ids = none if trusted_here is None else F.transform(trusted_here, bare)
        return found.select(*own, _spans(F.col(mark), ids).alias(into))
    found = staged(found.withColumn(f"{mark}row", F.monotonically_increasing_id()), "matches")
    each = found.select(f"{mark}row", F.explode(F.col(mark)["candidates"]).alias("x"))
    hits = each.join(patterns, context(F.col("x")) == F.col("pattern")).groupBy(f"{mark}row").agg(F.collect_list(bare(F.col("x"))).alias(f"{mark}ids"))
    return found.join(hits, f"{mark}row", "left").select(*own, _spans(F.col(mark), F.coalesce(F.col(f"{mark}ids"), none)).alias(into))


def joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each found span replaced by its kind in angle brackets; spans
    that overlap are replaced together, under the first one's name."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    mark = "_cut"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    found = with_spans(docs, trusted(docs, text), text, mark)
    t, name = F.col(f"`{text}`"), F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    low = lambda at: at.bitwiseAND(F.lit((1 << CHUNK) - 1))
    high = lambda at: F.shiftright(at, CHUNK)
    pieces = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{1 << CHUNK}}}"), F.lit(0))

    def part(c: Column, a: Column, b: Column) -> Column:
        """Characters a to b of the text in pieces c, without a walk over it all."""
        over = F.concat(F.substring(F.get(c, high(a)), low(a) + 1, F.lit(1 << CHUNK)), F.array_join(F.slice(c, high(a) + 2, high(b) - high(a) - 1), ""), F.substring(F.coalesce(F.get(c, high(b)), F.lit("")), F.lit(1), low(b)))
        return F.when(a >= b, F.lit("")).when(high(a) == high(b), F.substring(F.get(c, high(a)), low(a) + 1, b - a)).otherwise(over)

    spans = F.col(mark)
    ends = running(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    kept = F.filter(F.zip_with(spans, ends, lambda x, at: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), at.alias("at"))), lambda x: x["start"] >= x["at"])
    last = F.array_max(F.transform(spans, lambda x: x["end"]))
    cut = lambda c: F.concat(F.array_join(F.transform(kept, lambda x: F.concat(part(c, x["at"], x["start"]), F.get(name, x["kind"]))), ""), part(c, last, F.length(t)))
    changed = F.when(F.size(spans) > 0, let(pieces, cut)).otherwise(t)
    return found.select(*[changed.alias(c) if c == text else o for c, o in zip(docs.columns, own, strict=True)])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs, trusted(docs)).select("doc_id", "_spans")
    base = F.filter("_spans", lambda x: x["kind"] < len(PATTERNS))
    counts = [F.size(F.filter("_spans", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"))


def _of(number: int):
    return lambda x: x["kind"] == number
