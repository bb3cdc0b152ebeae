"""Connected components, joins whose left side may have hot keys, and the choice
of one row of each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roundwise.llm.common import free_name, staged, unstage

#: A key is hot with more than one in SHARE rows, so fewer than SHARE keys are.
SHARE = 1000
#: Rows whose ids are broadcast, so that texts stay where they are: 16 bytes each.
FEW = 2_000_000


def hot_keys(left: DataFrame, key: str) -> list:
    """The keys that hold over 1/SHARE of left's rows: SHARE values at most."""
    counted = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    whole = left.count()
    return [r[0] for r in counted.where((F.col("n") * SHARE > whole) & (F.col("n") > 1) & F.col(key).isNotNull()).select(key).collect()]


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: list | None = None, how: str = "inner") -> DataFrame:
    """left joined with right, whose keys are distinct. Rows of hot keys meet the
    fewer than SHARE rows of right by broadcast, so no key makes a task of its own."""
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = lambda df: F.coalesce(df[key].isin(hot), F.lit(False))
    few = left.where(is_hot(left)).join(F.broadcast(right.where(is_hot(right))), key, how)
    return few.unionByName(left.where(~is_hot(left)).join(right, key, how))


def components(pairs: DataFrame) -> DataFrame:
    """(v, c): every vertex of the pairs (a, b) and the least vertex of its
    component, by hooking and pointer jumping. Nothing but counts and hot keys
    comes to the driver; neither hubs nor large components make a task of their own."""
    edges = staged(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a")), "edges")
    hubs = hot_keys(edges, "u")
    label = staged(edges.groupBy("v").agg(F.min("u").alias("c")).select("v", F.least("v", "c").alias("c")), "labels")
    while True:
        seen = hot_join(edges, label.withColumnRenamed("v", "u"), "u", hubs).groupBy("v").agg(F.min("c").alias("m"))
        lower = label.join(seen, "v").where("m < c")
        hooks = lower.select("v", "m").union(lower.select(F.col("c").alias("v"), "m")).groupBy("v").agg(F.min("m").alias("m"))
        hooked = staged(label.join(hooks, "v", "left").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")), "hooked")
        jump = hooked.select(F.col("v").alias("c"), F.col("c").alias("next"))
        after = staged(hot_join(hooked, jump, "c", how="left").select("v", "old", F.least("c", "next").alias("c")), "labels")
        moved = after.where("old <> c").limit(1).count()
        unstage(label)
        unstage(hooked)
        label = after.select("v", "c")
        label._staged_at = after._staged_at
        if not moved:
            unstage(edges)
            return label


def row_hash() -> Column:
    """With the id, what a row is known by."""
    return F.xxhash64("doc_id", "text")


def _same_row(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.rid") == F.col(f"{b}.rid"))


def one_of_each(docs: DataFrame, rows: DataFrame, of: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the least doc_id (nulls last; then
    the least key; of rows equal in id and text, one). rows: doc_id, rid
    (row_hash), key. of: (v, c), the class c of key v; a key that is not there is
    a class of its own. Texts are not shuffled, but where the rows to drop are too
    many to broadcast."""
    each = rows.groupBy("doc_id", "rid").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("rows"))
    each = staged(hot_join(each, of.select(F.col("v").alias("key"), "c"), "key", how="left").withColumn("c", F.coalesce("c", "key")), "each")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rid")
    stay = staged(each.groupBy("c").agg(F.min(first).alias("x")).select("x.doc_id", "x.rid"), "stay")
    gone = staged(each.alias("e").join(stay.alias("s"), _same_row("e", "s"), "left_anti").select("doc_id", "rid"), "gone")
    again = staged(each.where("rows > 1").alias("e").join(stay.alias("s"), _same_row("e", "s"), "left_semi").select("doc_id", "rid"), "again")
    unstage(each)
    unstage(stay)
    mark = free_name("_rid", docs)
    marked = docs.withColumn(mark, row_hash())
    known = lambda df, other: df["doc_id"].eqNullSafe(other["doc_id"]) & (df[mark] == other["rid"])
    out = marked.join(F.broadcast(gone) if gone.count() <= FEW else gone, known(marked, gone), "left_anti")
    if again.limit(1).count():  # rows that the table holds more than once
        once = marked.join(again, known(marked, again), "left_semi").dropDuplicates(["doc_id", mark])
        out = out.join(again, known(out, again), "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
