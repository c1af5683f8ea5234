"""Problem 3: splits in which everything related stays together.

Groups are tied when rows of one item carry both. Borůvka rounds contract the ties: every component takes its smallest
edge, the chosen edges join the forest, trees are flattened by pointer doubling, and the edges between the new
components go on, of parallel ones the smallest. Components at least halve in a round, so there are at most
log2(groups) rounds; each is materialised in the shared checkpoint folder. Nothing of the graph comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.plans.runtime import bounded_rows, cut, drop


def ties(df: DataFrame, item: list[str], group: str) -> DataFrame:
    """(u, v): for every item with several groups, edges from its smallest group to the others, each once with u < v."""
    whole = F.col(group).isNotNull()
    for c in item:
        whole = whole & F.col(c).isNotNull()
    known = df.where(whole).select(*item, F.col(group).alias("g"))
    # few items have two groups: these are found by a partial aggregation, before any row is shuffled by item again
    several = known.groupBy(*item).agg(F.min("g").alias("u"), F.max("g").alias("w")).where("u <> w").drop("w")
    return known.join(several, item).where("g <> u").select("u", F.col("g").alias("v")).distinct()


def _weight(u: str, v: str) -> Column:
    return F.struct(F.xxhash64(u, v).alias("h"), F.col(u).alias("u"), F.col(v).alias("v"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(u, v, root): the edges chosen, with the smallest node of their component as its root, as a written table.

    Self-loops and null ends are ignored; repeated edges count once. Everything that is tied is read from the forest.
    """
    base = cut(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    labels = base.select(F.col("u").alias("node")).union(base.select("v")).distinct().withColumn("root", F.col("node"))
    live = base.select(F.col("u").alias("a"), F.col("v").alias("b"), _weight("u", "v").alias("w"))
    chosen: list[DataFrame] = []
    while not live.isEmpty():
        both = live.union(live.select(F.col("b"), F.col("a"), "w"))
        best = cut(both.groupBy("a").agg(F.min(F.struct("w", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.w").alias("w")))
        chosen.append(best)
        # two components that chose the same edge point at each other: the smaller becomes a root
        mutual = best.alias("x").join(best.alias("y"), (F.col("x.b") == F.col("y.a")) & (F.col("y.b") == F.col("x.a")), "left")
        flat = parent = cut(mutual.select(F.col("x.a").alias("a"), F.when(F.col("y.a").isNotNull() & (F.col("x.a") < F.col("x.b")), F.col("x.a")).otherwise(F.col("x.b")).alias("p")))
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            further = cut(parent.join(up, "p").select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            drop(flat)
            flat, parent = further, further.drop("moved")
            if further.where("moved").isEmpty():
                break
        # finished components stay
        now = cut(labels.join(parent.select(F.col("a").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        pa, pb = parent.select("a", F.col("p").alias("na")), parent.select(F.col("a").alias("b"), F.col("p").alias("nb"))
        moved = live.join(pa, "a").join(pb, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "w")
        rest = cut(moved.groupBy("a", "b").agg(F.min("w").alias("w")))
        drop(labels, live, flat)
        labels, live = now, rest
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    rooted = labels.join(least, "root").select(F.col("node").alias("u"), F.col("least").alias("root"))
    edges_ = reduce(DataFrame.union, [b.select("w.u", "w.v") for b in chosen], base.limit(0)).distinct()
    forest = cut(edges_.join(rooted, "u").select("u", "v", "root"))
    drop(labels, live, base, *chosen)
    return forest


def members(forest: DataFrame) -> DataFrame:
    """(node, root): the nodes of a forest."""
    return forest.select(F.col("u").alias("node"), "root").union(forest.select("v", "root")).distinct()


def units(df: DataFrame, item: list[str], group: str) -> DataFrame:
    """(group, root, n_groups): the class of every tied group, with the number of groups in it; other groups are alone."""
    m = members(spanning_forest(ties(df, item, group)))
    n = m.groupBy("root").agg(F.count("*").alias("n_groups"))
    return m.join(n, "root").select(F.col("node").alias(group), "root", "n_groups")


#: Members of a class from which on its pairs are spread over PAIR_BLOCKS tasks.
PAIR_MEMBERS = 1_000
PAIR_BLOCKS = 64


def tied_pairs(df: DataFrame, item: list[str], group: str) -> DataFrame:
    """(group_a, group_b) with group_a < group_b: the pairs of groups that must share a split, expanded from units.

    The pairs of a large class are split over blocks of its members, so that no class is expanded by one task.
    """
    u = cut(units(df, item, group).withColumn("blocks", F.when(F.col("n_groups") > PAIR_MEMBERS, PAIR_BLOCKS).otherwise(1)))
    a = u.select("root", F.col(group).alias("group_a"), F.pmod(F.xxhash64(group), "blocks").alias("block"))
    b = u.select("root", F.col(group).alias("group_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)).alias("block"))
    return a.join(b, ["root", "block"]).where("group_a < group_b").select("group_a", "group_b")


def assign_splits(df: DataFrame, item: list[str], group: str, shares: dict[str, float] | None = None, salt: str = "split-1") -> DataFrame:
    """(item..., root, split): one split for every item, all items tied by groups or by being one item together.

    Components are the units. They are put into bands by size (powers of two of their items), and the bands are dealt
    from the largest units down. In a band units are dealt by systematic selection over the cumulated sizes in hash
    order, in the proportions of what every split still lacks: what a large unit upsets, the smaller ones make up for.
    A split takes part in a band if it lacks at least half of a largest one of its units (if none does, the one that lacks
    most).
    Items without any group form their own unit; rows with a null item column are left out. The running sum over the
    units of a band is taken blockwise (partial sums per hash block, then within a block), so no band is pulled into one
    task; the driver sees a sum per band and split.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    whole = F.lit(True)
    for c in item:
        whole = whole & F.col(c).isNotNull()
    labels = members(spanning_forest(ties(df, item, group)))
    items = df.where(whole).groupBy(*item).agg(F.min(group).alias("g"))  # any group of the item: all are in one component
    alone = F.concat(F.lit("item:"), *[x for c in item for x in (F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))])
    rooted = items.join(labels.select(F.col("node").alias("g"), "root"), "g", "left").select(
        *item, F.coalesce(F.concat(F.lit("group:"), F.coalesce("root", "g")), alone).alias("root")
    )
    rooted = cut(rooted)
    hashed = rooted.groupBy("root").agg(F.count("*").alias("n")).withColumn("band", F.floor(F.log2("n")).cast("int")).withColumn("h", F.xxhash64(F.lit(salt), "root"))
    blocks = cut(hashed.withColumn("block", F.shiftright("h", 52)))  # 4096 blocks a band
    sums = blocks.groupBy("band", "block").agg(F.sum("n").alias("s"))
    before = sums.withColumn("base", F.coalesce(F.sum("s").over(Window.partitionBy("band").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("band", "block").orderBy("h", "root").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the midpoint of a unit on its band's line
    placed = cut(blocks.withColumn("inner", inner).join(before.select("band", "block", "base"), ["band", "block"]).select("root", "n", "band", (F.col("base") + F.col("inner") + F.col("n") / 2).alias("at")))
    totals = {r["band"]: r["total"] for r in bounded_rows(placed.groupBy("band").agg(F.sum("n").alias("total")), 64, "bands")}
    lacks = {k: v / sum(shares.values()) * sum(totals.values()) for k, v in shares.items()}
    parts = []
    for band in sorted(totals, reverse=True):
        part = {k: v for k, v in lacks.items() if v >= 2.0**band} or {max(lacks, key=lambda k: lacks[k]): 1.0}
        offset = F.pmod(F.xxhash64(F.lit(salt), F.lit(band)), F.lit(1000)) / 1000.0
        turn = F.pmod(F.col("at") / totals[band] + offset, F.lit(1.0))
        split, upto = F.lit(None).cast("string"), 0.0
        for name, lack in part.items():
            upto += lack / sum(part.values())
            split = F.coalesce(split, F.when(turn < upto, F.lit(name)))
        parts.append(placed.where(F.col("band") == band).select("root", "n", F.coalesce(split, F.lit(next(reversed(part)))).alias("split")))
        if band:
            for r in bounded_rows(parts[-1].groupBy("split").agg(F.sum("n").alias("n")), len(shares), "splits"):
                lacks[r["split"]] -= r["n"]
    if not parts:
        return rooted.select(*item, "root", F.lit(None).cast("string").alias("split"))
    return rooted.join(reduce(DataFrame.union, parts).select("root", "split"), "root").select(*item, "root", "split")
