"""Components of the links that posting lists lead to, without turning a list into all of its pairs.

lists has a row (token, group, size, pos, ...) for every token under which a
group is posted; groups with several members are in members(node, group), the
others are nodes themselves. Every group is first compared with a few central
groups of its list and of its size class (stars), and every member with the first
of its group; what that links is one component, and only pairs of different
components are then compared. A list of near copies thus costs as many pairs as it
has members. The result has all links between different components.

Lists meet on the token and the size class: sizes that can link differ by one
class at most, so a very common token falls apart into lists of like sizes, and
Spark splits the large ones of them on either side of the join. Lists of over
LONG rows may be left to a function that compares them in blocks and returns
only pairs that are as good as certain to link.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Centres of a posting list that all its groups are compared with first.
CENTRES = 3

#: Lists of more rows go to the function for long lists, if there is one.
LONG = 64

#: (pairs of nodes) -> those that link
Verify = Callable[[DataFrame], DataFrame]
#: (alias of a posting row, alias of another) -> condition that pairs that link meet at their first common token
Passes = Callable[[str, str], Column]


def size_class(size: Column, num: int, den: int) -> Column:
    """Sizes s <= l with den * s >= num * l are in one class or in neighbouring ones."""
    if num >= den:
        return size.cast("long")
    return F.floor(F.log(size.cast("double")) / (math.log(den / num) * (1 + 1e-9)))


def size_passes(x: str, y: str, num: int, den: int) -> Column:
    small, large = F.least(f"{x}.size", f"{y}.size"), F.greatest(f"{x}.size", f"{y}.size")
    return den * small >= num * large


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def list_components(lists: DataFrame, members: DataFrame, verify: Verify, passes: Passes, num: int, den: int, long_lists: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, label) of every node that links with another; label is the smallest node of its component."""
    lists = lists.withColumn("class", size_class(F.col("size"), num, den))
    ordered = stored(_ordered(_stars(lists, passes).unionByName(members.where("node <> group").select(F.col("node").alias("a"), F.col("group").alias("b")))))
    links = verify(ordered)
    labels = components(links)
    pairs = stored(_ordered(_other_pairs(lists, members, labels, passes, long_lists)).join(ordered, ["a", "b"], "left_anti"))
    if pairs.isEmpty():
        return labels
    return components(links.unionByName(verify(pairs)))


def _stars(lists: DataFrame, passes: Passes) -> DataFrame:
    """Every group with some centres of its list, and with one of its list and size class.

    Centres are groups whose tokens many others share: texts that others are edited copies of, where there are such.
    """
    of_token = lists.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    shares = lists.join(of_token, "token").groupBy("group").agg(F.sum("_n").alias("shares"))
    classed = lists.join(shares, "group")
    kept = [c for c in lists.columns if c not in ("token", "class")]
    row = F.struct("shares", *kept)
    part = F.pmod(F.xxhash64("group"), F.lit(CENTRES))
    of = stored(classed.groupBy("token", "class").agg(F.max(row).alias("own"), *[F.max(F.when(part == i, row)).alias(f"c{i}") for i in range(CENTRES)]))
    whole = of.groupBy("token").agg(*[F.max(f"c{i}").alias(f"c{i}") for i in range(CENTRES)])
    star = classed.join(of.select("token", "class", "own").join(whole, "token"), ["token", "class"])
    centres = F.filter(F.array_distinct(F.array("own", *[f"c{i}" for i in range(CENTRES)])), lambda c: c.isNotNull() & (c["group"] != F.col("group")))
    star = star.select(F.struct(*kept).alias("x"), F.explode(centres).alias("y")).where(passes("x", "y"))
    return star.select(F.col("x.group").alias("a"), F.col("y.group").alias("b"))


def _other_pairs(lists: DataFrame, members: DataFrame, labels: DataFrame, passes: Passes, long_lists: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Pairs of nodes that share a list or a group and are not of one component yet."""
    # A group of several nodes is one component only if all of them are.
    of_member = members.join(labels, "node", "left").select("node", "group", F.coalesce("label", "node").alias("label"))
    mixed = of_member.groupBy("group").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("group", F.lit(True).alias("mixed"))
    named = labels.select(F.col("node").alias("group"), "label")
    rows = lists.join(named, "group", "left").join(mixed, "group", "left")
    rows = rows.withColumn("label", F.coalesce("label", "group")).withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    # The label of the first row of a list marks its large component; lists of one component are done.
    spread = rows.groupBy("token").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.max("mixed").alias("_any"), F.min(F.struct("group", "label")).getField("label").alias("_main"), F.count(F.lit(1)).alias("rows"))
    open_ = stored(rows.join(spread.where("_low <> _high or _any").select("token", "_main", "rows"), "token").withColumn("main", (F.col("label") == F.col("_main")) & ~F.col("mixed")).drop("_main"))

    def met(x: DataFrame, y: DataFrame, classes: tuple[int, ...], order: Column) -> DataFrame:
        """Rows of x and y in one list, the class of y being that of x plus one of classes."""
        near = x.withColumn("_class", F.explode(F.array(*[F.col("class") + c for c in classes]))).alias("x")
        differ = (F.col("x.label") != F.col("y.label")) | F.col("x.mixed") | F.col("y.mixed")
        on = (F.col("x.token") == F.col("y.token")) & (F.col("x._class") == F.col("y.class")) & order & differ & passes("x", "y")
        return near.join(y.alias("y"), on).select(F.col("x.group").alias("g"), F.col("y.group").alias("h"))

    short = open_ if long_lists is None else open_.where(F.col("rows") <= LONG)
    main, others = short.where("main"), short.where("not main")
    first = met(others, main, (-1, 0, 1), F.col("x.group") != F.col("y.group"))
    second = met(others, others, (0, 1), (F.col("x.class") != F.col("y.class")) | (F.col("x.group") < F.col("y.group")))
    pairs = first.unionByName(second).distinct()
    if long_lists is not None:
        pairs = pairs.unionByName(long_lists(open_.where(F.col("rows") > LONG)).select(F.col("a").alias("g"), F.col("b").alias("h")))
    # Groups are expanded to their members.
    m = of_member.select("node", F.col("group").alias("_group"))
    left = pairs.join(m, F.col("g") == F.col("_group"), "left").select(F.coalesce("node", "g").alias("a"), "h")
    both = left.join(m, F.col("h") == F.col("_group"), "left").select("a", F.coalesce("node", "h").alias("b"))
    p, q = of_member.join(mixed, "group").alias("p"), of_member.join(mixed, "group").alias("q")
    within = p.join(q, (F.col("p.group") == F.col("q.group")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.label") != F.col("q.label")))
    return both.unionByName(within.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")))
