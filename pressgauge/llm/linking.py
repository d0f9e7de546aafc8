"""Connected components of a set-similarity graph, found key by key without all pairs of a key.

``members`` holds a row for every (key, node): nodes that share a key may be linked. In the first round every key names
a hub, and every node is compared with that hub that it shares the most keys with. Nodes already in one component need
no further edge, so keys whose nodes all lie in one component are finished. Of the others, small keys have their pairs
across components verified. Large ones may be groups of near copies, and are settled by families first:

A large key names a hub. A family is a hub and the nodes of its keys that are somewhat similar to it. Its reference is the set of items that
most of those close to the hub hold, and every node is known by its differences from the reference. For nodes x and y the
symmetric difference has |x| + |y| - 2 * (shared) differences, so with the slack
S = (100 - percent) * size - (100 + percent) * differences two nodes are linked for certain if S(x) + S(y) >= 0, and
otherwise only if they share differences. The node with the most slack is linked to all it can be for certain; other
pairs must share one of their rarest differences, and are then decided exactly from the differences. Any partner of a
node close to the hub belongs to the family, by the triangle inequality of the Jaccard distance, so such nodes have met
all they can be linked to under those keys and leave them. Two nodes of one family need never be compared again. What is
left under a key is less and less alike; after a few rounds every further one raises the number of members up to which
pairs that no family has settled are compared, so the rounds come to an end.

No pair that could join two components is skipped.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.llm.scratch import Workspace, small_side
from pressgauge.operators.components import components as settle

#: Members up to which a key's pairs across components are compared in the first ``ROUNDS`` rounds, and how that number
#: grows in every round after them.
SMALL, ROUNDS, GROWTH = 16, 1, 1024


def side(sets: DataFrame, node: str, items: str) -> DataFrame:
    return sets.select(F.col("node").alias(node), F.col("items").alias(items))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``percent`` or more, counted exactly."""
    both = pairs.join(side(sets, "a", "x"), "a").join(side(sets, "b", "y"), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def families(work: Workspace, members: DataFrame, turn: int, sets: DataFrame, meets: Callable[[DataFrame], DataFrame], percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links within the families of (key, node, n, component), the (key, node) that have met all their partners, and the
    families (hub, node).

    A node of less than half or more than twice the hub's size is no member of its family.
    """
    joined = members.select("node", "component").distinct()
    members = members.select("key", "node", F.col("n").cast("long").alias("s"))
    # The first hubs are the members of most keys: those are the same in many keys, so that a node meets few hubs however
    # many keys it has. Later ones are drawn, so that what is unlike the busiest members is met as well.
    busy = members.groupBy("node").agg((-F.count(F.lit(1))).alias("busy"))
    order = F.struct(F.when(F.lit(turn == 1), F.col("busy")).alias("p"), F.xxhash64("node", F.lit(turn)).alias("o"), "node", "s")
    named = members.join(busy, "node").groupBy("key").agg(F.min(order).alias("h"))
    named = work.cut(named.select("key", F.array(F.struct(F.col("h.node").alias("node"), F.col("h.s").alias("s"))).alias("h")), "hubs")
    near = F.filter("h", lambda h: F.least("s", h["s"]) * 2 >= F.greatest("s", h["s"]))
    # A row per key and node, whatever the number of hubs; hubs that several keys of a node name are one pair.
    placed = work.cut(members.join(named, "key").select("key", "node", F.transform(near, lambda h: h["node"]).alias("hubs")), "placed")
    pairs = placed.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("hubs"))).alias("hubs"))
    pairs = work.cut(pairs.select(F.explode("hubs").alias("hub"), "node").where("node <> hub"), "family-pairs")
    both = pairs.join(side(sets, "hub", "x"), "hub").join(side(sets, "node", "y"), "node")
    apart = F.concat(F.array_except("y", "x"), F.array_except("x", "y"))
    sized = both.select("hub", "node", F.size("x").cast("long").alias("hub_n"), F.size("y").cast("long").alias("n"), apart.alias("d"))
    sized = sized.withColumn("common", (F.col("n") + F.col("hub_n") - F.size("d")) / 2)
    union = F.col("n") + F.col("hub_n") - F.col("common")
    # Within twice the distance that a link may have; close ones are within that distance itself.
    ring = sized.where(F.col("common") * 100 >= (2 * percent - 100) * union).withColumn("close", F.col("common") * 100 >= percent * union)
    ring = work.cut_small(ring.select("hub", "hub_n", "node", "n", "d", "close"), "ring")
    own = ring.select("hub", F.col("hub_n").alias("n")).distinct().select("hub", F.col("hub").alias("node"), "n", F.array().cast("array<long>").alias("d"), F.lit(True).alias("close"))
    ring = ring.drop("hub_n").unionByName(own)
    # Any reference gives the same links; what the close members say settles it, as they have few differences.
    near = ring.where("close")
    many = near.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    often = near.select("hub", F.explode("d").alias("item")).groupBy("hub", "item").agg(F.count(F.lit(1)).alias("c")).join(many, "hub").where(F.col("c") * 2 > F.col("m"))
    # Items on which most of the close members differ from the hub: at most twice as many as a node has differences.
    flipped = often.groupBy("hub").agg(F.collect_list("item").alias("f"))
    known = ring.join(flipped, "hub", "left").withColumn("f", F.coalesce("f", F.array().cast("array<long>")))
    known = known.select("hub", "node", "n", "close", F.concat(F.array_except("d", "f"), F.array_except("f", "d")).alias("e"))
    known = work.cut(known.withColumn("slack", F.col("n") * (100 - percent) - F.size("e") * (100 + percent)), "family")
    best = work.cut(known.groupBy("hub").agg(F.max(F.struct("slack", "node")).alias("best")), "best")
    # A row per hub goes around, so that a large family is not dealt to one task.
    known = known.join(small_side(best), "hub").withColumn("certain", F.col("slack") + F.col("best.slack") >= 0)
    certain = known.where("certain and node <> best.node").select(F.least("node", "best.node").alias("a"), F.greatest("node", "best.node").alias("b"))

    items = known.select("hub", "node", "certain", "slack", F.size("e").alias("k"), (F.col("slack") + F.col("best.slack")).alias("over"), F.explode("e").alias("item"))
    count = items.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("c"), F.bool_and("certain").alias("sure"))
    # Differences that two nodes must share at least, given the sum of their slacks.
    need = lambda over: F.greatest(F.lit(1), F.ceil(-over / (2.0 * (100 + percent))))
    rare = Window.partitionBy("hub", "node").orderBy("c", "item")
    # Items that one node holds come first and cannot be shared, so only their number is needed; those whose holders all
    # are linked already add nothing.
    leading = items.join(count.where("c > 1"), ["hub", "item"]).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("hub", "node")))
    leading = leading.withColumn("place", F.col("k") - F.col("held") + F.row_number().over(rare)).where(F.col("place") <= F.col("k") - need(F.col("over")) + 1)
    leading = leading.where("not sure").join(joined, "node").select("hub", "item", "node", "certain", "component", "slack", (F.col("k") - F.col("place") + 1).alias("left"))
    leading = work.cut(leading, "leading")
    x, y = (leading.select("hub", "item", F.col("node").alias(c), *[F.col(v).alias(f"{c}_{v}") for v in ("certain", "component", "slack", "left")]) for c in ("a", "b"))
    apart = (F.col("a") < F.col("b")) & ~(F.col("a_certain") & F.col("b_certain")) & (F.col("a_component") != F.col("b_component"))
    # At the first item that two nodes share, all that they share lies from here on.
    enough = F.least("a_left", "b_left") >= need(F.col("a_slack") + F.col("b_slack"))
    near = meets(x.join(y, ["hub", "item"]).where(apart & enough).select("hub", "a", "b").distinct())
    own_side = lambda c: known.select("hub", F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("e").alias(f"{c}_e"))
    met = near.join(own_side("a"), ["hub", "a"]).join(own_side("b"), ["hub", "b"])
    differ = F.size("a_e") + F.size("b_e") - 2 * F.size(F.array_intersect("a_e", "b_e"))
    shared = met.where(differ * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)).select("a", "b")
    close = known.where("close").groupBy("node").agg(F.collect_set("hub").alias("close_hubs"))
    done = placed.join(close, "node").where(F.arrays_overlap("hubs", "close_hubs")).select("key", "node")
    done = done.unionByName(named.select("key", F.explode("h.node").alias("node"))).distinct()
    return certain.unionByName(shared).distinct(), done, known.select("hub", "node")


def sharing_rare(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs x, y of (node, n, ...) that share one of the rarest items of either, each with a prefix for its columns.

    Two linked sets of n and m items share one of the n - ceil(t n) + 1 items of either that the fewest of ``nodes`` hold,
    and at the first such item all that they share lies from there on. A pair comes once per item, though no pair that can
    be linked is left out.
    """
    items = nodes.select("node", "n").join(side(sets, "node", "items"), "node").select("node", "n", F.explode("items").alias("item"))
    count = items.groupBy("item").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # Items that one node holds come first and cannot be shared, so only their number is needed.
    leading = items.join(count, "item").withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("node")))
    leading = leading.withColumn("place", F.col("n") - F.col("held") + F.row_number().over(Window.partitionBy("node").orderBy("c", "item")))
    leading = leading.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    leading = leading.select("node", "item", (F.col("n") - F.col("place") + 1).alias("left")).join(nodes, "node")
    x, y = (leading.select("item", *[F.col(c).alias(f"{p}{c}") for c in leading.columns if c != "item"]) for p in ("x_", "y_"))
    enough = F.least("x_left", "y_left") * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent
    return x.join(y, "item").where(enough & (F.col("x_node") < F.col("y_node")))


def link(work: Workspace, members: DataFrame, sets: DataFrame, percent: int, fits: Callable[[str, str], Column], meets: Callable[[DataFrame], DataFrame], keys: DataFrame) -> DataFrame:
    """(node, component) for the nodes that have a link; other nodes are components of their own.

    ``members`` has key, node, the set's size n and what else ``fits`` reads, holds a (key, node) once, and is restricted
    to keys with two nodes or more; ``sets`` holds (node, items) once per node. ``fits(x, y)`` is a necessary condition
    on two members of a key, given their column prefixes. ``meets`` keeps those of the pairs (a, b) that pass further
    necessary conditions and leaves all their columns. ``keys`` holds (node, keys) with all keys of a node in one order.
    """
    carried = [c for c in members.columns if c not in ("key", "node")]

    def sides(here: DataFrame, prefix: str, *extra: str) -> DataFrame:
        return here.select("key", *[F.col(c).alias(f"{prefix}{c}") for c in ("node", *extra, *carried)])

    def checked(near: DataFrame, name: str) -> DataFrame:
        return linked(work.cut_small(meets(near), name), sets, percent)

    def components(links: DataFrame) -> DataFrame:
        part = work.part("stars")
        labels = work.cut(settle(links, lambda e: part.cut(e, "edges")), "labels")
        part.close()
        return labels

    hub = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("o"), "node", *carried)).alias("h"))
    first = hub.select("key", *[F.col(f"h.{c}").alias(f"y_{c}") for c in ("node", *carried)])
    stars = sides(members, "x_").join(first, "key").where(F.col("x_node") != F.col("y_node")).where(fits("x_", "y_"))
    stars = stars.groupBy(F.col("x_node").alias("a"), F.col("y_node").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    stars = stars.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    labels = components(work.cut_small(checked(stars, "stars"), "links"))
    settled = None
    for turn in itertools.count(1):
        small = SMALL * GROWTH ** max(0, turn - ROUNDS)
        here = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        spread = here.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi")
        here = work.cut(here.join(spread.select("key", "m"), "key"), "open")
        sizes = here.agg(F.max("m"), F.min("m")).first()
        if sizes[0] is None:
            return labels
        found, part = [], work.part("turn")
        if sizes[1] <= small:
            few = here.where(F.col("m") <= small)
            apart = F.expr("x_node < y_node and x_component <> y_component")
            if settled is None:
                across = sides(few, "x_", "component").join(sides(few, "y_", "component"), "key").where(apart).where(fits("x_", "y_"))
            else:
                met = F.coalesce(F.arrays_overlap("x_families", "y_families"), F.lit(False))
                in_families = settled.groupBy("node").agg(F.collect_set("hub").alias("families"))
                nodes = part.cut(few.groupBy("node").agg(F.first("component").alias("component"), F.first("n").cast("long").alias("n"), F.collect_set("key").alias("left_keys")), "open-nodes")
                if few.agg(F.sum(F.col("m") - 1)).first()[0] > 2 * nodes.agg(F.sum("n")).first()[0]:
                    # Keys that so many share make more pairs than their nodes have items.
                    across = sharing_rare(nodes.join(in_families, "node", "left"), sets, percent).where(apart & ~met & F.arrays_overlap("x_left_keys", "y_left_keys"))
                else:
                    # A pair belongs to the first key that it shares: there it was or will be settled if not here.
                    few = few.join(in_families, "node", "left").join(keys, "node")
                    first = F.col("key") == F.element_at(F.array_intersect("x_keys", "y_keys"), 1)
                    more = ("component", "families", "keys")
                    across = sides(few, "x_", *more).join(sides(few, "y_", *more).withColumnRenamed("key", "y_key"), F.col("key") == F.col("y_key")).where(apart & ~met & first).where(fits("x_", "y_"))
            found.append(checked(across.select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct(), "pairs"))
        if sizes[0] > small:
            large = here.where(F.col("m") > small)
            kin, done, placed = families(part, large, turn, sets, meets, percent)
            placed = work.cut_small(placed, "families")
            settled = placed if settled is None else settled.unionByName(placed)
            found.append(kin)
            members = work.cut(large.select("key", "node", *carried).join(done, ["key", "node"], "left_anti"), "members")
        links = work.cut_small(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "links")
        part.close()
        if not links.isEmpty():
            # Components so far stand for the links that made them.
            labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
        if sizes[0] <= small:
            return labels
