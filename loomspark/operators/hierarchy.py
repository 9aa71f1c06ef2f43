"""Parent-child rows of unknown depth to full hierarchies, by tree contraction.

Each round rakes the leaves (nodes that no remaining node points to) and compresses unary chains: a node with one child is spliced out if
its keyed hash beats those of its child and its parent, so that no two neighbours go at once and about a third of every chain goes a round.
Every removed node is recorded with the pointer, distance and path segment it had at that moment.  A raked node hands the size of its subtree on,
with what was spliced out below its pointer; a spliced one remembers its child.  A forest always has a leaf, so a round that finds none while nodes
remain has isolated the cycles; the nodes of a cycle take its smallest id as root, and everything recorded below inherits that with depth -1.

The records are reversed by doubling: a record points to one of a later round, so chains of records are as long as there were rounds, and after the
logarithm of that number of joins every record points to a root or a cycle.  Finished records take no further part.

Rounds grow with the logarithm of the longest chain plus that of the number of nodes, not with the depth; what is left shrinks from round to round.
All joins are on node ids; a parent with a third of all nodes as children is one row of a pre-aggregated count, and the
rows that look it up are spread by AQE's skew handling.  Round tables go to the shared scratch folder, so
lineage stays flat and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import Scratch

# Spellings that name no parent.
NO_PARENT = ("", "none", "null")


def clean_id(c: Column) -> Column:
    """Ids compare in lower case without outer blanks."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def session_links(events: DataFrame) -> DataFrame:
    """One row per session: node, parent (null for none).

    Sessions are all session ids and all named parents.  Null session ids with a parent still make that parent a
    session.  Should the rows of one session name different parents, the smallest holds; repeated rows count once.
    """
    pairs = events.select(clean_id(F.col("session_id")).alias("node"), clean_id(F.col("parent_session_id")).alias("parent"))
    pairs = pairs.withColumn("parent", F.when(~F.col("parent").isin(*NO_PARENT), F.col("parent")))
    named = pairs.select(F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"))
    return pairs.unionByName(named).filter("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"))


def resolve(links: DataFrame, with_paths: bool = False) -> DataFrame:
    """Root and depth of every node of ``links`` (node unique; parent null, or a node).

    Returns node, root, depth (bigint; -1 in or below a cycle) and, with ``with_paths``, path: the ids from the
    root down to the node (for nodes below a cycle from the cycle's first node met on the way up, for nodes of a cycle themselves alone), in_cycle and n_descendants (how many other
    nodes have the node on their way up; for a node of a cycle the rest of its cycle and all that hangs below it).  Parents that are
    no node themselves end the way up and count as roots without a row.  An empty table gives no rows.
    """
    scratch = Scratch(links.sparkSession, "hierarchy")
    segment = F.array(F.col("node")) if with_paths else F.lit(None).cast("array<string>")
    nodes = scratch.keep(links.select("node", "parent"), "nodes")
    removed, core = _contract(nodes, segment, scratch)
    ends = _reverse(removed, scratch) if removed is not None else None

    roots = nodes.filter("parent IS NULL").select("node")
    out = roots.select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), segment.alias("path"))
    path = lambda df: F.concat(F.array("ptr"), "seg") if with_paths else df["seg"]
    if core is None:
        if ends is not None:
            out = out.unionByName(ends.select("node", F.col("ptr").alias("root"), F.col("dist").alias("depth"), path(ends).alias("path")))
    else:
        labels = _cycle_labels(core, scratch)
        out = out.unionByName(labels.select("node", F.col("label").alias("root"), F.lit(-1).cast("bigint").alias("depth"), segment.alias("path")))
        if ends is not None:
            known = ends.join(labels.select(F.col("node").alias("ptr"), "label"), "ptr", "left")
            depth = F.when(F.col("label").isNull(), F.col("dist")).otherwise(-1).cast("bigint")
            out = out.unionByName(known.select("node", F.coalesce("label", "ptr").alias("root"), depth.alias("depth"), path(known).alias("path")))
    if not with_paths:
        return out.drop("path")
    # the segments of the core, which may overlap, hold the nodes compressed out of the cycles too
    cyclic = core.select(F.explode("seg").alias("node")).distinct().withColumn("in_cycle", F.lit(True)) if core is not None else roots.limit(0).withColumn("in_cycle", F.lit(True))
    out = out.join(cyclic, "node", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    if core is not None:  # a path from a node of the core may lead through more of the cycle before it leaves it
        out = scratch.keep(out, "marked")
        steps = out.filter("depth < 0 AND NOT in_cycle").select("node", F.explode("path").alias("_step"))
        inside = steps.join(cyclic.select(F.col("node").alias("_step")), "_step").groupBy("node").agg(F.count(F.lit(1)).alias("_inside"))
        own = F.when(F.col("in_cycle"), F.array("node")).when(F.col("_inside") > 1, F.slice("path", F.col("_inside").cast("int"), F.size("path"))).otherwise(F.col("path"))
        out = out.join(inside, "node", "left").withColumn("path", own).drop("_inside")
    sizes = _sizes(removed, roots, scratch)
    around = out.filter("depth < 0").groupBy("root").agg(F.count(F.lit(1)).alias("n_around"))
    n = F.when(F.col("in_cycle"), F.col("n_around") - 1).otherwise(F.coalesce("size", F.lit(1)) - 1)
    return out.join(sizes, "node", "left").join(around, "root", "left").withColumn("n_descendants", n.cast("bigint")).drop("size", "n_around")


def _contract(nodes: DataFrame, segment: Column, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """The records of all removed nodes (node, ptr, dist, seg; size and give of raked ones, via and more of spliced ones), and what is left: cycles, or none.

    ``size`` counts a node's subtree with itself; a spliced node's is ``more`` plus that of its child ``via``.
    """
    none, zero = F.lit(None), F.lit(0).cast("bigint")
    # a pointer to a parent without a row ends at that parent
    active = nodes.filter("parent IS NOT NULL").select("node", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("dist"), F.col("node").alias("low"), segment.alias("seg"), F.lit(1).cast("bigint").alias("w"), zero.alias("acc"))
    gave, removed, core, round_no = None, [], None, 0
    while True:
        # a node's own row and the rows of those that point to it meet in one aggregation; own is null for roots
        own = F.struct("ptr", "dist", "low", "seg", "w", "acc")
        below = active.select("node", own.alias("own"), F.lit(0).alias("n"), none.cast("string").alias("kid"), none.cast("bigint").alias("kid_acc"), zero.alias("gain"))
        below = below.unionByName(active.select(F.col("ptr").alias("node"), none.cast(below.schema["own"].dataType).alias("own"), F.lit(1).alias("n"), F.col("node").alias("kid"), F.col("acc").alias("kid_acc"), zero.alias("gain")))
        if gave is not None:
            below = below.unionByName(gave.select(F.col("ptr").alias("node"), none.cast(below.schema["own"].dataType).alias("own"), F.lit(0).alias("n"), none.cast("string").alias("kid"), none.cast("bigint").alias("kid_acc"), F.col("give").alias("gain")))
        below = below.groupBy("node").agg(F.first("own", ignorenulls=True).alias("own"), F.sum("n").alias("n"), F.min("kid").alias("kid"), F.min("kid_acc").alias("kid_acc"), F.sum("gain").alias("gain"))
        draw = lambda c, r=round_no: F.xxhash64(F.col(c), F.lit(r))
        goes = (F.col("n") == 1) & (draw("node") > draw("kid")) & (draw("node") > draw("ptr"))
        counted = below.filter("own IS NOT NULL").select("node", "own.ptr", "own.dist", "own.low", "own.seg", (F.col("own.w") + F.col("gain")).alias("w"), "own.acc", "n", "kid", "kid_acc").withColumn("goes", F.coalesce(goes, F.lit(False)))
        state, seen = scratch.keep_counted(counted, f"state{round_no}", left=F.count(F.lit(1)), leaves=F.count_if(F.col("n") == 0))
        if not seen["left"]:
            break
        if not seen["leaves"]:
            core = state
            break
        up = state.filter("goes").select(F.col("node").alias("ptr"), *[F.col(c).alias(f"up_{c}") for c in ("ptr", "dist", "low", "seg", "w", "acc")])
        moved = state.filter("NOT goes").join(up, "ptr", "left")
        seg = F.when(F.col("up_ptr").isNotNull(), F.concat("up_seg", "seg")).otherwise(F.col("seg"))
        plus = lambda c, *more: (F.col(c) + sum((F.coalesce(m, F.lit(0)) for m in more), F.lit(0))).alias(c)
        moved = moved.select("node", F.coalesce("up_ptr", "ptr").alias("ptr"), plus("dist", "up_dist"), F.least("low", "up_low").alias("low"), seg.alias("seg"), "w", plus("acc", "up_w", "up_acc"), "n")
        raked = moved.filter("n = 0").select("node", "ptr", "dist", "seg", F.col("w").alias("size"), (F.col("w") + F.col("acc")).alias("give"), none.cast("string").alias("via"), none.cast("bigint").alias("more"))
        spliced = state.filter("goes").select("node", "ptr", "dist", "seg", none.cast("bigint").alias("size"), none.cast("bigint").alias("give"), F.col("kid").alias("via"), (F.col("w") + F.col("kid_acc")).alias("more"))
        removed += [raked, spliced]
        gave = raked.select("ptr", "give")
        active = moved.filter("n > 0").drop("n")
        round_no += 1
    return (scratch.keep(reduce(lambda a, b: a.unionByName(b), removed), "removed") if removed else None), core


def _reverse(removed: DataFrame, scratch: Scratch) -> DataFrame:
    """node, ptr, dist, seg of every record, followed up to what was never removed."""
    ahead = lambda df, done: df.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"), F.col("seg").alias("seg2"), done.alias("done2"))
    seg = F.when(F.col("ptr2").isNotNull(), F.concat("seg2", "seg")).otherwise(F.col("seg"))
    step = lambda df: df.select("node", F.coalesce("ptr2", "ptr").alias("ptr"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), seg.alias("seg"), F.coalesce("done2", F.lit(True)).alias("done"))
    records = removed.select("node", "ptr", "dist", "seg")
    every, seen = scratch.keep_counted(step(records.join(ahead(records, F.lit(False)), "ptr", "left")), "ends0", open=F.count_if(~F.col("done")))
    finished, k = [every.filter("done")], 0
    while seen["open"]:
        k += 1
        moved = step(every.filter("NOT done").join(ahead(reduce(lambda a, b: a.unionByName(b), [*finished, every.filter("NOT done")]), F.col("done")), "ptr", "left"))
        every, seen = scratch.keep_counted(moved, f"ends{k}", open=F.count_if(~F.col("done")))
        finished.append(every.filter("done"))
    return reduce(lambda a, b: a.unionByName(b), finished).drop("done")


def _sizes(removed: DataFrame | None, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """node, size of the subtree of every removed node and every root that has one."""
    if removed is None:
        return roots.limit(0).withColumn("size", F.lit(0).cast("bigint"))
    given = removed.filter("give IS NOT NULL").groupBy(F.col("ptr").alias("node")).agg(F.sum("give").alias("below"))
    out = [removed.filter("size IS NOT NULL").select("node", "size"), roots.join(given, "node").select("node", (F.col("below") + 1).alias("size"))]
    waits, k = removed.filter("via IS NOT NULL").select("node", "via", "more"), 0
    known = removed.select("node", "via", "more", "size")
    while True:
        ahead = known.select(F.col("node").alias("via"), F.col("via").alias("via2"), F.col("more").alias("more2"), F.col("size").alias("size2"))
        moved = waits.join(ahead, "via", "left").select("node", F.col("via2").alias("via"), (F.col("more") + F.coalesce("more2", F.lit(0))).alias("more"), (F.col("more") + F.col("size2")).alias("size"))
        moved, seen = scratch.keep_counted(moved, f"sizes{k}", open=F.count_if(F.col("via").isNotNull()))
        out.append(moved.filter("size IS NOT NULL").select("node", "size"))
        if not seen["open"]:
            return reduce(lambda a, b: a.unionByName(b), out)
        waits, k = moved.filter("via IS NOT NULL").drop("size"), k + 1
        # those still waiting know twice as far; the others are known
        known = removed.filter("size IS NOT NULL").select("node", "via", "more", "size").unionByName(waits.withColumn("size", F.lit(None).cast("bigint"))).unionByName(reduce(lambda a, b: a.unionByName(b), out[2:]).select("node", F.lit(None).cast("string").alias("via"), F.lit(None).cast("bigint").alias("more"), "size"))


def _cycle_labels(core: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest id of each cycle, by doubling pointers until no minimum changes.

    ``low`` is the smallest id a pointer has passed, so that the nodes compressed out of a cycle count too.
    """
    state, step = core.select("node", "ptr", F.col("low").alias("label")), 0
    while True:
        ahead = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("label").alias("label2"))
        moved = state.join(ahead, "ptr").select("node", F.col("ptr2").alias("ptr"), F.least("label", "label2").alias("label"), (F.col("label2") < F.col("label")).alias("changed"))
        step += 1
        moved, seen = scratch.keep_counted(moved, f"cycle{step}", changed=F.count_if("changed"))
        if not seen["changed"]:
            return moved
        state = moved.drop("changed")


def descendants(paths: DataFrame) -> DataFrame:
    """All ancestor-descendant pairs from ``resolve(..., with_paths=True)``: ancestor, descendant, distance.

    Its rows are the sum of all depths, which is what the result asks for (``n_descendants`` is counted without it).  For a descendant in or below a
    cycle the ancestors are all nodes of the cycle but itself and those between, and the distance is -1, as the way up never ends.
    """
    up = paths.select(F.col("node").alias("descendant"), "depth", "root", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("at", "ancestor"))
    distance = F.when(F.col("depth") < 0, -1).otherwise(F.col("depth") - F.col("at")).cast("bigint")
    around = paths.filter("in_cycle").select("root", F.col("node").alias("ancestor"))
    cyclic = paths.filter("depth < 0").select(F.col("node").alias("descendant"), "root").join(around, "root").filter("ancestor <> descendant")
    return up.select("ancestor", "descendant", distance.alias("distance")).unionByName(cyclic.select("ancestor", "descendant", F.lit(-1).cast("bigint").alias("distance"))).distinct()
