"""Parent-child links to full hierarchies: paths, depths, roots, descendants and cycles of any depth.

Links need not form a tree: a child may have several parents and rows may contain themselves.

1. *Cycle separation.*  Strongly connected groups are found by one task if there are at most ``TASK_LINKS`` links.  With
   more, children with one parent form chains that pointer doubling folds onto the ends of the chains, and only the graph of
   the ends is left to search: by one task again, or in rounds of trimming and colouring if it is still larger.
2. *Fragments.*  A node without parents, with several parents or on a cycle heads a fragment, a tree in which every other
   node has exactly one parent.  Doubling yields the subtree sizes.
3. *Heavy paths.*  The child with the largest subtree continues its parent's chain, so that any path from a head crosses
   at most log2(n) chains.  Doubling over the labelled links gives each node the chain segments from its head down to itself;
   their concatenation is its path, the sum of their lengths its depth, their first chain its head.  Nodes are numbered so
   that a chain and all that hangs below it are consecutive: the descendants of a node are one interval.
4. *Heads.*  Distances from the tops spread over the graph of fragment heads alone; a node's distance is that of its head
   plus its depth within the fragment.

Steps 2 and 3 take a number of rounds that grows with the logarithm of the depth.  So do 1 and 4 while the graph of heads has
at most ``TASK_LINKS`` links, whatever its depth.  Beyond that, trimming, colouring and spreading take one round for each
head on the longest way, as no method is known that needs fewer without keeping all pairs of heads.  The results are the
same either way.

Every round writes its table with :class:`~terrafold.scratch.Scratch`; nothing but counts reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.operators.onetask import TASK_LINKS, groups_in_task, spread_in_tasks
from terrafold.operators.closure import transitive
from terrafold.scratch import Scratch

#: Children of one parent that one task numbers; more are numbered in buckets.
SIBLINGS = 100_000
SEGMENTS = "array<struct<chain:bigint,upto:bigint>>"


def _none() -> Column:
    return F.lit(None).cast("long")


def subtree_sizes(scratch: Scratch, links: DataFrame) -> DataFrame:
    """``id, size`` of a forest ``id, parent`` in which each parent has a row, by doubling."""
    state, m = scratch.save(links.select("id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size")), open=F.sum(F.col("anc").isNotNull().cast("long")))
    while m["open"]:
        moving, done = state.where("anc is not null"), state.where("anc is null").select("id", _none().alias("up"), "size")
        target = state.select(F.col("id").alias("anc"), F.col("anc").alias("up"))
        gifts = moving.groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("size")).select("id", _none().alias("up"), "size")
        rows = moving.join(target, "anc").select("id", "up", "size").unionByName(done).unionByName(gifts)
        new, m = scratch.save(rows.groupBy("id").agg(F.max("up").alias("anc"), F.sum("size").alias("size")), open=F.sum(F.col("anc").isNotNull().cast("long")))
        scratch.discard(state)
        state = new
    return state.select("id", "size")


def sibling_offsets(tree: DataFrame, siblings: int = SIBLINGS) -> DataFrame:
    """``tree`` (``id, parent, size``) with ``heavy`` and ``off``: whether a node continues its parent's chain, and how far
    its number is above its parent's, the heavy child coming first.  Roots have off 0.

    The other children follow in buckets, of which a parent has one for every ``siblings`` children, so that no task sorts
    all children of a parent that has a third of them.
    """
    best = F.max(F.struct("size", (-F.col("id")).alias("neg")))
    kids = tree.where("parent is not null").groupBy("parent").agg(best.alias("b"), F.count(F.lit(1)).alias("k"))
    kids = kids.select("parent", (-F.col("b.neg")).alias("first_child"), F.col("b.size").alias("first_size"), F.ceil(F.col("k") / siblings).alias("buckets"))
    rows = tree.join(kids, "parent", "left").withColumn("heavy", F.coalesce(F.col("id") == F.col("first_child"), F.lit(False)))
    rows = rows.withColumn("bucket", F.when(~F.col("heavy"), F.pmod(F.xxhash64("id"), F.col("buckets"))))
    light = rows.where("parent is not null and not heavy")
    sums = light.groupBy("parent", "bucket").agg(F.sum("size").alias("s"))
    before = sums.select("parent", "bucket", (F.sum("s").over(W.partitionBy("parent").orderBy("bucket")) - F.col("s")).alias("skip"))
    order = W.partitionBy("parent", "bucket").orderBy("id")
    placed = light.withColumn("own", F.sum("size").over(order) - F.col("size")).join(before, ["parent", "bucket"])
    cols = [c for c in tree.columns if c != "heavy"]
    placed = placed.select(*cols, "heavy", (F.col("first_size") + F.col("skip") + F.col("own") + 1).alias("off"))
    return placed.unionByName(rows.where("parent is null or heavy").select(*cols, "heavy", F.when(F.col("heavy"), 1).otherwise(0).cast("long").alias("off")))


def chain_segments(scratch: Scratch, tree: DataFrame) -> DataFrame:
    """``id, pre, segs`` of a forest ``id, parent, heavy, off``, by doubling: the number within the fragment, and the chain
    segments from the head down to the node as (first node, steps along the chain).

    On the way up a node's segments are kept from below; the last one is open while its chain's first node isn't known.
    """
    own = F.when(F.col("heavy"), F.struct(_none().alias("chain"), F.lit(1).cast("long").alias("upto"))).otherwise(F.struct(F.col("id").alias("chain"), F.lit(0).cast("long").alias("upto")))
    still = F.sum(F.col("anc").isNotNull().cast("long"))
    state, m = scratch.save(tree.select("id", F.col("parent").alias("anc"), F.col("off").alias("pre"), F.array(own).cast(SEGMENTS).alias("segs")), open=still)
    while m["open"]:
        target = state.select(F.col("id").alias("anc"), F.col("anc").alias("up"), F.col("pre").alias("pre2"), F.col("segs").alias("segs2"))
        last, first = F.element_at("segs", -1), F.element_at("segs2", 1)
        seam = F.array(F.struct(first["chain"].alias("chain"), (last["upto"] + first["upto"]).alias("upto")))
        met = F.concat(F.slice("segs", F.lit(1), F.size("segs") - 1), seam, F.slice("segs2", F.lit(2), F.size("segs2")))
        segs = F.when(last["chain"].isNull(), met).otherwise(F.concat("segs", "segs2"))
        stepped = state.where("anc is not null").join(target, "anc").select("id", F.col("up").alias("anc"), (F.col("pre") + F.col("pre2")).alias("pre"), segs.cast(SEGMENTS).alias("segs"))
        new, m = scratch.save(stepped.unionByName(state.where("anc is null")), open=still)
        scratch.discard(state)
        state = new
    return state.select("id", "pre", F.reverse("segs").alias("segs"))


def ascend(scratch: Scratch, links: DataFrame, sums: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Fold pointers onto their roots by doubling.

    links: ``id, parent, w`` with one row per id; parent is null for a root, and every parent has a row.  Returns
    ``id, root, depth, total`` (total: the sum of w over the subtree, if ``sums``) and, if some pointers run into cycles,
    ``id, anc, lo`` of all nodes that never reach a root, where the anc are exactly the nodes on cycles and lo of such a
    node is the least id of its cycle.
    """
    state = links.select(
        "id",
        F.col("parent").alias("anc"),
        F.when(F.col("parent").isNull(), F.col("id")).alias("root"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.col("w").cast("long").alias("total"),
        F.col("id").alias("lo"),
        F.lit(False).alias("moved"),
    )
    open_rows = F.sum(F.col("anc").isNotNull().cast("long"))
    moved_rows = F.sum(F.col("moved").cast("long"))
    state, n = scratch.save(state, open=open_rows)
    image = -1
    while n["open"]:
        moving, done = state.where("anc is not null"), state.where("anc is null")
        target = state.select(F.col("id").alias("anc"), F.col("anc").alias("up"), F.col("root").alias("aroot"), F.col("depth").alias("adepth"), F.col("lo").alias("alo"))
        stepped = moving.join(target, "anc").select(
            "id",
            F.col("up").alias("anc"),
            F.col("aroot").alias("root"),
            (F.col("depth") + F.col("adepth")).alias("depth"),
            "total",
            F.least("lo", "alo").alias("lo"),
            (F.col("alo") < F.col("lo")).alias("moved"),
        )
        new = stepped.unionByName(done.withColumn("moved", F.lit(False)))
        if sums:
            gifts = moving.groupBy(F.col("anc").alias("id")).agg(F.sum("total").alias("total"))
            gifts = gifts.select("id", _none().alias("anc"), _none().alias("root"), F.lit(0).cast("long").alias("depth"), "total", _none().alias("lo"), F.lit(False).alias("moved"))
            new = new.unionByName(gifts).groupBy("id").agg(*[F.max(c).alias(c) for c in ("anc", "root", "depth")], F.sum("total").alias("total"), F.min("lo").alias("lo"), F.max("moved").alias("moved"))
        new, m = scratch.save(new, open=open_rows, moved=moved_rows)
        scratch.discard(state)
        state = new
        if m["open"] == n["open"] and m["open"]:  # a round that frees nobody has only cycles left
            now = state.where("anc is not null").select("anc").distinct().count()
            if now == image and not m["moved"]:
                rest = state.where("anc is not null").select("id", "anc", "lo")
                return state.where("anc is null").select("id", "root", "depth", "total"), rest
            image = now
        n = m
    return state.select("id", "root", "depth", "total"), None


def _trim(scratch: Scratch, edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Drop edges that lie on no cycle because their source is never entered or their target never left."""
    while n:
        new = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        new = new.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        new, m = scratch.save(new.select("src", "dst"))
        if m["n"] == n:
            return new, n
        edges, n = new, m["n"]
    return edges, 0


def strong_groups(scratch: Scratch, edges: DataFrame) -> DataFrame | None:
    """``id, grp`` of the nodes of strongly connected groups of two or more, by forward colouring and backward search.

    edges: distinct ``src, dst`` without loops.  None if there is no such group.
    """
    edges, m = scratch.save(edges.select("src", "dst"))
    n, found = m["n"], None
    while True:
        edges, n = _trim(scratch, edges, n)
        if not n:
            return found
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        color, _ = scratch.save(ids.select("id", F.col("id").alias("c")))
        while True:  # the least id that leads to a node is its colour
            heard = color.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("h"))
            new = color.join(heard, "id", "left").select("id", F.least("c", "h").alias("c"), (F.col("h") < F.col("c")).alias("up"))
            color, m = scratch.save(new, up=F.sum(F.coalesce(F.col("up"), F.lit(False)).cast("long")))
            color = color.select("id", "c")
            if not m["up"]:
                break
        a, b = color.select(F.col("id").alias("src"), F.col("c").alias("cs")), color.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inner, _ = scratch.save(edges.join(a, "src").join(b, "dst").where("cs = cd").select("src", "dst"))
        back, m = scratch.save(color.where("id = c"))
        front = back
        while m["n"]:  # who reaches the node that gave the colour
            reach = inner.join(front.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
            front, m = scratch.save(reach.join(back.select("id"), "id", "left_anti"))
            back = back.unionByName(front)
        groups = back.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("c")
        part = back.join(groups, "c").select("id", F.col("c").alias("grp"))
        part, _ = scratch.save(part if found is None else found.unionByName(part))
        found = part
        gone = back.select("id")
        edges, m = scratch.save(inner.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        n = m["n"]


@dataclass
class Hierarchy:
    """The resolved hierarchy.

    nodes: ``id, grp, cyclic, head, depth, size, parent, chain, pos, pre, segs`` - grp is the least id of the node's group;
    head, depth, size and pre (the number) belong to the node's fragment; chain (its first node) and pos to its heavy path;
    segs lists the chain segments from the head down to the node as ``(chain, upto)``.
    bridges: ``head, via, child, w`` - the links into fragment heads, w steps below the head of via's fragment.
    tops: ``head, top`` - the members of groups that nothing outside contains.
    """

    scratch: Scratch
    nodes: DataFrame
    bridges: DataFrame
    n_bridges: int
    tops: DataFrame
    task_links: int = TASK_LINKS

    def reached(self, trail: bool = False) -> DataFrame:
        """``top, head, d, via``: the least number of steps from a top to each fragment head, and the last link's parent;
        with ``trail`` also ``vias``, the parents of all links into heads on the way, if one task can hold the graph."""
        scratch = self.scratch
        start = self.tops.select("top", "head", F.lit(0).cast("long").alias("d"), _none().alias("via"))
        if self.n_bridges <= self.task_links:
            if trail:
                start = start.withColumn("vias", F.array().cast("array<bigint>"))
            if not self.n_bridges:
                return start
            seeds = self.tops.join(self.bridges.select("head").distinct(), "head", "left_semi").select("top", "head")
            return start.unionByName(spread_in_tasks(scratch, seeds, self.bridges, self.n_bridges, trail))
        best, m = scratch.save(start)
        front = best
        while m["n"]:
            offer = front.select("top", "head", "d").join(self.bridges, "head").groupBy("top", F.col("child").alias("head")).agg(F.min(F.struct((F.col("d") + F.col("w")).alias("d"), "via")).alias("o"))
            new = offer.join(best.select("top", "head", F.col("d").alias("have")), ["top", "head"], "left").where("have is null or o.d < have").select("top", "head", "o.d", "o.via")
            front, m = scratch.save(new)
            if not m["n"]:
                break
            merged = best.unionByName(front).groupBy("top", "head").agg(F.min(F.struct("d", "via")).alias("o")).select("top", "head", "o.d", "o.via")
            old = best
            best, _ = scratch.save(merged)
            scratch.discard(old)
        return best

    def membership(self) -> DataFrame:
        """``id, top, depth, cyclic``: every pair of a node and a top that reaches it, with the fewest steps between."""
        at = self.nodes.select("id", "head", F.col("depth").alias("below"), "cyclic")
        return at.join(self.reached().select("top", "head", "d"), "head").select("id", "top", (F.col("d") + F.col("below")).alias("depth"), "cyclic")

    def paths(self, every: bool = False) -> DataFrame:
        """``id, top, depth, path``: the shortest way from a top to each node, as chain segments (first node, length).

        Of several tops the nearest counts, then the one with the least id; with ``every``, each top that reaches the node
        has a row.  A segment stands for consecutive nodes of a heavy path, so within a fragment the path of a node that is
        a million steps deep still has at most log2(n) of them.
        """
        scratch, short = self.scratch, self.n_bridges <= self.task_links
        best = self.reached(trail=short)
        if not every:
            rest = [c for c in best.columns if c != "head"]
            best = best.groupBy("head").agg(F.min(F.struct("d", "top", *[c for c in rest if c not in ("d", "top")])).alias("b")).select("head", *[f"b.{c}" for c in rest])
        best, _ = scratch.save(best)
        at = self.nodes.select("id", "head", "depth", "segs")
        if short:
            steps = best.select("head", "top", F.posexplode("vias").alias("k", "id")).join(at.select("id", "segs"), "id")
            done = steps.groupBy("head", "top").agg(F.sort_array(F.collect_list(F.struct("k", "segs"))).alias("parts")).select("head", "top", F.flatten("parts.segs").alias("before"))
            done = best.where("via is null").select("head", "top", F.array().cast(SEGMENTS).alias("before")).unionByName(done)
        else:
            done = self._trails(best, at)
        j = at.join(done, "head").join(best.select("head", "d", "top"), ["head", "top"])
        return j.select("id", "top", (F.col("d") + F.col("depth")).alias("depth"), F.concat("before", "segs").alias("path"))

    def _trails(self, best: DataFrame, at: DataFrame) -> DataFrame:
        """``head, top, before``: the segments above each head, one round for every fragment that a way goes through."""
        scratch = self.scratch
        done, m = scratch.save(best.where("via is null").select("head", "top", F.array().cast(SEGMENTS).alias("before")))
        wait, k = scratch.save(best.where("via is not null").select("head", "top", F.col("via").alias("id")).join(at.select("id", F.col("head").alias("over"), "segs"), "id").select("head", "top", "over", "segs"))
        front = done
        while k["n"] and m["n"]:
            front = wait.join(front.select(F.col("head").alias("over"), "top", "before"), ["over", "top"]).select("head", "top", F.concat("before", "segs").alias("before"))
            front, m = scratch.save(front)
            done = done.unionByName(front)
        return done

    def spelled(self, paths: DataFrame) -> DataFrame:
        """:meth:`paths` with ``ids`` beside them: all nodes of the way, from the member of the top down to the node."""
        paths, _ = self.scratch.save(paths)
        steps = paths.select("id", "top", F.posexplode("path").alias("seg", "s")).select("id", "top", "seg", F.col("s.chain").alias("chain"), F.explode(F.sequence(F.lit(0).cast("long"), "s.upto")).alias("pos"))
        named = steps.join(self.nodes.select("chain", "pos", F.col("id").alias("node")), ["chain", "pos"])
        ways = named.groupBy("id", "top").agg(F.sort_array(F.collect_list(F.struct("seg", "pos", "node"))).alias("way"))
        return paths.join(ways.select("id", "top", F.col("way.node").alias("ids")), ["id", "top"])

    def intervals(self) -> DataFrame:
        """``id, head, from_pre, to_pre``: the descendants of each node within its fragment, one interval a node; none of a
        leaf."""
        return self.nodes.where("size > 1").select("id", "head", (F.col("pre") + 1).alias("from_pre"), (F.col("pre") + F.col("size") - 1).alias("to_pre"))

    def below(self) -> DataFrame:
        """``id, head, from_pre, to_pre``: all descendants of each node as intervals of numbers within fragments.

        A node that contains itself is among its own descendants.  A link out of a node's subtree into the head of another
        fragment brings that fragment whole, and whatever its own links reach.
        """
        scratch = self.scratch
        own, loops = self.intervals(), self.nodes.where("cyclic").select("id", "head", F.col("pre").alias("from_pre"), F.col("pre").alias("to_pre"))
        if not self.n_bridges:
            return own.unionByName(loops)
        heads = transitive(self.bridges.select("head", "child"), self.task_links)
        steps = self.nodes.select(F.col("id").alias("via"), F.explode("segs").alias("s"))
        out = self.bridges.select("via", "child").join(steps, "via").select("child", F.col("s.chain").alias("chain"), F.col("s.upto").alias("upto"))
        left = self.nodes.select("id", "chain", "pos").join(out, "chain").where("pos <= upto").select("id", F.col("child").alias("head")).distinct()
        left, _ = scratch.save(left)
        far = left.join(heads.select(F.col("a").alias("head"), F.col("b").alias("next")), "head").select("id", F.col("next").alias("head"))
        whole, _ = scratch.save(left.union(far).distinct())
        sizes = self.nodes.where("id = head").select("head", (F.col("size") - 1).alias("to_pre"))
        filled = whole.join(sizes, "head").select("id", "head", F.lit(0).cast("long").alias("from_pre"), "to_pre")
        partly = own.unionByName(loops).join(whole, ["id", "head"], "left_anti")  # the others have their fragment whole
        return filled.unionByName(partly)

    def descendants(self) -> DataFrame:
        """``id, descendant``: :meth:`below` with the nodes themselves, each pair once."""
        places = self.below().select("id", "head", F.explode(F.sequence("from_pre", "to_pre")).alias("pre"))
        return places.join(self.nodes.select(F.col("id").alias("descendant"), "head", "pre"), ["head", "pre"]).select("id", "descendant")


def _cycles_in_rounds(scratch: Scratch, edges: DataFrame, base: DataFrame, task_links: int) -> DataFrame:
    """``id, grp`` of the nodes of strongly connected groups, by way of the graph of fragment heads."""
    pointer = base.select("id", F.when(F.col("parents") == 1, F.col("parent")).alias("parent"), F.lit(0).alias("w"))
    fold, rest = ascend(scratch, pointer)
    rings = None
    if rest is not None:  # cycles made of single links only
        on = rest.select(F.col("anc").alias("id")).distinct()
        rings, _ = scratch.save(rest.join(on, "id").select("id", F.col("lo").alias("grp")))
        cut = pointer.join(rings.select("id", F.lit(True).alias("ring")), "id", "left").select("id", F.when(F.col("ring").isNull(), F.col("parent")).alias("parent"), "w")
        pointer, _ = scratch.save(cut)
        fold, _ = ascend(scratch, pointer)
    heads = pointer.where("parent is null").select("id")
    if rings is not None:  # a ring is entered from nowhere else, so its own links needn't be looked at again
        heads = heads.join(rings.select("id"), "id", "left_anti")
    into = edges.join(heads.withColumnRenamed("id", "child"), "child").join(fold.select(F.col("id").alias("parent"), F.col("root").alias("src")), "parent")
    into, _ = scratch.save(into.select("src", F.col("child").alias("dst"), F.col("parent").alias("via")))
    between, m = scratch.save(into.where("src <> dst").select("src", "dst").distinct())
    groups = groups_in_task(scratch, between) if m["n"] <= task_links else strong_groups(scratch, between)
    own = into.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("grp")).distinct()
    if groups is not None:
        own = own.join(groups.select("id"), "id", "left_anti").unionByName(groups)
    head_groups, m = scratch.save(own)
    cyclic = None
    if m["n"]:  # the nodes between a head and a link that leads back into its group
        a, b = head_groups.select(F.col("id").alias("src"), "grp"), head_groups.select(F.col("id").alias("dst"), F.col("grp").alias("g2"))
        marks = into.join(a, "src").join(b, "dst").where("grp = g2").select(F.col("via").alias("id")).distinct().withColumn("mark", F.lit(1))
        inside = fold.join(head_groups.select(F.col("id").alias("root"), "grp"), "root").select("id", "grp")
        weighted = pointer.join(inside, "id").join(marks, "id", "left").select("id", "parent", F.coalesce("mark", F.lit(0)).alias("w"))
        sums, _ = ascend(scratch, weighted, sums=True)
        cyclic = sums.where("total > 0").select("id").join(inside, "id")
    if rings is not None:
        cyclic = rings.select("id", "grp") if cyclic is None else cyclic.unionByName(rings.select("id", "grp"))
    if cyclic is None:
        return base.where("false").select("id", F.col("id").alias("grp"))
    least = cyclic.groupBy("grp").agg(F.min("id").alias("low"))
    return cyclic.join(least, "grp").select("id", F.col("low").alias("grp")).distinct()


def resolve(spark: SparkSession, links: DataFrame, task_links: int = TASK_LINKS) -> Hierarchy:
    """Resolve ``parent, child`` links.

    Repeated links count once; links with a null end are dropped; a link from a node to itself makes the node cyclic.  No
    links at all give empty tables.  task_links: how many links of a graph one task may hold.
    """
    scratch = Scratch(spark)
    apart = F.sum((F.col("parent") != F.col("child")).cast("long"))
    links, m = scratch.save(links.select(F.col("parent").cast("long"), F.col("child").cast("long")).where("parent is not null and child is not null").distinct(), apart=apart)
    loops = links.where("parent = child").select(F.col("child").alias("id"), F.lit(True).alias("loop"))
    edges = links.where("parent <> child")
    ids = links.select(F.col("parent").alias("id"), F.lit(0).alias("n"), _none().alias("p"))
    into = links.select(F.col("child").alias("id"), (F.col("parent") != F.col("child")).cast("int").alias("n"), F.when(F.col("parent") != F.col("child"), F.col("parent")).alias("p"))
    base = ids.union(into).groupBy("id").agg(F.sum("n").alias("parents"), F.min("p").alias("parent"))
    if m["apart"] <= task_links:
        cyclic = groups_in_task(scratch, edges.select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    else:
        base, _ = scratch.save(base)
        cyclic, _ = scratch.save(_cycles_in_rounds(scratch, edges, base, task_links))

    # fragments, headed by every cyclic node besides those without a single parent
    base = base.join(cyclic, "id", "left").join(loops, "id", "left")
    base = base.select("id", F.when((F.col("parents") == 1) & F.col("grp").isNull(), F.col("parent")).alias("parent"), F.coalesce("grp", "id").alias("grp"), (F.col("grp").isNotNull() | F.col("loop").isNotNull()).alias("cyclic"))
    base, _ = scratch.save(base)
    tree = sibling_offsets(base.join(subtree_sizes(scratch, base.select("id", "parent")), "id"))
    tree, _ = scratch.save(tree)
    named = tree.drop("off", "heavy").join(chain_segments(scratch, tree.select("id", "parent", "heavy", "off")), "id")
    last = F.element_at("segs", -1)
    depth = F.aggregate("segs", F.lit(-1).cast("long"), lambda n, s: n + s["upto"] + 1)
    nodes, _ = scratch.save(named.select("id", "grp", "cyclic", F.element_at("segs", 1)["chain"].alias("head"), depth.alias("depth"), "size", "parent", last["chain"].alias("chain"), last["upto"].alias("pos"), "pre", "segs"))

    # links into heads, and the tops
    at = nodes.select(F.col("id").alias("via"), F.col("head"), F.col("depth").alias("d"), F.col("grp").alias("from_grp"))
    first = nodes.where("id = head").select(F.col("id").alias("child"), F.col("grp").alias("to_grp"))
    bridges, m = scratch.save(edges.select(F.col("parent").alias("via"), "child").join(first, "child").join(at, "via").select("head", "via", "child", (F.col("d") + 1).alias("w"), "from_grp", "to_grp"))
    entered = bridges.where("from_grp <> to_grp").select(F.col("to_grp").alias("grp")).distinct()
    tops, _ = scratch.save(nodes.where("id = head").join(entered, "grp", "left_anti").select("head", F.col("grp").alias("top")))
    return Hierarchy(scratch, nodes, bridges.select("head", "via", "child", "w"), m["n"], tops, task_links)


def member_links(relations: DataFrame) -> DataFrame:
    """``parent, child`` links between the relations of a table of current relation rows."""
    known = relations.select(F.col("id").alias("child"))
    m = relations.select(F.col("id").alias("parent"), F.explode("members").alias("m")).where("m.type = 'relation'")
    return m.select("parent", F.col("m.ref").alias("child")).distinct().join(known, "child", "left_semi").select("parent", "child")
