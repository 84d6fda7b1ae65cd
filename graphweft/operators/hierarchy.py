"""Parent-child links to full hierarchies: bottom-up peeling, then assignment in reverse peel order.

Every round peels the leaves off the remaining links (the leaf notes its parent and the distance to it). Plain
peeling needs as many rounds as the tallest tree has levels, so each round also takes an independent set of
nodes out of the chains that are left (nodes with one remaining child): such a node notes its parent, and its
child's link is joined over it. That keeps the number of rounds logarithmic for trees of any height. Links that
close on themselves are what is left: one for each cycle. Then the rounds are replayed backwards: what was
taken out last is assigned first, and each node takes root, depth and path from the parent that it noted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphweft.session import discard, removed, written, written_path

#: Link types by hierarchy, and which end is the parent (fixed values of the graph's vocabulary).
OWNERSHIP, INHERITANCE = ("CONTAINS", "DECLARES", "HAS_METHOD"), ("INHERITS",)


def graph_links(edges: DataFrame) -> DataFrame:
    """``hierarchy, child, parent`` of the edges that span a hierarchy.

    The type counts without blanks around it and in any case. Links with a null or empty end are left out; rows
    sent twice and the same link under another id count once.
    """
    kind = F.upper(F.trim("type"))
    return (
        edges.select(
            F.when(kind.isin(*OWNERSHIP), "ownership").when(kind.isin(*INHERITANCE), "inheritance").alias("hierarchy"),
            F.when(kind.isin(*INHERITANCE), F.col("source_node_id")).otherwise(F.col("target_node_id")).alias("child"),
            F.when(kind.isin(*INHERITANCE), F.col("target_node_id")).otherwise(F.col("source_node_id")).alias("parent"),
        )
        .where("hierarchy is not null and child <> '' and parent <> ''")
        .distinct()
    )


#: One round of peeling: every remaining link again with ``what`` became of it (``link``, ``raked`` or ``spliced``).
#: ``turn`` is a column, so that all rounds are one plan and their generated code is compiled once; as texts, rounds
#: cost the driver one call each. No two neighbours are spliced: a node with one child, whose number drawn in this
#: round is above its parent's and its child's.
_PEEL = """
    WITH links AS (SELECT * FROM {left} WHERE what = 'link'),
    kids AS (SELECT h, parent AS child, count(*) AS n, min(child) AS below FROM links GROUP BY h, parent),
    judged AS (
        SELECT l.h, l.child, l.parent, l.dist, l.between_, l.low, l.turn, CASE
            WHEN n IS NULL THEN 'raked'
            WHEN n = 1 AND l.child <> l.parent AND below <> l.child AND xxhash64(l.child, turn) > xxhash64(l.parent, turn) AND xxhash64(l.child, turn) > xxhash64(below, turn) THEN 'spliced'
            ELSE 'link' END AS what
        FROM links l LEFT JOIN kids k ON l.h = k.h AND l.child = k.child),
    over AS (SELECT h, child, parent AS up, dist AS up_dist, between_ AS up_between, low AS up_low FROM judged WHERE what = 'spliced'),
    met AS (SELECT j.*, up, up_dist, up_between, up_low, up IS NOT NULL AND what = 'link' AS moved FROM judged j LEFT JOIN over o ON j.h = o.h AND j.parent = o.child)
    SELECT h, child, IF(moved, up, parent) AS parent, IF(moved, dist + up_dist, dist) AS dist, IF(moved, concat(up_between, array(parent), between_), between_) AS between_,
        IF(moved, least(low, up_low, parent), low) AS low, turn + 1 AS turn, what
    FROM met
"""
#: The nodes that a round took out, assigned from the parents that they noted. A leaf's parent may have been spliced
#: out in the same round: it is assigned before the leaf.
_ASSIGN = """
    WITH over AS (
        SELECT d.h, d.child AS node, k.root, IF(k.depth < 0, -1, k.depth + d.dist) AS depth, concat(k.path, array(d.parent), d.between_) AS path
        FROM {done} d JOIN {known} k ON d.h = k.h AND d.parent = k.node WHERE d.what = 'spliced'),
    above AS (SELECT h, node, root, depth, path FROM {known} UNION ALL SELECT h, node, root, depth, path FROM over)
    SELECT h, node, root, depth, path FROM over
    UNION ALL
    SELECT d.h, d.child, k.root, IF(k.depth < 0, -1, k.depth + d.dist), concat(k.path, array(d.parent), d.between_)
    FROM {done} d JOIN above k ON d.h = k.h AND d.parent = k.node WHERE d.what = 'raked'
"""


def hierarchies(links: DataFrame) -> DataFrame:
    """``hierarchy, node_id, parent_id, root_id, depth, path`` of every node with a parent.

    ``links`` has ``hierarchy, child, parent``. ``path`` holds the ancestors from the root down to the parent.
    A node on a cycle or beneath one has the smallest node id of that cycle as ``root_id``, depth -1 and a null
    path. A node with several parents within one hierarchy hangs under the smallest of them (the result is a
    forest); links with a null end are left out, repeated links count once, no links give no rows.
    """
    spark = links.sparkSession
    start = links.where("child is not null and parent is not null").groupBy(F.col("hierarchy").alias("h"), "child").agg(F.min("parent").alias("parent"))
    nowhere = F.array().cast("array<string>")
    first = written(start.select("h", "child", "parent", F.lit(1).alias("dist"), nowhere.alias("between_"), F.lit(None).cast("string").alias("low"), F.lit(0).alias("turn"), F.lit("link").alias("what")))
    left, rounds = first, []
    while True:
        seen = Observation()
        left = written(spark.sql(_PEEL, left=left).observe(seen, F.expr("count_if(what = 'link' AND child <> parent) AS open")))
        rounds.append(left)
        if not seen.get.get("open"):
            break

    # roots are parents that are no child; a link that closed on itself stands for its cycle
    children = first.select("h", F.col("child").alias("node"))
    roots = first.select("h", F.col("parent").alias("node")).distinct().join(children, ["h", "node"], "left_anti").select("h", "node", F.col("node").alias("root"), F.lit(0).alias("depth"), nowhere.alias("path"))
    cycles = left.where("what = 'link'").select("h", F.col("child").alias("node"), F.least("child", "low").alias("root"), F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path"))
    top, assigned = written_path(roots), [written_path(cycles)]
    # one scan of all that is assigned, whatever the number of rounds: the plans of the rounds differ in paths only
    read = lambda paths: spark.read.schema(roots.schema).parquet(*paths)
    for done in reversed(rounds):
        assigned.append(written_path(spark.sql(_ASSIGN, done=done, known=read([top, *assigned]))))
    parents = written(first.select("h", F.col("child").alias("node"), F.col("parent").alias("parent_id")))
    discard(first, *rounds)
    removed(spark, top)
    return read(assigned).join(parents, ["h", "node"]).select(
        F.col("h").alias("hierarchy"), F.col("node").alias("node_id"), "parent_id", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"), "path"
    )


def descendants(found: DataFrame) -> DataFrame:
    """``hierarchy, ancestor_id, node_id, distance``: a row for each node beneath each of its ancestors.

    Rows instead of lists, so that a root above a third of all nodes fills no single task. Nodes on or beneath
    a cycle have no path and give no rows.
    """
    return found.where("path is not null").select("hierarchy", "node_id", "depth", F.posexplode("path").alias("pos", "ancestor_id")).select("hierarchy", "ancestor_id", "node_id", (F.col("depth") - F.col("pos")).alias("distance"))


def _sized(rows: DataFrame) -> DataFrame:
    """One round of sizes: links take up what the leaves of the round before sent to their child, and are peeled.

    ``n`` nodes are done at and beneath the child, ``tall`` links deep; ``add`` nodes were spliced out of the link
    or hang at those, ``deep`` links beneath the parent. A spliced node notes the link ``below`` it.
    """
    drawn = lambda c: F.xxhash64(F.col(c), F.col("turn"))
    link, leaf = F.col("what") == "link", F.col("what") == "raked"
    kids = rows.groupBy("h", F.col("parent").alias("child")).agg(
        F.count_if(link).alias("kids"),
        F.min(F.when(link, F.struct(F.col("child").alias("node"), "dist", "add", "deep"))).alias("below"),
        F.sum(F.when(leaf, F.col("n") + F.col("add"))).alias("sent"),
        F.max(F.when(leaf, F.greatest(F.col("tall") + F.col("dist"), "deep"))).alias("high"),
    )
    left = rows.where(link).drop("below", "what").join(kids, ["h", "child"], "left")
    left = left.withColumns({"n": F.col("n") + F.coalesce("sent", F.lit(0)), "tall": F.greatest("tall", F.coalesce("high", F.lit(0)))})
    free = (drawn("child") > drawn("parent")) & (drawn("child") > F.xxhash64("below.node", "turn"))
    left = left.withColumn("what", F.when(F.coalesce("kids", F.lit(0)) == 0, "raked").when((F.col("kids") == 1) & free, "spliced").otherwise("link")).drop("kids", "sent", "high")
    out = left.where("what = 'spliced'").select("h", F.col("child").alias("parent"), F.struct("parent", "dist", "add", "deep", "n", "tall").alias("x"))
    moved = F.col("x").isNotNull() & (F.col("what") != "spliced")
    to = lambda c, new: F.when(moved, new).otherwise(F.col(c)).alias(c)
    return left.join(out, ["h", "parent"], "left").select(
        "h", "child", to("parent", F.col("x.parent")), to("dist", F.col("dist") + F.col("x.dist")), "n", "tall",
        to("add", F.col("add") + F.col("x.n") + F.col("x.add")), to("deep", F.greatest(F.col("deep") + F.col("x.dist"), F.col("x.tall") + F.col("x.dist"), F.col("x.deep"))),
        (F.col("turn") + 1).alias("turn"), "what", "below",
    )


def subtree_sizes(found: DataFrame) -> DataFrame:
    """``hierarchy, node_id, n_descendants, height`` of every node that has a descendant (outside cycles).

    Leaves send sizes up with each round of peeling, a number per link, so that the work is linear in the nodes
    even of a chain. Nodes that were spliced out take theirs from the node below them when the rounds are replayed.
    """
    spark = found.sparkSession
    links = found.where("depth >= 0").select(F.col("hierarchy").alias("h"), F.col("node_id").alias("child"), F.col("parent_id").alias("parent"))
    zero = F.lit(0).cast("long")
    start = links.select("h", "child", "parent", F.lit(1).cast("long").alias("dist"), F.lit(1).cast("long").alias("n"), zero.alias("tall"), zero.alias("add"), zero.alias("deep"), F.lit(0).alias("turn"), F.lit("link").alias("what"))
    first = written(start.withColumn("below", F.lit(None).cast("struct<node:string,dist:bigint,add:bigint,deep:bigint>")))
    rounds, left = [], first
    while True:
        seen = Observation()
        left = written(_sized(left).observe(seen, F.count_if(F.col("what") == "link").alias("open")))
        rounds.append(left)
        if not seen.get.get("open"):
            break
    schema = "h string, node string, n long, tall long"
    done = [written_path(r.where("what = 'raked'").select("h", F.col("child").alias("node"), "n", "tall")) for r in rounds]
    known = lambda: spark.read.schema(schema).parquet(*done)
    for r in reversed(rounds):
        spliced = r.where("what = 'spliced'").select("h", "child", "n", "tall", "below.*")
        below = known().select("h", "node", F.col("n").alias("n_below"), F.col("tall").alias("tall_below"))
        done.append(written_path(spliced.join(below, ["h", "node"]).select("h", F.col("child").alias("node"), (F.col("n") + F.col("add") + F.col("n_below")).alias("n"), F.greatest("tall", F.col("tall_below") + F.col("dist"), "deep").alias("tall"))))
    # roots are the parents that are no child; all of their links were peeled at last
    raked = rounds[0]
    for r in rounds[1:]:
        raked = raked.unionByName(r)
    roots = raked.where("what = 'raked'").groupBy("h", F.col("parent").alias("node")).agg((F.sum(F.col("n") + F.col("add")) + 1).alias("n"), F.max(F.greatest(F.col("tall") + F.col("dist"), "deep")).alias("tall"))
    roots = roots.join(first.select("h", F.col("child").alias("node")), ["h", "node"], "left_anti")
    done.append(written_path(roots))
    discard(first, *rounds)
    return known().where("n > 1").select(F.col("h").alias("hierarchy"), F.col("node").alias("node_id"), (F.col("n") - 1).alias("n_descendants"), F.col("tall").alias("height"))
