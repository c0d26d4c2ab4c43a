"""Reachability and nesting: frontier joins until nothing new is found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgraph.plans.storage import written


#: Hops before chains are looked for: most graphs of packages are done by then.
PLAIN_HOPS = 4


def _hop(frontier: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    step = frontier.join(links, ["crate_id", "id"]).select("crate_id", F.col("dst").alias("id")).distinct()
    return written(step.join(found, ["crate_id", "id"], "left_anti"))


def _chain_heads(links: DataFrame, found: DataFrame) -> DataFrame:
    """crate_id, id, head: of the ids that aren't found and that one link alone leads to, where their chain of such links begins.

    Each round doubles the way that pointers cover, so the number of rounds is the
    logarithm of the longest chain.  A chain that bites its own tail has no head and is left out.
    """
    undone = links.join(found.select("crate_id", F.col("id").alias("dst")), ["crate_id", "dst"], "left_anti")
    lone = undone.groupBy("crate_id", "dst").agg(F.count("*").alias("n"), F.min("id").alias("head")).filter("n = 1 AND head <> dst")
    pointers = written(lone.select("crate_id", F.col("dst").alias("id"), "head", F.lit(True).alias("moved")))
    moving = pointers.count()
    while moving:
        further = pointers.select("crate_id", F.col("id").alias("head"), F.col("head").alias("next"))
        step = pointers.join(further, ["crate_id", "head"], "left").select("crate_id", "id", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("moved"))
        pointers = written(step)
        before, moving = moving, pointers.filter("moved").count()
        if moving == before:  # every round brings some of each chain to its head: only rings are left
            break
    return pointers.filter("NOT moved").select("crate_id", "id", "head")


def reachable(starts: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """crate_id, id of everything that links lead to from ``starts`` (crate_id, id), which are part of it.

    A hop joins the last hop's new ids with the links; ids already found are
    dropped, so cycles end.  Where a few hops don't do, chains of ids that one link
    alone leads to are followed to their ends at once before each further hop, so
    that long chains cost the logarithm of their length.  Tables in between are in
    the shared folder.
    """
    links = written(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("crate_id", F.col("src").alias("id"), "dst").distinct())
    found = frontier = written(starts.select("crate_id", "id").distinct())
    hops = 0
    while (max_hops is None or hops < max_hops) and not frontier.isEmpty():
        if max_hops is None and hops >= PLAIN_HOPS:
            ends = _chain_heads(links, found).join(found.select("crate_id", F.col("id").alias("head")), ["crate_id", "head"], "left_semi")
            chained = written(ends.select("crate_id", "id"))
            found, frontier = written(found.unionByName(chained)), frontier.unionByName(chained)
        frontier = _hop(frontier, links, found)
        found = found.unionByName(frontier)
        hops += 1
    return found


def unreachable(entities: DataFrame, found: DataFrame) -> DataFrame:
    """Entities that aren't among the reachable ones."""
    return entities.join(found.select("crate_id", "id"), ["crate_id", "id"], "left_anti")


def nested_packages(roots: DataFrame, children: DataFrame, max_depth: int | None = None) -> DataFrame:
    """package, depth: packages below ``roots`` (package) by ``children`` (parent, child), each with the multiplicity of its paths.

    A package is not entered again below itself: cycles end, where shared packages
    are found once for each way to them.
    """
    level = written(roots.select("package", F.array("package").alias("way")))
    found = level.select("package", F.lit(0).alias("depth"))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.join(children, F.col("package") == F.col("parent")).filter(~F.array_contains("way", F.col("child")))
        level = written(step.select(F.col("child").alias("package"), F.concat("way", F.array("child")).alias("way")))
        if level.isEmpty():
            break
        found = found.unionByName(level.select("package", F.lit(depth).alias("depth")))
    return found
