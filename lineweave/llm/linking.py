"""Links inside candidate groups, and the classes that links make. Nothing here gathers on the driver or in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.session import stored


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored_alone(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, and the shuffle files of the job go when the table is written, not when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def _is_star_forest(edges: DataFrame) -> bool:
    """Does every ``u`` point to one ``v`` that points nowhere?"""
    n = edges.agg(F.count("*").alias("edges"), F.count_distinct("u").alias("nodes")).first()
    return n["edges"] == n["nodes"] and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``id, class_id`` (the smallest id of the connected component) of each node of ``edges`` (``a, b``).

    Every node points to the smallest node that it knows; rounds of large-star and small-star steps shorten
    the pointers until every node points to the least of its component. A hub's edges are combined before the shuffle.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(),
                 "star")
    while not _is_star_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lower.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = stored(small, "star")
    return (now.select(F.col("u").alias("id"), F.col("v").alias("class_id"))
            .unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("class_id"))).distinct())


def link_to_leaders(members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Verified links (``a, b``) of each group's members to its leader; and ``id, cls`` of members that may have more.

    ``members`` has ``key, id``, groups of two or more. The leader is the member whose groups are largest, most likely the
    text that others were copied from: one row a member, in groups of any size. A member has no more to
    look for where the links have made each of its groups one class.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    weight = members.join(sizes, "key").groupBy("id").agg(F.sum("n").alias("w"))
    leaders = members.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("l"))
    pairs = stored(members.join(leaders, "key").filter("id <> l").select(
        F.least("id", "l").alias("a"), F.greatest("id", "l").alias("b")).distinct(), "leader-pairs")
    links = stored(verify(pairs).select("a", "b"), "leader-links")
    labels = stored(components(links), "leader-classes")
    labelled = members.join(labels, "id", "left").select("key", "id", F.coalesce("class_id", "id").alias("cls"))
    split = labelled.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi")
    return links, stored(labelled.join(split.select("key"), "key", "left_semi").select("id", "cls").distinct(), "open")


def link_by_leaders(members: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified links (``a, b`` and what ``verify`` adds) between leaders and members of each group.

    Each group stands for itself: a member that a leader of its group is linked to is covered and leads no more; a member that is
    not covered leads in its turn, and is compared with all others of the group, whatever the leaders before it met.
    Used where links are not transitive, as texts may share one passage and not another. Groups of the same members are one, as the
    keys of one passage mostly are. In each round the open member whose groups are largest leads (most likely the text that others
    were copied from), and twice as many others as in the round before, picked by hash; once all open members can lead for
    no more rows than the groups have, all do. Groups are counted and picked from by aggregates alone, so that none is sorted in one task.
    """
    grouped = members.select("key", "id").distinct()
    # 128 bits know a group by its members
    groups = (grouped.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                         F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
              .filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.count("*").alias("m")).drop("x", "y"))
    sized = stored_alone(grouped.join(groups, "key"), "members")
    total = sized.count()
    weight = sized.groupBy("id").agg(F.sum(F.col("n") * F.col("m")).alias("w"))
    open_ = stored_alone(sized.join(weight, "id").select("key", "id", "n", "w"), "open")
    links, tested, more = None, None, 0
    while True:
        best = open_.groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("best"), F.count("*").alias("open"))
        leads = (F.col("id") == F.col("best")) | (F.expr("pmod(xxhash64(key, id), open)") < more)
        if more and open_.agg(F.sum("n")).first()[0] <= total:
            leads = F.lit(True)
        lead = stored_alone(open_.join(best, "key").filter(leads).select("key", F.col("id").alias("l")), "leaders")
        met = stored_alone(sized.select("key", "id").join(lead, "key").filter("id <> l").select(
            "key", "id", F.least("id", "l").alias("a"), F.greatest("id", "l").alias("b")), "met")
        pairs = met.select("a", "b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored_alone(pairs, "pairs")
        found = stored_alone(verify(pairs), "links")
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        covered = met.join(links.select("a", "b").distinct(), ["a", "b"]).select("key", "id")
        # leaders are done; so are members that one is linked to
        done = lead.select("key", F.col("l").alias("id")).unionByName(covered).distinct()
        open_ = stored_alone(open_.join(done, ["key", "id"], "left_anti"), "open")
        if open_.isEmpty():
            return links
        more = 2 * more + 1
