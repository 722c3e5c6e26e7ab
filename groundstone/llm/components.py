"""Groups of records that are linked directly or indirectly (problem 2).

Randomised contraction: in each round every vertex looks at its neighbours and itself under a fresh
hash order and hooks to the smallest; edges are relabelled, loops dropped and repeats removed.  The
number of edges falls by a constant factor a round whatever the graph's shape, also for long
chains.  When no edge is left the rounds' mappings are composed from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from groundstone.operators.skew import weighed_keys, salted_join
from groundstone.session import cut, scratch

#: Rounds before giving up; 2^-90 of the edges remain by then.
MAX_ROUNDS = 150


def _hooks(edges: DataFrame, round_no: int) -> DataFrame:
    """v, rep and the number of v's edges: rep is the smallest of v and its neighbours by hash."""
    order = lambda c: F.struct(F.xxhash64(F.lit(round_no), F.col(c)).alias("h"), F.col(c).alias("w"))
    both = edges.select(F.col("u").alias("v"), F.col("v").alias("w")).union(edges.select("v", F.col("u").alias("w")))
    best = both.groupBy("v").agg(F.min(order("w")).alias("best"), F.count("*").alias("n"))
    return best.select("v", F.least("best", order("v"))["w"].alias("rep"), "n")


def _relabelled(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    heavy = weighed_keys(hooks, ["v"])
    named = lambda c: hooks.select(F.col("v").alias(c), F.col("rep").alias(f"r{c}"))
    flag = lambda c: heavy.withColumnRenamed("v", c)
    one = salted_join(edges, named("u"), ["u"], F.col("v"), flag("u")).select("ru", "v")
    two = salted_join(one, named("v"), ["v"], F.col("ru"), flag("v")).where("ru != rv")
    return two.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row per vertex that has a neighbour: id and first_id, the smallest id of its component.

    Direction, repeats, loops and null ends of the pairs don't matter; no pairs give no rows.
    """
    edges = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    rounds: list[DataFrame] = []
    with scratch(pairs.sparkSession):  # edges and hooks go when the roots are written
        edges = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges-0")
        while not edges.isEmpty():
            if len(rounds) == MAX_ROUNDS:
                raise RuntimeError("contraction didn't end")
            rounds.append(cut(_hooks(edges, len(rounds)), f"hooks-{len(rounds)}"))
            edges = cut(_relabelled(edges, rounds[-1]), f"edges-{len(rounds)}")
        if not rounds:
            empty = F.lit(None).cast("string")
            return pairs.select(empty.alias("id"), empty.alias("first_id")).limit(0)
        whole = rounds[-1].select("v", "rep")
        for hooks in reversed(rounds[:-1]):
            heavy = weighed_keys(hooks.groupBy("rep").agg(F.count("*").alias("n")), ["rep"])
            up = whole.select(F.col("v").alias("rep"), F.col("rep").alias("root"))
            whole = salted_join(hooks.select("v", "rep"), up, ["rep"], F.col("v"), heavy, "left").select("v", F.coalesce("root", "rep").alias("rep"))
            if hooks is not rounds[0]:  # written each time: the plan doesn't grow with the rounds
                whole = cut(whole, "roots")
        whole = cut(whole, "roots", keep=True)
    tops = whole.groupBy("rep").agg(F.min("v").alias("first_id"), F.count("*").alias("n"))
    heavy = weighed_keys(tops, ["rep"])
    return salted_join(whole, tops.select("rep", "first_id"), ["rep"], F.col("v"), heavy).select(F.col("v").alias("id"), "first_id")


def corroborating(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """Links of type CORROBORATES, however spelt, whose both ends are facts."""
    links = relationships.where(F.regexp_replace(F.upper("relation_type"), "[^A-Z]", "") == "CORROBORATES").select("fact_a_id", "fact_b_id").where("fact_a_id != fact_b_id").distinct()
    known = facts.where("id is not null").select("id").distinct()
    ends = links.select(F.col("fact_a_id").alias("id")).union(links.select(F.col("fact_b_id").alias("id"))).groupBy("id").agg(F.count("*").alias("n"))
    heavy = weighed_keys(ends, ["id"])
    for end, other in (("fact_a_id", "fact_b_id"), ("fact_b_id", "fact_a_id")):
        links = salted_join(links, known.select(F.col("id").alias(end)), [end], F.col(other), heavy.withColumnRenamed("id", end))
    return links.select("fact_a_id", "fact_b_id")


def fact_groups(relationships: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per fact: fact_id and group_id, the smallest id of its group (its own if it is alone)."""
    found = components(corroborating(relationships, facts), "fact_a_id", "fact_b_id")
    all_ids = facts.where("id is not null").select("id").distinct()
    return all_ids.join(found, "id", "left").select(F.col("id").alias("fact_id"), F.coalesce("first_id", "id").alias("group_id"))
