"""Connected components over edge tables, and joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.checkpoints import cut

#: How many tasks a hot key's rows are dealt to.
SALTS = 64


def salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def dealt(rows: DataFrame, key: str, named: DataFrame, by: str) -> DataFrame:
    """``rows`` joined with ``named`` (one row a key), where a key may hold a large share of the rows: they are dealt by the key
    and a salt from column ``by``, and ``named`` is repeated only for the salts that a key has. Rows without a name are
    left out."""
    salted = rows.withColumn("_salt", salt(by))
    present = salted.select(key, "_salt").distinct().join(named, key)
    return salted.join(present, [key, "_salt"]).drop("_salt")


def star_edges(members: DataFrame, group: list[str], member: str) -> DataFrame:
    """(a, b): edges that connect the distinct members of each group, fewer than two for each of them. Members point at the least
    of their share of the group, and the least of each share at the least of all, so that no task sees more than a share of
    a hot group. Groups of one give none."""
    rows = members.select(*group, F.col(member).alias("a"), salt(member).alias("_salt")).distinct()
    shares = rows.groupBy(*group, "_salt").agg(F.min("a").alias("b"))
    inner = rows.join(shares, [*group, "_salt"]).select("a", "b")
    least = shares.groupBy(*group).agg(F.min("b").alias("least"), F.count("*").alias("n")).filter("n > 1")
    outer = shares.join(least, group).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return inner.unionByName(outer).filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each end of an edge (a, b), the least end that is reachable.

    Each round takes the least label among neighbours and then that label's own label, so that rounds grow with the
    logarithm of a chain. Labels only fall, so the rounds come to an end. In either step rows are dealt by a salt: neighbours
    of a hub, and nodes that share a label, as all of a large component do in the end. Edges from a node to itself
    and repeated edges do no harm; without edges there are no rows."""
    either = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = cut(edges.select(either.alias("e")).select("e.a", "e.b"))
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        told = dealt(both, "b", state.select(F.col("node").alias("b"), "label"), "a").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        near = cut(state.join(told, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(dealt(near, "label", jump, "node").select("node", "old", F.least("label", "further").alias("label")))
        state = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            return state
