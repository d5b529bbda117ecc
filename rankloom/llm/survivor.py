"""The best representative of each duplicate group, field by field.

Bayesian fusion with copy detection: sources have an accuracy, estimated from the posterior of what
they claim; sources that share values which the rest holds to be false depend on each other, and a
vote that may be copied counts less. Statistics of sources and of pairs of sources are tables like the
claims themselves: every source has its own, and nothing but row counts comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import NO_VALUE
from ..plans.lineage import cut

#: Rounds of estimation; false values assumed per field; prior probability that two sources depend; share copied by a copier.
ROUNDS, FALSE_VALUES, DEPEND, COPIED = 4, 20.0, 0.1, 0.8
#: Rows of statistics up to which they are broadcast, a few MB; larger tables are joined by sort-merge.
SMALL = 50_000


def has_value(c: str | Column) -> Column:
    """Neither null nor blank nor a placeholder typed for nothing; any other text is a value."""
    t = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[\s ]+|[\s ]+$", ""))
    return F.coalesce(~t.isin(*sorted(NO_VALUE)) & t.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def claims(entities: DataFrame, members: DataFrame, *, entity: str, member_ids: str, member: str, source: str, stamp: str, fields: Sequence[str]) -> DataFrame:
    """``(entity, field, member, source, stamp, value, key, n_members)``: one row of each member's valued field.

    Only members that exist count, each once; ``n_members`` is their number.
    """
    ids = entities.select(F.col(entity).alias("entity"), F.explode(member_ids).alias("member")).where("entity IS NOT NULL AND member IS NOT NULL").distinct()
    cols = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    rows = members.select(F.col(member).alias("member"), F.col(source).cast("string").alias("source"), F.col(stamp).cast("timestamp_ntz").alias("stamp"), F.array(*cols).alias("f"))
    rows = rows.groupBy("member").agg(F.max(F.struct("stamp", "source", "f")).alias("r")).select("member", "r.stamp", "r.source", "r.f")
    joined = ids.join(rows, "member")
    sizes = joined.groupBy("entity").agg(F.count("*").alias("n_members"))
    each = joined.join(sizes, "entity").select("entity", "member", "source", "stamp", "n_members", F.inline("f"))
    key = F.regexp_replace(F.lower("value"), r"[^\p{L}\p{N}]+", " ")
    return each.where(has_value("value")).withColumn("key", F.trim(key))


def _sized(stats: DataFrame) -> DataFrame:
    """Checkpointed statistics, broadcast only if they are few."""
    kept = cut(stats)
    return F.broadcast(kept) if kept.count() <= SMALL else kept.hint("merge")


def fuse(c: DataFrame, *, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(entity, field, key, posterior)``, the accuracy ``(s, a)`` of each source, and ``(x, y, p, later)`` of each pair of sources with
    a common entity: the probability that one copies, which is the later, less accurate one."""
    votes = cut(c.groupBy("entity", "field", "key").agg(F.array_sort(F.collect_set(F.coalesce("source", F.lit("")))).alias("sources")).withColumn("v", F.monotonically_increasing_id()))
    said = votes.select("v", F.explode("sources").alias("s"))
    shared = votes.where(F.size("sources") > 1).select("v", F.explode("sources").alias("x"), "sources").select("v", "x", F.explode("sources").alias("y")).where("x < y")
    # Pairs of sources, not of rows: an entity of any size lists each of its sources once.
    listed = votes.select("entity", "field", F.explode("sources").alias("s")).groupBy("entity", "field").agg(F.collect_set("s").alias("all")).where(F.size("all") > 1)
    met = cut(listed.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x < y").groupBy("x", "y").agg(F.count("*").alias("n")))
    accuracy, depend = _sized(said.select("s", F.lit(0.8).alias("a")).distinct()), None
    for _ in range(rounds):
        scored = cut(_posterior(votes, said, shared, accuracy, depend).select("v", "posterior"))
        by = said.hint("merge").join(scored, "v").groupBy("s").agg(F.avg("posterior").alias("a"))
        accuracy = _sized(by.select("s", F.greatest(F.lit(0.05), F.least(F.lit(0.99), "a")).alias("a")))
        depend = _sized(_dependence(shared.hint("merge").join(scored, "v"), met, accuracy))
    return _posterior(votes, said, shared, accuracy, depend).select("entity", "field", "key", "posterior"), accuracy, depend


def _posterior(votes: DataFrame, said: DataFrame, shared: DataFrame, accuracy: DataFrame, depend: DataFrame | None) -> DataFrame:
    """Bayes over the values claimed for one field; a vote is discounted by the chance that it is copied from a source before it."""
    each = said.join(accuracy, "s").select("v", "s", F.log(F.lit(FALSE_VALUES) * F.col("a") / (1 - F.col("a"))).alias("worth"))
    if depend is not None:
        own = shared.join(depend.where("p > 0.01").select("x", "y", "p", "later"), ["x", "y"]).groupBy("v", F.col("later").alias("s")).agg(F.sum(F.log(1 - F.lit(COPIED) * F.col("p"))).alias("off"))
        each = each.hint("merge").join(own, ["v", "s"], "left").select("v", (F.col("worth") * F.exp(F.coalesce("off", F.lit(0.0)))).alias("worth"))
    summed = votes.select("v", "entity", "field", "key").hint("merge").join(each.groupBy("v").agg(F.sum("worth").alias("vote")), "v")
    total = W.partitionBy("entity", "field")  # different values of one field of one entity
    top = F.max("vote").over(total)
    return summed.withColumn("e", F.exp(F.col("vote") - top)).withColumn("posterior", F.col("e") / (F.sum("e").over(total) + F.lit(FALSE_VALUES) * F.exp(-top))).drop("e", "vote")


def _dependence(shared: DataFrame, met: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Probability that two sources depend, from the shared values held true and false and those that differ."""
    same = shared.groupBy("x", "y").agg(F.sum("posterior").alias("t"), F.sum(1 - F.col("posterior")).alias("f"))
    a = lambda c, n: accuracy.select(F.col("s").alias(c), F.col("a").alias(n))
    rows = met.hint("merge").join(same, ["x", "y"], "left").na.fill(0.0, ["t", "f"]).join(a("x", "ax"), "x").join(a("y", "ay"), "y")
    rows = rows.withColumn("d", F.greatest(F.lit(0.0), F.col("n") - F.col("t") - F.col("f")))
    true, false, mean = F.col("ax") * F.col("ay"), (1 - F.col("ax")) * (1 - F.col("ay")) / F.lit(FALSE_VALUES), (F.col("ax") + F.col("ay")) / 2
    other = F.greatest(F.lit(1e-9), 1 - true - false)
    logs = F.lit(math.log(DEPEND / (1 - DEPEND)))
    for n, p, q in (("t", true, mean), ("f", false, 1 - mean), ("d", other, F.lit(0.0))):
        logs = logs + F.col(n) * (F.log(F.greatest(F.lit(1e-12), F.lit(COPIED) * q + F.lit(1 - COPIED) * p)) - F.log(p))
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), logs))))
    # The more accurate source is the original.
    later = F.when((F.col("ax") > F.col("ay")) | ((F.col("ax") == F.col("ay")) & (F.col("x") < F.col("y"))), F.col("y")).otherwise(F.col("x"))
    return rows.select("x", "y", chance.alias("p"), later.alias("later"))


def survivors(c: DataFrame, trust: DataFrame | None = None, *, rounds: int = ROUNDS) -> DataFrame:
    """``(entity, field, member, value, posterior)``: of each field the member whose value is kept.

    Without ``trust`` it is the value with the highest posterior, in the spelling of the latest member
    that claims it. With ``trust`` (``source``, ``trust``) the order that a house prescribes goes
    before: highest trust (0 without a feed), then latest stamp (null is oldest), and the posterior
    decides between members that are equal in both. Last of all comes the smallest member id.
    Fields without any value give no row.
    """
    post, _, _ = fuse(c, rounds=rounds)
    rows = c.hint("merge").join(post, ["entity", "field", "key"])
    never = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    stamp = F.coalesce("stamp", never)
    score = F.round("posterior", 9)
    if trust is not None:
        best = trust.where("source IS NOT NULL").groupBy(F.col("source").cast("string").alias("source")).agg(F.max("trust").alias("trust"))
        rows = rows.join(best, "source", "left")
        order = F.struct(F.coalesce("trust", F.lit(0)).alias("a"), stamp.alias("b"), score.alias("c"), (-F.col("member")).alias("d"))
    else:
        order = F.struct(score.alias("a"), stamp.alias("b"), (-F.col("member")).alias("d"))
    kept = rows.withColumn("o", order).groupBy("entity", "field").agg(F.max(F.struct("o", "member", "value", "posterior")).alias("k"))
    return kept.select("entity", "field", "k.member", "k.value", "k.posterior")
