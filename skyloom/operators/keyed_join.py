"""Joins on identifiers and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_variants
from ..storage import stored


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; one aggregation by struct, not a window over a hot key."""
    rest = F.struct(*df.columns)
    return df.groupBy(*[F.expr(k) if isinstance(k, str) else k for k in keys]).agg(F.min_by(rest, F.struct(*order)).alias("r")).select("r.*")


def enrich(base: DataFrame, lookup: DataFrame, key: str, order: list) -> DataFrame:
    """LEFT join with the lookup's first row of each key."""
    return base.join(keep_first(lookup, [key], order), key, "left")


def id_or_place(rows: DataFrame, by_id: DataFrame, by_place: DataFrame) -> DataFrame:
    """rows(id, key, ...): gid by key from by_id(key, gid, order), the last one counting; else by_place(id, gid)."""
    last = by_id.groupBy("key").agg(F.max_by("gid", "order").alias("_by_id"))
    return rows.join(last, "key", "left").join(by_place.select("id", F.col("gid").alias("_by_place")), "id", "left").withColumn("gid", F.coalesce("_by_id", "_by_place")).drop("_by_id", "_by_place")


def shared_members(df: DataFrame, group: str, member: str) -> DataFrame:
    """For each pair of groups a < b, the number of members that both have."""
    d = df.select(group, member).distinct()
    a, b = d.select(F.col(group).alias("a"), member), d.select(F.col(group).alias("b"), member)
    return a.join(b, member).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def _forms(df: DataFrame, name: str, as_name: str, per_task: int) -> DataFrame:
    """Each distinct name with its distinct forms, the earliest priority of each. Names are dealt out before they are
    multiplied, at most some per_task to a task, since a small file of names would else be a single task's."""
    names = df.select(F.col(name).alias(as_name)).distinct()
    forms = names.repartition(max(-(-df.count() // per_task), 1), as_name).withColumn("_f", name_variants(F.col(as_name)))
    first = F.filter("_f", lambda x, i: F.array_position(F.col("_f.name"), x["name"]) == i + 1)
    return forms.select(as_name, F.inline(first)).filter("name <> ''")


def by_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str, per_task: int = 1 << 14) -> DataFrame:
    """Each left row's right row by any form of its name, the earliest form first, then the right name. Of the right names that share
    a form only the best one is joined, so names that stand in many rows, or forms that many names have, make no pairs.
    The joins are merges: the names' file is small for what they are multiplied to, so Spark would broadcast them by its size."""
    best = _forms(right, right_name, "_r", per_task).groupBy("name").agg(F.min(F.struct(F.col("priority").alias("p2"), "_r")).alias("_b")).hint("merge")
    hit = _forms(left, left_name, "_l", per_task).join(best, "name").groupBy("_l").agg(F.min(F.struct("priority", "_b")).alias("_m")).select("_l", F.col("_m._b._r").alias("_r")).hint("merge")
    return left.join(hit, left[left_name] == hit["_l"], "left").drop("_l").withColumnRenamed("_r", "matched_name")


def by_containment(left: DataFrame, right: DataFrame, left_name: str, right_name: str, gram: int = 4) -> DataFrame:
    """Pairs in which one name (of at least `gram` characters) holds the other; found by shared pieces of
    `gram` characters, not by comparing every two. A name is looked up by the one of its pieces that fewest names of the
    other side hold, so names that begin alike do not all meet."""
    pieces = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - gram + 1), lambda i: F.substring(c, i, F.lit(gram))))
    a = stored(left.filter(F.length(left_name) >= gram).select(F.col(left_name).alias("l")).distinct(), "left-names")
    b = stored(right.filter(F.length(right_name) >= gram).select(F.col(right_name).alias("r")).distinct(), "right-names")

    def held(short, long):
        """Pairs of names of `short` that stand in one of `long`."""
        of_long = stored(long.select(*long.columns, F.explode(pieces(F.col(long.columns[0]))).alias("g")), "pieces")
        frequency = of_long.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        # a piece that no name of the other side holds rules a name out
        own = short.select(*short.columns, F.explode(pieces(F.col(short.columns[0]))).alias("g")).join(frequency, "g", "left")
        rarest = own.groupBy(*short.columns).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m")).filter("m.n > 0")
        return rarest.select(*short.columns, F.col("m.g").alias("g")).join(of_long, "g").filter(F.col(long.columns[0]).contains(F.col(short.columns[0])))

    return held(a, b).select("l", "r").union(held(b, a).select("l", "r")).distinct()


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a digest of the key and the seed: the same rows on every run, partitioning and engine."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)
