"""Customers for scale tests: clusters of a stated size mix that share identifiers, with noise. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The benchmark's workload. Share of clusters' entities by cluster size (least, most), and chance that an entity shares its cluster's value.
SIZES = ((0.35, 1, 1), (0.25, 2, 2), (0.20, 3, 5), (0.12, 6, 15), (0.05, 16, 50), (0.02, 51, 200), (0.01, 201, 1000))
SHARED = {"email": 0.55, "phone": 0.25, "loyalty_id": 0.10, "address": 0.10}
SOURCES = (("web", 0.35), ("store", 0.30), ("mobile", 0.20), ("call_center", 0.10), ("partner", 0.05))


#: Fixed value: the chance that an entity of a cluster is linked only to the one before it, by a value that just those two have.
CHAIN = 0.15


def _u(seed: int, *cols) -> Column:
    """0 to 1, the same for the same columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def pick(u: Column, shares) -> Column:
    """The value whose part of 0 to 1 holds u. shares: (value, share)."""
    at, c = 1.0, F.lit(shares[-1][0])
    for value, share in reversed(shares):
        at -= share
        c = F.when(u < at + share, value).otherwise(c)
    return c


def customers(spark: SparkSession, entities: int, seed: int = 42) -> DataFrame:
    """About `entities` rows: entity_id, source_system, cluster, email, phone, loyalty_id, address, created_at."""
    mean = sum(share / ((low + high) / 2) for share, low, high in SIZES)  # clusters for each entity
    weights = [((low, high), share / ((low + high) / 2) / mean) for share, low, high in SIZES]
    c = spark.range(max(1, round(entities * mean))).withColumnRenamed("id", "cluster")
    u = _u(seed, "cluster")
    low, high = (pick(u, [(w[0][k], w[1]) for w in weights]) for k in (0, 1))
    c = c.withColumn("size", (low + F.floor(_u(seed + 1, "cluster") * (high - low + 1))).cast("int"))
    e = c.select("cluster", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("k"))
    e = e.withColumn("entity_id", F.concat_ws("-", "cluster", "k"))

    def value(name: str, text: Column, salt: int) -> Column:
        own = F.sha2(F.concat_ws("|", F.lit(name), "entity_id"), 256)
        shared = F.sha2(F.concat_ws("|", F.lit(name), F.col("cluster").cast("string")), 256)
        return F.when(_u(seed + salt, "entity_id") < SHARED[name], F.concat(text, F.substring(shared, 1, 12))).otherwise(F.concat(text, F.substring(own, 1, 12)))

    email = F.concat(value("email", F.lit("u"), 2), F.lit("@example.com"))
    # links of a chain: entity 2k and the one after it share a phone of their own
    linked = (F.col("size") > 2) & (_u(seed + 9, "cluster", F.floor(F.col("k") / 2)) < CHAIN)
    chain = F.concat(F.lit("+1"), F.substring(F.sha2(F.concat_ws("|", F.lit("chain"), F.col("cluster").cast("string"), F.floor(F.col("k") / 2).cast("string")), 256), 1, 12))
    return e.select(
        "entity_id", pick(_u(seed + 6, "entity_id"), SOURCES).alias("source_system"), "cluster",
        F.when(_u(seed + 7, "entity_id") < 0.2, F.upper(email)).otherwise(email).alias("email"), F.when(linked, chain).otherwise(value("phone", F.lit("+1"), 3)).alias("phone"),
        value("loyalty_id", F.lit("L"), 4).alias("loyalty_id"), value("address", F.lit("A"), 5).alias("address"),
        (F.lit("2024-01-01").cast("timestamp") - F.make_interval(days=F.floor(_u(seed + 8, "entity_id") * 365).cast("int"))).alias("created_at"),
    )


def aliased(email: Column, tag: str = "shop") -> Column:
    """name+tag@host, which reaches the same mailbox."""
    return F.concat(F.substring_index(email, "@", 1), F.lit(f"+{tag}@"), F.substring_index(email, "@", -1))


def dotted(email: Column) -> Column:
    """A dot after the name's first character, where the host ignores dots."""
    return F.concat(F.substring(email, 1, 1), F.lit("."), F.substr(email, F.lit(2)))


def dashed(phone: Column) -> Column:
    """The last ten digits as 123-456-7890."""
    d = F.right(F.regexp_replace(phone, "[^0-9]", ""), F.lit(10))
    return F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4))


def prefixed(phone: Column, code: str = "+1") -> Column:
    return F.concat(F.lit(code), F.regexp_replace(phone, "[^0-9]", ""))


def noisy_email(email: Column, u: Column, upper: float = 0.1, alias: float = 0.1, dots: float = 0.1, null: float = 0.1) -> Column:
    """u: 0 to 1, which says what happens to a value."""
    forms = ((upper, F.upper(email)), (alias, aliased(email)), (dots, dotted(email)), (null, F.lit(None).cast("string")))
    return _one_of(u, forms, email)


def noisy_phone(phone: Column, u: Column, dashes: float = 0.2, code: float = 0.2, null: float = 0.1) -> Column:
    return _one_of(u, ((dashes, dashed(phone)), (code, prefixed(phone)), (null, F.lit(None).cast("string"))), phone)


def _one_of(u: Column, forms, otherwise: Column) -> Column:
    out, at = None, 0.0
    for share, value in forms:
        at += share
        out = F.when(u < at, value) if out is None else out.when(u < at, value)
    return out.otherwise(otherwise)


def sample(df: DataFrame, fraction: float, seed: int, with_replacement: bool = False) -> DataFrame:
    """A Bernoulli sample; with replacement, each row comes a Poisson-distributed number of times."""
    return df.sample(with_replacement, fraction, seed)


def from_pool(spark: SparkSession, rows: int, pool: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """`rows` rows (row_id and the pool's columns), each with a member of the pool of persons, whose keys are 0 to n - 1.

    The side is chosen by Spark: a pool grows with the rows that it is for."""
    n = pool.count()
    r = spark.range(rows).select(F.col("id").alias("row_id"), F.floor(_u(seed, "id") * n).cast("long").alias(key))
    return r.join(pool, key)


def giant_group(spark: SparkSession, rows: int, value: str = "orders@corporate-hub.com") -> DataFrame:
    """An edge case: one identifier on many rows."""
    return spark.range(rows).select(F.concat(F.lit("giant-"), "id").alias("entity_id"), F.lit(value).alias("email"))
