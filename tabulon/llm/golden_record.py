"""Golden record survivorship by lexicographic elimination.

A record of a cluster survives for a field as long as no other one beats it. Round by round, the best
value of the next criterion is aggregated for each cluster and field, and only the records that have it
stay (a semi-join); a field whose survivor is alone is settled and looks at no further criterion. All
fields of a rule set run in the same rounds, a row staying while it survives for any of them. The balance
comes second: its candidates carry whether they agree with the segment that survived.

Clusters may be of any size. A row is dealt by its cluster and a hash of itself (``salts`` parts), the
best values are aggregated before they are shuffled, and each goes to those parts alone in which its
cluster has rows; so no task gets a whole cluster, nothing is broadcast whose size Spark hasn't checked,
and nothing comes to the driver. Clusters of one record skip the rounds. Every round is written to the
shared folder, and the one before it deleted; what the lazy result reads is left there.

Defined cases: strings that are empty or hold only ASCII white space are null; others stay as they are; a balance that is
not a number or infinite is null; unknown and null sources are trusted least; a null updated_at is stale and goes last, a
null client_id after others; cluster ids that are null on both sides are one cluster of null; rows that
tie in all criteria of a field (repeated rows, say) give the least (client_id, value); repeated rows
count each; other columns are not read, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tabulon.llm.session import cut, drop, partitions, table

#: Sources by falling trust; hours after which a record is stale.
TRUST, STALE_HOURS = ["store", "crm", "partner", "web"], 240
BLANK = r"^[\x20\x09-\x0D]*$"
KEY = ["k", "none", "salt"]
LEAST = -(2**63)


@dataclass
class Rule:
    """Which rows are candidates for a field, and the criteria in order: numbers, the larger the better,
    null last."""

    field: str
    candidate: Column
    criteria: list[Column]


def survivors(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that survive for a field, with a flag ``is_<field>`` each. ``rows`` have the columns in
    ``KEY``; those of a salt need not be all of a cluster."""
    flag = {r.field: f"is_{r.field}" for r in rules}
    rows = rows.withColumns({flag[r.field]: F.coalesce(r.candidate, F.lit(False)) for r in rules})
    rows = rows.filter(reduce(or_, map(F.col, flag.values())))
    before = None
    for i in range(max(len(r.criteria) for r in rules)):
        active = [r for r in rules if i < len(r.criteria)]
        value = {r.field: F.coalesce(r.criteria[i].cast("bigint"), F.lit(LEAST)) for r in active}
        wanted = [F.max(F.when(F.col(flag[f]), v)).alias(f"best_{f}") for f, v in value.items()]
        wanted += [F.count_if(flag[f]).alias(f"n_{f}") for f in value]
        best = rows.groupBy("k", "none").agg(*wanted, F.collect_set("salt").alias("salts"))
        best = best.filter(reduce(or_, (F.col(f"n_{f}") > 1 for f in value))).withColumn("salt", F.explode("salts")).drop("salts")
        joined = rows.join(best, KEY, "left")
        stays = {flag[f]: F.col(flag[f]) & F.coalesce((F.col(f"n_{f}") == 1) | (F.col(f"best_{f}") == v), F.lit(True)) for f, v in value.items()}
        after = cut(joined.withColumns(stays).select(*rows.columns).filter(reduce(or_, map(F.col, flag.values()))))
        if before is not None:
            drop(before)
        rows = before = after
    return rows


def micros(x: Column, zoned: bool) -> Column:
    """Microseconds since 1970, of a timestamp without a zone by its own calendar."""
    if zoned:
        return F.unix_micros(x)
    gap = x - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda name: F.extract(F.lit(name), gap)
    minutes = (part("DAY").cast("bigint") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return minutes * 60_000_000 + (part("SECOND") * 1_000_000).cast("bigint")


def prepared(clients: DataFrame, salts: int) -> DataFrame:
    """The rows with null for blanks, their cluster, salt, and what criteria are made of."""
    text = lambda c: F.when(~F.col(c).rlike(BLANK), F.col(c)).alias(c)
    zoned = not isinstance(clients.schema["updated_at"].dataType, TimestampNTZType)
    cluster = F.coalesce("master_id", "client_id")
    trust = reduce(lambda acc, s: acc.when(F.col("source") == s[1], len(TRUST) - s[0]), enumerate(TRUST), F.when(F.lit(False), 0)).otherwise(0)
    read = ["client_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
    return clients.select(
        F.coalesce(cluster, F.lit(0)).alias("k"),
        cluster.isNull().alias("none"),
        F.pmod(F.xxhash64(*read), F.lit(salts)).cast("int").alias("salt"),
        "client_id",
        micros(F.col("updated_at"), zoned).alias("updated"),
        trust.alias("trust"),
        *map(text, ("name", "email", "city", "segment")),
        "nation_id",
        F.when(F.abs("balance") < float("inf"), F.floor(100 * F.col("balance") + 0.5)).alias("balance_cents"),
    )


def golden(clients: DataFrame, salts: int) -> DataFrame:
    """One record a cluster: its counts, fields, and the clients that gave them."""
    rows = prepared(clients, salts)
    sums = rows.groupBy("k", "none").agg(F.count("*").alias("n"), F.max("updated").alias("latest"), F.collect_set("salt").alias("salts"))
    sums = sums.withColumn("salt", F.explode("salts")).drop("salts")
    fresh = F.coalesce(F.col("updated") >= F.col("latest") - STALE_HOURS * 3_600_000_000, F.lit(False))
    rows = cut(rows.join(sums, KEY).withColumn("fresh", fresh).drop("latest"))

    recent = [F.col("updated"), F.col("trust"), F.bitwise_not("client_id")]
    trusted = [F.col("fresh").cast("int"), F.col("trust"), F.col("updated"), F.bitwise_not("client_id")]
    filled = F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")
    several = rows.filter("n > 1")
    first = survivors(
        several,
        [
            Rule("segment", F.col("segment").isNotNull(), recent),
            Rule("email", F.col("email").isNotNull(), trusted),
            Rule("name", F.col("name").isNotNull(), [F.length("name"), *trusted]),
            Rule("address", F.lit(True), [filled, *recent]),
        ],
    )
    # the segment that survived, to the candidates for the balance: the same few rows a cluster, by salt
    chosen = first.groupBy("k", "none").agg(F.min(F.when(F.col("is_segment"), F.struct("client_id", "segment")))["segment"].alias("chosen"))
    salted = several.groupBy("k", "none").agg(F.collect_set("salt").alias("salts")).join(chosen, ["k", "none"]).select("k", "none", "chosen", F.explode("salts").alias("salt"))
    holding = several.filter("balance_cents IS NOT NULL").join(salted, KEY)
    second = survivors(holding, [Rule("balance", F.lit(True), [F.col("segment").eqNullSafe(F.col("chosen")).cast("int"), *recent])])

    alone = rows.filter("n = 1").withColumns({"is_segment": F.col("segment").isNotNull(), "is_email": F.col("email").isNotNull(), "is_name": F.col("name").isNotNull(), "is_address": F.lit(True), "is_balance": F.col("balance_cents").isNotNull()})
    none = lambda *names: {f"is_{n}": F.lit(False) for n in names}
    shown = ["k", "none", "client_id", "name", "email", "segment", "city", "nation_id", "balance_cents", *(f"is_{f}" for f in ("segment", "email", "name", "address", "balance"))]
    winners = [alone.select(*shown), first.withColumns(none("balance")).select(*shown), second.withColumns(none("segment", "email", "name", "address")).select(*shown)]
    counted = rows.select("k", "none", F.lit(1).alias("records"), (~F.col("fresh")).cast("int").alias("stale"))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*winners, counted])
    pick: Callable[..., Column] = lambda f, *cols: F.min(F.when(F.col(f"is_{f}"), F.struct("client_id", *cols))).alias(f)
    picked = every.groupBy("k", "none").agg(
        F.sum("records").alias("n_records"),
        F.sum("stale").alias("n_stale"),
        *(pick(f, f) for f in ("name", "email", "segment")),
        pick("balance", "balance_cents"),
        pick("address", "city", "nation_id"),
    )
    has = F.col("address.city").isNotNull() | F.col("address.nation_id").isNotNull()
    return picked.select(
        F.when(~F.col("none"), F.col("k")).alias("cluster_id"),
        "n_records",
        "n_stale",
        F.col("name.name").alias("name"),
        F.col("email.email").alias("email"),
        F.col("segment.segment").alias("segment"),
        F.col("address.city").alias("city"),
        F.col("address.nation_id").alias("nation_id"),
        "balance.balance_cents",
        *(F.col(f"{f}.client_id").alias(f"{f}_from") for f in ("name", "email", "segment", "balance")),
        F.when(has, F.col("address.client_id")).alias("address_from"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden(table(spark, sf_dir, "clients"), max(64, partitions(spark)))


SQL = r"""
WITH c AS (
    SELECT client_id, coalesce(master_id, client_id) AS cluster_id, updated_at, nation_id, balance,
        CASE source WHEN 'store' THEN 4 WHEN 'crm' THEN 3 WHEN 'partner' THEN 2 WHEN 'web' THEN 1 ELSE 0 END AS trust,
        CASE WHEN NOT regexp_full_match(name, '[\x20\x09-\x0D]*') THEN name END AS name,
        CASE WHEN NOT regexp_full_match(email, '[\x20\x09-\x0D]*') THEN email END AS email,
        CASE WHEN NOT regexp_full_match(city, '[\x20\x09-\x0D]*') THEN city END AS city,
        CASE WHEN NOT regexp_full_match(segment, '[\x20\x09-\x0D]*') THEN segment END AS segment
    FROM clients
), f AS (
    SELECT *, coalesce(updated_at >= max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 240 HOUR, false) AS fresh FROM c
), r AS (
    SELECT *,
        row_number() OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, updated_at DESC NULLS LAST, trust DESC, client_id) AS by_segment,
        row_number() OVER (PARTITION BY cluster_id ORDER BY email IS NULL, fresh DESC, trust DESC, updated_at DESC NULLS LAST, client_id) AS by_email,
        row_number() OVER (PARTITION BY cluster_id ORDER BY name IS NULL, length(name) DESC, fresh DESC, trust DESC, updated_at DESC NULLS LAST, client_id) AS by_name,
        row_number() OVER (PARTITION BY cluster_id ORDER BY (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT DESC, updated_at DESC NULLS LAST, trust DESC, client_id) AS by_address
    FROM f
), s AS (
    SELECT *, max(CASE WHEN by_segment = 1 THEN segment END) OVER (PARTITION BY cluster_id) AS chosen FROM r
), b AS (
    SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY balance IS NULL, segment IS NOT DISTINCT FROM chosen DESC, updated_at DESC NULLS LAST, trust DESC, client_id) AS by_balance
    FROM s
)
SELECT cluster_id, count(*) AS n_records, count(*) FILTER (WHERE NOT fresh) AS n_stale,
    max(name) FILTER (WHERE by_name = 1) AS name, max(email) FILTER (WHERE by_email = 1) AS email, max(chosen) AS segment,
    max(city) FILTER (WHERE by_address = 1) AS city, max(nation_id) FILTER (WHERE by_address = 1) AS nation_id,
    CAST(floor(100 * max(balance) FILTER (WHERE by_balance = 1) + 0.5) AS BIGINT) AS balance_cents,
    max(client_id) FILTER (WHERE by_name = 1 AND name IS NOT NULL) AS name_from,
    max(client_id) FILTER (WHERE by_email = 1 AND email IS NOT NULL) AS email_from,
    max(client_id) FILTER (WHERE by_segment = 1 AND segment IS NOT NULL) AS segment_from,
    max(client_id) FILTER (WHERE by_balance = 1 AND balance IS NOT NULL) AS balance_from,
    max(client_id) FILTER (WHERE by_address = 1 AND (city IS NOT NULL OR nation_id IS NOT NULL)) AS address_from
FROM b GROUP BY cluster_id
"""
