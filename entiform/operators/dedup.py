"""Order-dependent deduplication over three keys.

In order, a lead is a duplicate when one of its keys (company and city, phone, web domain) belongs to an
already accepted lead; keys of rejected leads do not count. Spark decides in rounds:

1. per key, the smallest open row (one hash aggregate, combined before the shuffle);
2. rows that are smallest for every key they hold are accepted and own those keys;
3. open rows holding an owned key are rejected.

Copies with the same three keys collapse to their first row before the rounds. A hot key is owned after a round or two, and its rows go.
What is left then are rows that wait for each other in turn, and rounds would take as many turns as the longest of these chains has
rows. So, once a round decides few rows, or few are left, the open rows are split into connected components: rows that share keys, directly
or through others. Components do not touch, so each is decided on its own, row by row in order, and a task takes as many whole ones as
`GROUP_ROWS` allows. Of a component beyond that its first rows are decided so, which is exact as well, because no later row can change
them; the others stay open. No row is ever dropped by a limit.

Open rows and owners are written as tables each round, so a lost executor costs a task, not the run.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entiform.functions import names, web
from entiform.functions.storage import Scratch
from entiform.operators.components import components
from entiform.operators.lookups import HOT_KEYS, lookup_join

SIGNALS = ("name+city", "phone", "website")
_KEYS = ("k1", "k2", "k3")
#: Rows that one task decides in order, and the share of open rows below which a round has decided few.
GROUP_ROWS = 100_000
SLOW_ROUND = 0.2


def entity_keys(leads: DataFrame, ord: str = "ord") -> DataFrame:
    """(ord, id, k1, k2, k3); NULL where a lead has no such key."""
    company = names.company_key(F.col("company_name"))
    return leads.select(
        F.col(ord).cast("bigint").alias("ord"), "id",
        F.when(company != "", F.concat(company, F.lit("::"), names.city_key(F.col("city")))).alias("k1"),
        F.nullif(F.col("phone_normalized"), F.lit("")).alias("k2"),
        web.domain_of(F.col("website_url")).alias("k3"),
    )


def _long(keys: DataFrame, *carry: str) -> DataFrame:
    pairs = F.array(*[
        F.struct(F.lit(i).alias("signal"), F.col(k).alias("key")) for i, k in enumerate(_KEYS, 1)])
    return keys.select(*carry, F.inline(pairs)).filter(F.col("key").isNotNull())


def key_counts(keys: DataFrame) -> DataFrame:
    """(signal, key, n): how many rows hold each key."""
    return _long(keys).groupBy("signal", "key").agg(F.count("*").alias("n"))


def _key_count() -> Column:
    return sum((F.col(k).isNotNull().cast("bigint") for k in _KEYS), F.lit(0).cast("bigint"))


def without_owned(rows: DataFrame, owned: DataFrame, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Rows that hold none of the owned keys (signal, key, n). The widest-spread keys go by broadcast first."""
    hot = owned.filter("n > 1").orderBy(F.desc("n"), "signal", "key").limit(hot_keys)
    for source, wrap in ((hot, F.broadcast), (owned, lambda d: d)):
        for i, k in enumerate(_KEYS, 1):
            # A NULL key must match nothing and must not gather all its rows in one task.
            own = wrap(source.filter(F.col("signal") == i).select(F.concat(F.lit("="), "key").alias("_probe")))
            probe = F.coalesce(F.concat(F.lit("="), k), F.col("ord").cast("string"))
            rows = rows.withColumn("_probe", probe).join(own, "_probe", "left_anti").drop("_probe")
    return rows


def _in_order(names=("ord", *_KEYS)):
    """The sequential rules themselves, for whole components; a closure, so that executors need no copy of the package."""
    def owned(table: pa.Table) -> pa.Table:
        owners: dict[tuple[int, str], int] = {}
        held: dict[tuple[int, str], int] = {}
        for ord_, *keys in sorted(zip(*(table.column(c).to_pylist() for c in names)), key=lambda row: row[0]):
            own = [(i, k) for i, k in enumerate(keys, 1) if k is not None]
            for k in own:
                held[k] = held.get(k, 0) + 1
            if not any(k in owners for k in own):
                owners.update(dict.fromkeys(own, ord_))
        return pa.table({
            "signal": pa.array([i for i, _ in owners], pa.int32()), "key": pa.array([k for _, k in owners], pa.string()),
            "ord": pa.array(owners.values(), pa.int64()), "n": pa.array([held[k] for k in owners], pa.int64())})

    return owned


def _solve(still_open: DataFrame, rows: int, scratch: Scratch, turn: int, group_rows: int) -> tuple[DataFrame, bool]:
    """(owners of the decided rows, whether rows are left): by components, each as far as one task may go."""
    held = "signal int, key string, ord bigint, n bigint"
    if rows <= group_rows:
        return scratch.write(still_open.groupBy().applyInArrow(_in_order(), held), f"owners-{turn}"), False
    first = Window.partitionBy("signal", "key")
    links = _long(still_open, "ord").select("ord", F.min("ord").over(first).alias("least")).where("ord <> least")
    rooted = scratch.write(components(links.select(F.col("ord").alias("a"), F.col("least").alias("b"))), f"components-{turn}")
    alone = still_open.join(rooted.select(F.col("node").alias("ord"), "root"), "ord", "left").withColumn("root", F.coalesce("root", "ord"))
    parts = -(-rows // group_rows)
    longest = rooted.groupBy("root").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if longest > group_rows:
        turns = Window.partitionBy("root").orderBy("ord")
        alone = alone.withColumn("_turn", F.row_number().over(turns)).where(F.col("_turn") <= group_rows).drop("_turn")
    owned = alone.groupBy(F.pmod(F.xxhash64("root"), F.lit(parts))).applyInArrow(_in_order(), held)
    return scratch.write(owned, f"owners-{turn}"), longest > group_rows


def resolve_owners(keys: DataFrame, scratch: Scratch, hot_keys: int = HOT_KEYS, group_rows: int | None = None) -> DataFrame:
    """Owners of keys: (signal, key, ord, n), one row per key of every accepted row that holds a key."""
    group_rows = group_rows or GROUP_ROWS
    firsts = keys.filter(F.coalesce(*_KEYS).isNotNull()).groupBy(*_KEYS).agg(F.min("ord").alias("ord"))
    still_open = scratch.write(firsts, "open-0")
    tables, rows, slow = [], still_open.count(), False
    while rows:
        turn = len(tables)
        tables.append(f"owners-{turn}")
        if slow or rows <= group_rows:
            owned, more = _solve(still_open, rows, scratch, turn, group_rows)
            if not more:
                break
        else:
            # ord and the number of keys share one long, so the minimum stays a hash aggregate
            smallest = (
                _long(still_open.withColumn("packed", F.col("ord") * 4 + _key_count()), "packed")
                .groupBy("signal", "key").agg(F.min("packed").alias("packed"), F.count("*").alias("n"))
            )
            won = F.count("*").over(Window.partitionBy("packed"))
            owned = scratch.write(
                smallest.withColumn("won", won).filter(F.col("won") == F.pmod("packed", F.lit(4)))
                .select("signal", "key", F.expr("shiftright(packed, 2)").alias("ord"), "n"),
                f"owners-{turn}")
        still_open = scratch.write(without_owned(still_open, owned, hot_keys), f"open-{turn + 1}")
        scratch.drop(f"open-{turn}")
        left = still_open.count()
        slow, rows = left > (1 - SLOW_ROUND) * rows, left
    if not tables:
        return _long(keys, "ord").select("signal", "key", "ord", F.lit(0).cast("bigint").alias("n"))
    return scratch.read(*tables)


def _accepted_ords(keys: DataFrame, owners: DataFrame) -> DataFrame:
    keyless = keys.filter(F.coalesce(*_KEYS).isNull()).select("ord")
    return owners.select("ord").distinct().unionByName(keyless)


def dedup_entities(leads: DataFrame, ord: str = "ord") -> DataFrame:
    """Accepted leads only."""
    scratch = Scratch(leads.sparkSession, "dedup")
    keys = scratch.write(entity_keys(leads, ord), "keys")
    accepted = _accepted_ords(keys, resolve_owners(keys, scratch)).withColumnRenamed("ord", ord)
    return leads.join(accepted, ord, "left_semi")


def decide(keys: DataFrame, owners: DataFrame) -> DataFrame:
    """(ord, id, duplicate, reason, matched_id) of every row, given the owners (signal, key, owner_ord, owner_id)."""
    judged = keys
    for i, k in enumerate(_KEYS, 1):
        facts = owners.filter(F.col("signal") == i).select(
            F.col("key").alias(k), F.col("owner_ord").alias(f"o{i}"), F.col("owner_id").alias(f"i{i}"))
        judged = lookup_join(judged, facts, [k], keys.select(k))
    earlier = [F.col(f"o{i}") < F.col("ord") for i in (1, 2, 3)]
    reason = F.coalesce(*[F.when(e, F.lit(s)) for e, s in zip(earlier, SIGNALS)])
    matched = F.coalesce(*[F.when(e, F.col(f"i{i}")) for i, e in enumerate(earlier, 1)])
    return judged.select(
        "ord", "id", reason.isNotNull().alias("duplicate"), reason.alias("reason"), matched.alias("matched_id"))


def with_owner_ids(owners: DataFrame, keys: DataFrame) -> DataFrame:
    ids = keys.select(F.col("ord").alias("owner_ord"), F.col("id").alias("owner_id"))
    return owners.withColumnRenamed("ord", "owner_ord").join(ids, "owner_ord")


def dedup_decisions(leads: DataFrame, ord: str = "ord") -> DataFrame:
    """Decision per lead with the first signal that hit and the id of the accepted lead it matched."""
    scratch = Scratch(leads.sparkSession, "decisions")
    keys = scratch.write(entity_keys(leads, ord), "keys")
    owners = scratch.write(with_owner_ids(resolve_owners(keys, scratch), keys), "owner_ids")
    return decide(keys, owners)
