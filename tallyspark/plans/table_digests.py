"""Facts against their staging by digests, and the digests kept beside the store.

A load brings some batches and rewrites some months. The digest of a month belongs to the folder that holds it,
which is never written again, so only folders without one are read. The digest of the latest accepted staged rows
is a sum of changes, one for each refresh; a refresh weighs only the keys its new batches touch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.digests import COUNT, MEASURES, TOTAL, added, change_of_latest, digests
from tallyspark.operators.latest import VERSION_COLUMNS
from tallyspark.operators.reconcile import TOTALS
from tallyspark.plans.facts import FACTS, latest_staged
from tallyspark.sources.tables import MONTH, PART, TableStore

Version = Sequence[str | Column]
KEPT_MONTHS, KEPT_STAGED = "month_digests", "staged_digests"
BATCH = "ingestion_batch_id"


@dataclass(frozen=True)
class Sides:
    """Key and amount of a fact and of its staging; facts without a total are compared by keys alone."""

    staging: str
    staged_key: str
    key: str
    staged_amount: str | None = None
    amount: str | None = None


def _sides() -> dict[str, Sides]:
    amounts = {fact: (staged, own) for _, _, staged, fact, own in TOTALS.values()}
    found = {}
    for name, spec in FACTS.items():
        key = spec.business_key[-1]
        staged_key = key if name == "fact_partner_capital" else spec.staging_key
        found[name] = Sides(spec.staging, staged_key, key, *amounts.get(name, (None, None)))
    return found


SIDES = _sides()


def month_digests(fact: str, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Digests of a fact by month, or by other columns."""
    if not by:
        rows, by = rows.withColumn(MONTH, F.floor(F.col("date_key") / 100).cast("int")), [MONTH]
    return digests(rows, SIDES[fact].key, SIDES[fact].amount, by)


def staged_digest(fact: str, staged: DataFrame, version: Version = VERSION_COLUMNS) -> DataFrame:
    """One row: the digest of the latest accepted staged row of each key."""
    side = SIDES[fact]
    return staged_digest_of(fact, {side.staging: staged}, version)


def staged_digest_of(fact: str, t: Mapping[str, DataFrame], version: Version = VERSION_COLUMNS) -> DataFrame:
    """The same from tables; those that bring the latest rows themselves share the shuffle of their facts."""
    side = SIDES[fact]
    latest = latest_staged(t, side.staging, [side.staged_key], version).where(F.col(side.staged_key).isNotNull())
    return digests(latest, side.staged_key, side.staged_amount)


def compared(staged: DataFrame, core: DataFrame) -> DataFrame:
    """Both digests of each fact side by side, and whether all their measures agree; each side has a row per fact."""
    old, new = (df.select("fact_name", *[F.col(m).alias(f"{side}_{m}") for m in MEASURES]) for side, df in (("staged", staged), ("core", core)))
    same = [F.col(f"staged_{m}").eqNullSafe(F.col(f"core_{m}")) for m in MEASURES]
    return old.join(new, "fact_name", "full").select(
        "fact_name",
        F.col(f"staged_{COUNT}").alias("expected_count"), F.col(f"core_{COUNT}").alias("actual_count"),
        F.col(f"staged_{TOTAL}").alias("source_value"), F.col(f"core_{TOTAL}").alias("warehouse_value"),
        same[2].alias("same_rows"),
        (same[0] & same[1] & same[2]).alias("is_valid"),
    )


def digest_report(t: Mapping[str, DataFrame], version_of: Callable[[str], Version] = lambda staging: VERSION_COLUMNS) -> DataFrame:
    """Every fact of ``t`` against its staging, in full. Unlike equal sums, equal digests rule out that two rows swapped amounts."""
    name = lambda df, fact: df.withColumn("fact_name", F.lit(fact))
    staged = [name(staged_digest_of(f, t, version_of(s.staging)), f) for f, s in SIDES.items()]
    core = [name(digests(t[f], s.key, s.amount), f) for f, s in SIDES.items()]
    return compared(reduce(DataFrame.unionByName, staged), reduce(DataFrame.unionByName, core))


# kept digests -------------------------------------------------------------------


def refresh_months(store: TableStore) -> dict[str, list[str]]:
    """Digest the folders of each fact's present state that have none; gives the folders that were read."""
    kept = store.read("ops", KEPT_MONTHS)
    known: dict[str, set[str]] = {}
    if kept is not None:
        for row in kept.select("fact_name", PART).collect():  # a row per fact and month
            known.setdefault(row["fact_name"], set()).add(row[PART])
    fresh, frames = {}, []
    for fact in FACTS:
        parts = store.parts("core", fact)
        fresh[fact] = [p for p in parts if p not in known.get(fact, ())]
        if kept is not None and known.get(fact):
            frames.append(kept.where((F.col("fact_name") == fact) & F.col(PART).isin(parts)))
        if fresh[fact]:
            rows = store.read_parts("core", fact, fresh[fact])
            frames.append(month_digests(fact, rows, [PART]).withColumn("fact_name", F.lit(fact)))
    if any(fresh.values()):
        store.replace(reduce(DataFrame.unionByName, frames), "ops", KEPT_MONTHS)
    return fresh


def refresh_staged(store: TableStore, version_of: Callable[[str], Version] = lambda staging: VERSION_COLUMNS) -> dict[str, list[str]]:
    """Add what the batches staged since the last refresh change; gives these batches by fact.

    A batch is known by its number of accepted rows. If a known one has another number by now, the changes after it
    no longer hold, and the fact's digest is made anew.
    """
    kept = store.read("ops", KEPT_STAGED)
    known: dict[str, dict[str, int]] = {}
    if kept is not None:
        for row in kept.select("fact_name", "batches").collect():  # the batches of each refresh, once
            known.setdefault(row["fact_name"], {}).update(row["batches"])
    fresh, kept_facts, frames = {}, [], []
    for fact, side in SIDES.items():
        staged = store.read("staging", side.staging.removeprefix("stg_"))
        if staged is None:
            continue
        accepted = staged.where(F.col("record_status") == "pending")
        sizes = {r[BATCH]: r["count"] for r in accepted.groupBy(BATCH).count().collect()}
        before = known.get(fact, {})
        holds = all(sizes.get(b) == n for b, n in before.items())
        fresh[fact] = sorted(b for b in sizes if not holds or b not in before)
        if holds and before:
            kept_facts.append(fact)
        if not fresh[fact]:
            continue
        if holds and before:
            version = version_of(side.staging)
            change = change_of_latest(accepted, F.col(BATCH).isin(fresh[fact]), side.staged_key, side.staged_amount, version)
        else:
            change = staged_digest(fact, staged, version_of(side.staging))
        batches = F.create_map(*[F.lit(x) for b in fresh[fact] for x in (b, sizes[b])]).cast("map<string,bigint>")
        frames.append(change.select(F.lit(fact).alias("fact_name"), batches.alias("batches"), *MEASURES))
    if frames:
        if kept_facts:
            frames.append(kept.where(F.col("fact_name").isin(kept_facts)))
        store.replace(reduce(DataFrame.unionByName, frames), "ops", KEPT_STAGED)
    return fresh


def validate_by_digests(store: TableStore, version_of: Callable[[str], Version] = lambda staging: VERSION_COLUMNS) -> DataFrame:
    """``digest_report`` of the store, after bringing the kept digests up to date; what they cover is not read again."""
    refresh_months(store)
    refresh_staged(store, version_of)
    staged, core = store.read("ops", KEPT_STAGED), store.read("ops", KEPT_MONTHS)
    if staged is None or core is None:
        raise KeyError("nothing to compare: no fact was loaded")
    return compared(added(staged, ["fact_name"]), added(core, ["fact_name"]))
