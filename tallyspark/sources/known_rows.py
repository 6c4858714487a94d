"""Which rows of a load were ingested before, without reading the history.

Every batch of the raw layer has a Bloom filter of its row hashes: PROBES positions per hash in a space of
``bits``, kept as bitmaps of 32,768 bits, of which only those that hold something are stored. The
hashes of a load meet the filters; only what a filter cannot rule out meets raw rows, and only those of the
batches whose filters let it pass. A filter never rules out a row it holds, so the result is that of an anti join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.joins import missing_from
from tallyspark.sources.tables import TableStore

HASH, BATCH = "source_row_hash", "ingestion_batch_id"
#: A position is made of this many hex digits, so four of them use 60 of the 64 digits of a SHA-256.
PROBES, DIGITS = 4, 15
#: Positions of a filter. At 16 or more per row of a batch about one foreign row in 400 passes its filter.
BITS = 1 << 30
BUCKET, SET = "bucket", "bits"


def positions(row_hash: Column, bits: int) -> Column:
    """The distinct positions of a hash, from 1."""
    digits = [F.conv(F.substring(row_hash, 1 + DIGITS * n, DIGITS), 16, 10).cast("long") for n in range(PROBES)]
    return F.array_distinct(F.array(*[d % bits + 1 for d in digits]))


def filters_of(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """The filters of all batches in ``rows``: batch, bucket and bitmap."""
    probes = rows.select(BATCH, F.explode(positions(F.col(HASH), bits)).alias("at"))
    state = F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at"))).alias(SET)
    return probes.groupBy(BATCH, F.bitmap_bucket_number(F.col("at")).alias(BUCKET)).agg(state)


def not_ruled_out(hashes: DataFrame, filters: DataFrame, bits: int = BITS) -> DataFrame:
    """(hash, batch) for each batch whose filter has all positions of a hash.

    The hashes asked for in a bucket are gathered, so that a bitmap is read once per bucket and not once per
    hash; hashes are spread evenly over the buckets, so no bucket gathers more than its share.
    """
    places = positions(F.col(HASH), bits)
    asked = hashes.select(HASH, F.size(places).alias("size"), F.explode(places).alias("at"))
    asked = asked.groupBy(F.bitmap_bucket_number(F.col("at")).alias(BUCKET)).agg(
        F.collect_list(F.struct(HASH, "size", F.bitmap_bit_position(F.col("at")).alias("bit"))).alias("asked")
    )
    byte = "conv(hex(substring(bits, CAST(a.bit DIV 8 AS INT) + 1, 1)), 16, 10)"
    there = F.expr(f"filter(asked, a -> shiftright(CAST({byte} AS INT), CAST(a.bit % 8 AS INT)) & 1 = 1)")
    found = filters.join(asked, BUCKET).select(BATCH, F.explode(there).alias("a")).select(BATCH, "a.*")
    return found.groupBy(HASH, BATCH, "size").agg(F.count("*").alias("n")).where("n = size").select(HASH, BATCH)


def known_rows_by_filter(hashes: DataFrame, raw: DataFrame, filters: DataFrame, batches: Sequence[str] | None = None, bits: int = BITS) -> DataFrame:
    """The hashes among ``hashes`` that ``raw`` holds; ``batches``, if given, are the only ones whose raw rows need be read."""
    maybe = not_ruled_out(hashes.select(HASH).distinct(), filters, bits)
    rows = raw if batches is None else raw.where(F.col(BATCH).isin(*batches))
    return rows.select(HASH, BATCH).join(maybe, [HASH, BATCH], "left_semi").select(HASH).distinct()


def filter_table(entity: str) -> str:
    return f"row_filters_{entity}"


def refresh_filters(store: TableStore, entity: str, loading: str, bits: int = BITS) -> DataFrame | None:
    """Filters of all batches in raw but the one being loaded.

    Batches without one get theirs now, so a driver lost after raw rows were appended leaves nothing to repair. A
    batch that is loaded again may grow, so its filter is dropped and made by the next load.
    """
    table = filter_table(entity)
    store.drop_part("ops", table, BATCH, loading)
    missing = sorted(store.parts_by("raw", entity, BATCH) - store.parts_by("ops", table, BATCH) - {loading})
    if missing:
        rows = store.read("raw", entity).where(F.col(BATCH).isin(*missing))
        store.append(filters_of(rows, bits), "ops", table, partition_by=[BATCH])
    return store.read("ops", table) if store.parts_by("ops", table, BATCH) else None


def drop_known(store: TableStore, entity: str, rows: DataFrame, batch_id: str, bits: int = BITS) -> DataFrame:
    """The rows whose hash raw does not hold. ``rows`` are written aside, as they are read several times."""
    filters = refresh_filters(store, entity, batch_id, bits)
    own = batch_id in store.parts_by("raw", entity, BATCH)
    if filters is None and not own:
        return rows
    rows = store.aside(rows, "raw", f"{entity}__load")
    raw = store.read("raw", entity)
    if filters is not None:
        maybe = store.aside(not_ruled_out(rows.select(HASH), filters, bits), "ops", f"{filter_table(entity)}__maybe")
        # the names of batches, of which a warehouse has far fewer than rows, become a partition filter
        batches = [r[0] for r in maybe.select(BATCH).distinct().collect()]
        if batches:
            there = raw.where(F.col(BATCH).isin(*batches)).select(HASH, BATCH).join(maybe, [HASH, BATCH], "left_semi")
            rows = missing_from(rows, there, [HASH])
    return missing_from(rows, raw.where(F.col(BATCH) == batch_id), [HASH]) if own else rows
