"""Business terms to metrics and dimensions, entity names to ids, as joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.cleaning import clean_text, normalize_term
from tallyspark.plans.metrics import MetricRegistry

# What users say for a dimension.
DIMENSION_ALIASES = {
    "customer": "customer_name",
    "buyer": "customer_name",
    "client": "customer_name",
    "product": "product_name",
    "item": "product_name",
    "goods": "product_name",
    "sku": "product_name",
    "category": "product_category",
    "location": "location_name",
    "branch": "location_name",
    "outlet": "location_name",
    "store": "location_name",
    "supplier": "supplier_name",
    "vendor": "supplier_name",
    "partner": "partner_name",
    "cash account": "cash_account_name",
    "account": "cash_account_name",
    "collector": "collected_by",
    "payer": "paid_by",
    "returned by": "returned_by",
    "from location": "from_location_name",
    "to location": "to_location_name",
    "destination": "to_location_name",
    "source location": "from_location_name",
}

# Dimensions whose values are names of entities -> the id dimension.
ENTITY_DIMENSIONS = {
    "customer_name": "customer_id",
    "product_name": "product_id",
    "supplier_name": "supplier_id",
    "partner_name": "partner_id",
    "location_name": "location_id",
    "cash_account_name": "cash_account_id",
    "from_location_name": "from_location_id",
    "to_location_name": "to_location_id",
}

RESOLVED, AMBIGUOUS, INVALID, NOT_FOUND = "resolved", "ambiguous", "invalid", "not_found"
EXACT_NAME, DISPLAY_NAME, ALIAS = 1, 2, 3


def _norm(word: str) -> str:
    return " ".join(word.replace("_", " ").split()).lower()


def metric_vocabulary(spark: SparkSession, registry: MetricRegistry) -> DataFrame:
    """(term, priority, target) rows; as long as the registry and its aliases."""
    rows = set()
    for name, m in registry.items():
        rows.add((_norm(name), EXACT_NAME, name))
        rows.add((_norm(m.display_name), DISPLAY_NAME, name))
        rows.update((_norm(a), ALIAS, name) for a in m.aliases)
    return spark.createDataFrame(sorted(rows), "term string, priority int, target string")


def dimension_vocabulary(spark: SparkSession, registry: MetricRegistry) -> DataFrame:
    rows = {(_norm(d), EXACT_NAME, d) for d in registry.dimensions()}
    rows |= {(_norm(term), ALIAS, target) for term, target in DIMENSION_ALIASES.items()}
    return spark.createDataFrame(sorted(rows), "term string, priority int, target string")


def _best_targets(vocabulary: DataFrame) -> DataFrame:
    """Targets of the best priority per term. The vocabulary is code, not data: it fits any task."""
    per_level = vocabulary.groupBy("term", "priority").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return per_level.groupBy("term").agg(F.min_by("targets", "priority").alias("targets"))


def resolve_metrics(terms: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Add ``status``, ``resolved`` and ``candidates`` for each term.

    A registered name beats a display name, which beats an alias; an alias
    several metrics claim is ambiguous.
    """
    best = _best_targets(vocabulary).withColumnRenamed("term", "__term")
    joined = terms.join(F.broadcast(best), normalize_term(column) == F.col("__term"), "left")
    found = F.coalesce(F.size("targets"), F.lit(0))
    status = (
        F.when(clean_text(column).isNull(), INVALID)
        .when(found == 1, RESOLVED)
        .when(found > 1, AMBIGUOUS)
        .otherwise(NOT_FOUND)
    )
    return _finish(joined, terms, status, F.when(found > 1, F.col("targets")))


def resolve_dimensions(terms: DataFrame, column: str, vocabulary: DataFrame, allowed: Iterable[str]) -> DataFrame:
    """Like ``resolve_metrics``; a known dimension outside ``allowed`` is invalid.

    A canonical name is taken before an alias.
    """
    best = _best_targets(vocabulary).withColumnRenamed("term", "__term")
    joined = terms.join(F.broadcast(best), normalize_term(column) == F.col("__term"), "left")
    target = F.try_element_at("targets", F.lit(1))
    permitted = F.coalesce(target.isin(*allowed), F.lit(False))
    status = (
        F.when(clean_text(column).isNull(), INVALID)
        .when(target.isNull(), NOT_FOUND)
        .when(permitted, RESOLVED)
        .otherwise(INVALID)
    )
    return _finish(joined, terms, status, F.lit(None).cast("array<string>"))


def _finish(joined: DataFrame, terms: DataFrame, status: Column, candidates: Column) -> DataFrame:
    one = F.try_element_at("targets", F.lit(1))
    return (
        joined.withColumn("status", status)
        .withColumn("resolved", F.when(F.col("status") == RESOLVED, one))
        .withColumn("candidates", candidates)
        .select(*terms.columns, "status", "resolved", "candidates")
    )


# entity names ------------------------------------------------------------------

#: Texts are looked up by a piece of LONG_GRAM characters, shorter ones by one of GRAM.
GRAM, LONG_GRAM = 3, 8


def _grams(text: Column, length: int) -> Column:
    last = F.char_length(text) - (length - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(length)))).otherwise(
        F.array().cast("array<string>")
    )


def _contained_pairs(short: DataFrame, long: DataFrame) -> DataFrame:
    """(s, l) where text ``s`` occurs inside text ``l``.

    Each short text is looked up by the one of its grams that fewest long
    texts hold, so a common syllable never pairs everything with everything,
    and names that are mostly digits differ in eight of them sooner than in
    three. Texts below the gram length are looked up whole. All joins are
    shuffled: the sizes Spark plans with know nothing of exploded grams, and
    a broadcast of them would pass whole through the driver.
    """
    lengths = (*range(1, GRAM + 1), LONG_GRAM)
    holders = long.select("l", F.explode(F.array_distinct(F.concat(*[_grams(F.col("l"), n) for n in lengths]))).alias("gram"))
    frequency = holders.groupBy("gram").agg(F.count("*").alias("n"))
    size = F.char_length("s")
    pieces = (
        F.when(size < GRAM, F.array("s")).when(size < LONG_GRAM, _grams(F.col("s"), GRAM)).otherwise(_grams(F.col("s"), LONG_GRAM))
    )
    probes = short.select("s", F.explode(F.array_distinct(pieces)).alias("gram"))
    rarest = (
        probes.join(frequency.hint("merge"), "gram", "left")
        .groupBy("s")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    )
    return rarest.join(holders.hint("merge"), "gram").where(F.contains(F.col("l"), F.col("s"))).select("s", "l")


def entity_matches(values: DataFrame, column: str, directory: DataFrame) -> DataFrame:
    """(value, id, name, exact) for every entity whose name matches a value.

    ``directory`` has ``id`` and ``name``. A match is exact when the
    normalised texts are equal, loose when one contains the other.
    """
    wanted = values.select(normalize_term(column).alias("v")).where(F.coalesce(F.col("v"), F.lit("")) != "").distinct()
    named = directory.select("id", "name", normalize_term("name").alias("n")).where(F.col("n") != "")
    names = named.select("n").distinct()
    value_in_name = _contained_pairs(wanted.select(F.col("v").alias("s")), names.select(F.col("n").alias("l"))).select(
        F.col("s").alias("v"), F.col("l").alias("n")
    )
    name_in_value = _contained_pairs(names.select(F.col("n").alias("s")), wanted.select(F.col("v").alias("l"))).select(
        F.col("l").alias("v"), F.col("s").alias("n")
    )
    pairs = value_in_name.unionByName(name_in_value).distinct()
    return pairs.join(named.hint("merge"), "n").select("v", "id", "name", (F.col("v") == F.col("n")).alias("exact"))


def resolve_entities(values: DataFrame, column: str, directory: DataFrame) -> DataFrame:
    """Add ``status``, ``resolved`` id and ``match_count`` to each value.

    One exact match wins over any loose ones; one loose match alone is taken;
    more of the deciding kind is ambiguous. So values with an exact match,
    found by an equality join, need no search, and only the others are looked
    for inside names. The matches themselves can be many: take them from
    ``entity_matches``.
    """
    wanted = values.select(normalize_term(column).alias("v")).where(F.coalesce(F.col("v"), F.lit("")) != "").distinct()
    named = directory.select("id", normalize_term("name").alias("n"))
    exact = wanted.join(named.hint("merge"), F.col("v") == F.col("n")).groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    rest = wanted.join(exact.select("v").hint("merge"), "v", "left_anti")
    loose = entity_matches(rest, "v", directory).groupBy("v").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    per_value = exact.unionByName(loose)
    joined = values.withColumn("__v", normalize_term(column)).join(
        per_value.withColumnsRenamed({"v": "__match", "n": "__n", "id": "__id"}).hint("merge"), F.col("__v") == F.col("__match"), "left"
    )
    deciding = F.coalesce("__n", F.lit(0))
    status = F.when(deciding == 0, NOT_FOUND).when(deciding == 1, RESOLVED).otherwise(AMBIGUOUS)
    best = F.col("__id")
    return (
        joined.withColumn("status", status)
        .withColumn("resolved", F.when(F.col("status") == RESOLVED, best))
        .withColumn("match_count", deciding)
        .select(*values.columns, "status", "resolved", "match_count")
    )


def resolve_value_list(resolved: DataFrame, key: str) -> DataFrame:
    """A list filter resolves only when every one of its values does."""
    return resolved.groupBy(key).agg(
        F.every(F.col("status") == RESOLVED).alias("all_resolved"),
        F.count_if(F.col("status") != RESOLVED).alias("open_values"),
    )


def collect_issues(*parts: tuple[str, DataFrame, str]) -> DataFrame:
    """Every unresolved term of all kinds: (kind, frame, term column), metrics first."""
    frames = [
        df.where(F.col("status") != RESOLVED).select(
            F.lit(i).alias("position"), F.lit(kind).alias("kind"), F.col(term).alias("term"), "status"
        )
        for i, (kind, df, term) in enumerate(parts)
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
