"""License templates in documents, by MinHash over overlapping windows of five-word shingles.

A long template is entered with all its windows of WINDOW shingles, a document is cut into such windows every
STRIDE shingles, so an undamaged template shows at least one equal window. Windows are compared by BANDS
MinHash values, each a band of its own: a window that shares the part J of its shingles with a template's
window meets it with probability 1 - (1 - J)^BANDS, which is 0.98 at one half, 0.999 at 0.7 and 1 for equal
ones. Short templates have windows of a single shingle, whose MinHash is the shingle. What is retrieved
is verified on the words: the share of the template's shingles in the stretch it would cover.

Everything is column expressions; documents are not shuffled, only the verified matches are.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common
from tallyspark.llm.license_texts import TEMPLATES

SHINGLE, LEAST = 5, 0.8
STRIDE, BANDS = 4, 6
#: A window is two blocks of STRIDE shingles.
WINDOW = 2 * STRIDE
#: Templates of fewer shingles are searched by single shingles: a window of WINDOW must fit in STRIDE places.
LONG_TEMPLATE = WINDOW + STRIDE - 1
#: Shingles on each side of the stretch in which verification looks, for words put in or left out: this share of
#: the template's shingles, so that a block of half its length may stand in it, and at least so many.
SLACK_SHARE, LEAST_SLACK = 0.5, 4

def words_of(text: Column) -> Column:
    """Runs of letters a-z and digits, in lower case; everything else parts words."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def upto(count: Column) -> Column:
    """0 ... count - 1, empty for counts below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column) -> Column:
    return F.transform(upto(F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))


def shingles(words: Column) -> Column:
    return F.transform(upto(F.size(words) - SHINGLE + 1), lambda i: F.concat_ws(" ", F.slice(words, i + 1, SHINGLE)))


def mask(band: int) -> Column:
    """The band's permutation of hashes: they are spread already, so flipping a fixed set of bits reorders them."""
    return F.lit(int.from_bytes(hashlib.md5(f"band {band}".encode()).digest()[:8], "big", signed=True))


def block_minima(hashed: Column, length: int, step: int, count: Column, band: int) -> Column:
    """The band's least hash of ``count`` stretches of ``length`` shingles, ``step`` apart."""
    return F.transform(upto(count), lambda i: F.array_min(
        F.transform(F.slice(hashed, i * step + 1, length), lambda h: h.bitwiseXOR(mask(band)))
    ))


def window_keys(minima: Column) -> Column:
    """The MinHash of each window of two neighbouring blocks, of the last block alone at the end."""
    return F.transform(minima, lambda x, i: F.least(x, F.get(minima, i + 1)))


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later expressions read instead of repeating its expression, once per array element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def told_apart(hashed: DataFrame, least: float) -> DataFrame:
    """n, marks: for each template that is as good as contained in another one, the shingles that this other one lacks."""
    each = hashed.select("n", "size", F.explode(F.array_distinct("own")).alias("shingle"))
    shared = each.join(each.select(F.col("n").alias("other"), "shingle"), "shingle").where(F.col("n") != F.col("other"))
    alike = shared.groupBy("n", "other", "size").agg(F.count("*").alias("shared")).where(F.col("shared") >= least * F.col("size"))
    both = alike.select("n", "other").join(hashed.select("n", "own"), "n").join(
        hashed.select(F.col("n").alias("other"), F.col("own").alias("other_own")), "other"
    )
    marks = both.select("n", F.array_except("own", "other_own").alias("mark")).where(F.size("mark") > 0)
    return marks.groupBy("n").agg(F.collect_list("mark").alias("marks"))


def keyed_templates(spark: SparkSession, templates=TEMPLATES, least: float = LEAST) -> tuple[DataFrame, list[int]]:
    """key, template, shingle, own shingles, their number, marks; and all keys. As long as the list of templates: a proven bound."""
    if isinstance(templates, DataFrame):
        table = templates.select("template", "text").withColumn("n", F.monotonically_increasing_id())
    else:
        table = spark.createDataFrame([(n, *t) for n, t in enumerate(templates)], "n long, template string, text string")
    table = common.cut(table.select("n", "template", words_of(F.col("text")).alias("words")))
    hashed = table.select("n", "template", shingles(F.col("words")).alias("own"), shingle_hashes(F.col("words")).alias("h")).select(
        "*", F.size("h").alias("number"), F.size(F.array_distinct("own")).alias("size")
    ).where("number > 0")
    hashed = hashed.join(told_apart(hashed, least), "n", "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<array<string>>")))
    carried = ("n", "template", "own", "number", "marks")
    single = hashed.where(F.col("number") < LONG_TEMPLATE).select(*carried, F.posexplode("h").alias("shingle", "key"))
    windows = hashed.where(F.col("number") >= LONG_TEMPLATE)
    banded = reduce(DataFrame.union, [
        windows.select(*carried, F.posexplode(block_minima(F.col("h"), WINDOW, 1, F.col("number") - WINDOW + 1, b)).alias("shingle", "key"))
        for b in range(BANDS)
    ])
    keys = common.cut(single.union(banded))
    return keys, sorted({r["key"] for r in keys.select("key").collect()})


def scan(
    docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text", templates=TEMPLATES, least: float = LEAST,
) -> DataFrame:
    """One row per row of ``docs`` and template found in it: key, id, template, start_word, shingles, containment.

    containment is the share of the template's distinct five-word shingles in the stretch, at least
    ``least``; of several places the best, then the first, counts. Where a template is as good as contained in another
    one, such as another version of it, the stretch must also hold a shingle that the other one lacks: a notice
    whose version is unreadable is none of them. ``templates`` are pairs or a table of template and text, few enough
    for a driver. Templates of fewer than five words match nothing, and neither do null, empty and shorter texts. The whole text is scanned. Repeated rows are
    found each; an empty table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    known, keys = keyed_templates(spark, templates, least)
    literal = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<bigint>")
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{id_column}`").alias("id"), common.text_of(text_column).alias("text"))
    hashed = settled(settled(plain, "words", words_of(F.col("text"))).drop("text"), "h", shingle_hashes(F.col("words")))
    count = F.floor((F.size("h") + STRIDE - 1) / STRIDE).cast("int")
    blocks = settled(hashed, "minima", F.array(*[block_minima(F.col("h"), STRIDE, STRIDE, count, b) for b in range(BANDS)]))
    banded = settled(blocks, "bands", F.flatten(F.transform("minima", window_keys))).drop("minima")
    # most documents end here: nothing they hold is a key
    held = settled(banded, "met", F.array_intersect(F.concat("h", "bands"), literal)).where(F.size("met") > 0)
    places = F.concat(
        F.transform("h", lambda x, i: F.struct(x.alias("key"), i.alias("at"))),
        F.transform("bands", lambda x, i: F.struct(x.alias("key"), (F.pmod(i, count) * STRIDE).alias("at"))),
    )
    met = held.select("key", "id", "words", F.explode(F.filter(places, lambda p: F.array_contains(F.col("met"), p["key"]))).alias("place"))
    candidates = met.join(F.broadcast(known.withColumnRenamed("key", "template_key")), F.col("place.key") == F.col("template_key")).select(
        "key", "id", "words", "n", "template", "own", "number", "marks",
        F.greatest(F.col("place.at") - F.col("shingle"), F.lit(0)).alias("start"),
    )
    slack = F.greatest((F.col("number") * SLACK_SHARE).cast("int"), F.lit(LEAST_SLACK))
    low = F.greatest(F.col("start") - slack, F.lit(0))
    stretch = F.slice(F.col("words"), low + 1, F.col("number") + SHINGLE - 1 + 2 * slack)
    covered = settled(settled(candidates, "stretch", stretch), "pieces", shingles(F.col("stretch")))
    shared = F.size(F.array_intersect("own", "pieces")) / F.size(F.array_distinct("own"))
    own_version = F.forall("marks", lambda mark: F.arrays_overlap(mark, F.col("pieces")))
    best = F.max(F.struct(F.col("containment"), (-F.col("start")).alias("earlier")))
    return (
        covered.where(own_version).select("key", "id", "n", "template", "start", "number", shared.alias("containment"))
        .where(F.col("containment") >= least)
        .groupBy("key", "id", "n", "template", "number").agg(best.alias("best"))
        .select(
            "key", "id", "template", (-F.col("best.earlier")).alias("start_word"), F.col("number").alias("shingles"),
            F.col("best.containment").alias("containment"),
        )
    )


def op10(spark: SparkSession, folder: str) -> DataFrame:
    keyed, key = common.row_keyed(common.table(spark, folder, "documents"))
    return scan(keyed, key).select(F.col("id").alias("doc_id"), "template", "start_word", "shingles", "containment")
