"""Merkle manifests against a tree built in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import merkle

COLUMNS = "doc_id long, lang string, text string, grp string, AT int, node int, block int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(digests, k):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][n : n + k]) for n in range(0, len(out[-1]), k)])
    return out


def proof(tree, at, k):
    steps = []
    for row in tree[:-1]:
        start = at // k * k
        steps.append(("".join(row[start:at]), "".join(row[at + 1 : start + k])))
        at //= k
    return steps


def brute(rows, k):
    """(id, lang, leaf, subroot, root, proof) of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], h(field(r[0]), field(r[1]), field(r[2]))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([d for _, d in sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], k) for g in names}
    top = levels([trees[g][-1][0] for g in names], k)
    return sorted(
        (str(i), str(g), d, trees[g][-1][0], top[-1][0], proof(trees[g], at, k) + proof(top, n, k))
        for n, g in enumerate(names)
        for at, (i, d) in enumerate(sorted(groups[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1])))
    )


def table(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], COLUMNS)
    return docs, merkle.leaf_hash([F.col("doc_id"), F.col("lang"), F.col("text")])


ROWS = [(n, "en", f"text é {n}") for n in range(37)] + [(n, None, None) for n in range(40, 49)] + [(99, "és", ""), (98, "e", "one"), (None, "e", "no id")]
ROWS += [(3, "en", "another"), (3, "en", "text é 3"), (3, "en", "text é 3")]


@pytest.mark.parametrize("k,block", [(2, 4), (2, 1024), (3, 9), (5, 30)])
def test_against_plain_python(spark, monkeypatch, k, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    docs, leaf = table(spark, ROWS)
    out = merkle.manifest(docs, leaf, fan_out=k).withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof")))
    got = out.withColumn("hash", merkle.proof_hash(F.col("proof"))).collect()
    assert all(r.folded == r.root for r in got)
    assert sorted((str(r.id), str(r.grp), r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got) == brute(ROWS, k)
    assert all(r.hash == h(*[a + b for a, b in r.proof]) for r in got)


def test_changed_rows_do_not_verify(spark):
    docs, leaf = table(spark, ROWS)
    changed = merkle.leaf_hash([F.col("doc_id"), F.col("lang"), F.when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.col("text"))])
    got = merkle.manifest(docs, leaf, other_leaf=changed).withColumn("ok", merkle.folded(F.col("other"), F.col("proof")) == F.col("root")).collect()
    assert {r.id for r in got if not r.ok} == {r[0] for r in ROWS if r[0] is not None and r[0] % 5 == 0}


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(None, "a", "x"), (None, "a", "x")], [(1, "", "x"), (2, None, "x" * 1_000_000)]])
def test_odd_tables(spark, rows):
    docs, leaf = table(spark, rows)
    got = merkle.manifest(docs, leaf).collect()
    assert sorted((str(r.id), str(r.grp), r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got) == brute(rows, 2)


def test_numbers_do_not_depend_on_partitions(spark):
    docs, leaf = table(spark, ROWS)
    first, second = (
        sorted(map(tuple, merkle.manifest(d, leaf).drop("proof").collect()), key=str) for d in (docs, docs.repartition(7))
    )
    assert first == second
