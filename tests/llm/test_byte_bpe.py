"""Byte-level BPE against the tiktoken library, with places, exact round trips and odd tables."""

import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyspark.llm import byte_bpe

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(byte_bpe.RANKS)


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own():
    return byte_bpe.codec(PATH, public_tokenizers.PATTERN)


LETTERS = [
    "ab \n", "the of and 's 'll 123 .,", " \t\n\r\x0b\x0c\x1c\x85\xa0     　é x日", "éèçñ öß ",
    "日本語 한국어 \U0001F600\U0001F469‍\U0001F52C ", "́՘౜₏٣ ½Ⅷ x ", "".join(map(chr, range(1, 0x250))),
]


def texts():
    draw = random.Random(13)
    out = ["", " ", "\n", "a", "<|endoftext|>", "a" * 5_000, " " * 3_000, "ab" * 4_000 + " x", "　 x", "x \t y", "x    y"]
    out += ["".join(draw.choice(letters) for _ in range(draw.randint(0, 90))) for letters in LETTERS for _ in range(400)]
    out += ["".join(chr(draw.choice([draw.randrange(1, 0xD800), draw.randrange(0xE000, 0x110000)])) for _ in range(30)) for _ in range(400)]
    return out


def test_ids_are_those_of_tiktoken(plain):
    rows = texts()
    made = byte_bpe.encode_batch(own(), pa.array(rows), True).to_pylist()
    assert [m["ids"] for m in made] == [plain.encode_ordinary(t) for t in rows]
    assert byte_bpe.decode_batch(own(), pa.array([m["ids"] for m in made], pa.list_(pa.int32()))).to_pylist() == [t.encode() for t in rows]


def test_places_cover_the_text(plain):
    rows = texts()
    for text, m in zip(rows, byte_bpe.encode_batch(own(), pa.array(rows), True).to_pylist(), strict=True):
        assert len(m["ids"]) == len(m["starts"]) == len(m["ends"])
        at, inside = 0, 0
        for token, start, end in zip(m["ids"], m["starts"], m["ends"], strict=True):
            data = plain.decode_single_token_bytes(token)
            first = len(text.encode()[:at].decode(errors="ignore"))
            assert start == first, (text, token)
            at += len(data)
            done = text.encode()[:at]
            assert end == len(done.decode(errors="ignore")) + (done.decode(errors="ignore").encode() != done)
            inside += (data[0] & 0xC0) == 0x80
        assert at == len(text.encode()) and m["split"] == inside


def test_batches_of_few_bytes_and_few_remembered_chunks(monkeypatch, plain):
    rows = [t or None for t in texts()[:600]]
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 50)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    made = byte_bpe.encode_batch(own(), pa.array(rows).slice(3), False).to_pylist()
    assert [m["ids"] for m in made] == [plain.encode_ordinary(t or "") for t in rows[3:]]
    assert len(own().late) <= 20 and len(own().before) <= 20


def test_query_by_brute_force(spark, plain):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: r for r in byte_bpe.op13(spark, FOLDER).collect()}
    assert len(got) == len(docs)
    for r in docs:
        ids = plain.encode_ordinary(r.text or "")
        row = got[r.doc_id]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_tables(spark):
    rows = [(1, "naïve café", "x"), (1, "naïve café", "x"), (None, None, "y"), (2, "", None), (3, "w " * 200_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = byte_bpe.with_ids(docs, PATH)
    assert out.columns == ["doc_id", "text", "IDS", "ids_"]
    got = [r.ids_ for r in out.collect()]
    assert got[0] == got[1] and got[2] == got[3] == [] and len(got[4]) >= 200_000
    assert byte_bpe.with_ids(docs.limit(0), PATH).count() == 0
    back = out.select("text", byte_bpe.decoded(F.col("ids_"), PATH).cast("string").alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_ids_cut_inside_a_character(spark, plain):
    ids = plain.encode_ordinary("\U0001F9EC")
    assert len(ids) > 1
    docs = spark.createDataFrame([(ids[:1],), (ids,), (None,), ([None, -1, 10**6],)], "ids array<int>")
    got = [r[0] for r in docs.select(byte_bpe.text_of_bytes(byte_bpe.decoded(F.col("ids"), PATH))).collect()]
    assert got == ["�", "\U0001F9EC", "", "�" * 3]


def test_decoding_builds_no_tokenizer():
    import subprocess
    import sys

    code = f"""
import sys, pyarrow as pa
from tallyspark.llm import byte_bpe
made = byte_bpe.decode_batch(byte_bpe.pieces_of({PATH!r}), pa.array([[64, 272], [-1], None], pa.list_(pa.int32())))
print(made.to_pylist() == [b"a b", byte_bpe.UNKNOWN, b""], "tokenizers" in sys.modules)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120)
    assert done.stdout.split() == ["True", "False"]
