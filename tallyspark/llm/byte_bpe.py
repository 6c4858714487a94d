"""Byte-level BPE encoding and decoding with the tokenizers library, batch by Arrow batch.

The library merges characters, the ranks merge bytes. Each byte is therefore written as one printable
character (the usual table: printable Latin-1 bytes stand for themselves, the others for characters from
U+0100 on); the library's own byte-level step does the same to the text and keeps, for every token, its
place in the original characters. Decoding looks up the characters of each id, reverses the table and puts the bytes
together before it reads any of them as UTF-8, so characters that are split between tokens come back whole.

Within a batch a text is first cut into chunks, where a space or line feed follows a character that is no
white space. No match of the pattern crosses such a place, so each distinct chunk is encoded once and its
ids are put where the chunk stands; a worker remembers chunks from batch to batch, up to REMEMBERED. A worker that
decodes reads the bytes of the ids only, and builds no tokenizer.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import common

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of texts that are encoded at a time; a longer text is encoded alone, whole.
AT_ONCE = 1 << 20
#: Chunks a worker remembers, twice (those of late and those before), and the characters of the longest one it does.
REMEMBERED, LONGEST = 1 << 16, 64
#: Chunks that go through the library in one call.
A_CALL = 1 << 14
#: What an id that the vocabulary lacks decodes to.
UNKNOWN = "�".encode()



def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@dataclass
class Pieces:
    """The bytes of each id of one rank file, and those of an unknown one behind them."""

    pieces: pa.Array


@dataclass
class Codec(Pieces):
    """A tokenizer for one rank file, the bytes of its ids, and the chunks met of late."""

    tokenizer: object
    inside: np.ndarray  # whether a token begins inside a character
    late: dict[str, bytes] = field(default_factory=dict)
    before: dict[str, bytes] = field(default_factory=dict)

    def encode(self, chunks: list[str], places: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of each chunk, and all ids; with ``places`` (id, first code point, the one after the last) instead of an id."""
        counts, out = [np.zeros(0, np.int64)], [np.zeros((0, 3) if places else 0, np.int32)]
        for n in range(0, len(chunks), A_CALL):
            some = chunks[n : n + A_CALL]
            made = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(made.ids, np.int32)
            counts.append(np.bincount(np.array(made.word_ids, np.int64), minlength=len(some)))
            out.append(np.column_stack([ids, np.array(made.offsets, np.int32).reshape(-1, 2)]) if places else ids)
        return np.concatenate(counts), np.concatenate(out)

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each chunk, and all ids, with chunks met of late looked up."""
        held = [self.late.get(c) or self.before.get(c) for c in chunks]
        new = [n for n, h in enumerate(held) if h is None]
        counts, ids = self.encode([chunks[n] for n in new], False)
        data, ends = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
        for n, start, end in zip(new, [0, *ends], ends, strict=False):
            held[n] = data[start:end]
            if len(chunks[n]) <= LONGEST:
                if len(self.late) >= REMEMBERED:
                    self.late, self.before = {}, self.late
                self.late[chunks[n]] = held[n]
        return np.array([len(h) // 4 for h in held], np.int64), np.frombuffer(b"".join(held), np.int32)


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def pieces_of(path: str) -> Pieces:
    token_of = {rank: token for token, rank in ranks_of(path).items()}
    return Pieces(pa.array([*(token_of.get(n, UNKNOWN) for n in range(max(token_of) + 1)), UNKNOWN], pa.large_binary()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = ranks_of(path)
    of = byte_characters()
    name = {token: "".join(of[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        halves = [(token[:n], token[n:]) for n in range(1, len(token))]
        halves = [(a, b) for a, b in halves if a in ranks and b in ranks]
        merges += [(name[a], name[b]) for a, b in sorted(halves, key=lambda h: (ranks[h[0]], ranks[h[1]]))]
    # a match that is a token by itself is taken as it is, as the ranks demand
    model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    inside = np.zeros(max(ranks.values()) + 1, bool)
    for token, rank in ranks.items():
        inside[rank] = token != UNKNOWN and 0x80 <= token[0] < 0xC0
    return Codec(pieces_of(path).pieces, tokenizer, inside)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a space or line feed follows a character that is surely no white space."""
    if len(data) < 2:
        return np.zeros(0, np.int64)
    gap = (data == 0x20) | (data == 0x0A)
    before = np.concatenate([np.zeros(3, np.uint8), data[:-1]])
    one, two, three = before[2:], before[1:-1], before[:-2]
    plain = (one > 0x20) & (one < 0x7F)
    # two-byte characters from U+00C0 on and four-byte or higher three-byte ones hold no white space
    wide = (one >= 0x80) & (((two >= 0xC3) & (two <= 0xDF)) | ((three >= 0xE4) & (two >= 0x80) & (two < 0xC0)))
    return np.flatnonzero(gap & (plain | wide))


def buffers(texts: pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of ``texts``, null as empty."""
    texts = pa.concat_arrays([texts.cast(kind).fill_null("" if pa.types.is_large_string(kind) else b"")])
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def groups(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of about AT_ONCE bytes."""
    out, start, held = [], 0, 0
    for n, size in enumerate(sizes.tolist()):
        if n > start and held + size > AT_ONCE:
            out.append((start, n))
            start, held = n, 0
        held += size
    return [*out, (start, len(sizes))] if len(sizes) else out


def encode_some(own: Codec, texts: pa.Array, places: bool) -> pa.StructArray:
    offsets, data = buffers(texts, pa.large_string())
    # a text begins a chunk, an empty one has none
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cuts(data)]))
    bounds = np.append(starts, len(data)).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data.tobytes()))
    distinct = strings.dictionary_encode()
    at = np.asarray(distinct.indices, np.int64) if len(starts) else np.zeros(0, np.int64)
    chunks = distinct.dictionary.to_pylist()
    counts, made = own.encode(chunks, True) if places else own.ids(chunks)
    # the tokens of the chunk at each place, one behind the other
    per_chunk, lists = counts[at], np.concatenate([[0], np.cumsum(counts)])
    before = np.concatenate([[0], np.cumsum(per_chunk)])
    where = np.arange(before[-1]) + np.repeat(lists[at] - before[:-1], per_chunk)
    flat = made[where]
    first = np.searchsorted(starts, offsets)  # first chunk of each text
    rows = before[first]
    ids = flat[:, 0] if places else flat
    columns = {"ids": ids}
    if places:
        letters = np.array([len(c) for c in chunks], np.int64)[at]
        passed = np.concatenate([[0], np.cumsum(letters)])
        shift = np.repeat(passed[:-1] - np.repeat(passed[first[:-1]], np.diff(first)), per_chunk)
        columns |= {"starts": flat[:, 1] + shift, "ends": flat[:, 2] + shift}
    lists_of = {n: pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array(c, pa.int32())) for n, c in columns.items()}
    split = np.diff(np.concatenate([[0], np.cumsum(own.inside[ids])])[rows])
    return pa.StructArray.from_arrays([*lists_of.values(), pa.array(split, pa.int32())], [*lists_of, "split"])


def encode_batch(own: Codec, texts: pa.Array, places: bool) -> pa.StructArray:
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    parts = [encode_some(own, texts.slice(a, b - a), places) for a, b in groups(sizes)]
    return pa.concat_arrays(parts or [encode_some(own, texts, places)])


def decode_some(own: Pieces, ids: pa.Array) -> pa.Array:
    ids = pa.concat_arrays([ids])
    rows = np.asarray(ids.offsets, np.int64)
    wanted = np.asarray(ids.values.slice(rows[0], rows[-1] - rows[0]).fill_null(-1))
    last = len(own.pieces) - 1
    wanted = np.where((wanted < 0) | (wanted >= last), last, wanted)
    bounds, data = buffers(own.pieces.take(pa.array(wanted)), pa.large_binary())
    own_bounds = pa.py_buffer(bounds[rows - rows[0]])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, own_bounds, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def decode_batch(own: Pieces, ids: pa.Array) -> pa.Array:
    sizes = 4 * np.asarray(pc.list_value_length(ids))
    return pa.concat_arrays([decode_some(own, ids.slice(a, b - a)) for a, b in groups(sizes)] or [decode_some(own, ids)])


def encoded(text: Column, path: str, pattern: str = public_tokenizers.PATTERN, places: bool = False) -> Column:
    """Struct of a text: ids; with ``places`` the first code point of each token and the one after its last; split.

    ``path`` is a file of base64 tokens and ranks that every executor sees. Each match of ``pattern`` is merged by
    itself, without special tokens; a pattern must not match a space or line feed behind a character that is no white space.
    A token that holds a part of a character has the place of the whole character; split counts the tokens
    that begin inside a character. Null and empty texts have no ids. Texts are encoded whole, whatever their length.
    """

    kept = ["ids", "starts", "ends"] if places else ["ids"]

    @F.arrow_udf(", ".join([*[f"{n} array<int>" for n in kept], "split int"]))
    def apply(texts: pa.Array) -> pa.Array:
        return encode_batch(codec(path, pattern), texts, places)

    return apply(text.cast("string"))


def decoded(ids: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes of an array of ids. A null array counts as empty; a null or unknown id gives the bytes of U+FFFD."""

    @F.arrow_udf("binary")
    def apply(lists: pa.Array) -> pa.Array:
        return decode_batch(pieces_of(path), lists)

    return apply(F.coalesce(ids.cast("array<int>"), F.array().cast("array<int>")))


def text_of_bytes(data: Column) -> Column:
    """Bytes as text; a part of a character, as in ids cut inside one, becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def with_ids(
    docs: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids", pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """``docs`` with the ids of the text in a new column, named ``ids_column`` with underscores until no column has that name.

    Null and empty texts have an empty array; repeated rows are encoded alike; an empty table gives no rows.
    """
    held = common.fresh(docs, "_encoded")
    name = common.fresh(docs, ids_column)
    made = docs.withColumn(held, encoded(F.col(f"`{text_column}`"), path, pattern))
    return made.withColumn(name, F.col(f"{held}.ids")).drop(held)


def digest_of_ids(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256)


def op13(spark: SparkSession, folder: str) -> DataFrame:
    """split_tokens counts the tokens that begin inside a character."""
    path = public_tokenizers.path(RANKS)
    docs = common.table(spark, folder, "documents").select("doc_id", encoded(F.col("text"), path).alias("e"))
    docs = docs.select("doc_id", F.col("e.ids").alias("ids"), F.col("e.split").alias("split_tokens"))
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest_of_ids(F.col("ids")).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), path), 256).alias("decoded_sha256"), F.col("split_tokens").cast("long").alias("split_tokens"),
    )
