"""Encode a corpus with a public byte-level BPE, reusing content-defined chunks.

A rolling hash over the bytes of a text marks chunk borders, so equal
passages of different documents give equal chunks wherever they stand.  Every
distinct chunk of the corpus is encoded once; the ids are joined back to the
documents and the chunk joins are repaired.

Repair: the tokenizer cuts a text into pieces (a word with its space, a run of
digits, ...) and encodes each piece alone, so ids depend only on where pieces
begin.  At a join only the last two pieces of the left chunk may change.  From
their start the text is cut anew until a piece begins where one of the
right chunk's own pieces begins; up to there the pieces are re-encoded, and
beyond it the right chunk's ids hold exactly.  If the right chunk ends first,
the open piece is carried into the next one.

Defined results: null and empty texts give an empty list; special-token
strings in a text are ordinary text; whole texts are encoded.  Rows that
repeat a document id each come out with the ids of their own text; rows
without an id are left out; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.tables import spread

TOKENIZER_DIR = os.environ.get("GRIDLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: how this vocabulary cuts a text into pieces; a fixed value of the public tokenizer
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

WINDOW = 16  # bytes that decide on a border
MASK = 0x1FF  # one border in 512 bytes on average
LEAST = 64  # bytes of a chunk at least, the last one excepted
MOST = 8192  # a border is forced after so many bytes

_PIECE = regex.compile(PIECES)
_GEAR = (np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**32, 256, dtype=np.uint64)).astype(np.uint32)


@lru_cache(4)
def encoding(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY):
    """The tokenizer, read once per process."""
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def token_bytes(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The length of every token."""
    enc = encoding(folder, vocabulary)
    return np.array([len(x) for x in enc.decode_tokens_bytes(list(range(enc.n_vocab)))], dtype=np.int64)


def cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(text, start, end) of the content-defined chunks of many texts that lie in one array of UTF-8 bytes.

    The hash of a place sums the last ``WINDOW`` bytes, the older ones shifted
    further, built by doubling.  It reads bytes of the text before only where
    no border may stand, as chunks have ``LEAST`` bytes.
    """
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    whole = (data & 0xC0) != 0x80  # a border may stand before byte i
    marks = np.flatnonzero(((h >> np.uint32(7)) & np.uint32(MASK)) == 0) + 1
    marks = marks[marks < len(data)]
    marks = marks[whole[marks]]
    first, last = np.searchsorted(marks, begin, side="right").tolist(), np.searchsorted(marks, end, side="left").tolist()
    marks = marks.tolist()
    text, start, stop = [], [], []
    for i, (a, z, lo, hi) in enumerate(zip(begin.tolist(), end.tolist(), first, last)):
        for m in [*marks[lo:hi], z]:
            while m - a > MOST:
                c = a + MOST
                while not whole[c]:
                    c -= 1
                text.append(i)
                start.append(a)
                stop.append(c)
                a = c
            if (m - a >= LEAST or m == z) and m > a:
                text.append(i)
                start.append(a)
                stop.append(m)
                a = m
    return text, start, stop


def chunks(text: str) -> list[str]:
    """Content-defined chunks; their concatenation is the text and no character is cut."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    _, start, end = cut(data, np.array([0]), np.array([len(data)]))
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start, end)]


def encode_chunk(text: str, enc=None, lengths: np.ndarray | None = None) -> tuple[list[int], int]:
    """Ids of a chunk, and how many of them stand for its open end."""
    enc = enc or encoding()
    lengths = token_bytes() if lengths is None else lengths
    ids = enc.encode_ordinary(text)
    left, n = sum(len(p.encode("utf-8", "surrogatepass")) for p in open_end(text)), 0
    while left > 0:
        n += 1
        left -= lengths[ids[-n]]
    return ids, n


def open_end(text: str) -> list[str]:
    """The last two pieces of a text, which a following text may change (``'v`` and ``e``)."""
    size = 64
    while size < len(text):
        # a space before a visible character that follows a visible one always begins a piece
        at = regex.search(r"(?<=[^\s]) (?=[^\s])", text, pos=len(text) - size)
        if at and len(found := _PIECE.findall(text, pos=at.start())) > 1:
            return found[-2:]
        size *= 4
    return _PIECE.findall(text)[-2:]


def joined(parts: list[tuple[Sequence[int], int]], enc=None, lengths: np.ndarray | None = None) -> np.ndarray:
    """Ids of the concatenated chunks: equal to encoding the whole text at once."""
    enc = enc or encoding()
    lengths = token_bytes() if lengths is None else lengths
    out: list[np.ndarray] = []
    tail: list[int] = []  # ids of the last two pieces, still open
    for ids, n in parts:
        ids = np.asarray(ids, dtype=np.int32)
        if not len(ids):
            continue
        if not tail:
            out.append(ids[: len(ids) - n])
            tail = ids[len(ids) - n :].tolist()
            continue
        left = enc.decode_bytes(tail).decode("utf-8", "surrogatepass")
        right = enc.decode_bytes(ids.tolist()).decode("utf-8", "surrogatepass")
        both, own, at, fresh = left + right, _PIECE.finditer(right), len(left), []
        agreed = False
        for m in _PIECE.finditer(both):
            if m.end() < len(left):
                fresh.append(m[0])
                continue
            while at < m.end():  # the right chunk's own pieces up to here
                at += len(next(own)[0])
            fresh.append(m[0])
            if at == m.end():
                agreed = at < len(both)
                break
        # how many of the right chunk's ids the pieces up to here took
        used = int(np.searchsorted(np.cumsum(lengths[ids]), len(both[len(left) : at].encode("utf-8", "surrogatepass")), side="right"))
        done = [enc.encode_ordinary(p) for p in fresh]
        if agreed and used < len(ids) - n:
            out += [np.array([i for x in done for i in x], dtype=np.int32), ids[used : len(ids) - n]]
            tail = ids[len(ids) - n :].tolist()
        else:  # the repair reached the right chunk's open end, which may be a single piece
            rest = ids[used:].tolist() if agreed else []
            keep = 1 if rest else 2
            out.append(np.array([i for x in done[:-keep] for i in x], dtype=np.int32))
            tail = [i for x in done[-keep:] for i in x] + rest
    return np.concatenate([*out, np.array(tail, dtype=np.int32)])


def join_chunks(parts: list[tuple[Sequence[int], int]]) -> list[int]:
    """:func:`joined` as a plain list."""
    return joined(parts).tolist()


def encode_by_chunks(text: str | None) -> list[int]:
    """The operator on one text, for tests."""
    return join_chunks([encode_chunk(c) for c in chunks(text)]) if text else []


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and where each text begins and ends in them; nothing is copied."""
    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    body = raw.buffers()[2]
    return np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8), ends[:-1], ends[1:]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """A list column of arrays of numbers."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.LargeListArray.from_arrays(ends, np.concatenate([np.zeros(0, dtype=np.int32), *parts])).cast(pa.list_(pa.int32()))


def encode_corpus(df: DataFrame, key: str, field: str, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row.

    Three shuffles: distinct chunks by their text's hash, ids back to the
    documents' chunk lists, chunk lists by document.  The texts are cut for
    the chunks and again for the lists, at the speed of the memory, rather
    than written down.  A chunk that a third of the corpus shares is combined
    on the map side and encoded once; its many references are 50-byte rows,
    and adaptive execution splits the join's partition that holds them.
    """

    def digests(data: np.ndarray, start: list[int], end: list[int]) -> list[bytes]:
        view = memoryview(data)
        return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start, end)]

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin, stop = _utf8(batch.column("t"))
            text, start, end = cut(data, begin, stop)
            text = np.array(text, dtype=np.int64)
            places = np.arange(len(text)) - np.searchsorted(text, text, side="left")
            take = pa.array(text)
            columns = [batch.column("k").take(take), batch.column("h").take(take), pa.array(places.astype(np.int32)), pa.array(digests(data, start, end), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "h", "pos", "digest"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begin, stop = _utf8(batch.column("t"))
            _, start, end = cut(data, begin, stop)
            once = {d: (a, b) for d, a, b in zip(digests(data, start, end), start, end)}
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(once), pa.binary()), pa.array([raw[a:b] for a, b in once.values()], pa.binary()).cast(pa.string())], ["digest", "body"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(folder, vocabulary), token_bytes(folder, vocabulary)
        for batch in batches:
            done = [encode_chunk(t, enc, lengths) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), _lists([np.array(x, dtype=np.int32) for x, _ in done]), pa.array([n for _, n in done], pa.int32())], ["digest", "ids", "tail"])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoding(folder, vocabulary), token_bytes(folder, vocabulary)
        for batch in batches:
            parts = batch.column("parts")
            flat = parts.flatten()
            ids = flat.field("ids")
            values, ends, tails = ids.values.to_numpy(), ids.offsets.to_numpy(), flat.field("tail").to_numpy()
            out, keys, at = [], [], 0
            for k, n, copies in zip(batch.column("k").to_pylist(), parts.value_lengths().to_pylist(), batch.column("copies").to_pylist()):
                whole = joined([(values[ends[i] : ends[i + 1]], int(tails[i])) for i in range(at, at + n)], enc, lengths)
                out += [whole] * copies
                keys += [k] * copies
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(out)], ["k", "ids"])

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(field).cast("string").alias("t")).where("k is not null")
    filled = F.coalesce(F.length("t"), F.lit(0)) > 0
    full = spread(rows.where(filled)).withColumn("h", F.xxhash64("t"))
    refs = full.mapInArrow(refer, "k bigint, h bigint, pos int, digest binary")
    book = full.select("t").mapInArrow(gather, "digest binary, body string").groupBy("digest").agg(F.first("body").alias("body")).mapInArrow(encode, "digest binary, ids array<int>, tail int")
    parts = refs.join(book, "digest").groupBy("k", "h").agg(F.sort_array(F.collect_set(F.struct("pos", "ids", "tail"))).alias("parts"), F.count_if(F.col("pos") == 0).alias("copies"))
    ids = parts.select("k", "parts", "copies").mapInArrow(repair, "k bigint, ids array<int>")
    none = rows.where(~filled).select("k", F.array().cast("array<int>").alias("ids"))
    return ids.unionByName(none).withColumnRenamed("k", key)
