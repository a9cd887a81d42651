"""Token ids of every text by a public tokenizer, long texts in parallel by tree concatenation.

Texts of up to `limit` characters are encoded whole on the workers. Longer ones are cut into pieces that travel as rows
of their own and are encoded wherever there is room; their ids are then concatenated pairwise, as a tree.

- A cut between a non-space and a white-space character is exact: the tokenizer's first step never joins the two.
- Inside unsplit text (no such place within a piece) the cut may fall inside a token. Then a window around the join is
  encoded again, and grown until its first token agrees with the left ids and its last with the right ids. Byte-pair
  encoding is a matter of neighbouring tokens: a sequence is the encoding of its text as soon as every two neighbours
  are, so agreement at both edges makes the concatenation equal to the encoding of the whole.

Defined results: null and empty texts give an empty list, blank texts are encoded as they are, strings that look like
special tokens are ordinary text. One row per input row; equal rows give equal lists.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
LIMIT = 1 << 16
OUT = "doc_id long, ids array<int>"
# Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache
def _tokenizer(path: str):
    import tiktoken

    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache
def _bytes_of(path: str) -> dict[int, bytes]:
    """The bytes behind each id."""
    return {rank: token for token, rank in _ranks(path).items()}


def encode_batch(texts: list[str], path: str) -> list[list[int]]:
    encode_one = _tokenizer(path).encode_ordinary
    return [encode_one(t) for t in texts]


def pieces(text: str, size: int) -> list[tuple[str, bool]]:
    """The text in pieces of about `size`, each with whether the cut before it is exact by itself."""
    out, start, exact = [], 0, True
    while len(text) - start > size:
        stop = start + size
        at = next((p for p in range(stop, start + size // 2, -1) if text[p].isspace() and not text[p - 1].isspace()), 0)
        out.append((text[start : at or stop], exact))
        start, exact = at or stop, bool(at)
    return [*out, (text[start:], exact)]


def _edge(ids: list[int], n: int, from_left: bool, of: dict[int, bytes]) -> tuple[int, bytes]:
    """The last (first) tokens, n or a few more, so that they start (end) at a whole character."""
    while True:
        n = min(n, len(ids))
        held = b"".join(of[i] for i in (ids[len(ids) - n :] if from_left else ids[:n]))
        try:
            text = held.decode()
        except UnicodeDecodeError:
            text = None
        if n == len(ids) or (text is not None and (from_left or not text[-1:].isspace())):
            return n, held
        n += 1


def join(left: list[int], right: list[int], path: str, start: int = 8) -> list[int]:
    """Ids of the concatenated text from the ids of its halves."""
    if not left or not right:
        return left + right
    of, n = _bytes_of(path), start
    while True:
        a, head = _edge(left, n, True, of)
        b, tail = _edge(right, n, False, of)
        window = encode_batch([(head + tail).decode()], path)[0]
        fits_left = a == len(left) or window[:2] == left[len(left) - a :][:2]
        fits_right = b == len(right) or window[-2:] == right[:b][-2:]
        if fits_left and fits_right:
            return left[: len(left) - a] + window + right[b:]
        n *= 2


def concatenate(parts: list[tuple[list[int], bool]], path: str) -> list[int]:
    """All pieces of one text, pairwise as a tree; `exact` tells of the cut before each piece."""
    while len(parts) > 1:
        parts = [reduce(lambda x, y: (x[0] + y[0] if y[1] else join(x[0], y[0], path), x[1]), parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0][0] if parts else []


def _lists(rows: list[list[int]]) -> pa.ListArray:
    offsets = [0]
    for row in rows:
        offsets.append(offsets[-1] + len(row))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([i for row in rows for i in row], pa.int32()))


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, ids) of every row."""
    path = f"{folder}/{tokenizer}.tiktoken"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = encode_batch([x or "" for x in part.column("text").to_pylist()], path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "n", "text")])
            cut = [(row, i, n, k, t, ok) for row, i, n, x in rows for k, (t, ok) in enumerate(pieces(x, limit))]
            schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("k", pa.int32()), ("text", pa.string()), ("exact", pa.bool_())])
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, c)) for c in cut], schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _lists(encode_batch(batch.column("text").to_pylist(), path))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "n", "k", "exact")], ids], ["row", "doc_id", "n", "k", "exact", "ids"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [concatenate([(p["ids"], p["exact"]) for p in row], path) for row in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(done), batch.column("n")], ["doc_id", "ids", "n"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    short = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= limit).mapInArrow(whole, OUT)
    # Equal rows travel once; the name of a row is made of what it holds, so that a task run again gives the same one.
    held = rows.where(F.length("text") > limit).groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    long = (
        held.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "n", "text")
        .mapInArrow(split, "row long, doc_id long, n long, k int, text string, exact boolean")
        .repartition("row", "k")
        .mapInArrow(parts, "row long, doc_id long, n long, k int, exact boolean, ids array<int>")
        .groupBy("row", "doc_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("k", "exact", "ids"))).alias("parts"))
        .mapInArrow(merged, OUT + ", n long")
    )
    again = F.explode(F.sequence(F.lit(1), "n")).alias("copy")
    return short.unionByName(long.select("doc_id", "ids", again).drop("copy"))
