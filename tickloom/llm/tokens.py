"""Encoding of a whole corpus with a public byte-level BPE, and decoding.

Short texts are encoded where they are read, in Arrow batches, without a shuffle. Long ones are cut
into overlapping chunks that are pre-tokenised in parallel. Pre-tokenising from a true boundary
depends only on what follows, so two chunks agree from the first boundary that both have in their
overlap: there the text is cut, and the pieces between cuts are encoded in parallel. A chunk is
trusted from the first white space after a word on, as that begins a pre-token in any case; where
there is none, or no common boundary, chunks stay one piece. The ids are exactly those of encoding
the whole text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.skew import kept

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512

# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that decide where a match ends, beyond its end (the longest contraction).
LOOK = 4

_split = regex.compile(PATTERN)
#: White space after anything else always begins a pre-token, wherever pre-tokenising began; found from the end.
_sure = regex.compile(r"(?r)\S\s")
_space = regex.compile(r"\s")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """The text whose encoding is ``ids``: the tokens' bytes, put together."""
    raw = {v: k for k, v in ranks(path).items()}
    return b"".join(raw[i] for i in ids).decode("utf-8", errors="replace")


def boundaries(chunk: str, last: bool, begin: int = 0, until: int | None = None) -> list[int]:
    """Ends of the pre-tokens of ``chunk`` from ``begin`` to ``until`` at which a text may be cut.

    Matches that end at, or begin close to, the end of a chunk might go on in the text. After white
    space a cut would change how that is divided, as its last character goes to the next word.
    """
    out = []
    limit = len(chunk) if last else len(chunk) - LOOK
    for m in _split.finditer(chunk, begin):
        if not last and (m.start() >= limit or m.end() >= len(chunk)) or until is not None and m.end() >= until:
            break
        if not _space.match(chunk, m.end() - 1):
            out.append(m.end())
    return out


def _ids(texts: list[str | None], path: str, count: bool) -> pa.Array:
    e = encoding(path)
    parts = [e.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in texts]
    lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    if count:
        return pa.array(lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = (np.concatenate(parts) if parts else np.zeros(0)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _encoder(keep: list[str], text: str, path: str, count: bool, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = 2_000
            for at in range(0, max(whole.num_rows, 1), step):
                b = whole.slice(at, step)
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], _ids(b.column(text).to_pylist(), path, count)], names=[*keep, name])

    return run


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = -(-len(text) // chunk)
                for lo in range(0, n, 64):
                    some = range(lo, min(n, lo + 64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(some)), pa.array(list(some), pa.int32()), pa.array([i == n - 1 for i in some]), pa.array([text[i * chunk : (i + 1) * chunk + overlap] for i in some])],
                        names=["key", "i", "last", "chunk"],
                    )

    return run


def _ends(chunk: int, overlap: int):
    """Boundaries in the overlaps: of a chunk with the one before (head) and the one after (tail).

    The tail is pre-tokenised from the last white space before it that follows a word, which begins
    a pre-token; without one only the first chunk, which begins the text, has a tail to trust.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for i, last, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                heads.append([b + i * chunk for b in boundaries(text, last, 0, overlap)])
                sure = _sure.search(text, 0, chunk)
                begin = sure.start() + 1 if sure else 0
                tails.append([b + i * chunk for b in boundaries(text, last, begin) if b >= chunk] if sure or i == 0 else [])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, kind), pa.array(tails, kind)], names=["key", "i", "head", "tail"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for key, text, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            at = [0, *sorted(set(cuts or [])), len(text)]
            for lo in range(0, len(at) - 1, 64):
                some = range(lo, min(len(at) - 1, lo + 64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(some)), pa.array(list(some), pa.int32()), pa.array([text[at[j] : at[j + 1]] for j in some])], names=["key", "j", "piece"]
                )


def encode_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, count_only: bool = False, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """``key`` and ``ids`` (or ``n_tokens``) of every row, without special tokens.

    NULL and empty texts have the empty list (0 tokens). Strings of special tokens in a text are
    ordinary text. Repeated rows and NULL keys come out as often as they go in; copies of a long
    text are encoded once. Other columns are not read.
    """
    name, kind = ("n_tokens", "long") if count_only else ("ids", "array<int>")
    docs = docs.select(key, F.col(text).alias("_text"))
    key_kind = docs.schema[key].dataType.simpleString()
    is_long = F.coalesce(F.length("_text") > chunk, F.lit(False))
    short = docs.where(~is_long).mapInArrow(_encoder([key], "_text", path, count_only, name), f"{key} {key_kind}, {name} {kind}")

    # the long texts are read from storage once; the branches below share them
    keyed = kept(docs.where(is_long).withColumn("_key", F.sha2("_text", 256)))
    texts = keyed.groupBy("_key").agg(F.first("_text").alias("text")).select(F.col("_key").alias("key"), "text")
    chunks = texts.mapInArrow(_chunks(chunk, overlap), "key string, i int, last boolean, chunk string").repartition("key", "i")
    ends = chunks.mapInArrow(_ends(chunk, overlap), "key string, i int, head array<long>, tail array<long>")
    after = F.lead("head").over(Window.partitionBy("key").orderBy("i"))  # a few numbers for each chunk of a text
    cuts = ends.withColumn("after", after).groupBy("key").agg(F.collect_list(F.array_min(F.array_intersect("tail", "after"))).alias("cuts"))
    pieces = texts.join(cuts, "key", "left").select("key", "text", "cuts").mapInArrow(_pieces, "key string, j int, piece string").repartition("key", "j")
    coded = pieces.mapInArrow(_encoder(["key", "j"], "piece", path, count_only, name), f"key string, j int, {name} {kind}")
    if count_only:
        whole = coded.groupBy("key").agg(F.sum(name).alias(name))
    else:
        whole = coded.groupBy("key").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("j", name))), lambda s: s[name])).alias(name))
    long = keyed.select(key, "_key").join(whole, F.col("_key") == F.col("key")) if key != "key" else keyed.select(F.col(key).alias("_id"), "_key").join(whole, F.col("_key") == F.col("key")).drop("key").withColumnRenamed("_id", "key")
    return short.unionByName(long.select(key, name))
