"""Operator 10, byte-level BPE: a global distinct-word shuffle.

Each block of documents splits its texts into pre-tokens, numbers its distinct
ones and sends each of them once, packed by word bucket, through a shuffle; a bucket holds all
occurrences of its words and is read in one go, so each distinct word of the corpus is encoded once. The ids return to the
blocks in a second shuffle and are laid out by position. A word in every document costs one entry a
block, so no word is hot. Decoding joins the ids with the table of token bytes, whose size is that
of the vocabulary.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm import kernels as K
from lexiprobe.llm.shared import deal, small_batches, text_bytes

_MOVED = "to long, kind int, blk long, payload binary"


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pre-token pattern of the public multilingual vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All token bytes by id, laid end to end, and their offsets."""
    table = [b""] * (1 + max(_ranks(path).values(), default=0))
    for token, rank in _ranks(path).items():
        table[rank] = token
    return np.frombuffer(b"".join(table), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int64)


def _row(to: int, kind: int, blk: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([kind], pa.int32()), pa.array([blk], pa.int64()), pa.array([payload], pa.binary())], ["to", "kind", "blk", "payload"])


def _split_words(pattern: str, buckets: int, block_chars: int):
    """mapInArrow: (doc_id, text) to one row of word numbers a block (kind 0) and its distinct words by bucket (kind 1)."""

    def run(batches):
        import regex

        findall, crosses = regex.compile(pattern).findall, regex.compile(r" \s|\s ").search
        apart = pattern == _public_pattern()
        part, nth = TaskContext.get().partitionId(), 0
        K.release()
        ids: list = []
        docs: list[np.ndarray] = []
        number: dict[str, int] = {}
        chunks: dict[str, int | list[int]] = {}  # a number alone where a part is one pre-token, as most are
        chars = 0

        def numbers(text: str) -> list[int]:
            return [number.setdefault(w, len(number)) for w in findall(text)]

        def flush():
            blk = (part << 32) | nth
            chunks.clear()  # before a block is packed, and what earlier tasks of the worker left
            K.release()
            seq = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(seq, minlength=len(number)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            lens = np.fromiter(map(len, docs), np.int64, len(docs))
            yield _row(blk % 1_000_003, 0, blk, K.pack_all(K.pack_ids(ids), K.pack(lens), K.pack_ranks(rank[seq]), len(number).to_bytes(8, "little")))
            texts = list(number)
            number.clear()
            raw = [texts[i].encode("utf-8", "surrogatepass") for i in order.tolist()]
            del texts, seq, rank
            docs.clear()
            bucket = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % buckets
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1))
            if not len(cuts):  # empty texts only
                return
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
                own = by[s:e]
                some = [raw[i] for i in own.tolist()]
                blob = K.zstandard.ZstdCompressor(level=3).compress(b"".join(some))
                yield _row(int(bucket[own[0]]), 1, blk, K.pack_all(K.pack(np.diff(own, prepend=0)), K.pack(np.fromiter(map(len, some), np.int64, len(some))), blob))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for i, text in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist(), strict=True):
                    text = text or ""
                    if not apart or crosses(text) or len(text) < 2:
                        seq = numbers(text)
                    else:  # by the public pattern a space starts a pre-token, and no run of white space crosses it: the parts can be split alone
                        first, *rest = text.split(" ")
                        seq = numbers(first)
                        for c in rest:
                            known = chunks.get(c)
                            if known is None:
                                known = numbers(" " + c)
                                known = chunks[c] = known[0] if len(known) == 1 else known
                            if type(known) is int:
                                seq.append(known)
                            else:
                                seq += known
                    ids.append(i)
                    docs.append(np.array(seq, np.uint32))
                    chars += len(text)
                    if chars >= block_chars:
                        yield from flush()
                        ids, docs, chars, nth = [], [], 0, nth + 1
                        number.clear()
                        chunks.clear()
                        K.release()
        if ids:
            yield from flush()

    return run


def _encode_words(path: str, pattern: str):
    """mapInArrow over rows sorted by bucket: word rows to the words' ids (kind 1); rows of documents pass. A bucket's words are remembered to its end."""

    def run(batches):
        encode = _encoder(path, pattern).encode_ordinary
        memo: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            for to, kind, blk, payload in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if to != bucket:
                    bucket = to
                    memo.clear()
                if kind == 0:
                    yield _row(0, 0, blk, payload)
                    continue
                own, lens, blob = K.unpack_all(payload)
                lens = K.unpack(lens).astype(np.int64)
                text = K.zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(1, int(lens.sum())))
                out, counts, at = [], [], 0
                for n in lens.tolist():
                    w = text[at : at + n]
                    at += n
                    ids = memo.get(w)
                    if ids is None:
                        ids = memo[w] = encode(w.decode("utf-8", "surrogatepass"))
                    out += ids
                    counts.append(len(ids))
                yield _row(0, 1, blk, K.pack_all(own, K.pack(np.array(counts, np.int64)), K.pack(np.array(out, np.int64))))

    return run


def _spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... lens[i] of them, for each i in turn."""
    total = np.cumsum(lens)
    return np.arange(int(total[-1]) if len(total) else 0) + np.repeat(starts - (total - lens), lens)


def _assemble(table: pa.Table) -> pa.Table:
    """One block: word numbers and the words' ids to each document's ids."""
    docs, number, counts, ids = None, [], [], []
    for kind, payload in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True):
        parts = K.unpack_all(payload)
        if kind == 0:
            docs = parts
        else:
            number.append(np.cumsum(K.unpack(parts[0]).astype(np.int64)))
            counts.append(K.unpack(parts[1]).astype(np.int64))
            ids.append(K.unpack(parts[2]).astype(np.uint32))
    doc_ids, lens, seq = K.unpack_ids(docs[0]), K.unpack(docs[1]).astype(np.int64), K.unpack_ranks(docs[2])
    words = int.from_bytes(docs[3], "little")
    at, many = np.zeros(words, np.int64), np.zeros(words, np.int64)
    if number:
        where, much, flat = np.concatenate(number), np.concatenate(counts), np.concatenate(ids)
        if len(where) != words:
            raise RuntimeError(f"a block has {words} distinct words but got the ids of {len(where)}")
        at[where], many[where] = np.cumsum(much) - much, much
    out, n_tokens, done = [], [], 0
    for n in lens.tolist():
        own = seq[done : done + n]
        done += n
        tokens = flat[_spread(at[own], many[own])] if n else np.zeros(0, np.uint32)
        out.append(tokens.astype("<u4").tobytes())
        n_tokens.append(len(tokens))
    seq = flat = at = many = None
    K.release()
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(out, pa.binary())})


def bpe_encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every row of ``docs``.

    Null and empty texts have no tokens. Rows are encoded alone, so null and repeated ids keep their
    rows; an empty table gives none. Other columns are ignored whatever their names. A text longer
    than a block is a block of its own. ``path`` must be readable on the executors.
    """
    default_path, default_pattern = default_vocabulary() if path is None or pattern is None else (path, pattern)
    path, pattern = path or default_path, pattern or default_pattern
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    each, n = (0, 0) if block_chars and buckets else deal(text_bytes(docs))
    moved = docs.mapInArrow(_split_words(pattern, buckets or n, block_chars or each), _MOVED).repartition("to").sortWithinPartitions("to")
    back = moved.mapInArrow(_encode_words(path, pattern), _MOVED)
    return back.groupBy("blk").applyInArrow(_assemble, "doc_id long, n_tokens long, ids binary")


def _decode(path: str):
    def run(batches):
        data, offsets = _token_bytes(path)
        lens = np.diff(offsets)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for raw in part.column(part.schema.get_field_index("ids")).to_pylist():
                    ids = np.frombuffer(raw or b"", "<u4").astype(np.int64)
                    # pieces of 64k tokens bound the index arrays
                    out.append(b"".join(data[_spread(offsets[x], lens[x])].tobytes() for x in np.array_split(ids, 1 + len(ids) // 65536)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    return run


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (of :func:`bpe_encode`) with the column decoded: the ids joined with the tokens' bytes. Null ids decode to no bytes."""
    path = path or default_vocabulary()[0]
    encoded = encoded.select(*(c for c in encoded.columns if c != "decoded"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decode(path), f"{schema}, decoded binary")


def bpe_digests(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    both = bpe_decode(bpe_encode(docs, **how), how.get("path"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
