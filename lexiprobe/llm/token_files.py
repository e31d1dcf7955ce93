"""Operator 13, token ids in ORC files: stripes of run-length encoded integers, row indexes and Bloom filters on document ids.

Rows are dealt by ranges of (id, hash of the text, place of origin), so that an id that many rows share is
spread over ranges as well, sorted, and encoded while a task writes its file. Spark's ORC writer keeps
``ids`` as a list of integers (run-length encoded), an index entry every ``stride`` rows and a Bloom filter on
``doc_id`` for each. Files follow each other by ``part``; ``at`` is the number of ids before a row in its
part. A reader splits files at stripes, leaves out stripes and index groups by the minimum, maximum and
filter of ``doc_id``, and needs only the parts' totals (one number a file) to know where each document starts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm.shared import fresh_path, small_batches

#: Distinct pieces that a worker remembers from task to task (about 200 bytes each): those met since, and as many from before.
REMEMBERED = 800_000
#: Pieces of more bytes are not remembered.
LONG = 48
#: Ids of a batch of rows on its way to the writer, about.
IDS = 1 << 19
#: Parts up to this many have their offsets broadcast (16 bytes each); beyond they are joined by shuffle.
BROADCAST_PARTS = 1_000_000
_SCHEMA = "doc_id long, part int, at long, n_tokens long, ids array<int>"
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PRE_TOKEN = re.compile(rf" ?(?:[{_LATIN}]+|[0-9]+)").fullmatch


def _bytes(chars: bytes) -> np.ndarray:
    """Whether each of the 256 bytes is one of ``chars``."""
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_SPACE = _bytes(b"\t\n\v\f\r ")
_ALNUM = _bytes(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
# ASCII characters that are white space by no library: they differ on four of the controls.
_SOLID = (np.arange(256) < 128) & ~_SPACE & ~_bytes(b"\x1c\x1d\x1e\x1f")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # without the apostrophe, which begins pre-tokens of letters


def default_tokenizer() -> str:
    """Path of the public byte-level vocabulary for the tokenizers library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=2)
def splits_alone(path: str) -> bool:
    """Whether the tokenizer encodes pieces as it encodes the whole: byte-level, nothing normalised, added or cut."""
    t = _file(path)
    pre = t.get("pre_tokenizer") or {}
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    added = [a for a in t.get("added_tokens", ()) if a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) or _PRE_TOKEN(a["content"])]
    return bool(byte_level and t.get("normalizer") is None and not t.get("truncation") and not t.get("padding") and not added)


@lru_cache(maxsize=2)
def _stops(path: str) -> np.ndarray:
    """Whether each byte is punctuation that a piece may begin or end at: none that an added token holds."""
    added = "".join(a["content"] for a in _file(path).get("added_tokens", ()))
    return _bytes("".join(c for c in _PUNCTUATION if c not in added).encode())


def cut_points(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Positions in UTF-8 ``data`` where byte-level patterns always begin a pre-token, whatever stands around.

    These are starts of runs of ASCII white space, and changes between ASCII or Latin letters or digits and ``stops``.
    None is behind a character that may be white space itself: a run of white space is never cut.
    """
    space, stop = _SPACE[data], stops[data]
    at = np.flatnonzero(space[1:] > space[:-1]) + 1
    p, q, r = data[at - 1], data[at - 2], data[at - 3]  # the bytes before; a position that wraps around is not looked at
    two, three = (q >= 0xC3) & (q <= 0xDF), (q >= 0x80) & (q < 0xC0) & (r >= 0xE4) & (r <= 0xEF)  # no white space begins so
    spaces = at[_SOLID[p] | (p >= 0x80) & (two | three)]
    at = np.flatnonzero(stop[1:] != stop[:-1]) + 1
    p, q = data[at - 1], data[at - 2]
    latin = (p >= 0x80) & ((q >= 0xC4) & (q <= 0xC8) | (q == 0xC3) & (p != 0x97) & (p != 0xB7))
    return np.concatenate([spaces, at[np.where(stop[at], _ALNUM[p] | latin, _ALNUM[data[at]])]])


class Pieces(dict):
    """Ids of pieces (bytes of UTF-8) as little-endian 32-bit integers, made when they are first asked for; of old ones those asked for again stay."""

    def __init__(self, path: str):
        super().__init__()
        self.old: dict[bytes, bytes] = {}
        self.tokenizer, self.alone = _tokenizer(path), splits_alone(path)
        self.merges = self.tokenizer.model.tokenize

    def __missing__(self, piece: bytes) -> bytes:
        out = self.old.pop(piece, None)
        if out is None:
            out = self.encode(piece)
        if len(piece) <= LONG:
            if 2 * len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out

    def encode(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8")
        if self.alone and _PRE_TOKEN(text):  # a single pre-token goes to the merges at once
            letters = text if text.isascii() else piece.decode("latin-1").translate(_letters())
            ids = [t.id for t in self.merges("\u0120" + letters[1:] if text[0] == " " else letters)]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class Encoder:
    """Ids of texts as little-endian 32-bit integers; pieces that recur in a batch are looked up once, and those remembered are not encoded again."""

    def __init__(self, path: str):
        self.known, self.stops = Pieces(path), _stops(path)

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def batch(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by ``end``, and where each text's begin (one more number than texts). Null is empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        if not self.known.alone:
            made = pa.array([self.known[t] + end for t in texts.to_pylist()], pa.large_binary())
            last = np.arange(len(texts) + 1)
        else:
            pieces, last = self.pieces(texts)
            found = pieces.dictionary_encode()
            ids = [self.known[p] if p else end for p in found.dictionary.to_pylist()]
            made = pa.array(ids, pa.large_binary()).take(found.indices)
        at = np.frombuffer(made.buffers()[1], np.int64)[made.offset : made.offset + len(made) + 1]
        values = made.buffers()[2]
        return np.frombuffer(values or b"", "<u4", int(at[-1]) // 4), at[last] // 4

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all texts, an empty one behind each text, as views of their bytes; and how many there are before each text and in all."""
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        ends = bounds[1:] - bounds[0]
        within = np.zeros(len(data) + 1, bool)
        within[cut_points(data, self.stops)] = True
        within[ends] = False
        cuts = np.flatnonzero(within)
        marks = 1 + (np.diff(bounds) > 0)  # an empty text has the empty piece alone
        offsets = np.sort(np.concatenate([[0], cuts, np.repeat(ends, marks)]), kind="stable")
        last = np.concatenate([[0], np.searchsorted(cuts, ends) + np.cumsum(marks)])
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]), last


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """The worker's encoder, which later tasks find with what it knows."""
    return Encoder(path)


@lru_cache(maxsize=1)
def _letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


def _encode_sorted(path: str, end_id: int | None):
    """mapInArrow over the sorted rows of a part."""

    def run(batches):
        names = ["doc_id", "part", "at", "n_tokens", "ids"]
        part, encode = TaskContext.get().partitionId(), _encoder(path)
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        done = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, bounds = encode.batch(batch.column(1), end)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(done + bounds[:-1]), pa.array(np.diff(bounds)), lists], names)
            done += len(ids)
            each = max(1, batch.num_rows * IDS // max(1, len(ids)))
            for s in range(0, batch.num_rows, each):
                yield rows.slice(s, each)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 2, partitions: int | None = None, stripe_bytes: int = 16 << 20, stride: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the token ids of every row of ``docs`` to ORC files under ``path``: doc_id, part, at, n_tokens, ids, ascending by id.

    Rows of one id follow each other by the hash of their text; null ids come first. Null and empty
    texts have ``end_id`` alone, or no ids where that is None. Every row is written, repeated ones too; an
    empty table writes no rows. Other columns are ignored whatever their names. ``tokenizer`` is the path of a
    file of the tokenizers library that executors can read. A batch of rows is held while it is encoded, a text whole. ``stride``, the
    rows of an index entry, is at least 1,000 by the format.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    keys = ("doc_id", "tie", "place")
    dealt = (rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys).select("doc_id", "text")
    made = dealt.mapInArrow(_encode_sorted(tokenizer or default_tokenizer(), end_id), _SCHEMA)
    how = {"orc.stripe.size": stripe_bytes, "orc.row.index.stride": stride, "orc.rows.between.memory.checks": 100, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
    made.write.options(**how).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The rows of the files under ``path``; with ``ids`` only theirs, by the files' metadata: stripes and index groups that cannot hold them are not read."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    return rows if ids is None else rows.filter(F.col("doc_id").isin([int(i) for i in ids]))


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """part and before: the ids in all earlier parts. One number a part passes the driver."""
    sums = spark.read.schema(_SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    sums.sort(key=lambda r: r["part"])
    before = np.concatenate([[0], np.cumsum([r["n"] for r in sums])])[:-1].tolist() if sums else []
    out = spark.createDataFrame([(r["part"], b) for r, b in zip(sums, before, strict=True)], "part int, before long")
    return F.broadcast(out) if len(sums) <= BROADCAST_PARTS else out


def _checksums(batches):
    """mapInArrow: rows that end with a list of ids to the same ones with the list's CRC-32."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
        bounds = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], ["doc_id", "part", "at", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens and ids_crc32 of every row of the files under ``path``."""
    rows = read_tokens(spark, path).withColumn("n_tokens", F.size("ids").cast("long")).mapInArrow(_checksums, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return rows.join(token_starts(spark, path), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digests(spark, path)
