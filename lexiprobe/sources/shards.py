"""Activation stores as NumPy shards: a Spark data source that plans partitions, prunes layers and leaves skipped rows out.

A store is a folder with ``meta.json`` (layers, and what the model was), ``index.jsonl`` (a line a row: occurrence_id,
occurrence_type, problem_id, function, variable, row, perhaps skip) and ``shard.npy`` (rows x layers x width, or rows x
width of one layer). A path holds one store, or folders of them with ``_stores.jsonl``, which the writer commits
last and which alone is read. Partitions are ranges of bytes of an index; a partition reads its rows of the shard.
A dump is a folder with ``layer_<k>.npy``, ``labels.npy``, ``programs.npy`` and ``meta.json``; its partitions are ranges of rows of a layer.
Files are opened by pyarrow, on what ``fs`` the path names.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from lexiprobe.sources.tables import ACTIVATION

FORMAT = "activations"
_STORES = "_stores.jsonl"


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _exists(fs: pa.fs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pa.fs.FileType.File


def _text(fs: pa.fs.FileSystem, path: str) -> str:
    with fs.open_input_stream(path) as f:
        return f.read().decode("utf-8")


class Npy:
    """A .npy file of plain numbers or fixed-width text whose rows are read by range."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        version = np.lib.format.read_magic(self.file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.file)
        if fortran or self.dtype.hasobject:
            raise ValueError(f"{path} is not an array of plain values in rows")
        self.start = self.file.tell()
        self.width = int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize

    def __enter__(self) -> Npy:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def rows(self, first: int, last: int) -> np.ndarray:
        self.file.seek(self.start + first * self.width)
        raw = self.file.read((last - first) * self.width)
        return np.frombuffer(raw, self.dtype).reshape(last - first, *self.shape[1:])


@dataclass
class Piece(InputPartition):
    """A part of a store or dump: bytes of an index, or rows of a layer's file."""

    path: str
    kind: str
    layers: list[int]
    all_layers: list[int]
    first: int
    last: int


class ShardReader(DataSourceReader):
    def __init__(self, path: str, index_bytes: int, dump_rows: int):
        self.path, self.index_bytes, self.dump_rows = path, index_bytes, dump_rows
        self.layers: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what is asked of ``layer``; the rest is left to Spark."""
        for f in filters:
            asked = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if asked is not None and getattr(f, "attribute", None) == ("layer",):
                self.layers = asked if self.layers is None else self.layers & asked
            else:
                yield f

    def _stores(self, fs: pa.fs.FileSystem, root: str) -> Iterator[tuple[str, dict]]:
        if _exists(fs, f"{root}/{_STORES}"):
            for line in _text(fs, f"{root}/{_STORES}").splitlines():
                entry = json.loads(line)
                yield f"{root}/{entry.pop('store')}", entry
        elif _exists(fs, f"{root}/meta.json"):
            yield root, json.loads(_text(fs, f"{root}/meta.json"))
        else:
            raise ValueError(f"no finished store at {root}")

    def partitions(self) -> list[Piece]:
        """The pieces that can hold asked layers; stores without one are not opened."""
        fs, root = _open(self.path)
        out = []
        for store, meta in self._stores(fs, root):
            dump = _exists(fs, f"{store}/labels.npy")
            layers = list(range(meta["n_layers"])) if dump else meta.get("layers")
            if layers is None:  # a store that does not say: as many as its shard has
                with Npy(fs, f"{store}/shard.npy") as shard:
                    layers = list(range(shard.shape[1] if len(shard.shape) == 3 else 1))
            asked = [k for k in layers if self.layers is None or k in self.layers]
            if not asked:
                continue
            size, step = (meta["n_used"], self.dump_rows) if dump else (fs.get_file_info(f"{store}/index.jsonl").size, self.index_bytes)
            for own in [[k] for k in asked] if dump else [asked]:
                out += [Piece(store, "dump" if dump else "store", own, layers, at, min(at + step, size)) for at in range(0, size, step)]
        return out

    def read(self, piece: Piece) -> Iterator[tuple]:
        fs, _ = _open(self.path)
        yield from self._read_dump(fs, piece) if piece.kind == "dump" else self._read_store(fs, piece)

    def _read_dump(self, fs: pa.fs.FileSystem, piece: Piece) -> Iterator[tuple]:
        (layer,) = piece.layers
        with Npy(fs, f"{piece.path}/layer_{layer}.npy") as x, Npy(fs, f"{piece.path}/labels.npy") as y, Npy(fs, f"{piece.path}/programs.npy") as p:
            for at in range(piece.first, piece.last, 1024):
                end = min(at + 1024, piece.last)
                for i, vec, label, program in zip(range(at, end), x.rows(at, end), y.rows(at, end), p.rows(at, end), strict=True):
                    yield f"{program}:{i}", str(program), str(label), None, None, layer, vec.astype(np.float32).tolist()

    def _lines(self, fs: pa.fs.FileSystem, piece: Piece) -> Iterator[dict]:
        """The lines that begin in the piece's bytes."""
        with fs.open_input_file(f"{piece.path}/index.jsonl") as f:
            at = piece.first
            f.seek(max(0, at - 1))
            text = io.BufferedReader(f, 1 << 16)
            if at:
                at += len(text.readline()) - 1  # up to the newline of the line before
            while at < piece.last and (line := text.readline()):
                at += len(line)
                if line.strip():
                    yield json.loads(line)

    def _read_store(self, fs: pa.fs.FileSystem, piece: Piece) -> Iterator[tuple]:
        with Npy(fs, f"{piece.path}/shard.npy") as shard:
            for r in self._lines(fs, piece):
                if r.get("skip"):
                    continue
                row = shard.rows(r["row"], r["row"] + 1)[0].reshape(len(piece.all_layers), -1)
                for k, layer in enumerate(piece.all_layers):
                    if layer in piece.layers:
                        yield r["occurrence_id"], str(r.get("problem_id")), r.get("occurrence_type"), r.get("variable"), r.get("function"), layer, row[k].astype(np.float32).tolist()


@dataclass
class Written(WriterCommitMessage):
    stores: list[dict]


class ShardWriter(DataSourceWriter):
    """Each task writes stores of one layer and at most ``rows`` rows; the list of stores is written when all tasks are done."""

    def __init__(self, path: str, overwrite: bool, rows: int, meta: dict):
        self.path, self.overwrite, self.most, self.meta = path, overwrite, rows, meta

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        fs, root = _open(self.path)
        context, done = TaskContext.get(), []
        waiting: dict[int, list] = {}

        def flush(layer: int) -> None:
            rows = waiting.pop(layer)
            name = f"store-{context.partitionId()}-{context.taskAttemptId()}-{len(done)}"
            fs.create_dir(f"{root}/{name}", recursive=True)
            vectors = np.array([r["vec"] for r in rows], np.float32)
            raw = io.BytesIO()
            np.save(raw, vectors.reshape(len(rows), 1, -1), allow_pickle=False)
            index = "".join(json.dumps({"row": i, "occurrence_id": r["occurrence_id"], "problem_id": r["problem_id"], "occurrence_type": r["label"], "variable": r["variable"], "function": r["function"]}) + "\n" for i, r in enumerate(rows))
            meta = self.meta | {"layers": [layer], "dtype": "float32", "shape": [len(rows), 1, vectors.shape[1]]}
            for file, data in (("shard.npy", raw.getvalue()), ("index.jsonl", index.encode()), ("meta.json", json.dumps(meta).encode())):
                with fs.open_output_stream(f"{root}/{name}/{file}") as f:
                    f.write(data)
            done.append(meta | {"store": name})

        for row in iterator:
            waiting.setdefault(row["layer"], []).append(row)
            if len(waiting[row["layer"]]) >= self.most or sum(map(len, waiting.values())) >= 4 * self.most:
                flush(max(waiting, key=lambda k: len(waiting[k])))
        for layer in list(waiting):
            flush(layer)
        return Written(done)

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        old = _text(fs, f"{root}/{_STORES}") if _exists(fs, f"{root}/{_STORES}") and not self.overwrite else ""
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{_STORES}") as f:
            f.write((old + "".join(json.dumps(s) + "\n" for m in messages if m for s in m.stores)).encode())

    def abort(self, messages) -> None:
        """Stores that no list names are never read."""


class ActivationSource(DataSource):
    """``spark.read.format("activations")``; options path, index_bytes (of a partition), dump_rows; for writes store_rows and meta (JSON)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ACTIVATION

    def reader(self, schema: T.StructType) -> ShardReader:
        return ShardReader(self.options["path"].rstrip("/"), int(self.options.get("index_bytes", 8 << 20)), int(self.options.get("dump_rows", 50_000)))

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"].rstrip("/"), overwrite, int(self.options.get("store_rows", 4096)), json.loads(self.options.get("meta", "{}")))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ActivationSource)


def read_shards(spark: SparkSession, path: str, layers: list[int] | None = None, **options) -> DataFrame:
    """The rows of stores or of a dump under ``path``, of ``layers`` alone if given; skipped rows are left out."""
    register(spark)
    rows = spark.read.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(path)
    return rows if layers is None else rows.filter(F.col("layer").isin([int(k) for k in layers]))


def write_shards(rows: DataFrame, path: str, meta: dict | None = None, store_rows: int = 4096, mode: str = "overwrite") -> None:
    """Stores of ``rows`` (the columns of ACTIVATION); a task holds at most four times ``store_rows`` vectors."""
    register(rows.sparkSession)
    names = [f.split(" ")[0] for f in ACTIVATION.split(", ")]
    rows.select(*names).write.format(FORMAT).mode(mode).options(store_rows=str(store_rows), meta=json.dumps(meta or {})).save(path)


def store_exists(path: str) -> bool:
    """Whether a finished store or dump is there."""
    fs, root = _open(path)
    return _exists(fs, f"{root}/{_STORES}") or _exists(fs, f"{root}/meta.json") and (_exists(fs, f"{root}/labels.npy") or _exists(fs, f"{root}/shard.npy"))


def store_meta(path: str) -> dict:
    """What a store says of itself; of several, the first one's."""
    fs, root = _open(path)
    if _exists(fs, f"{root}/{_STORES}"):
        return json.loads(_text(fs, f"{root}/{_STORES}").split("\n")[0] or "{}")
    return json.loads(_text(fs, f"{root}/meta.json"))


def read_tensors(spark: SparkSession, path: str, pooling: str = "mean") -> DataFrame:
    """name and vec of the .npz files under ``path``, the array ``pooling`` of each; files without it are left out."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def unpack(content: pd.Series) -> pd.Series:
        out = []
        for raw in content:
            with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                out.append(z[pooling].astype(np.float32).ravel() if pooling in z else None)
        return pd.Series(out, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), unpack("content").alias("vec")).filter("vec IS NOT NULL")


def write_tensors(rows: DataFrame, path: str, pooling: str = "mean") -> None:
    """One .npz a row of (name, vec), with the array ``pooling``; a name must be a plain file name. A file is written whole or not at all."""

    def run(batches):
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for name, vec in zip(batch["name"], batch["vec"], strict=True):
                if not re.fullmatch(r"[\w.-]+", name):
                    raise ValueError(f"{name!r} is no plain file name")
                raw = io.BytesIO()
                np.savez(raw, **{pooling: np.array(vec, np.float32)})
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(raw.getvalue())
            yield pd.DataFrame({"n": [len(batch)]})

    rows.select("name", "vec").mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()
