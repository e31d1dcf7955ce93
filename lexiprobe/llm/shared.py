"""What the operators of this subpackage share: the checkpoint folder, cut points, sizes, joins with hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
#: Text of a block and of a bucket: UNIT bytes, and more where a block's row to a bucket would stand for less
#: than ROW_BYTES of text, up to TOP (about 2 GB of a Python worker's memory).
UNIT, TOP, ROW_BYTES = 8 << 20, 256 << 20, 32 << 10
#: Bytes of a batch of rows between Spark and a Python worker.
BATCH_BYTES = 4 << 20
#: A key of more than a HOT-th of all rows is hot, so that there are fewer than HOT of them.
HOT = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir, else the context's checkpoint folder; a temporary one, removed at
    the end of the process, only where both are unset and Spark runs on this machine alone."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    known = context._jsc.sc().getCheckpointDir()
    if place and known.isEmpty():
        context.setCheckpointDir(place)
    elif not place and known.isDefined():
        place = known.get()
    elif not place:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="lexiprobe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = f"file://{folder}"
        context.setCheckpointDir(place)
    return place


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the checkpoint folder; later reads need no earlier stage again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fewer(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df``, which has about ``rows`` rows, in no more partitions than one for ``each`` of them: small rounds leave few files."""
    return df.coalesce(max(1, -(-rows // each)))


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers BATCH_BYTES at a time, however long their texts are; a size that the session names itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(name, str(BATCH_BYTES))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """The bytes of a column's texts, and a few for each row, counted."""
    return int(df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16)).first()[0] or 0)


def deal(total: int) -> tuple[int, int]:
    """(text bytes of a block, number of buckets) for ``total`` bytes of text.

    There are as many buckets as blocks, and each block sends a row to each bucket: blocks grow with the
    root of the input, so that rows grow in proportion to it as long as blocks are below TOP.
    """
    each = min(TOP, max(UNIT, int((total * ROW_BYTES) ** 0.5)))
    return each, max(8, -(-total // each))


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups``, of which there is one row a key, whose ``size`` is the key's share of ``total`` rows.

    Hot keys meet their rows through a broadcast table of fewer than HOT rows, so that none fills a task; the rest by shuffle.
    """
    hot = F.col(size) > total // HOT
    few = F.broadcast(groups.filter(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(groups.filter(~hot), key))


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1) from the SHA-256 of the parts joined by ':' (52 bits; null parts read as 'null')."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
