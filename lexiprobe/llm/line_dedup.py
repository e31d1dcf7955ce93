"""Operator 8, line dedup: hashes range-partitioned with a secondary sort by document.

Each document gives one entry for each of its distinct long lines (128-bit hash, positions). Entries are
range-partitioned and sorted by (hash, document descending); as the document is part of the range
key, a line in a third of all documents spreads over many partitions. Of each partition only its
first and last hash are summed up and sent to the driver (two rows a partition), so that a hash cut
by a boundary is judged by all its documents. Each partition is then read once, in order, with a few
rows of state: the first document seen of a hash is the largest and keeps its lines, the others lose
theirs once there are enough documents. What comes back for a document is a compressed bitmap of the
lines it keeps, never text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiprobe.llm import kernels as K
from lexiprobe.llm.shared import cut

_ENTRY = "hi long, lo long, doc_id long, row long, n_lines int, lines array<int>"
_NONE = np.iinfo(np.int64).min  # a null id is below all others


def row_hash(text: Column) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _line_entries(min_chars: int):
    def run(batches):
        rng = np.random.default_rng(77)
        other = rng.permutation(256).astype(np.uint8)[K.LOWER]
        dark = ~K._WHITE
        for batch in batches:
            ids = batch.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = K.text_buffer(batch.column(2))
            for i, j in K.pieces(offsets):
                offs = offsets[i : j + 1]
                breaks = np.flatnonzero(data[offs[0] : offs[-1]] == 10) + offs[0]
                of = np.searchsorted(offs, breaks, "right") - 1
                counts = np.bincount(of, minlength=j - i) + 1
                first = np.cumsum(counts) - counts
                starts, ends = np.empty(int(counts.sum()), np.int64), np.empty(int(counts.sum()), np.int64)
                at = np.arange(len(breaks)) + of  # place of the line that a break ends
                ends[at], starts[at + 1] = breaks, breaks + 1
                starts[first], ends[first + counts - 1] = offs[:-1], offs[1:]
                # strip: first and last byte that is no white space
                seen = np.concatenate([[0], np.cumsum(dark[data[offs[0] : offs[-1]]])])
                place = np.append(np.flatnonzero(dark[data[offs[0] : offs[-1]]]) + offs[0], offs[-1])
                a, b = seen[starts - offs[0]], seen[ends - offs[0]]
                full = b > a
                starts[full], ends[full] = place[a[full]], place[b[full] - 1] + 1
                chars = np.concatenate([[0], np.cumsum((data[offs[0] : offs[-1]] & 0xC0) != 0x80)])
                long = np.flatnonzero(full & (chars[ends - offs[0]] - chars[starts - offs[0]] >= min_chars))
                if not len(long):
                    continue
                hi = K.spans_hash(data, starts[long], ends[long], K.LOWER).view(np.int64)
                lo = K.spans_hash(data, starts[long], ends[long], other).view(np.int64)
                doc = np.repeat(np.arange(j - i), counts)[long]
                pos = long - first[doc]
                order = np.lexsort((pos, lo, hi, doc))
                doc, hi, lo, pos = doc[order], hi[order], lo[order], pos[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
                lines = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)), pa.int32()), pa.array(pos, pa.int32()))
                d = doc[new]
                own = ids[i:j][d]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hi[new]), pa.array(lo[new]), pa.array(own, mask=own == _NONE), pa.array(rows[i:j][d]), pa.array(counts[d], pa.int32()), lines],
                    ["hi", "lo", "doc_id", "row", "n_lines", "lines"],
                )

    return run


def _columns(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    return get("hi").to_numpy(zero_copy_only=False), get("lo").to_numpy(zero_copy_only=False), get("doc_id").fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)


def _boundaries(batches):
    """Of a sorted partition: documents and largest document of its first and its last hash."""
    runs: list = []  # the first run and the last: [hi, lo, documents, largest, smallest]
    for batch in batches:
        hi, lo, doc = _columns(batch)
        if not len(hi):
            continue
        heads = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])).tolist()
        for s, e in sorted({(0, [*heads, len(hi)][1]), (heads[-1], len(hi))}):
            own = doc[s:e]
            run = [int(hi[s]), int(lo[s]), 1 + int((own[1:] != own[:-1]).sum()), int(own[0]), int(own[-1])]
            if runs and runs[-1][:2] == run[:2]:
                runs[-1][2] += run[2] - (runs[-1][4] == run[3])
                runs[-1][4] = run[4]
            else:
                runs = [*runs[:1], run]
    rows = runs
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays(
        [pa.array([part] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(5))],
        ["part", "nth", "hi", "lo", "docs", "largest", "smallest"],
    )


def _merged(rows: list) -> dict[tuple[int, int], tuple[int, int]]:
    """(documents, largest document) of the hashes at boundaries; ``rows`` in the partitions' order."""
    out: dict = {}
    for r in rows:
        docs, largest, smallest = out.get((r["hi"], r["lo"]), (0, r["largest"], None))
        out[r["hi"], r["lo"]] = (docs + r["docs"] - (smallest == r["largest"]), largest, r["smallest"])
    return {k: (d, m) for k, (d, m, _) in out.items()}


def _losers(least_docs: int, known: dict):
    """Sorted entries to those whose lines go."""

    def run(batches):
        held = None  # rows of the last hash, as long as it has too few documents to judge
        judged = None  # (hi, lo, keeper) of a last hash that has been judged
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            held = None
            if not table.num_rows:
                continue
            batch = table.to_batches()[0]
            hi, lo, doc = _columns(batch)
            heads = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
            size = np.diff(np.append(heads, len(hi)))
            step = np.concatenate([[0], np.cumsum(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (doc[1:] != doc[:-1])]))])
            docs = step[heads + size] - step[heads]
            keeper, goes = doc[heads].copy(), docs >= least_docs
            for i in {0, len(heads) - 1}:
                key = (int(hi[heads[i]]), int(lo[heads[i]]))
                if key in known:
                    goes[i], keeper[i] = known[key][0] >= least_docs, known[key][1]
                elif judged is not None and judged[:2] == key:
                    goes[i], keeper[i] = True, judged[2]
                elif i == len(heads) - 1 and not goes[i]:
                    held = batch.slice(int(heads[i]))
            last = len(heads) - 1
            judged = (int(hi[heads[last]]), int(lo[heads[last]]), int(keeper[last])) if goes[last] else None
            out = np.repeat(goes, size) & (doc != np.repeat(keeper, size))
            yield batch.filter(pa.array(out)).select(["doc_id", "row", "n_lines", "lines"])

    return run


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for n, lines in zip(n_lines, gone, strict=True):
        keep = np.ones(n, np.uint8)
        keep[np.asarray(lines, np.int64)] = 0
        out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
    return pd.Series(out)


def line_bitmaps(docs: DataFrame, min_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (:func:`row_hash`), n_lines, keep (zlib-compressed bits, first line first), for rows that lose lines."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(text).alias("row"), text.alias("text"))
    entries = cut(docs.mapInArrow(_line_entries(min_chars), _ENTRY))
    order = [F.col("hi"), F.col("lo"), F.desc_nulls_last("doc_id")]
    ranged = cut(entries.repartitionByRange(*order).sortWithinPartitions(*order))
    ends = ranged.select("hi", "lo", "doc_id").mapInArrow(_boundaries, "part int, nth int, hi long, lo long, docs long, largest long, smallest long")
    known = _merged(sorted(ends.collect(), key=lambda r: (r["part"], r["nth"])))
    gone = ranged.mapInArrow(_losers(least_docs, known), "doc_id long, row long, n_lines int, lines array<int>")
    gone = gone.groupBy("doc_id", "row").agg(F.max("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))
    return gone.select("doc_id", "row", "n_lines", _bitmap("n_lines", "gone").alias("keep"))


@F.pandas_udf(T.StructType().add("kept", "string").add("n_dropped", "long"))
def _apply(text: pd.Series, keep: pd.Series) -> pd.DataFrame:
    out, gone = [], []
    for t, bits in zip(text, keep, strict=True):
        if bits is None:
            out.append(None)
            gone.append(0)
            continue
        lines = (t or "").split("\n")
        stay = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[: len(lines)].tolist()
        out.append("\n".join([x for x, s in zip(lines, stay, strict=True) if s]))
        gone.append(len(lines) - sum(stay))
    return pd.DataFrame({"kept": out, "n_dropped": gone})


def line_dedup(docs: DataFrame, min_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept (the lines left, joined by newlines), for every row of ``docs``.

    Null and empty texts are one empty line and lose nothing. A null id is below all others; rows
    that share an id are one document where documents are counted, and each keeps or loses its own
    lines. A text that loses all its lines is empty. An empty table gives no rows; other columns are
    ignored whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    maps = line_bitmaps(docs, min_chars, least_docs).select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), "keep")
    row = docs.withColumn("row", row_hash(F.col("text")))
    row = row.join(maps, row.doc_id.eqNullSafe(F.col("__doc")) & (F.col("row") == F.col("__row")), "left")
    plain = F.coalesce(F.col("text"), F.lit(""))
    row = row.select("doc_id", plain.alias("plain"), _apply(F.when(F.col("keep").isNotNull(), F.col("text")), F.col("keep")).alias("cut"))
    n_lines = F.length("plain") - F.length(F.replace("plain", F.lit("\n"), F.lit(""))) + 1
    return row.select("doc_id", n_lines.cast("long").alias("n_lines"), F.col("cut.n_dropped").alias("n_dropped"), F.coalesce("cut.kept", "plain").alias("kept"))


OP8_SQL = r"""
WITH l AS (SELECT doc_id, p, ls[p] AS line, regexp_replace(regexp_replace(translate(ls[p], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d, range(1, len(ls) + 1) r(p)),
h AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN h USING (k) GROUP BY doc_id
"""


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
