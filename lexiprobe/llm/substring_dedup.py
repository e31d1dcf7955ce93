"""Operator 4, substring dedup by compaction of a de Bruijn graph over tokens.

A window of k words is an edge of the graph (its first and last k-1 words are the nodes). Each block
of documents hashes its windows and keeps its own first occurrence of every edge, so that a passage
in a third of all documents costs one entry a block. The entries are dealt by hash, sorted and packed,
into buckets; a bucket finds the earliest source coordinate (document, position) of each repeated
edge. Repeated edges return to their block, where chains of edges whose source coordinates advance
together, which no branch interrupts, are compacted into paths (start, edges, source). The sources of
all paths are then read by their coordinates, and a path stays only if the words of its span and of its
source are the same by a second digest, of the words themselves. The words that such paths cover are
removed.

Edges are found by 64-bit hashes of their words: with n windows about n**2 / 2**65 of all pairs collide
by chance. Such a path fails the verification and removes nothing; a window that repeats elsewhere too
is then missed, which takes a collision with an earlier window on top of a repetition.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm import kernels as K
from lexiprobe.llm.shared import WHITE, cut, deal, small_batches, spread_join, text_bytes

#: Bytes of text that a window stands for, about, in the size of a block.
WINDOW_BYTES = 6
#: Where null ids sort: behind all others.
NULL_ID = np.iinfo(np.int64).max
_MOVED = "to long, kind int, blk long, payload binary"
_PATHS = "doc_id long, paths array<struct<start:int,edges:int,source_doc:long,source_start:int>>"


def _row(to: int, kind: int, blk: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([kind], pa.int32()), pa.array([blk], pa.int64()), pa.array([payload], pa.binary())], ["to", "kind", "blk", "payload"])


def _pack_ids(ids: np.ndarray) -> bytes:
    low = int(ids.min(initial=NULL_ID)) if len(ids) else 0
    return low.to_bytes(8, "little", signed=True) + K.pack(ids.view(np.uint64) - np.uint64(low & 0xFFFFFFFFFFFFFFFF))


def _unpack_ids(blob: bytes) -> np.ndarray:
    low = int.from_bytes(blob[:8], "little", signed=True)
    return (K.unpack(blob[8:]) + np.uint64(low & 0xFFFFFFFFFFFFFFFF)).view(np.int64)


def _pack_found(doc, start, source_doc, source_start) -> bytes:
    return K.pack_all(_pack_ids(doc), K.pack(start), _pack_ids(source_doc), K.pack(source_start))


def _unpack_found(blob: bytes) -> tuple:
    a, b, c, d = K.unpack_all(blob)
    return _unpack_ids(a), K.unpack(b).astype(np.int64), _unpack_ids(c), K.unpack(d).astype(np.int64)


def _repeats(edge: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by edge; where each edge's run begins; for each place of the order the index of its edge's earliest coordinate."""
    order = np.argsort(edge)
    e = edge[order]
    head = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]])) if len(e) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(e)))
    many = np.repeat(size > 1, size)
    if many.any():
        some = order[many]
        order[many] = some[np.lexsort((start[some], doc[some], edge[some]))]
    return order, head, np.repeat(order[head], size)


def _later(order, first, doc, start):
    """Of the order's places, those that start later than their edge's first coordinate."""
    return (doc[order] != doc[first]) | (start[order] != start[first])


def _edges(k: int, buckets: int, block_windows: int, bits: int):
    def run(batches):
        part, nth, held = TaskContext.get().partitionId(), 0, 0
        parts: list[tuple] = []

        def flush():
            blk = (part << 32) | nth
            edge, doc, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order, head, first = _repeats(edge, doc, start)
            late = _later(order, first, doc, start)
            a, b = order[late], first[late]
            if len(a):
                yield _row(blk % 1_000_003, 0, blk, _pack_found(doc[a], start[a], doc[b], start[b]))
            own = order[head]  # sorted by edge, first coordinates only
            cuts = np.searchsorted(edge[own], (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets).clip(0, (1 << 64) - 1).astype(np.uint64))
            cuts[-1] = len(own)
            for i, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if e > s:
                    x = own[s:e]
                    gaps = np.diff(edge[x], prepend=np.uint64(0))
                    yield _row(i, 1, blk, K.pack_all(K.pack(gaps), _pack_ids(doc[x]), K.pack(start[x])))

        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = K.text_buffer(batch.column(1))
            for i, j in K.pieces(offsets):
                starts, ends, of = K.words(data, offsets[i : j + 1])
                edge = K.rolling(K.spans_hash(data, starts, ends), k)
                if bits < 64:
                    edge = edge << np.uint64(64 - bits)
                lens = np.maximum(np.diff(of) - k + 1, 0)
                if not lens.sum():
                    continue
                within = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
                parts.append((edge[np.repeat(of[:-1], lens) + within], np.repeat(ids[i:j], lens), within))
                held += len(within)
                if held >= block_windows:
                    yield from flush()
                    parts.clear()
                    K.release()
                    nth, held = nth + 1, 0
        if parts:
            yield from flush()

    return run


def _firsts(table: pa.Table) -> pa.Table:
    """One bucket: the edges of blocks whose earliest coordinate is elsewhere; rows of kind 0 pass."""
    out_blk, out_payload = [], []
    blks, edges, docs, starts = [], [], [], []
    for kind, blk, payload in zip(*(table.column(c).to_pylist() for c in ("kind", "blk", "payload")), strict=True):
        if kind == 0:
            out_blk.append(blk)
            out_payload.append(payload)
            continue
        gaps, doc, start = K.unpack_all(payload)
        edges.append(np.cumsum(K.unpack(gaps), dtype=np.uint64))
        docs.append(_unpack_ids(doc))
        starts.append(K.unpack(start).astype(np.int32))
        blks.append(blk)
    if blks:
        edge, doc, start = np.concatenate(edges), np.concatenate(docs), np.concatenate(starts)
        of = np.repeat(np.arange(len(blks), dtype=np.int32), [len(e) for e in edges])
        edges = docs = starts = None
        order, _, first = _repeats(edge, doc, start)
        late = _later(order, first, doc, start)
        a, b = order[late], first[late]
        by = np.argsort(of[a], kind="stable")
        a, b = a[by], b[by]
        cuts = np.searchsorted(of[a], np.arange(len(blks) + 1))
        for i, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if e > s:
                x, y = a[s:e], b[s:e]
                x, y = x[z := np.lexsort((start[x], doc[x]))], y[z]
                out_blk.append(blks[i])
                out_payload.append(_pack_found(doc[x], start[x], doc[y], start[y]))
    blks = edge = doc = start = of = order = first = a = b = None
    K.release()
    return pa.table({"blk": pa.array(out_blk, pa.int64()), "payload": pa.array(out_payload, pa.binary())})


def _compact(table: pa.Table) -> pa.Table:
    """One block: its repeated edges to paths by document."""
    found = [_unpack_found(p) for p in table.column("payload").to_pylist()]
    doc, start, source_doc, source_start = (np.concatenate([f[i] for f in found]) for i in range(4))
    order = np.lexsort((source_start, source_doc, start, doc))
    doc, start, source_doc, source_start = doc[order], start[order], source_doc[order], source_start[order]
    same = (doc[1:] == doc[:-1]) & (source_doc[1:] == source_doc[:-1]) & (start[1:] == start[:-1] + 1) & (source_start[1:] == source_start[:-1] + 1)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    edges = np.diff(np.append(head, len(doc)))
    own = doc[head]
    cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    paths = pa.StructArray.from_arrays(
        [pa.array(start[head], pa.int32()), pa.array(edges, pa.int32()), pa.array(source_doc[head], pa.int64(), mask=source_doc[head] == NULL_ID), pa.array(source_start[head], pa.int32())],
        ["start", "edges", "source_doc", "source_start"],
    )
    lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(own)), pa.int32()), paths)
    return pa.table({"doc_id": pa.array(own[cuts], pa.int64(), mask=own[cuts] == NULL_ID), "paths": lists})


def repeated_paths(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", block_windows: int | None = None, buckets: int | None = None, bits: int = 64) -> DataFrame:
    """doc_id and its compacted paths of repeated edges, for documents that have any.

    A path (start, edges, source_doc, source_start) says that the document's words start ..
    start + edges + k - 2 repeat those from source_start on of source_doc, where each of the path's
    windows occurs first (smallest document, then smallest start), as the hashes say. ``bits`` of each hash
    count; fewer than 64 make collisions likely.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    each, n = (0, 0) if block_windows and buckets else deal(text_bytes(docs))
    found = docs.mapInArrow(_edges(k, buckets or n, block_windows or each // WINDOW_BYTES, bits), _MOVED).groupBy("to").applyInArrow(_firsts, "blk long, payload binary")
    paths = found.groupBy("blk").applyInArrow(_compact, _PATHS)
    return paths.groupBy("doc_id").agg(F.flatten(F.collect_list("paths")).alias("paths"))


def _digests(text: str | None, spans: list) -> list[int | None]:
    """A 64-bit digest of each span (first word, words) of a text's words, joined by blanks; None where the text has no such span."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends, _ = K.words(raw, np.array([0, len(raw)]))
    data = raw.tobytes()

    def digest(s: int, n: int) -> int | None:
        if s + n > len(starts):
            return None
        words = b" ".join([data[a:b] for a, b in zip(starts[s : s + n].tolist(), ends[s : s + n].tolist(), strict=True)])
        return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)

    return [digest(s, n) for s, n in spans]


def _say(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, own in zip(text, spans, strict=True):
        said = _digests(t, [(x["s"], x["words"]) for x in own])
        out.append([{"s": x["s"], "words": x["words"], "said": d} for x, d in zip(own, said, strict=True) if d is not None])
    return pd.Series(out)


def sourced_paths(docs: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """``paths`` (doc_id, paths) with the digest of each path's words as its source has them (said); ``docs`` are doc_id and text.

    A source span that many paths name is read once, and joined with them through a small table if they are very many.
    """
    words = F.col("p.edges") + (k - 1)
    key = F.xxhash64("p.source_doc", "p.source_start", words)
    one = cut(paths.select("doc_id", F.explode("paths").alias("p")).select("doc_id", "p", key.alias("key")))
    asked = one.groupBy(F.col("p.source_doc").alias("__doc")).agg(F.collect_set(F.struct(F.col("p.source_start").alias("s"), words.alias("words"))).alias("spans"))
    read = docs.join(asked, docs.doc_id.eqNullSafe(F.col("__doc")))
    say = F.pandas_udf(_say, "array<struct<s:int,words:int,said:long>>")
    said = read.select("doc_id", F.explode(say("text", "spans")).alias("x")).select(F.xxhash64("doc_id", "x.s", "x.words").alias("key"), F.col("x.said").alias("said"))
    # rows that repeat an id may each have such a span: any of them will do
    said = said.groupBy("key").agg(F.collect_set("said").alias("said"))
    said = cut(said.join(one.groupBy("key").agg(F.count(F.lit(1)).alias("paths")), "key"))
    both = spread_join(one, said, "key", "paths", one.count())
    return both.groupBy("doc_id").agg(F.collect_list(F.struct("p.start", "p.edges", "p.source_doc", "p.source_start", "said")).alias("paths"))


def _remove(k: int):
    @F.pandas_udf("kept string, n_removed long, paths array<struct<start:int,edges:int,source_doc:long,source_start:int>>")
    def remove(text: pd.Series, paths: pd.Series) -> pd.DataFrame:
        out, gone, held = [], [], []
        for t, own in zip(text, paths, strict=True):
            if t is None or own is None:
                out.append(None)
                gone.append(0)
                held.append(None)
                continue
            raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
            starts, ends, _ = K.words(raw, np.array([0, len(raw)]))
            cover = np.zeros(len(starts) + 1, np.int64)
            said = _digests(t, [(p["start"], p["edges"] + k - 1) for p in own])
            true = [p for p, d in zip(own, said, strict=True) if d is not None and d in p["said"]]
            for p in true:
                cover[p["start"]] += 1
                cover[p["start"] + p["edges"] + k - 1] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            gone.append(int((~keep).sum()))
            data = raw.tobytes()
            out.append(b" ".join([data[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode("utf-8", "surrogatepass"))
            held.append([{c: p[c] for c in ("start", "edges", "source_doc", "source_start")} for p in true])
        return pd.DataFrame({"kept": out, "n_removed": gone, "paths": held})

    return remove


def substring_dedup(docs: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and paths, for every row.

    Null and empty texts, and those of under ``k`` words, lose nothing. A null id is behind all
    others in the order of documents. Rows that share an id are one document: a window never counts
    as repeated at its own place, and what repeats elsewhere goes from those of them that hold it.
    An empty table gives no rows; other columns are ignored whatever their names.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    paths = sourced_paths(docs, repeated_paths(docs, k, **how), k).withColumnRenamed("doc_id", "__doc")
    row = docs.join(paths, docs.doc_id.eqNullSafe(F.col("__doc")), "left").drop("__doc")
    plain = F.trim(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), WHITE, " "))
    row = row.select("doc_id", plain.alias("plain"), _remove(k)(F.when(F.col("paths").isNotNull(), F.col("text")), F.col("paths")).alias("cut"))
    n_words = F.when(F.col("plain") == "", F.lit(0)).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1)
    return row.select("doc_id", n_words.cast("long").alias("n_words"), F.col("cut.n_removed").alias("n_removed"), F.coalesce("cut.kept", "plain").alias("kept"), F.col("cut.paths").alias("paths"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
v AS (SELECT doc_id, p, word, count(*) OVER o AS n, string_agg(word, ' ') OVER o AS win FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS nth FROM v WHERE n = 20),
l AS (SELECT v.doc_id, v.p, v.word, max(CASE WHEN f.nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY v.doc_id ORDER BY v.p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM v LEFT JOIN f ON v.doc_id = f.doc_id AND v.p = f.p),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone = 1) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM l GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
