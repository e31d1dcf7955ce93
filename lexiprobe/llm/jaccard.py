"""Operator 6, n-gram Jaccard join over prefix trees.

1. Documents are dealt into blocks. Each block sends its distinct shingles, packed by hash range, to
   buckets that count in how many sets each occurs; the counts return to the block. Sets are ordered
   by (count class, hash), the same order everywhere; of those with equal sets one goes on (a class).
2. Two sets over the threshold share a shingle of their prefixes. Shingles that occur once cannot be
   shared, so most sets end here; the others enter the groups of their prefix's shingles.
3. A group never forms all its pairs. Its most central class is tested against the rest (a star), and
   components of these links name what is known to be joined. Only groups of several components go on:
   their classes meet in chunks, and a pair of two components is a candidate if lengths, positions and
   the parities of its sets' hashes, which bound how far the sets differ, leave room for the overlap.
   The best candidate of a class in each other component is tested first, and all that are left after
   the components were joined by what that found are tested then: no link between components is lost.
4. A test puts the candidates of a probe into a trie of the sets in descending order of counts, where
   near copies share their beginnings, and walks it once: candidates share partial overlaps, and
   subtrees end where what remains cannot reach the overlap needed. Candidates come in chunks.
5. The components give every document the smallest id it reaches.

Shingles are 64-bit hashes; sets are told apart by 128-bit digests of theirs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm import kernels as K
from lexiprobe.llm.components import connected_components
from lexiprobe.llm.shared import cut, deal, fewer, small_batches, spread_join, text_bytes

#: Sets of a trie, and classes of either side of a chunk of a group.
CHUNK, MEMBERS = 512, 2_048
#: Bits of a set's parities: about twice its size, within these bounds.
LEAST_BITS, MOST_BITS = 256, 4_096
#: Bytes of parities, and pairs of a chunk, that are compared at once.
PARITY_BYTES, PAIRS = 8 << 20, 1 << 17
_FOLD = np.uint64(24)  # occurrences are counted by a hash's upper 40 bits: any function of the shingle gives a valid order


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document (A-Z lowered); under k words the whole sequence is one."""
    out: list[np.ndarray] = []
    for i, j in K.pieces(offsets):
        starts, ends, of = K.words(data, offsets[i : j + 1])
        h = K.spans_hash(data, starts, ends, K.LOWER)
        grams = K.rolling(h, k)
        for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            else:
                out.append(K.rolling(h[a:b], b - a) * np.uint64(3) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _block_sets(table: pa.Table, k: int) -> tuple[list[np.ndarray], list]:
    """The sets of a block's rows and their digests (None for the empty set)."""
    col = table.column("text").combine_chunks()
    sets: list[np.ndarray] = []
    for chunk in col.chunks if isinstance(col, pa.ChunkedArray) else [col]:
        sets += shingle_sets(*K.text_buffer(chunk), k)
    return sets, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]


def _distinct(sets: list, digests: list) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a block, sorted, and how many of its distinct sets hold each."""
    one = list({d: s for s, d in zip(sets, digests, strict=True) if d is not None}.values())
    return np.unique(np.concatenate(one), return_counts=True) if one else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    edges = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64) >> _FOLD << _FOLD
    return np.append(np.searchsorted(values, edges), len(values))


def _entries(k: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        blk = table.column("blk")[0].as_py()
        shingles, counts = _distinct(*_block_sets(table, k))
        to, payload = [], []
        cuts = _cuts(shingles, buckets)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            s, e = int(cuts[b]), int(cuts[b + 1])
            if e > s:
                to.append(b)
                payload.append(K.pack_all(K.pack(np.diff(shingles[s:e] >> _FOLD, prepend=np.uint64(0))), K.pack(counts[s:e])))
        K.release()
        return pa.table({"to": pa.array(to, pa.int64()), "blk": pa.array([blk] * len(to), pa.int64()), "payload": pa.array(payload, pa.binary())})

    return run


def _count(table: pa.Table) -> pa.Table:
    """One bucket: each block's entries to classes of their counts in all blocks (0: once; else 1 + log2)."""
    parts = [K.unpack_all(p) for p in table.column("payload").to_pylist()]
    folds = [np.cumsum(K.unpack(p[0]), dtype=np.uint64) for p in parts]
    # rows of one hash range may repeat a fold within a block; they count together
    _, which = np.unique(np.concatenate(folds), return_inverse=True)
    total = np.bincount(which, np.concatenate([K.unpack(p[1]) for p in parts]).astype(float))
    classes = np.where(total > 1, 1 + np.floor(np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
    out, done = [], 0
    for f in folds:
        out.append(K.pack(classes[which[done : done + len(f)]]))
        done += len(f)
    parts = folds = which = total = classes = None
    K.release()
    return pa.table({"to": table.column("to"), "blk": table.column("blk"), "codes": pa.array(out, pa.binary())})


_MEMBER = "doc_id long, n int, digest binary, first int, grams binary"


def _ordered(k: int, percent: int):
    """A block's rows and its shingles' counts: per row its set's size and digest; once per distinct set, if its prefix may be shared, the ordered set."""

    def run(rows: pa.Table, codes: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "digest": pa.array([], pa.binary()), "first": pa.array([], pa.int32()), "grams": pa.array([], pa.binary())})
        sets, digests = _block_sets(rows, k)
        shingles, _ = _distinct(sets, digests)
        order = np.argsort(codes.column("to").to_numpy())
        blobs = codes.column("codes").to_pylist()
        code = np.concatenate([K.unpack(blobs[i]).astype(np.uint8) for i in order.tolist()]) if len(order) else np.zeros(0, np.uint8)
        if len(code) != len(shingles):
            raise RuntimeError(f"a block has {len(shingles)} shingles but got the counts of {len(code)}")
        first, grams, done = [], [], set()
        for s, d in zip(sets, digests, strict=True):
            first.append(None)
            grams.append(None)
            if d is None or d in done:
                continue
            done.add(d)
            c = code[np.searchsorted(shingles, s)]
            n, once = len(s), int((c == 0).sum())
            if once < n - (-(-percent * n // 100)) + 1:
                first[-1] = once
                grams[-1] = s[np.lexsort((s, c))].astype("<u8").tobytes()
        K.release()
        return pa.table({
            "doc_id": rows.column("doc_id"), "n": pa.array([len(s) for s in sets], pa.int32()), "digest": pa.array(digests, pa.binary()),
            "first": pa.array(first, pa.int32()), "grams": pa.array(grams, pa.binary()),
        })

    return run


def _prefixes(percent: int):
    """mapInArrow: ordered sets to the shingles of their prefixes that may be shared, with their positions."""

    def run(batches):
        for batch in batches:
            token, key, size, pos = [], [], [], []
            for d, n, first, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                upto = n - (-(-percent * n // 100)) + 1
                token.append(np.frombuffer(raw, "<i8")[first:upto])
                key += [d] * (upto - first)
                size += [n] * (upto - first)
                pos += range(first, upto)
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), pa.array(key, pa.binary()), pa.array(size, pa.int32()), pa.array(pos, pa.int32())], ["token", "key", "n", "pos"])

    return run


def trie_overlaps(probe: np.ndarray, candidates: list[np.ndarray], percent: int) -> list[int]:
    """Which candidates have 100 * overlap >= percent * union with ``probe``; all sets in one global order.

    The candidates, read from the order's far end, stand as paths of a trie. Its paths are walked in
    depth-first order: what a candidate shares with the one before keeps its partial overlaps.
    """
    inside = np.sort(probe)
    paths = [c[::-1] for c in candidates]
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
    found: list[int] = []
    before = np.zeros(0, np.uint64)
    overlap = np.zeros(1, np.int64)  # overlap[d]: of the first d shingles of the path before; valid as far as it was walked
    for i in order:
        path = paths[i]
        need = -(-percent * (len(probe) + len(path)) // (100 + percent))
        m = min(len(before), len(path))
        differ = before[:m] != path[:m]
        depth = min(int(differ.argmax()) if differ.any() else m, len(overlap) - 1)
        overlap = overlap[: depth + 1]
        before = path
        while depth < len(path) and overlap[-1] + len(path) - depth >= need:
            step = path[depth : depth + 64]
            at = np.searchsorted(inside, step).clip(0, len(inside) - 1)
            overlap = np.concatenate([overlap, overlap[-1] + np.cumsum(inside[at] == step)])
            depth += len(step)
        if depth == len(path) and overlap[-1] >= need:
            found.append(i)
    return sorted(found)


def _walk(percent: int):
    """mapInArrow over rows sorted by (a, chunk, b nulls first): the probe's set, then its candidates' sets, to links."""

    def run(batches):
        probe = key = None
        held: list = []

        def links():
            if probe is None or not held:
                return
            got = trie_overlaps(probe, [h[1] for h in held], percent)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(got), pa.binary()), pa.array([held[i][0] for i in got], pa.binary())], ["u", "v"])

        for batch in batches:
            for a, chunk, b, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if b is None:
                    yield from links()
                    probe, key, held = np.frombuffer(raw, "<u8"), (a, chunk), []
                else:
                    held.append((b, np.frombuffer(raw, "<u8")))
        yield from links()
        probe, held = None, []
        K.release()

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among ``pairs`` (a, b) of keys of ``sets`` (key, n, grams)."""
    pairs = cut(pairs.distinct())
    n = pairs.count()
    pairs = fewer(pairs, n)
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).withColumn("chunks", F.ceil(F.col("c") / CHUNK).cast("int"))
    pairs = spread_join(pairs, sizes, "a", "c", n).select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    rows = pairs.join(sets.select(F.col("key").alias("b"), "grams"), "b").select("a", "chunk", "b", "grams")
    probes = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("binary").alias("b"))
    probes = probes.join(sets.select(F.col("key").alias("a"), "grams"), "a").select("a", "chunk", "b", "grams")
    dealt = probes.unionByName(rows).repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
    return dealt.mapInArrow(_walk(percent), "u binary, v binary")


def parities(hashes: np.ndarray) -> bytes:
    """Bit i says whether an odd number of the hashes end in i. Sets differ in at least as many members as their parities in bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _signed(batches):
    """mapInArrow: (key, grams) to (key, sig)."""
    for batch in batches:
        sig = [parities(np.frombuffer(g, "<u8")) for g in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary())], ["key", "sig"])


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the rows of two matrices of parities differ; the wider one is folded to the width of the other."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


_MEET = ["token", "x", "y", "side", "key", "label", "inner", "n", "pos", "sig"]


def _pairs_of(part: dict, percent: int, one: bool) -> tuple[list, list]:
    """Candidates of one chunk of a group's classes (side 0) with one of those outside its main component (side 1;
    where that has no rows of its own, the chunk holds the whole group)."""
    label = {}
    labels = np.array([label.setdefault(x, len(label)) for x in part["label"]])
    side, n, pos = np.array(part["side"]), np.array(part["n"]), np.array(part["pos"])
    inner = np.array(part["inner"])  # of the group's main component
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left[~inner[left]]
    widths = np.array([len(s) for s in part["sig"]])
    packed: dict = {}
    place = np.zeros(len(widths), np.int64)
    for w in np.unique(widths).tolist():
        own = np.flatnonzero(widths == w)
        place[own] = np.arange(len(own))
        packed[w] = np.frombuffer(b"".join(part["sig"][i] for i in own.tolist()), np.uint8).reshape(len(own), w).view(np.uint64)
    key = part["key"]
    rank = np.empty(len(key), np.int64)
    rank[sorted(range(len(key)), key=key.__getitem__)] = np.arange(len(key))
    u, v = [], []
    step = max(1, PAIRS // max(1, len(left)))
    for s in range(0, len(right), step):
        y = right[s : s + step]
        # the pair's first shared shingle must leave room for the overlap needed; a pair of two outside the main component is met once
        room = np.minimum((n - pos)[y][:, None], (n - pos)[left])
        ok = (labels[y][:, None] != labels[left]) & ((100 + percent) * room >= percent * (n[y][:, None] + n[left]))
        ok &= inner[left] | (rank[y][:, None] > rank[left])
        i, j = np.nonzero(ok)
        i, j = y[i], left[j]
        bound = np.zeros(len(i), np.int64)
        for wi in packed:
            for wj in packed:
                every = np.flatnonzero((widths[i] == wi) & (widths[j] == wj))
                each = max(1, PARITY_BYTES // max(wi, wj))
                for k in range(0, len(every), each):
                    at = every[k : k + each]
                    bound[at] = (n[i[at]] + n[j[at]] - _differ(packed[wi][place[i[at]]], packed[wj][place[j[at]]])) // 2
        fit = (100 + percent) * bound >= percent * (n[i] + n[j])
        i, j, bound = i[fit], j[fit], bound[fit]
        if one and len(i):
            order = np.lexsort((rank[j], -bound, labels[j], i))
            i, j = i[order], j[order]
            first = np.concatenate([[True], (i[1:] != i[:-1]) | (labels[j][1:] != labels[j][:-1])])
            i, j = i[first], j[first]
        u += [key[a] for a in j.tolist()]
        v += [key[a] for a in i.tolist()]
    return u, v


def _meet(percent: int, one: bool):
    """mapInArrow over rows sorted by (token, x, y): each chunk's candidates (a, b)."""

    def run(batches):
        part: dict = {c: [] for c in _MEET}
        at = None

        def flush():
            u, v = _pairs_of(part, percent, one) if len(part["key"]) > 1 else ([], [])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["a", "b"])

        for batch in batches:
            cols = {c: batch.column(i).to_pylist() for i, c in enumerate(_MEET)}
            places = list(zip(cols["token"], cols["x"], cols["y"], strict=True))
            s = 0
            while s < len(places):
                e = s
                while e < len(places) and places[e] == places[s]:
                    e += 1
                if places[s] != at:
                    if at is not None:
                        yield from flush()
                    at, part = places[s], {c: [] for c in _MEET}
                for c in _MEET:
                    part[c] += cols[c][s:e]
                s = e
        if at is not None:
            yield from flush()
        part = None
        K.release()

    return run


def _candidates(members: DataFrame, sigs: DataFrame, labels: DataFrame | None, percent: int, one: bool, total: int) -> DataFrame:
    """Pairs (a, b) of classes of two components that share a prefix shingle and whose bounds leave room for a link.

    ``members``: token, key, n, pos; ``labels``: key, label of the classes in a component with others.
    """
    rows = members.withColumn("label", F.col("key")) if labels is None else members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    counts = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token")
    groups = counts.agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("nx"), F.max("c").alias("nm")).filter("nx > nm")
    # without components nothing may be left out of the right side
    main = F.lit(b"") if labels is None else F.col("main")
    sizes = groups.select("token", main.alias("main"), "nx", F.ceil(F.col("nx") / MEMBERS).cast("int").alias("cx"), F.ceil((F.col("nx") if labels is None else F.col("nx") - F.col("nm")) / MEMBERS).cast("int").alias("cy"))
    rows = spread_join(rows, cut(sizes), "token", "nx", total).select("token", "key", "n", "pos", "label", (F.col("label") == F.col("main")).alias("inner"), "cx", "cy")
    rows = cut(rows).join(sigs, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = rows.withColumn("x", F.pmod(F.xxhash64("key"), F.col("cx")).cast("int")).withColumn("y", every("cy")).withColumn("side", F.lit(0)).select(*_MEET)
    y = rows.filter(~F.col("inner") & (F.col("cx") > 1))
    y = y.withColumn("y", F.pmod(F.xxhash64("key", F.lit(1)), F.col("cy")).cast("int")).withColumn("x", every("cx")).withColumn("side", F.lit(1)).select(*_MEET)
    return x.unionByName(y).repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(_meet(percent, one), "a binary, b binary")


def _members(sets: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """token, key, n, pos, members of the prefix shingles that several sets share; and how many rows there were before."""
    tokens = cut(sets.select("key", "n", "first", "grams").mapInArrow(_prefixes(percent), "token long, key binary, n int, pos int"))
    total = tokens.count()
    groups = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    return cut(spread_join(tokens, cut(groups), "token", "members", total)), total


def class_roots(sets: DataFrame, percent: int) -> DataFrame:
    """u, root: the smallest key in its component, for every class of ``sets`` (key, n, first, grams) that is not its own."""
    members, total = _members(sets, percent)
    central = members.groupBy("key").agg(F.sum("members").alias("central"))
    rows = members.join(central, "key").select("token", "key", "n", "central")
    # the hub of a token's group, and everything that shares the token: a star, never the group's pairs
    hubs = rows.groupBy("token").agg(F.max_by(F.struct("key", "n"), F.struct("central", "key")).alias("hub"), F.count(F.lit(1)).alias("members"))
    stars = spread_join(rows, cut(hubs), "token", "members", total).select(F.col("hub.key").alias("a"), F.col("key").alias("b"), F.col("hub.n").alias("an"), F.col("n").alias("bn"))
    fits = 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")
    sets = cut(sets.join(members.select("key").distinct(), "key", "left_semi").select("key", "grams"))
    roots = connected_components(verified(stars.filter(F.col("a") != F.col("b")).filter(fits).select("a", "b"), sets, percent))
    members = members.select("token", "key", "n", "pos")
    sigs = cut(sets.mapInArrow(_signed, "key binary, sig binary"))
    for one in (True, False):
        labels = roots.select(F.col("u").alias("key"), F.col("root").alias("label"))
        pairs = cut(_candidates(members, sigs, labels, percent, one, total).distinct())
        if pairs.isEmpty():
            break
        found = verified(pairs, sets, percent)
        for end in ("u", "v"):
            found = found.join(labels.withColumnRenamed("key", end), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
        joined = cut(connected_components(found.select("u", "v")).withColumnRenamed("root", "top"))
        moved = roots.join(joined.withColumnRenamed("u", "root"), "root", "left").select("u", F.coalesce("top", "root").alias("root"))
        roots = cut(moved.unionByName(joined.select("u", F.col("top").alias("root"))))
    return roots


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """All links (u, v) of two classes, once each: no component stands for its links here."""
    members, total = _members(sets, percent)
    sets = cut(sets.join(members.select("key").distinct(), "key", "left_semi").select("key", "grams"))
    sigs = cut(sets.mapInArrow(_signed, "key binary, sig binary"))
    return verified(_candidates(members.select("token", "key", "n", "pos"), sigs, None, percent, False, total), sets, percent)


def _classes(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, blocks: int | None, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, digest, ...) and the sets of the classes that may link (key, n, first, grams)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    dealt = deal(text_bytes(docs))[1] if not (blocks and buckets) else 0
    n_blocks, n_buckets = blocks or dealt, buckets or dealt
    rows = docs.withColumn("blk", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_blocks)))
    entries = rows.groupBy("blk").applyInArrow(_entries(k, n_buckets), "to long, blk long, payload binary")
    codes = entries.groupBy("to").applyInArrow(_count, "to long, blk long, codes binary")
    members = cut(rows.groupBy("blk").cogroup(codes.groupBy("blk")).applyInArrow(_ordered(k, percent), _MEMBER))
    sets = members.filter("grams IS NOT NULL").groupBy(F.col("digest").alias("key")).agg(F.max("n").alias("n"), F.max("first").alias("first"), F.any_value("grams").alias("grams"))
    return members, cut(sets)


def jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All links, between classes of rows with equal sets: (class_a, class_b) in doc ids, and membership (doc_id, class_id, n_links).

    A class is named by its smallest id, null if it has none; n_links counts the other classes that a row's
    class links with. Null and empty texts are in no class. Rows, ids, empty tables as in :func:`jaccard_components`.
    """
    members, sets = _classes(docs, k, percent, id_col, text_col, blocks, buckets)
    links = cut(class_links(sets, percent))
    names = members.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    n = links.select(F.explode(F.array("u", "v")).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n_links"))
    names = cut(names.join(n, "digest", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0))))
    a, b = names.select(F.col("digest").alias("u"), F.col("class_id").alias("class_a")), names.select(F.col("digest").alias("v"), F.col("class_id").alias("class_b"))
    return links.join(a, "u").join(b, "v").select("class_a", "class_b"), members.select("doc_id", "digest").join(names, "digest").select("doc_id", "class_id", "n_links")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable over links) of every row of ``docs``.

    Rows link when 100 * overlap >= ``percent`` * union of their sets of k-word shingles. Null and
    empty texts have empty sets and link with nothing; null ids are reachable but never name a
    component unless all of it is null; rows that repeat an id are judged one by one. An empty table
    gives no rows; other columns are ignored whatever their names.
    """
    members, sets = _classes(docs, k, percent, id_col, text_col, blocks, buckets)
    roots = class_roots(sets, percent)
    classes = members.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    linked = cut(classes.join(roots.select(F.col("u").alias("digest"), "root"), "digest", "left").select("digest", "rep", "copies", F.coalesce("root", "digest").alias("root")))
    tops = linked.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    linked = cut(spread_join(linked, cut(tops), "root", "classes", linked.count()).select("digest", "copies", "component_id"))
    rows = members.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "digest")
    out = spread_join(rows.filter("digest IS NOT NULL"), linked, "digest", "copies", rows.count()).select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.filter("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, range(1, greatest(2, len(ws) - 3)) r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a AS d, b AS t FROM l UNION SELECT r.d, l.b FROM r JOIN l ON r.t = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, min(r.t)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.d = w.doc_id GROUP BY w.doc_id
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
