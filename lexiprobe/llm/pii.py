"""Operator 9, personal data by bootstrapped contextual extraction.

Exact expressions find the base entities, which are the seeds. The two tokens before an entity (words or
single punctuation marks; the start of the text stands for missing ones) are a lexical pattern. Strings that look like an identifier of a kind without being one by the exact
expressions are the unseen instances. Patterns and instances form a graph; Spark scores it in rounds:
a pattern's confidence is the score of what it extracts over all of its occurrences in the corpus
(ordinary tokens included), an instance's score the noisy-or of its patterns' confidences. Instances
that end above a threshold are added as spans where a confident pattern stands before them. Edges are
counted by partial aggregation, so a pattern in front of a third of all entities is one row a task.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm import kernels as K
from lexiprobe.llm.shared import cut, small_batches

#: Kinds in the order in which spans of one start are listed. Fixed values of the contract.
KINDS = ("email", "ip", "card", "phone")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What an identifier of a kind may look like beyond the exact expressions.
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,64}){0,8}"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,4}(?:[.:-][0-9]{1,4}){2,5}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])"),
}
_SCHEMA = (
    "rid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, "
    "seen array<struct<kind:string,start:int,end:int,instance:string,pattern:string,seed:boolean>>"
)


def _emails(text: str):
    """Matches of the email expression by the places of '@', in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _HOST.match(text, at + 1) if s < at else None
        if m:
            yield s, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: list[int]) -> bool:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, index of kind, end) of the base entities, sorted."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = [int(c) for c in m[0] if c in "0123456789"] if len(m[0]) < 64 else []
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_TOKEN = re.compile("[0-9A-Za-z_\x80-\U0010ffff]+|[^\x20\x09-\x0D]")
_LETTER = re.compile("[0-9A-Za-z_\x80-\U0010ffff]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _before(text: str, start: int) -> str | None:
    """The two tokens before ``start``, A-Z lowered, an empty one for each that is missing; None within a token."""
    if start and _LETTER.match(text, start - 1) and _LETTER.match(text, start):
        return None
    room = 64
    while True:
        lo = max(0, start - room)
        found = _TOKEN.findall(text, lo, start)
        if len(found) > 2 or not lo:  # the first one may be cut at lo
            a, b = ["", "", *found][-2:]
            return f"{a} {b}".translate(_LOWER)
        room *= 4


def _scan(batches):
    rid = TaskContext.get().partitionId() << 33
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                text = text or ""
                base = base_spans(text)
                said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                seen = [(KINDS[k], s, e, text[s:e].lower(), _before(text, s), True) for s, k, e in base]
                ends = list(accumulate((e for _, _, e in base), max))
                starts = [s for s, _, _ in base]
                if "@" in text or "(at)" in text or "[at]" in text or _DIGIT.search(text):
                    for kind, loose in _LOOSE.items():
                        for m in loose.finditer(text):
                            s, e = m.span()
                            over = bisect_left(starts, e)
                            if not over or ends[over - 1] <= s:  # no base entity there
                                p = _before(text, s)
                                if p is not None:
                                    seen.append((kind, s, e, m[0].lower(), p, False))
                n = [sum(k == i for _, k, _ in base) for i in range(4)]
                rows.append({
                    "rid": rid, "doc_id": doc_id, "n_email": n[0], "n_ip": n[1], "n_card": n[2], "n_phone": n[3], "base": said,
                    "base_sha256": hashlib.sha256(said.encode()).hexdigest(),
                    "seen": [dict(zip(("kind", "start", "end", "instance", "pattern", "seed"), x, strict=True)) for x in seen],
                })
                rid += 1
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


_ARROW = pa.schema([
    ("rid", pa.int64()), ("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()),
    ("base", pa.string()), ("base_sha256", pa.string()),
    ("seen", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("pattern", pa.string()), ("seed", pa.bool_())]))),
])


def _pattern_hashes(patterns: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") for p in patterns for t in p.split(" ")]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return K.rolling(K.spans_hash(data, at[:-1], at[1:], K.LOWER), 2)[::2]


def _pairs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The hash of the two tokens before each token of some documents; two empty ones stand before each document."""
    starts, ends, of = K.tokens(data, offsets)
    none = K.spans_hash(data, np.zeros(1, np.int64), np.zeros(1, np.int64), K.LOWER)[0]
    h = np.insert(K.spans_hash(data, starts, ends, K.LOWER), np.repeat(of[:-1], 2), none)
    of = of + 2 * np.arange(len(of))
    pair = K.rolling(h, 2)
    return pair[np.repeat(of[1:], np.diff(of))[: len(pair)] > np.arange(len(pair)) + 2]


def _occurrences(patterns: list[str]):
    """mapInArrow: how often each pattern stands before any token."""
    hashes = _pattern_hashes(patterns)
    order = np.argsort(hashes)
    sorted_hashes = hashes[order]

    def run(batches):
        total = np.zeros(len(patterns), np.int64)
        for batch in batches:
            data, offsets = K.text_buffer(batch.column(0))
            for i, j in K.pieces(offsets):
                pair = _pairs(data, offsets[i : j + 1])
                at = np.searchsorted(sorted_hashes, pair).clip(0, len(patterns) - 1)
                total += np.bincount(order[at[sorted_hashes[at] == pair]], minlength=len(patterns))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([patterns[i] for i in found.tolist()], pa.string()), pa.array(total[found])], ["pattern", "times"])

    return run


def find_pii(
    docs: DataFrame, min_seeds: int = 3, patterns_per_run: int = 20_000, rounds: int = 3, confidence: float = 0.8, accept: float = 0.9, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base entities), base_sha256, spans (all), n_added, for every row of ``docs``.

    A pattern needs ``min_seeds`` different seeds of its kind; all such patterns are rated. A run over the texts
    counts about ``patterns_per_run`` of them, which bounds what is broadcast, and there are as many runs as it
    takes. Patterns count with ``confidence`` or more, instances with ``accept`` or more. Null text counts as empty; rows
    with null or repeated ids are judged alone; an empty table gives no rows; other columns are
    ignored whatever their names. Equal entities in many documents count once as seeds.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    rows = cut(docs.mapInArrow(_scan, _SCHEMA))
    seen = rows.select("rid", F.explode("seen").alias("s")).select("rid", "s.*").filter("pattern IS NOT NULL")  # not within a token
    edges = seen.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))
    # one score an edge: seeds are certain; what is unseen starts at nothing
    edges = cut(edges.withColumn("score", F.col("seed").cast("double")))
    by_pattern = edges.groupBy("kind", "pattern").agg(F.sum(F.col("seed").cast("int")).alias("seeds"), F.sum(F.col("n") * F.col("seed").cast("int")).alias("sure"), F.sum("n").alias("all"))
    best = cut(by_pattern.filter(F.col("seeds") >= min_seeds).select("pattern").distinct())
    n = best.count()
    added = None
    if n:
        runs, times = -(-n // patterns_per_run), None
        for run in range(runs):
            names = sorted(r["pattern"] for r in best.filter(F.pmod(F.xxhash64("pattern"), F.lit(runs)) == run).collect())
            if names:
                found = docs.select("text").mapInArrow(_occurrences(names), "pattern string, times long").groupBy("pattern").agg(F.sum("times").alias("times"))
                found = cut(found) if runs > 1 else found
                times = found if times is None else times.unionByName(found)
        graph = cut(edges.join(F.broadcast(times) if n <= patterns_per_run else times, "pattern"))
        for _ in range(rounds):
            rated = graph.groupBy("kind", "pattern").agg(F.sum(F.col("score") * F.col("n")).alias("sure"), F.max("times").alias("times"))
            rated = rated.select("kind", "pattern", F.least(F.lit(1.0), F.col("sure") / F.col("times")).alias("conf"))
            fresh = graph.join(rated, ["kind", "pattern"])
            doubt = F.log(F.greatest(F.lit(1e-12), 1.0 - F.when(F.col("conf") >= confidence, F.col("conf")).otherwise(0.0)))
            belief = fresh.groupBy("kind", "instance").agg((1.0 - F.exp(F.sum(doubt))).alias("belief"))
            graph = cut(fresh.join(belief, ["kind", "instance"]).select("pattern", "kind", "instance", "seed", "n", F.when(F.col("seed"), 1.0).otherwise(F.col("belief")).alias("score"), "times", "conf").drop("conf"))
        rated = graph.groupBy("kind", "pattern").agg((F.sum(F.col("score") * F.col("n")) / F.max("times")).alias("conf")).filter(F.col("conf") >= confidence)
        good = graph.filter(~F.col("seed") & (F.col("score") >= accept)).join(rated, ["kind", "pattern"], "left_semi").select("kind", "pattern", "instance")
        new = seen.filter(~F.col("seed")).join(good, ["kind", "pattern", "instance"], "left_semi")
        added = new.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("more"))
    out = rows if added is None else rows.join(added, "rid", "left")
    more = F.array().cast("array<struct<start:int,kind:string,end:int>>") if added is None else F.coalesce(F.col("more"), F.array().cast("array<struct<start:int,kind:string,end:int>>"))
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.split(x, ":"))
    base = F.transform(base, lambda p: F.struct(p[1].cast("int").alias("start"), rank[p[0]].alias("rank"), p[2].cast("int").alias("end"), p[0].alias("kind")))
    extra = F.transform(more, lambda m: F.struct(m["start"].alias("start"), rank[m["kind"]].alias("rank"), m["end"].alias("end"), m["kind"].alias("kind")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, extra)), lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.size(more).cast("long").alias("n_added"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
