"""Operator 11, fill-in-the-middle: texts are cut at two ranks among their units and told in another order.

Each text becomes an array of UTF-32 code points. The class of every code point is compared with its
neighbour's, ``flatnonzero`` of what differs gives the boundaries of units (lines, words or code
points), two ranks drawn from a hash of the id choose boundaries, and the three slices are encoded
again between markers. A text holds four bytes a code point while it is cut, one text at a time; no
row meets another one, so nothing is shuffled and no key can be hot. Restoring is DataFrame functions.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.llm.shared import small_batches

#: The markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
_BLANK = np.array([0x20, 9, 10, 11, 12, 13], np.uint32)
_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def unit_starts(points: np.ndarray, unit: str) -> np.ndarray:
    """Where the units of a text start, by its code points.

    ``line``: behind each newline; ``word``: where a word follows white space (a word owns the white
    space behind it, and white space that leads the text is a unit); ``char``: everywhere.
    """
    if not len(points):
        return np.zeros(0, np.int64)
    if unit == "char":
        return np.arange(len(points))
    if unit == "line":
        ends = points == 10
        inner = ends[:-1]  # a unit starts behind every member of the class
    elif unit == "word":
        blank = np.isin(points, _BLANK)
        inner = blank[:-1] & ~blank[1:]  # neighbours of unlike classes, white space first
    else:
        raise ValueError(f"unit must be line, word or char, not {unit}")
    return np.concatenate([[0], np.flatnonzero(inner) + 1])


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers: the first groups of the SHA-256 of ``seed:doc_id``; a null id reads as 'null'."""
    raw = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(raw[i : i + 4], "big") for i in (0, 4, 8, 12))


def _cut(text: str, doc_id: int | None, seed: int, unit: str, rate: int, spm_rate: int, markers: tuple[str, str, str]):
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    starts = unit_starts(points, unit)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in markers) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    bounds = np.append(starts, len(points))
    a, b = (int(x) for x in bounds[np.sort([h1 % (n + 1), h2 % (n + 1)])])
    prefix, middle, suffix = (points[s:e].tobytes().decode("utf-32-le", "surrogatepass") for s, e in ((0, a), (a, b), (b, len(points))))
    p, s, m = markers
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _check_markers(markers: tuple[str, str, str]) -> None:
    """Refuses markers that could be read at another place than where they were put."""
    if len(set(markers)) != 3 or "" in markers or any(a in b for a in markers for b in markers if a is not b):
        raise ValueError("markers must be three unlike texts, none empty or within another")
    if any(b.startswith(a[k:]) for a in markers for b in markers for k in range(1, len(a))):
        raise ValueError("no marker may begin as another one or itself ends")


def fim_transform(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm_rate: int = 50, markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points) and output of every row of ``docs``.

    ``rate`` percent of the texts are cut, ``spm_rate`` percent of these tell the suffix first; the rest,
    empty texts and those that hold a marker stay plain, with null lengths. Null texts count as empty;
    a null id has draws of its own, the same for all such rows. Repeated rows are cut alike, an empty
    table gives no rows. Other columns are ignored whatever their names. A text is held whole, however
    long. ``markers`` must be three unlike texts that do not overlap.
    """
    _check_markers(markers)
    unit_starts(np.zeros(1, np.uint32), unit)  # refuses an unknown unit before any job

    def run(batches):
        done, chars = [], 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(batch.num_rows):  # a row at a time bounds what a task holds by one text
                i, text = ids[at].as_py(), texts[at].as_py() or ""
                done.append((i, *_cut(text, i, seed, unit, rate, spm_rate, markers)))
                chars += len(text)
                if chars >= 1 << 20:
                    yield _batch(done)
                    done, chars = [], 0
        if done:
            yield _batch(done)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


def fim_restore(output: Column | str, form: Column | str, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made from, by its form alone; null where either is null, and for an unknown form."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    first, second, third = parts.getItem(1), parts.getItem(2), parts.getItem(3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first))


def fim_digests(docs: DataFrame, **how) -> DataFrame:
    """The columns of :func:`fim_transform`, the output and the text restored from it as digests."""
    made = fim_transform(docs, **how)
    restored = fim_restore("output", "form", how.get("markers", MARKERS))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), counted AS (
  SELECT *, len(parts) AS m, len(parts) - (parts[-1] = '')::BIGINT AS n,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn
), ranked AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM counted
), cut AS (
  SELECT *, array_to_string(parts[1:a], chr(10)) || CASE WHEN a > 0 AND a < m THEN chr(10) ELSE '' END AS prefix,
    array_to_string(parts[a+1:b], chr(10)) || CASE WHEN b > a AND b < m THEN chr(10) ELSE '' END AS middle,
    array_to_string(parts[b+1:m], chr(10)) AS suffix
  FROM ranked
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
