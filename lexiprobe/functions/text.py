"""Text and source-code expressions: columns where Catalyst can say it, Arrow UDFs for stateful scans."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- programs from tokens -------------------------------------------------------------------------


def join_tokens(tokens: Column) -> Column:
    """Source of a token list with NEW_LINE / INDENT / DEDENT marks; four spaces a level, never below 0."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("line"), F.array().cast("array<string>").alias("lines"))
    flushed = lambda a: F.when(F.size(a["line"]) > 0, F.concat(a["lines"], F.array(F.concat(F.repeat(F.lit("    "), a["depth"]), F.array_join(a["line"], " "))))).otherwise(a["lines"])
    none = F.array().cast("array<string>")

    def step(a: Column, t: Column) -> Column:
        mark = t.isin("NEW_LINE", "INDENT", "DEDENT")
        depth = F.when(t == "INDENT", a["depth"] + 1).when(t == "DEDENT", F.greatest(F.lit(0), a["depth"] - 1)).otherwise(a["depth"])
        return F.struct(depth.alias("depth"), F.when(mark, none).otherwise(F.concat(a["line"], F.array(t))).alias("line"), F.when(mark, flushed(a)).otherwise(a["lines"]).alias("lines"))

    return F.regexp_replace(F.array_join(F.aggregate(tokens, start, step, flushed), "\n"), r"^\s+|\s+$", "")


# The steps of undoing a tokeniser's blanks, in order; the second list is for PHP and comes before SPACING's last four.
JOINING = ((r" NEW_LINE ", "\n"), (r"NEW_LINE", "\n"), (r"(?<=\w)\s*\.\s*(?=\w)", "."), (r"-\s+>", "->"), (r"=\s+>", "=>"))
PHP_JOINING = ((r"<\s*\?\s*php", "<?php"), (r"\?\s*>", "?>"), (r"\$\s+(?=\w)", r"\$"), (r"::\s+", "::"))
SPACING = ((r"\s+([;,)\]}])", "$1"), (r"([(\[{])\s+", "$1"), (r"(\w)\s*\(", "$1("), (r"\s*(\+\+|--)", "$1"))


def join_brace_tokens(tokens: Column, php: bool = False) -> Column:
    """Source of a brace language's tokens: blanks that a tokeniser put around punctuation removed."""
    text = F.array_join(tokens, " ")
    for pattern, to in (*JOINING, *(PHP_JOINING if php else ()), *SPACING):
        text = F.regexp_replace(text, f"(?U){pattern}", to)
    return text


#: Any white space of Unicode, as a class of both engines' expressions; what ends a line.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def single_blanks(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def problem_id(text: Column) -> Column:
    """First 16 hex digits of the sha1 of the lowered text with single blanks."""
    return F.substring(F.sha1(single_blanks(F.lower(text)).cast("binary")), 1, 16)


# --- predicates -------------------------------------------------------------------------------------


def balanced(code: Column) -> Column:
    """As many opening as closing braces, and parentheses."""
    count = lambda c: F.length(code) - F.length(F.replace(code, F.lit(c), F.lit("")))
    return (count("{") == count("}")) & (count("(") == count(")"))


def span_holds(code: Column, s: Column, e: Column, name: Column) -> Column:
    """0 <= s < e <= length and code[s:e] is the name, with or without a leading $."""
    piece = F.substring(code, s + 1, e - s)
    return (s >= 0) & (s < e) & (e <= F.length(code)) & ((piece == name) | (piece == F.concat(F.lit("$"), name)))


def full_lines(code: Column) -> Column:
    """Lines that are not blank."""
    return F.size(F.filter(F.split(code, LINE_END), lambda x: x.rlike(SPACE.replace("[", "[^", 1)))).cast("long")


# Marks of generated files and of notebooks.
GENERATED = (r"auto[-_\s]?generated", r"do\s+not\s+(edit|modify)", r"this\s+file\s+was\s+generated", r"@generated\b", r"\bgenerated\s+by\b")
NOTEBOOK_PATH, NOTEBOOK_CODE = "ipynb", ("get_ipython(", "IPython.")


def generated(code: Column) -> Column:
    """Marks of generated files within the first 8,000 characters."""
    return F.substring(code, 1, 8000).rlike("(?i)" + "|".join(GENERATED))


def notebook(path: Column, code: Column) -> Column:
    return F.lower(path).contains(NOTEBOOK_PATH) | code.contains(NOTEBOOK_CODE[0]) | code.contains(NOTEBOOK_CODE[1])


# --- places -------------------------------------------------------------------------------------------


def line_of(code: Column, at: Column) -> Column:
    """1-based line of a 0-based character offset."""
    before = F.substring(code, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(code: Column, at: Column) -> Column:
    """0-based column of a 0-based character offset."""
    return F.length(F.substring_index(F.substring(code, F.lit(1), at), "\n", -1))


def char_offset(code: Column, byte: Column) -> Column:
    """Characters in the first ``byte`` bytes of the UTF-8 text."""
    return F.length(F.decode(F.substring(F.encode(code, "UTF-8"), F.lit(1), byte), "UTF-8"))


def identifiers(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(r"[A-Za-z_]\w*"), F.lit(0))


@F.pandas_udf(T.ArrayType(T.StructType().add("name", "string").add("s", "integer").add("e", "integer")))
def identifier_spans(code: pd.Series) -> pd.Series:
    """Identifiers with their character spans."""
    import re

    find = re.compile(r"[A-Za-z_]\w*", re.ASCII).finditer
    return code.map(lambda c: [{"name": m[0], "s": m.start(), "e": m.end()} for m in find(c or "")])


# --- masks --------------------------------------------------------------------------------------------


def masked(code: Column, s: Column, e: Column, name: Column, whole_word: bool = False) -> Column:
    """code[s:e] with the name replaced by ' VAR ': as a substring (also within longer names), or as a whole word."""
    piece = F.substring(code, s + 1, e - s)
    if whole_word:
        return F.regexp_replace(piece, F.concat(F.lit(r"(?<!\w)\Q"), name, F.lit(r"\E(?!\w)")), F.lit(" VAR "))
    return F.replace(piece, name, F.lit(" VAR "))


def line_span(code: Column, at: Column) -> Column:
    """[s, e) of the line around an offset, without its newline."""
    s = at - column_of(code, at)
    rest = F.substring_index(F.substring(code, at + 1, F.length(code)), "\n", 1)
    return F.struct(s.alias("s"), (at + F.length(rest)).alias("e"))


def window_span(code: Column, s: Column, e: Column, width: int) -> Column:
    return F.struct(F.greatest(F.lit(0), s - width).alias("s"), F.least(F.length(code), e + width).alias("e"))


def code_mask(code: str) -> list[tuple[bool, int]]:
    """(is code, depth of round and square brackets) of each character; strings and comments are no code.

    Strings open with ', ", ` or three quotes and close with the same; a backslash takes the next
    character along; // and # comments run to the end of the line, /* to */.
    """
    out: list[tuple[bool, int]] = []
    depth, i, n, until = 0, 0, len(code), ""
    while i < n:
        c = code[i]
        if until:
            step = 1
            if until == "\n" and c == "\n":
                until = ""
                out.append((True, depth))
                i += 1
                continue
            if until not in ("\n", "*/") and c == "\\":
                step = 2
            elif until != "\n" and code.startswith(until, i):
                step, until = len(until), ""
            out += [(False, depth)] * min(step, n - i)
            i += step
            continue
        opened = next((q for q in ('"""', "'''", '"', "'", "`", "/*", "//", "#") if code.startswith(q, i)), None)
        if opened:
            until = {"/*": "*/", "//": "\n", "#": "\n"}.get(opened, opened)
            out += [(False, depth)] * len(opened)
            i += len(opened)
            continue
        depth = max(0, depth + (c in "([") - (c in ")]"))
        out.append((True, depth))
        i += 1
    return out


def statement_bounds(code: str, start: int, end: int) -> tuple[int, int]:
    """[s, e) of the statement around [start, end): from behind the ; { } or newline before it to the next one, which
    belongs to it; only those in code count, outside of round and square brackets."""
    stops = [i + 1 for i, (is_code, depth) in enumerate(code_mask(code)) if is_code and depth == 0 and code[i] in ";{}\n"]
    before, after = bisect_right(stops, min(start, len(code))), bisect_right(stops, max(end, 0))
    return (stops[before - 1] if before else 0), (stops[after] if after < len(stops) else len(code))


@F.pandas_udf(T.StructType().add("s", "integer").add("e", "integer"))
def statement_span(code: pd.Series, start: pd.Series, end: pd.Series) -> pd.DataFrame:
    """Column form of :func:`statement_bounds`; null code or offsets give [0, 0)."""
    spans = [(0, 0) if c is None or pd.isna(a) or pd.isna(b) else statement_bounds(c, int(a), int(b)) for c, a, b in zip(code, start, end, strict=True)]
    return pd.DataFrame(spans, columns=["s", "e"])


# --- n-grams --------------------------------------------------------------------------------------------


def word_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams within words padded by a blank on either side; a padded word shorter than n is one n-gram, once."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        size = F.length(w)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)), lambda i: F.substring(w, i, F.lit(n)))
        return F.when((size >= n) | F.lit(n == low), cut).when(size >= n - 1, F.array().cast("array<string>")).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.concat(*(grams(w, n) for n in range(low, high + 1)))))


def word_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, w, c: each row's different words, lowered and padded by a blank on either side, and how often it has them."""
    words = rows.select(key, F.explode(F.split(F.lower(text), r"\s+")).alias("w")).filter("w <> ''")
    return words.groupBy(key, F.concat(F.lit(" "), "w", F.lit(" ")).alias("w")).agg(F.count(F.lit(1)).alias("c"))


def ngram_rows(rows: DataFrame, key: str, text: str, low: int = 2, high: int = 4) -> DataFrame:
    """key, ngram, c: the n-grams of :func:`word_ngrams`, cut once from each different word of a row.

    Rows are dealt by key first, so that words and n-grams are counted where they are.
    """
    words = word_rows(rows.repartition(F.col(key)), key, text)
    cut = words.withColumn("n", F.explode(F.array(*(F.lit(n) for n in range(low, high + 1))))).filter((F.length("w") >= F.col("n")) | (F.col("n") == low))
    cut = cut.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("w") - F.col("n") + 1))))
    return cut.groupBy(key, F.substring(F.col("w"), F.col("i"), F.col("n")).alias("ngram")).agg(F.sum("c").alias("c"))


#: Characters of texts whose n-grams a task counts at once (about 60 bytes each); sums over all come from Spark.
BLOCK_CHARS = 1 << 20
#: Codes up to this are numbered by a table, greater ones by sorting.
TABLE = 1 << 22


def _numbered(codes: np.ndarray, space: int) -> tuple[np.ndarray, int]:
    """Different codes (below ``space``) as 0, 1, ..., and how many there are."""
    if space > TABLE:
        known, number = np.unique(codes, return_inverse=True)
        return number.astype(np.int32), len(known)
    held = np.zeros(space, np.bool_)
    held[codes] = True
    number = np.cumsum(held, dtype=np.int32) - 1
    return number[codes], int(number[-1]) + 1 if space else 0


def ngram_numbers(texts: list[bytes], low: int = 2, high: int = 4) -> tuple[list[str], list[np.ndarray]]:
    """The different n-grams of lowered texts in UTF-8, as :func:`word_ngrams` cuts them, and for each text the places of its own among them, repeats too."""
    padded = [f" {b' '.join(t.split()).decode('utf-8', 'replace')} " for t in texts]  # bytes split at \t to \r and the blank, as the expressions do
    whole = "".join(padded)
    starts = np.cumsum([0, *map(len, padded)])
    chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    word = chars != 32
    letter, letters = _numbered(chars, 0x110000)
    at, number, many = np.arange(len(chars)), letter, letters
    names: list[str] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(2, high + 1):  # an n-gram is one of n - 1 and a character; blanks stand at its ends only
        fits = at < len(chars) - n + 1
        at, number = at[fits], number[fits]
        fits = word[at] | word[at + 1] if n == 2 else word[at + n - 2]
        at, number = at[fits], number[fits]
        number, many = _numbered(number.astype(np.int64) * letters + letter[at + n - 1], many * letters)
        short = slice(None) if n >= low else ~word[at] & ~word[at + n - 1] & (n > 2)  # whole words shorter than the least n
        where, own = at[short], number[short]
        if n < low:
            own, found = _numbered(own, many)
        else:
            found = many
        place = np.zeros(found, np.int64)
        place[own] = where
        parts.append((own + len(names), np.searchsorted(where, starts)))
        names += [whole[i : i + n] for i in place.tolist()]
    return names, [np.concatenate([own[cut[i] : cut[i + 1]] for own, cut in parts]) for i in range(len(texts))]


def text_blocks(batches):
    """Arrow batches (key, text as bytes) to lists of (key, text) of about BLOCK_CHARS bytes; of a longer text, some words at a time follow each other."""
    block, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for k, text in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist(), strict=True):
                text = text or b""
                words = text.split() if len(text) > BLOCK_CHARS else ()
                for part in [b" ".join(words[i : i + BLOCK_CHARS // 16]) for i in range(0, len(words), BLOCK_CHARS // 16)] if words else (text,):
                    block.append((k, part))
                    size += len(part)
                    if size >= BLOCK_CHARS:
                        yield block
                        block, size = [], 0
    if block:
        yield block


def _counted_ngrams(low: int, high: int):
    """mapInArrow: (key, text as lowered bytes) to ngram, df, tf over some of the rows; a run of rows with one key is one document, rows without are none."""

    def run(batches):
        import pyarrow as pa

        key, held = None, set()  # the document that may go on, and its n-grams

        def rows(names, df, tf):
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(df, pa.int64()), pa.array(tf, pa.int64())], ["ngram", "df", "tf"])

        for block in text_blocks(batches):
            names, texts = ngram_numbers([t for _, t in block], low, high)
            df, last = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            tf = np.bincount(np.concatenate(texts), minlength=len(names))
            for i, (own, (k, _)) in enumerate(zip(texts, block, strict=True)):
                order = np.arange(len(own))
                last[own] = order
                once = own[last[own] == order]
                if k is not None and (k == key or i == len(block) - 1 or block[i + 1][0] == k):  # a document of several rows or blocks
                    if k != key:
                        yield rows(list(held), [1] * len(held), [0] * len(held))
                        key, held = k, set()
                    held.update(map(names.__getitem__, once.tolist()))
                elif k is not None:
                    df[once] += 1
            yield rows(names, df, tf)
        yield rows(list(held), [1] * len(held), [0] * len(held))

    return run


def ngram_documents(rows: DataFrame, key: str | None, text: str, low: int = 2, high: int = 4, min_df: int = 2) -> DataFrame:
    """ngram, df (documents that hold it), tf over all, of n-grams in at least ``min_df`` documents.

    Tasks count their rows' n-grams and send each of them on once, so what is shuffled grows with the different n-grams
    of a task and not with those of each row. Rows of one key are one document; only where keys repeat are rows dealt
    and sorted by key first. Rows without a key add to tf alone. With no ``key``, each row is a document.
    """
    k = F.monotonically_increasing_id() if key is None else F.col(key)
    if key is not None and rows.filter(k.isNotNull()).groupBy(k).count().filter("count > 1").limit(1).count():
        rows = rows.repartition(k, F.when(k.isNull(), F.xxhash64(text))).sortWithinPartitions(k)
    lowered = rows.select(k, F.lower(F.col(text)).cast("binary"))
    counted = lowered.mapInArrow(_counted_ngrams(low, high), "ngram string, df long, tf long")
    return counted.groupBy("ngram").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter(F.col("df") >= min_df)


def ablate(text: Column, chars: str) -> Column:
    """Those characters as blanks; the length stays."""
    return F.translate(text, chars, " " * len(chars))


# Classes of n-grams, the first that is found; the characters of each that can be blanked.
NGRAM_CLASSES = (
    ("terminator", r";"), ("brace", r"[{}]"), ("bracket", r"[\[\]]"), ("paren", r"[()]"), ("operator", r"[+\-*/%<>=!&|]"),
    ("keyword", r"\b(for|while|in|range|let|var|const|foreach|do|if)\b"), ("alpha", r"^[A-Za-z_ ]+$"),
)
ABLATED = {"terminator": ";", "brace": "{}", "bracket": "[]", "paren": "()", "operator": "+-*/%<>=!&|"}


def ngram_class(g: Column) -> Column:
    """Which syntax an n-gram shows; the first that fits."""
    out = F.lit("other")
    for name, pattern in reversed(NGRAM_CLASSES):
        out = F.when(g.rlike(pattern), name).otherwise(out)
    return out


def ablate_class(text: Column, name: str | None) -> Column:
    """The characters of a class as blanks; 'none' or nothing leaves the text."""
    if name in (None, "", "none"):
        return text
    if name not in ABLATED:
        raise ValueError(f"cannot ablate {name}; known are {sorted(ABLATED)}")
    return ablate(text, ABLATED[name])


def model_slug(model: Column) -> Column:
    """Last part of the path, lowered, letters and digits only."""
    return F.regexp_replace(F.lower(F.element_at(F.split(model, "/"), -1)), "[^a-z0-9]", "")


def language_slug(language: Column) -> Column:
    return F.replace(F.replace(F.lower(language), F.lit("++"), F.lit("pp")), F.lit("#"), F.lit("sharp"))


def safe_component(part: Column) -> Column:
    return F.regexp_replace(part, r"[^A-Za-z0-9._-]+", "--")
