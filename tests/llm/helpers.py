"""Tables that the tests of this folder share."""

import random

from pyspark.sql import functions as F

WORDS = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本", "ﬁn", "A.B", "x" * 70]


def make_texts(seed=3, n=60):
    """Random prose with exact and near copies, shared passages, repeated lines, odd white space, junk."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    passage, line = say(30), "This line is Shared by many documents, and is long enough."
    out = []
    for i in range(n):
        lines = [say(rng.randint(1, 25)) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), f"{rng.choice(['', '  ', chr(9)])}{line}{rng.choice(['', ' '])}")
        if i % 4 == 0:
            lines.append(f"{say(3)} {passage} {say(2)}")
        out.append("\n".join(lines))
    base = say(200)
    for _ in range(12):
        w = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    out += [out[5], out[5].replace(" ", "\t\t"), out[7], None, "", " \n\t ", "one", "one", "two words", "Two Words", "a " * 400, line, "\n\n", "  lead  and\r\n trail  ", "long " * 3000 + passage]
    return out


CLASH = ("digest", "row", "keep", "copy", "mix_key", "host", "path", "blk", "to", "token", "key", "kept", "held_out", "rep", "hi", "lo", "seen", "__row", "__doc", "__id", "n_lines", "paths")


def frame(spark, rows, parts=5):
    """documents with nullable columns, extra ones with clashing names, over several partitions."""
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 4}" if (i or 0) % 5 else None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(parts)
