"""Finding 1 of round 3: op13 cuts and looks up whole batches; what it cuts, remembers and hands to the library."""

import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiprobe.llm import token_files

SPACES = [" ", "  ", "\n", "\t", "\x0b", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "᠎", " ", "​", " ", " ", "　", "﻿", "\0", "\x7f"]
OTHERS = [*"abzA09'\".,;:!?()<>|@#_-/\\", "'s", "'LL", "<|endoftext|>", "word", "Été", "÷", "×", "ß", "ÿ", "Ā", "ȿ", "ɐ", "ª", "²", "日本", "の", "é", "ا", "\U0001d4b3", "ﬁ", "ǅ", "䀀"]


def odd(rng):
    share = rng.random()
    return "".join(rng.choice(SPACES if rng.random() < share else OTHERS) for _ in range(rng.randint(0, 30)))


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_batches_encode_as_the_library(kind):
    rng = random.Random(11)
    encode = token_files.Encoder(token_files.default_tokenizer())
    for texts in ([None], [""], [None, "", None], [rng.choice([None, "", odd(rng), odd(rng), odd(rng)]) for _ in range(3000)]):
        rows = pa.array(["not of the slice ", *texts, " nor this"], kind).slice(1, len(texts))
        want = [x.ids for x in encode.known.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        for end in ([], [2], [2, 70_000]):
            ids, at = encode.batch(rows, np.array(end, "<u4").tobytes())
            assert [ids[s:e].tolist() for s, e in zip(at[:-1], at[1:], strict=True)] == [w + end for w in want]
            assert at[-1] == len(ids)


def counted(encode):
    """How often each piece goes to the library's merges."""
    asked, merges = Counter(), encode.known.merges

    def count(letters):
        asked[letters] += 1
        return merges(letters)

    encode.known.merges = count
    return asked


def test_frequent_pieces_outlive_rare_ones(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 80)
    encode = token_files.Encoder(token_files.default_tokenizer())
    asked = counted(encode)
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    for k in range(40):
        encode("".join(f" often{name(i)}" for i in range(10)) + "".join(f" once{name(15 * k + i)}" for i in range(15)))
    assert [asked[f"Ġoften{name(i)}"] for i in range(10)] == [1] * 10
    assert len(encode.known) + len(encode.known.old) <= 80


def test_a_piece_is_cut_from_its_punctuation():
    encode = token_files.Encoder(token_files.default_tokenizer())
    asked = counted(encode)
    encode(" lorem lorem, lorem. lorem!? (lorem) [lorem](lorem) é été, lorem;")
    assert asked["Ġlorem"] == 1 and asked["lorem"] == 1


@pytest.mark.parametrize("content", ["zebra", "90817263", "ab!", "(x", "été", "<|x|>"])
def test_added_tokens_of_any_kind_are_found(tmp_path, content):
    """An added token of letters alone was passed over within a longer word."""
    with open(token_files.default_tokenizer(), encoding="utf-8") as f:
        made = json.load(f)
    made["added_tokens"].append(made["added_tokens"][0] | {"id": 50_257, "content": content})
    path = tmp_path / "own.json"
    path.write_text(json.dumps(made), encoding="utf-8")
    encode = token_files.Encoder(str(path))
    for text in (f"a {content} b", f"one{content}two {content}, {content}.", f" x{content}", f"({content})\n\n{content}  ", f"1{content}1 , lorem{content}!"):
        want = encode.known.tokenizer.encode(text, add_special_tokens=False).ids
        assert 50_257 in want and np.frombuffer(encode(text), "<u4").tolist() == want, text
