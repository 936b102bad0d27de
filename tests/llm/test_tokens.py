import base64
import os
import random

import pytest

from tessaro.llm.tokens import BYTE_BPE, encode_part, encode_texts, join, part_ends, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE), reason="the vocabulary files aren't there")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoded(t, text, size):
    """The ids of a text by joining its parts as a tree."""
    at, level = 0, []
    for end in part_ends(text, size):
        ids, spans = encode_part(t, text[at:end])
        level.append((at, end, (ids, [(a + at, b + at) for a, b in spans])))
        at = end
    while len(level) > 1:
        joined = []
        for (a, m, left), (_, e, right) in zip(level[::2], level[1::2]):
            move = lambda x, by: (x[0], [(p + by, q + by) for p, q in x[1]])
            joined.append((a, e, move(join(t, text[a:e], move(left, -a), move(right, -a), m - a), a)))
        level = joined + level[len(level) - len(level) % 2 :]
    return level[0][2][0] if level else []


def test_parts_join_to_the_whole_encoding():
    t, rng = tokenizer(BYTE_BPE), random.Random(4)
    kinds = ["abcdefgh", "a-=é日", "the and'st''é日本語🙂 \n-12", "a", "  \n\t x", "don't we'll I've "]
    for _ in range(900):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(30, 600))) if rng.random() < 0.6 else rng.choice("aé日- ") * rng.randint(30, 600)
        assert encoded(t, text, rng.choice([7, 30, 61, 100])) == t.encode(text, add_special_tokens=False).ids


def test_every_row(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE.replace(".json", ".tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    long = "Some words, don't they? " * 300 + "q" * 900
    texts = [None, "", "   \n", "<|endoftext|>", "naïve café 日本", long, "x" * 2000, long]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, long, "y"), (None, long, "y")]
    found = encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text", part=500).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: list(r["ids"]) for r in found if r["doc_id"] is not None}
    assert by == {i: other.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert [list(r["ids"]) for r in found if r["doc_id"] is None] == [by[5]] * 2
    assert encode_texts(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
