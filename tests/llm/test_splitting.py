from hypothesis import given, settings
from hypothesis import strategies as st

import re

from tessaro.llm.splitting import LEVELS, bisected, boundaries, split_oversized

TEXTS = st.lists(st.sampled_from(["word", "Ends here.", "\n", "\n\n", " ", "x" * 40, "日本", "a\r\n"]), max_size=60).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.integers(5, 60))
def test_cuts_leave_no_part_over_the_limit(text, limit):
    found = boundaries(text)
    edges = [0, *(c for c, _ in bisected(text, limit, 2, found)[0]), len(text)]
    assert edges == sorted(set(edges)) or text == ""
    assert all(b - a <= limit - 2 for a, b in zip(edges, edges[1:]))


def coarsest(text, limit):
    """By the definition: the first level at which no part exceeds the limit."""
    spaces = [(m.start(), m.end()) for m in re.finditer(r"\s+", text)]
    strength = dict(zip(spaces, (x for _, _, x in boundaries(text))))
    for level in (4, 3, 2, 1):
        at, longest = 0, 0
        for a, b in spaces:
            if strength[a, b] >= level:
                longest, at = max(longest, len(text[at:a].strip())), b
        if max(longest, len(text[at:].strip())) <= limit:
            return LEVELS[level]
    return LEVELS[0]


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(5, 90))
def test_the_cuts_tell_the_coarsest_boundary(text, limit):
    if len(text.strip()) > limit:
        assert LEVELS[bisected(text, limit, 2, boundaries(text))[1]] == coarsest(text, limit)


def test_coarsest():
    part = "a" * 30
    for text, level in ((f"{part}\n\n{part}", "paragraph"), (f"{part}\n{part}", "line"), (f"{part}. {part}", "sentence"), (f"{part} {part}", "word"), (part * 2, "none")):
        assert coarsest(text, 31) == LEVELS[bisected(text, 31, 3, boundaries(text))[1]] == level


def test_pieces(spark):
    long = " ".join(f"Sentence number {i} ends here." for i in range(300))
    rows = [(1, long, 3, "p"), (2, "short", None, None), (3, None, 1, None), (4, "", 1, None), (5, "y" * 4500, None, None), (5, "y" * 4500, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, page_start int, _text_ string")
    found = split_oversized(df, "text", ["id", "page_start"]).collect()
    own = sorted((r for r in found if r["id"] == 1), key=lambda r: r["piece_no"])
    assert all(len(r["piece"]) <= 2000 for r in found) and {r["id"] for r in found} == {1, 5}
    assert "".join(r["piece"][r["repeated"] :] for r in own) == long
    assert all(0 < r["repeated"] <= 200 and r["cut"] == "sentence" and r["page_start"] == 3 for r in own[1:])
    assert all(a["piece"].endswith(b["piece"][: b["repeated"]]) for a, b in zip(own, own[1:]))
    assert {r["boundary"] for r in found if r["id"] == 5} == {"none"} and len([r for r in found if r["id"] == 5 and r["piece_no"] == 1]) == 2
    assert split_oversized(df.limit(0), "text", ["id"]).count() == 0
