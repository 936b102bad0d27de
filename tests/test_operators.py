"""The newer operators of the core against brute force and planted cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessaro.functions import text as X
from tessaro.functions.canonical import canonical, contains_words, iso_date
from tessaro.functions.speech import digits_of, errors, spoken, word_error_rate
from tessaro.operators import metrics as M
from tessaro.operators.chunking import empty_grid, is_section_row, merged_under_heading, sentence_parts, split_chunks, split_tables, table_parts
from tessaro.operators.grids import f1_of, grid_of
from tessaro.operators.packing import packed
from tessaro.operators.pauses import pause_chunks, split_at_longest
from tessaro.operators.search import identifier_hits, vector_topk
from tessaro.operators.segments import with_previous, with_running_sums
from tessaro.operators.sequence import covering, overlap_counts


def column(spark, values, function, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"t {kind}").select(function(F.col("t"))).collect()]


def test_stems(spark):
    cases = {"filled": "fill", "calling": "call", "spelling": "spell", "trekked": "trek", "quizzed": "quiz", "buzzing": "buz", "egg": "egg", "add": "add", "running": "run", "offices": "offic", "arrangement": "arrang", "arrange": "arrang", "shipments": "ship", "buses": "bus", "is": "is", "": ""}
    assert column(spark, list(cases), X.stem) == list(cases.values())


def test_canonical(spark):
    cases = {
        "$4,980.00": "4980", "October 14, 2026": "2026-10-14", "14th Oct. 2026": "2026-10-14", "10/4/2026": "2026-10-04", "2026-1-5": "2026-01-05", "3.9 – 4.3": "3.9-4.3", "INV-2026-0042.": "inv-2026-0042",
        "At 10:30, “done”: yes.": "at 10:30 done yes", "1,234,567.50": "1234567.50", "ﬁrst x²": "first x2", "": "", None: None,
    }
    assert column(spark, list(cases), canonical) == list(cases.values())


def test_contains_words(spark):
    rows = spark.createDataFrame([("pay 498 now", "498"), ("pay 4980 now", "498"), ("inv-2026-0042", "2026"), ("a+b", "a+b"), ("abc", ""), (None, "x"), ("x", None)], "h string, n string")
    assert [r[0] for r in rows.select(contains_words(F.col("h"), F.col("n"))).collect()] == [True, False, True, True, False, False, False]


@pytest.mark.parametrize(
    ("said", "words"),
    [
        ("one hundred and five", "105"), ("twenty twenty six", "20 26"), ("five twenty", "5 20"), ("It's $16,500.", "it is 16500 dollars"), ("sixteen thousand five hundred dollars", "16500 dollars"),
        ("50% of us can't", "50 percent of us cannot"), ("two million three hundred thousand", "2300000"), ("and so on", "and so on"), ("nineteen five", "19 5"), ("", ""),
    ],
)
def test_spoken(said, words):
    assert " ".join(spoken(said)) == words


def test_word_errors_against_brute_force(spark):
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert errors(a, b) == slow(a, b)
    assert digits_of(["ten", "hundred"]) == ["1000"]
    rows = spark.createDataFrame([("a b c d", "a x c"), ("", "x"), (None, ""), ("a", None)], "r string, h string")
    assert [r[0] for r in rows.select(word_error_rate("r", "h")).collect()] == [0.5, 1.0, 0.0, 1.0]


def test_running_sums_and_previous_rows_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(3)
        rows = [(None if rng.random() < 0.2 else rng.choice("ab") if rng.random() < 0.9 else "c", i, rng.randint(-3, 3)) for i in range(400)]
        df = spark.createDataFrame(rows, "k string, t long, v long")
        sums, before, total, last = {}, {}, {}, {}
        for k, t, v in rows:
            total[k] = total.get(k, 0) + v
            sums[t], before[t], last[k] = total[k], last.get(k), t
        assert {r["t"]: r["s"] for r in with_running_sums(df, ["k"], ["t"], {"s": F.col("v"), "n": F.lit(1)}).collect()} == sums
        assert {r["t"]: r["_previous"] and r["_previous"]["t"] for r in with_previous(df, ["k"], ["t"], ["t"]).collect()} == before
        assert with_previous(df.limit(0), ["k"], ["t"], ["t"]).count() == 0 and with_running_sums(df.limit(0), ["k"], ["t"], {"s": F.col("v")}).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_overlap_counts_and_covering_against_brute_force(spark):
    rng = random.Random(8)
    spans = [(i, rng.choice(["a", None]), s := rng.choice([None, *range(90)]), None if s is None else s + rng.randint(-2, 25)) for i in range(120)]
    turns = [(i, rng.choice(["a", None]), s := rng.choice([None, *range(90)]), None if s is None else s + rng.randint(-2, 25)) for i in range(150)]
    right = lambda x: x[2] is not None and x[3] > x[2]
    left, other = (spark.createDataFrame(x, f"{n} long, k string, s long, e long") for x, n in ((spans, "l"), (turns, "r")))
    expected = {a[0]: n for a in spans if right(a) and (n := sum(right(b) and a[1] == b[1] and a[2] < b[3] and b[2] < a[3] for b in turns))}
    assert {r["l"]: r["n"] for r in overlap_counts(left, other, ["k"], "l", "s", "e").collect()} == expected
    cover = {t[0]: [a[0] for a in spans if right(a) and a[1] == t[1] and a[2] <= t[2] < a[3]] for t in turns if t[2] is not None}
    found = {r["r"]: (r["n"], r["l"]) for r in covering(other, left, ["k"], "r", "s", "l", "s", "e").collect()}
    assert found == {t: (len(x), x[0] if len(x) == 1 else None) for t, x in cover.items() if x}
    assert overlap_counts(left.limit(0), other, ["k"], "l", "s", "e").count() == 0


def test_split_at_pauses(spark):
    assert split_at_longest([0, 10, 30], [5, 20, 35], 25, 2) == [(0, 20, False), (30, 35, False)]
    assert split_at_longest([0], [70], 30, 5) == [(0, 30, False), (25, 55, True), (50, 70, True)]

    def slow(spans):
        if spans[-1][1] - spans[0][0] <= 40 or len(spans) == 1:
            return [(p[0], p[1]) for p in split_at_longest([spans[0][0]], [spans[-1][1]], 40, 4)] if len(spans) == 1 else [(spans[0][0], spans[-1][1])]
        gaps = [b[0] - a[1] for a, b in itertools.pairwise(spans)]
        k = gaps.index(max(gaps)) + 1
        return slow(spans[:k]) + slow(spans[k:])

    rng, at, spans = random.Random(4), 0, []
    for _ in range(200):
        at += rng.randint(1, 60)
        spans.append((1, at, at := at + rng.randint(1, 60)))
    found = pause_chunks(spark.createDataFrame(spans, "k long, s long, e long"), ["k"], "s", "e", 40, 4).collect()
    assert sorted((r["s"], r["e"]) for r in found) == sorted(slow([(s, e) for _, s, e in spans]))


def test_tables_and_sections(spark):
    rows = [f"| r{i} | {i} |" for i in range(6)]
    text = "\n".join(["Cap", "| a | b |", "|---|---|", "| Old | Old |", *rows])
    parts = table_parts(text, 60)
    assert all(p.startswith("Cap\n| a | b |\n|---|---|") and len(p) <= 60 for p, _ in parts)
    assert [g for _, g in parts] == [False] + [True] * (len(parts) - 1) and all("| Old | Old |" in p for p, _ in parts)
    assert [x for p, _ in parts for x in p.split("\n") if x in rows] == rows
    assert table_parts("| a |", 2) == [("| a |", False)]
    lines = ["| New | New |", "| 3 | 3 |", "| a | b |", "| a |", "|  |  |", "text"]
    assert column(spark, lines, is_section_row) == [True, False, False, False, False, False]
    assert column(spark, [[["a"]], [[" ", ""]], [], None], empty_grid, "array<array<string>>") == [False, True, True, True]
    df = spark.createDataFrame([(1, text, "table", "x"), (2, "One. Two! " + "y" * 70, "text", "x"), (3, None, "text", "x"), (4, "", None, "x"), (5, "Short.", None, "x")], "id long, body string, element string, part string")
    found = {(r["id"], r["part_no"]): r["part"] for r in split_chunks(df, ["id"], "body", "element", 60).collect()}
    assert found[2, 1] == "One." and found[2, 2] == "Two! " + "y" * 55
    assert {k[0] for k in found} == {1, 2, 4, 5} and found[4, 1] == "" and max(map(len, found.values())) <= 60
    assert split_tables(df.limit(0), ["id"], "body", 60).count() == 0


def test_sentences(spark):
    cases = {"A one. B two. C three.": ["A one. B two.", "C three."], "x" * 30: ["x" * 14, "x" * 14, "xx"], "": [], "Dr. who? No (yes) ok.": ["Dr. who?", "No (yes) ok."]}
    assert column(spark, list(cases), lambda c: sentence_parts(c, 14)) == list(cases.values())
    assert column(spark, [["a", "bb", "cccccc", "d"], [], ["x"]], lambda c: packed(c, 4), "array<string>") == [["a bb", "cccccc", "d"], [], ["x"]]


def test_merge_under_heading(spark):
    rows = [(1, 1, "aa", "text", "H"), (1, 2, "bb", "text", "H"), (1, 3, "| t |", "table", "H"), (1, 4, "cc", "text", "H"), (1, 5, "dd", "text", "G"), (1, 6, "ee", "text", None), (1, 7, "ff", "text", None), (2, 1, "gg", "text", None), (2, 2, None, "text", None), (2, 3, "h" * 20, "text", None)]
    df = spark.createDataFrame(rows, "s long, n long, t string, e string, h string")
    found = [r["part"] for r in merged_under_heading(df, "s", ["n"], "t", "e", "h", 10).orderBy("s", "run", "part_no").collect()]
    assert found == ["aa\n\nbb", "| t |", "cc", "dd", "ee\n\nff", "gg", "h" * 20]


def test_cell_f1():
    one = grid_of("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |")
    assert f1_of(one, one) == 1.0 and f1_of([], []) == 1.0 and f1_of(one, []) == 0.0
    assert f1_of(one, [["a", "b"], ["3", "4"]]) == pytest.approx(2 * 4 / 10)
    assert f1_of(one, [["b", "a"], ["1", "x"]]) == pytest.approx(2 * 2 / 10)
    assert grid_of("| | A |\n| | B  C |") == [["a"], ["b c"]]


def test_places_and_values(spark):
    place = "struct<page_start:int,page_end:int,start_s:double,end_s:double>"
    rows = [((1, 3, None, None), (2, None, None, None), True), ((4, None, None, None), (5, None, None, None), False), ((None, None, 1.0, 2.0), (None, None, 2.0, 9.0), True), ((None, None, None, None), (None, None, 2.0, 9.0), False), ((7, 7, None, None), (None, None, None, None), True)]
    assert all(r[0] == r[1] for r in spark.createDataFrame(rows, f"c {place}, r {place}, x boolean").select(M.at_place(F.col("c"), F.col("r")), "x").collect())
    values = spark.createDataFrame([(None, " "), (None, "x"), ("$5", "5"), ("5", None)], "e string, g string")
    assert [r[0] for r in values.select(M.value_matches(F.col("e"), F.col("g"), canonical)).collect()] == [True, False, True, False]


def test_identifiers_inside_longer_ones(spark):
    docs = spark.createDataFrame([(1, "The CN78-X5 came. cn78-x5!"), (2, "about cn78 only"), (3, None), (4, "CN7"), (5, "")], "id long, text string")
    asked = spark.createDataFrame([(10, "Where is CN78?"), (11, "And CN78-X5 or ZZ-9?"), (12, "no code")], "q long, question string")
    found = identifier_hits(docs, "id", F.col("text"), asked, "q", X.identifiers(F.col("question"))).collect()
    assert {(r["q"], r["id"]) for r in found} == {(10, 1), (10, 2), (11, 1)}
    assert identifier_hits(docs.limit(0), "id", F.col("text"), asked, "q", X.identifiers(F.col("question"))).count() == 0


def test_vector_ties(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(40)], "id long, v array<float>")
    found = vector_topk(rows, "id", "v", rows.where("id = 1"), 5).orderBy("rank").collect()
    assert [r["id"] for r in found] == [1, 3, 5, 7, 9]


def test_written_dates(spark):
    cases = {
        "2026-09-14": "2026-09-14", "14/09/2026": "2026-09-14", "09/14/2026": "2026-09-14", "03/04/2026": None, "5.5.2026": "2026-05-05", "31/02/2026": None, "5 September 2026": "2026-09-05", "Sept. 5, 2026": "2026-09-05",
        "14-Oct-2026": "2026-10-14", "May 32, 2026": None, "13/13/2026": None, "soon": None, "": None, None: None,
    }
    assert column(spark, list(cases), iso_date) == list(cases.values())
