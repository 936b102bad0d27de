from collections import defaultdict

from tessaro.llm.quality import FEATURES, kinds_of_text, statistics, text_statistics
from tessaro.llm.quality_holdout import HOLDOUT

COMMON = [("en", w, i) for i, w in enumerate("the of and to in is it that was for on are with as they be at this have from or had by not but what all were we when your can said there an each which she do how their if will up about out many then them these so some".split(), 1)]
COMMON += [("de", w, i) for i, w in enumerate("der die das und ist nicht ein eine im am zu den von mit sich auf für war dass auch es an werden aus er hat".split(), 1)]


def table(spark):
    return spark.createDataFrame(COMMON, "lang string, word string, word_rank int")


def test_statistics():
    common = defaultdict(set)
    for lang, word, _ in COMMON:
        common[lang].add(word)
    row = dict(zip(FEATURES, statistics("The cat is in.\n- two\nNo end", common)))
    assert row["n_words"] == 7 and row["n_lines"] == 3 and abs(row["punctuated_lines"] - 1 / 3) < 1e-9 and abs(row["common_words"] - 3 / 7) < 1e-9 and abs(row["marked_lines"] - 1 / 3) < 1e-9


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n​"), (4, "word"), (4, "word"), (None, "a b"), (5, "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    assert sorted((r["doc_id"] or 0) for r in text_statistics(df, "doc_id", "text", table(spark)).collect()) == [0, 4, 4, 5]
    assert text_statistics(df.limit(0), "doc_id", "text", table(spark)).count() == 0
    assert kinds_of_text(df.limit(0), "doc_id", "text", table(spark)).count() == 0


def test_held_out_accuracy(spark):
    """Texts made of the holdout's kinds by doubling their lines; most must come out as their kind."""
    rows = [(i * 10 + j, t if j == 0 else t + "\n" + t.replace("a", "e", j)) for i, (_, t) in enumerate(HOLDOUT) for j in range(4)]
    truth = {i * 10 + j: k for i, (k, _) in enumerate(HOLDOUT) for j in range(4)}
    found = kinds_of_text(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", table(spark), trees=5, depth=3).collect()
    right = sum(truth[r["doc_id"]] == r["kind"] for r in found)
    assert len(found) == len(rows) and right >= 0.8 * len(rows)
    assert all(0 <= r[f"p_{k}"] <= 1 for r in found for k in ("list", "table", "junk"))


def test_the_classifiers_overrule_a_line_test(spark):
    """One line of prose with a special token's bars passes for a row of a table by its lines, not by its words."""
    prose = "The {} of the house is not the one that was in the {}, but they have it with them. So we can go there if you will, and all of them were at the {} when it was done."
    things = "door lamp gate yard roof shed well barn mill pond".split()
    rows = [(i, prose.format(a, b, c)) for i, (a, b, c) in enumerate((a, b, c) for a in things for b in things for c in things[:2])]
    rows += [(1000 + i, "\n".join(f"| {a} | {i + k} | {k * 7} |" for k, a in enumerate(things))) for i in range(60)]
    rows += [(2000 + i, "\n".join(f"- {a}, {i + k} pieces" for k, a in enumerate(things))) for i in range(60)]
    rows += [(3000 + i, " ".join([things[i % 10]] * (30 + i))) for i in range(60)]
    rows += [(5000, prose.format("<|end|>", "barn", "<|end|>"))]
    found = {r["doc_id"]: r for r in kinds_of_text(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", table(spark), trees=10).collect()}
    assert found[5000]["kind"] == "prose" and found[5000]["weak"] is None
    assert {found[k]["kind"] for k in range(1000, 1060)} == {"table"} and {found[k]["kind"] for k in range(3000, 3060)} == {"junk"}
