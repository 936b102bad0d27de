import random
import unicodedata

from tessaro.llm.leaks import WuManber, leaked, words


def brute(docs, items, run):
    out = set()
    for d, text in docs:
        w = words(text or "")
        held = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
        out |= {(d, k) for k, t in items if t and any(tuple(words(t)[i : i + run]) in held for i in range(len(words(t)) - run + 1))}
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(80)] + [(500, None), (501, "")]
    items = [(i, text(rng.randint(0, 12))) for i in range(40)] + [(90, None)]
    schema = "{0} long, text string, _doc string"
    frames = [spark.createDataFrame([(*r, "x") for r in rows], schema.format(k)) for rows, k in ((docs, "doc_id"), (items, "item_id"))]
    for size in (1 << 20, 40):
        found = leaked(frames[0], "doc_id", "text", frames[1], "item_id", "text", run=4, block_words=size)
        assert {tuple(r) for r in found.collect()} == brute(docs, items, 4)
    assert leaked(frames[0].limit(0), "doc_id", "text", frames[1], "item_id", "text").count() == 0
    assert leaked(frames[0], "doc_id", "text", frames[1].limit(0), "item_id", "text").count() == 0


def test_form_and_case_and_punctuation_do_not_matter():
    finder = WuManber([(1, "Café au lait, s'il vous plaît")], 5)
    assert finder.find(unicodedata.normalize("NFD", "… CAFÉ—au (lait) s’IL vous!")) == {1}
    assert finder.find("café au lait s vous il") == set()


def test_tables_are_bounded():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(8000)]
    items = [(i, " ".join(vocabulary[min(int(rng.paretovariate(0.6)), 8000) - 1] for _ in range(60))) for i in range(3000)]
    finder = WuManber(items, 12)
    assert finder.size() <= 8 * sum(len(t) for _, t in items)
    assert finder.find("x y " + items[5][1]) >= {5} and finder.find(" ".join(items[5][1].split()[:11])) == set()


def test_long_runs():
    text = " ".join(f"w{i % 7}" for i in range(900))
    assert WuManber([(1, text)], 300).find("a b " + text[:1500]) == {1} and WuManber([(1, text)], 300).find(text[:600]) == set()


def test_large_vocabulary():
    items = [(k, " ".join(f"w{k * 20 + i}" for i in range(20))) for k in range(20_000)]
    finder = WuManber(items, 12)
    assert all(finder.find("the " + items[k][1] + " end") == {k} for k in (0, 7, 15_000, 19_999))
