import pytest

from tessaro.llm.scans import _LINE_DDL, document_lines, edit_cost, is_number_line, number_repair, repaired_paragraphs, repairs, scan_noise, with_furniture


def test_lines():
    assert all(is_number_line(x) for x in ("- 18 -", "[3]", "Page 2 of 9", "Seite 4", "iv", "7/8"))
    assert not any(is_number_line(x) for x in ("", "9.", "record.", "May 4", "mix"))
    pages = document_lines("One\ntwo\n- 1 -\nTitle of it\nthree\n\fTitle of it\nfour")
    assert [x["page"] for x in pages] == [0, 0, 0, 0, 0, 1, 1]


def test_page_number_without_a_digit():
    assert all(is_number_line(x) for x in ("Page l", "Seite l", "- Page O -", "Página I of lO", "PAGE S"))
    assert not any(is_number_line(x) for x in ("Page so", "Pages", "Page one", "pagel of it", "B", "Seite"))


@pytest.mark.parametrize(("read", "true", "cost"), [("wr0ng", "wrong", 0.3), ("writteri", "written", 0.3), ("rnonth", "month", 0.3), ("same", "same", 0.0), ("abc", "abd", 1.0)])
def test_edit_cost(read, true, cost):
    assert edit_cost(read, true) == pytest.approx(cost)


def test_numbers():
    assert [number_repair(x) for x in ("2O31-05-1l", "€3,B45", "PO-2O31-77", "O2", "2031", "GR58-B2")] == ["2031-05-11", "3,845", "PO-2031-77", None, None, None]


def documents(spark, whole, items):
    return spark.createDataFrame(whole, "source_id long, pages int, markdown string, item_no string"), spark.createDataFrame(items, "source_id long, item_no int, self_ref string, label string, page_no int, text string, kind string")


def test_noise(spark):
    body = "The carrier came before noon and left the boxes at the gate.\n" * 30
    torn = "Notes of the year\n\nThe carrier came before noon and left the\nboxes at the sbort gate. No one could car-\n\n- 1 -\n\fNotes of the year\n\nrier or not, it was 2O31 that counted here.\nThe end came.\n\n- 2 -"
    items = [
        (7, 1, "", "text", 1, "The carrier left the boxes because the\ngate was closed and nobody had asked the", ""),
        (7, 2, "", None, 1, "- 4 -", ""),
        (7, 3, "", "page_header", 2, "Year of notes", ""),
        (7, 4, "", "text", 2, "others about it.", ""),
        (8, 1, "", None, None, None, ""),
    ]
    clean = "The short way was short. " * 12
    whole, rest = documents(spark, [(1, 2, torn, "x"), (2, 1, clean, "x"), (3, None, None, "x"), (4, 0, "", "x"), (5, 1, body, "x")], items)
    found = {tuple(r) for r in scan_noise(whole, rest).collect()}
    assert found == {
        (1, 0, 1, "header", ""), (1, 0, 7, "header", ""), (1, 0, 6, "page_number", ""), (1, 0, 12, "page_number", ""), (1, 0, 4, "hyphen", "carrier"), (1, 0, 4, "char", "short"),
        (1, 0, 9, "join", ""), (1, 0, 9, "char", "2031"), (7, 2, 1, "page_number", ""), (7, 3, 1, "header", ""), (7, 4, 1, "join", ""),
    }
    assert scan_noise(whole.limit(0), rest.limit(0)).count() == 0
    twice = {tuple(r) for r in scan_noise(whole.where("source_id = 1"), rest.limit(0)).collect()}
    assert ("header" in {r[3] for r in twice}) and all(r[0] == 1 for r in twice)


def test_every_recurring_header_counts(spark):
    names = ["The Ferries Of Upper Quilla In Winter", "A Short Account Of Many Bridges Built", "Letters From Harbour Masters And Pilots", "Rules For Crates That Nobody Collected", "What Became Of Those Older Warehouses", "On Lamps And Their Keepers By Night", "Seven Journeys Through Northern Canals"]
    rows = [(n + ("" if k else "s"), names.index(n)) for n in names for k in range(3)]
    rows = [(1, 0, i, i, x, False, True, False, False, None) for i, (x, _) in enumerate(rows)]
    rows.append((1, 0, 99, 99, "An unlike line that stands there just once", False, True, False, False, None))
    lines = spark.createDataFrame(rows, _LINE_DDL)
    assert {r["line_no"] for r in with_furniture(lines).where("header").collect()} == set(range(21))


def test_short_words_meet(spark):
    true = [("mit", 400), ("der", 400), ("was", 400), ("die", 400), ("me", 400), ("mine", 400), ("wrong", 3)]
    read = {"rnit": "mit", "cler": "der", "vvas": "was", "clie": "die", "rne": "me", "rnirie": "mine", "wr0ng": "wrong"}
    rows = spark.createDataFrame(true + [(w, 1) for w in read], "word string, n long")
    found = {(r["word"], r["candidate"]) for r in repairs(rows).collect()}
    assert set(read.items()) <= found


def test_paragraphs(spark):
    torn = "Notes of the year\n\nThe carrier came before noon and left the\nboxes at the sbort gate. No one could car-\n\n- 1 -\n\fNotes of the year\n\n“rier”, or not: it was 2O31 that counted here.\nThe ﬁrst end came.\n\nA new one, at\nlast.\n# Head\n- one\n- two\n\n- 2 -"
    items = [(7, 1, "", "text", 1, "The carrier left the boxes because the\ngate was closed and nobody had asked the", ""), (7, 2, "", None, 1, "- 4 -", ""), (7, 4, "", "text", 2, "others about it.", ""), (7, 5, "", "text", 2, "Once more.", ""), (8, 1, "", None, None, None, "")]
    whole, rest = documents(spark, [(1, 2, torn, "x"), (2, 1, "The short way was short. " * 12, "x"), (3, None, None, "x"), (4, 0, " \n", "x")], items)
    rows = {(r["source_id"], r["item_no"], r["paragraph_no"]): r["text"] for r in repaired_paragraphs(whole, rest).collect()}
    assert rows == {
        (1, 0, 1): "The carrier came before noon and left the boxes at the short gate. No one could carrier”, or not: it was 2031 that counted here. The first end came.",
        (1, 0, 2): "A new one, at last.", (1, 0, 3): "# Head", (1, 0, 4): "- one", (1, 0, 5): "- two",
        (2, 0, 1): ("The short way was short. " * 12).strip(),
        (7, 1, 1): "The carrier left the boxes because the gate was closed and nobody had asked the others about it.", (7, 5, 1): "Once more.",
    }
    assert repaired_paragraphs(whole.limit(0), rest.limit(0)).count() == 0


def test_keys_of_columns_agree_with_those_of_lines(spark):
    from pyspark.sql import functions as F

    from tessaro.llm.scans import _could_be_header, _key_of, could_be_header, furniture_key

    lines = ["Notes of 2031", "  12   The Year  ", "The Year   - 7 -", "ends.", "lower case", "# head", "Ä broken-", "x", "Title – 4", "1O  Harbour", "Über  alles", "a" * 80, "Says:", "O2 Sensors\u00a0 9", "5", "Straße 7,"]
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select("t", _key_of(F.col("t")), _could_be_header(F.col("t"))).collect()
    assert [(r[1], r[2]) for r in rows] == [(furniture_key(r[0]), could_be_header(r[0])) for r in rows]
