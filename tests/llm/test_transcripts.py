import pytest
from pyspark.sql import functions as F

from tessaro.llm.transcripts import _repeated, speaker_turns, typical_pause
from tessaro.operators.intervals import periods_and_gaps

TURNS = "turn_id long, source_id long, take int, start_s double, end_s double, speaker string, text string, language string, names string"


def turns(spark, rows, **options):
    filled = [(i, *r, "x", "y") for i, r in enumerate(rows)]
    sources = spark.createDataFrame([(1, '{"language": "en"}'), (2, "{}"), (3, '{"language": "de"}')], "id long, info string")
    names = spark.createDataFrame([(1, 1, " Quilla"), (1, 2, "Rosmer "), (2, 5, None)], "source_id long, speaker int, name string")
    found = speaker_turns(spark.createDataFrame(filled, TURNS), sources, names, **options)
    return [tuple(r) for r in found.orderBy("source_id", "take", "start_cs", "speaker").collect()]


def test_labels_notes_and_hesitations(spark):
    rows = [
        (1, 1, 5.0, 6.0, "Qiulla [host]", "[0:05] Uhm, we   meet at 8:50 (without freight) [coughs 00:03] today."),
        (1, 1, 2.0, 4.0, None, ">> Rosmer: Note: er — it's ((phone rings)) fine, mhm"),
        (1, 1, None, 9.0, "S2", "00:00:08 - *music* Agreed (tos) (inaudible)"),
        (1, 1, 9.0, 9.5, "Speaker 2", "[laughter]"),
        (1, 1, 10.0, 11.0, "?", "nobody knows"),
        (1, 1, 12.0, 13.0, "spk3", None),
        (1, 1, None, 13.0, "spk3", "no time at all"),
    ]
    assert turns(spark, rows) == [
        (1, 1, 200, 2, "note it s fine"),
        (1, 1, 500, 1, "we meet at 8 50 without freight today"),
        (1, 1, 800, 2, "agreed"),
        (1, 1, 1000, 0, "nobody knows"),
    ]


def test_language_decides_what_a_hesitation_is(spark):
    rows = [(3, 1, 1.0, 2.0, "1", "Äh er kommt um 9"), (2, 1, 1.0, 2.0, "1", "um er yes")]
    assert turns(spark, rows) == [(2, 1, 100, 1, "yes"), (3, 1, 100, 1, "er kommt um 9")]


def test_duplicates_ties_order_and_unknown_source(spark):
    rows = [(9, 1, 3.0, 4.0, "S1", "third"), (9, 1, 1.0, 2.0, "1", "first"), (9, 1, 1.0000001, 2.0, "SPEAKER_01", "first "), (9, 1, 1.0, 2.0, "2", "other"), (9, 2, 1.0, 2.0, "1", "take two"), (None, 1, 1.0, 2.0, "1", "null source")]
    assert turns(spark, rows) == [(None, 1, 100, 1, "null source"), (9, 1, 100, 1, "first"), (9, 1, 100, 2, "other"), (9, 1, 300, 1, "third"), (9, 2, 100, 1, "take two")]
    assert turns(spark, []) == []


def test_one_take_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(1, 1, float(i), i + 0.5, "1" if i < 150 or i % 2 else "2", f"w{i}") for i in range(200)]
        found = turns(spark, rows)
        assert len(found) == 51 and found[0] == (1, 1, 0, 1, " ".join(f"w{i}" for i in range(150)))
        assert " ".join(r[4] for r in found) == " ".join(f"w{i}" for i in range(200))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rolling_captions_and_pauses(spark):
    rolling = [(1, 1, 1.0, 4.0, "1", "we walked down to the lake"), (1, 1, 3.0, 6.0, "1", "down to the lake and then home"), (1, 1, 5.0, 8.0, "1", "and then home we slept")]
    assert turns(spark, rolling) == [(1, 1, 100, 1, "we walked down to the lake and then home we slept")]
    said_again = [(1, 1, 1.0, 2.0, "1", "it is what it is"), (1, 1, 8.0, 9.0, "1", "it is what it is")]
    assert turns(spark, said_again) == [(1, 1, 100, 1, "it is what it is it is what it is")]
    assert len(turns(spark, said_again, pause_cs=300)) == 2


@pytest.mark.parametrize(("before", "now", "n"), [("a b c", "b c d", 2), ("a b", "c", 0), ("a a a", "a a", 2), ("x", "x", 1), ("", "a", 0)])
def test_suffix_prefix(before, now, n):
    assert _repeated(before.split(), now.split()) == n


def test_typical_pause(spark):
    df = spark.createDataFrame([(1, i * 10, i * 10 + 4) for i in range(11)], "k long, start_cs long, end_cs long")
    assert typical_pause(periods_and_gaps(df, ["k"], "start_cs", "end_cs")) == 6
    assert typical_pause(df.withColumn("kind", F.lit("gap")).limit(0)) is None
