"""Speech transcripts as delivered into clean speaker turns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import periods_and_gaps
from ..operators.segments import PARTITION, carried, range_sorted, with_carried
from ..operators.skew import sized_join
from ..session import cut

# Hesitation sounds of each language, as patterns for whole lower-case words.
HESITATIONS = {
    "en": r"uh+-?huh+|u+h+m*|u+m+|er+m*|h+m+|m+-?h+m+|mm+",
    "de": r"ä+h+m*|ö+h+m*|e+hm+|h+m+|m+h+m*|mm+",
    "fr": r"e+u+h+|h+e+u+h*|hu+m+|h+m+|m+h+m*|mm+",
    "es": r"e+h+m*|e+m+|h+m+|m+h+m*|mm+",
}
# Words of notes about sounds. Only round brackets need them, as people also speak remarks that are set in round brackets.
SOUNDS = (
    "applause applauding clapping background noise noises static breath breathing breathes sigh sighs cough coughs coughing sneezes "
    "crosstalk overlapping door doors slams closes opens inaudible indistinct unintelligible laughter laughs laughing chuckles "
    "music pause silence phone rings ringing beep footsteps typing "
    "applaus beifall hintergrundgeräusch hintergrundgeräusche geräusch husten hustet seufzt lachen lacht musik pause stille rauschen "
    "telefon klingelt tür knallt schlägt zu unverständlich durcheinander "
    "applaudissements bruit bruits de fond porte claque toux tousse rires rire musique silence soupir téléphone sonne inaudible incompréhensible "
    "aplausos ruido ruidos fondo portazo puerta tos tose risas risa música pausa silencio suspiro suena el teléfono golpe inaudible ininteligible"
).split()

_NOT_WORD = r"(?![\p{L}\p{N}])"
_AFTER_NOT_WORD = r"(?<![\p{L}\p{N}])"
#: A time of the transcript: alone in brackets, or at the head before a dash or bar. Groups: hours, minutes, seconds.
_TIME = r"(?:[\[({<]\s*|^\s*)(?:(\d+):)?(\d+):(\d\d(?:\.\d+)?)(?:\s*[\])}>]:?|\s*[-–—|]\s)"
#: A speaker label at the head. Groups: what stands in brackets, between stars, before a colon or dash.
_LABEL = r"^\s*(?:>>+\s*)?(?:\[([^\[\]]{1,40})\]:?|\*\*\s*([^*:]{1,40}?)\s*:?\s*\*\*:?|([^\s:\[\](){}<>*.,!?-][^:\[\](){}<>*.,!?\n]{0,40}?)\s*(?::|\s[-–—])\s)"
_NOTE = r"\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\(\([^()]*\)\)|\*[^*\s][^*]*\*"
_SOUND = r"\((?:[\s,\d:]*" + _AFTER_NOT_WORD + "(?:" + "|".join(sorted(set(SOUNDS))) + ")" + _NOT_WORD + r")+[\s,\d:]*\)"


def _hundredths(text: Column) -> Column:
    part = [F.regexp_extract(text, _TIME, i) for i in (1, 2, 3)]
    hours, minutes, seconds = (F.when(p != "", p).cast("double") for p in part)
    return F.round((F.coalesce(hours, F.lit(0.0)) * 3600 + minutes * 60 + seconds) * 100).cast("long")


def _plain(label: Column) -> Column:
    """A speaker label in lower case without roles in brackets, punctuation and initials."""
    bare = F.regexp_replace(F.lower(label), r"[\[(][^\])]*[\])]|[:*>]", " ")
    return F.trim(F.regexp_replace(F.trim(bare), r"\s+\p{L}\.$|\s+", " "))


def _number(label: Column, names: Column) -> Column:
    """The speaker's number that a label means, or null.

    A name may differ by one letter or by two neighbours that changed places.
    """
    digits = F.regexp_extract(label, r"(\d+)", 1)
    plain = _plain(label)
    letters = F.array_sort(F.split(plain, ""))

    def alike(known: Column) -> Column:
        swapped = (F.levenshtein(known, plain) == 2) & (F.length(known) == F.length(plain)) & (F.array_sort(F.split(known, "")) == letters)
        return (F.length(plain) > 2) & ((F.levenshtein(known, plain) <= 1) | swapped)

    exact = F.filter(names, lambda n: n["name"] == plain)
    near = F.filter(names, lambda n: alike(n["name"]))
    by_name = F.coalesce(F.try_element_at(exact, F.lit(1))["speaker"], F.when(F.size(near) == 1, F.try_element_at(near, F.lit(1))["speaker"]))
    return F.when(digits != "", digits.cast("int")).when(plain != "", by_name)


def profiles(sources: DataFrame, speaker_names: DataFrame) -> DataFrame:
    """One row for each recording: its language and the plain names of its speakers."""
    language = F.coalesce(F.get_json_object("info", "$.language"), F.lit("en"))
    named = speaker_names.where("name IS NOT NULL").groupBy("source_id").agg(F.collect_set(F.struct(_plain(F.col("name")).alias("name"), F.col("speaker").cast("int").alias("speaker"))).alias("names"))
    spoken = sources.select(F.col("id").alias("source_id"), language.alias("language")).dropDuplicates(["source_id"])
    return spoken.join(named, "source_id", "full").withColumn("language", F.coalesce("language", F.lit("en")))


def spoken_rows(turns: DataFrame, profile: DataFrame) -> DataFrame:
    """Each row's start, end, speaker and spoken words, which may be none."""
    fields = turns.select("turn_id", "source_id", "take", "start_s", "end_s", "speaker", "text")
    rows = sized_join(fields, profile, ["source_id"])
    names = F.coalesce("names", F.array().cast("array<struct<name:string,speaker:int>>"))
    said = F.lower(F.col("text"))
    start = F.coalesce(F.round(F.col("start_s") * 100).cast("long"), _hundredths(said))
    timeless = F.regexp_replace(said, _TIME, " ")
    rows = rows.withColumns({"_start": start, "_said": timeless, "_names": names})
    head = F.concat(*(F.regexp_extract("_said", _LABEL, i) for i in (1, 2, 3)))
    rows = rows.withColumns({"_head": head, "_own": _number(F.col("speaker"), F.col("_names"))})
    rows = rows.withColumn("_named", F.when(F.col("_head").rlike(r"^\s*(speaker|sprecher|sprecherin|locuteur|locutrice|intervenant|hablante|orador|spk|s)\W*\d+\s*$") | ~F.col("_head").rlike(r"\d"), _number(F.col("_head"), F.col("_names"))))
    said = F.when(F.col("_named").isNotNull(), F.regexp_replace("_said", _LABEL, " ")).otherwise(F.col("_said"))
    said = F.regexp_replace(F.regexp_replace(said, _NOTE, " "), _SOUND, " ")
    language = F.coalesce("language", F.lit("en"))
    quiet = F.lit(None).cast("string")
    for code, sounds in HESITATIONS.items():
        quiet = F.when(language == code, F.regexp_replace(said, f"{_AFTER_NOT_WORD}(?:{sounds}){_NOT_WORD}", " ")).otherwise(quiet)
    words = F.regexp_extract_all(F.coalesce(quiet, said), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return rows.select("turn_id", "source_id", "take", F.col("_start").alias("start_cs"), F.round(F.col("end_s") * 100).cast("long").alias("end_cs"), F.coalesce("_own", "_named", F.lit(0)).alias("speaker"), F.array_join(words, " ").alias("words"))

def _repeated(before: list[str], now: list[str]) -> int:
    """How many words at the head of ``now`` repeat the end of ``before``: the longest suffix of one that is a prefix of the other, by the failure function of ``now``."""
    fail, k = [0] * len(now), 0
    for i in range(1, len(now)):
        while k and now[i] != now[k]:
            k = fail[k - 1]
        k += now[i] == now[k]
        fail[i] = k
    k = 0
    for word in before[-len(now) :] if now else ():
        if k == len(now):
            k = fail[k - 1]
        while k and word != now[k]:
            k = fail[k - 1]
        k += word == now[k]
    return k


def _merge(pause: float | None, least: int):
    """A scan that joins successive rows of one speaker into pieces of turns."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, piece, number, fresh = None, object(), None, 0, True

        done: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["source_id"], row["take"])
                if fresh:
                    fresh = False
                    if row["_last"] is not None:
                        group, last = at, row["_last"]
                words = row["words"].split(" ")
                same = at == group
                again = _repeated(last["words"].split(" "), words) if same else 0
                rolled = again >= least and row["speaker"] == last["speaker"] and (last["end_cs"] is None or row["start_cs"] <= last["end_cs"])
                goes_on = same and row["speaker"] == last["speaker"] and (pause is None or last["end_cs"] is None or row["start_cs"] - last["end_cs"] <= pause)
                if piece is None or not goes_on:
                    if piece is not None:
                        done.append(piece)
                    number += 1
                    piece = {PARTITION: row[PARTITION], "source_id": row["source_id"], "take": row["take"], "number": number, "speaker": row["speaker"], "turn": None if goes_on else row["turn_id"], "start_cs": None if goes_on else row["start_cs"], "words": [], "trimmed": [], "pairs": 0, "rolled": 0}
                piece["words"].append(row["words"])
                kept = words[again:] if rolled else words
                piece["trimmed"] += [" ".join(kept)] if kept else []
                piece["pairs"] += same
                piece["rolled"] += rolled
                group, last = at, row
            if len(done) >= 1000:
                yield _batch(done)
                done = []
        if piece is not None:
            done.append(piece)
        if done:
            yield _batch(done)

    return scan


_PIECE = pa.schema([(PARTITION, pa.int32()), ("source_id", pa.int64()), ("take", pa.int32()), ("number", pa.int64()), ("speaker", pa.int32()), ("turn", pa.int64()), ("start_cs", pa.int64()), ("words", pa.string()), ("trimmed", pa.string()), ("pairs", pa.int64()), ("rolled", pa.int64())])


def _batch(pieces: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(p, words=" ".join(p["words"]), trimmed=" ".join(p["trimmed"])) for p in pieces], _PIECE)


_KEYS = ["source_id", "take"]


def _swept(rows: DataFrame, pause_cs: float | None, rolling_words: int) -> DataFrame:
    """The pieces of turns of ``rows`` (turn_id, ``_KEYS``, start_cs, end_cs, speaker, words), one row for each, in the order of the sweep."""
    ordered = range_sorted(rows, _KEYS, ["start_cs", "turn_id"])
    last = ordered.groupBy(PARTITION, *_KEYS).agg(F.max_by(F.struct("speaker", "words", "end_cs"), F.struct("start_cs", "turn_id")).alias("_l"))
    seeded = with_carried(ordered, carried(last, _KEYS, {"_last": F.last("_l")}))
    schema = f"{PARTITION} int, source_id bigint, take int, number bigint, speaker int, turn bigint, start_cs bigint, words string, trimmed string, pairs bigint, rolled bigint"
    return cut(seeded.mapInArrow(_merge(pause_cs, rolling_words), schema))


def rolling_takes(rows: DataFrame, rolling_words: int = 3) -> DataFrame:
    """How many successive rows of each take there are, and how many of them repeat the end of the row before: ``_KEYS``, pairs, rolled."""
    return _swept(rows, None, rolling_words).groupBy(*_KEYS).agg(F.sum("pairs").alias("pairs"), F.sum("rolled").alias("rolled"))


def merged_turns(rows: DataFrame, pause_cs: float | None = None, rolling_words: int = 3, rolling_share: float = 0.5) -> DataFrame:
    """The turns of clean rows (turn_id, ``_KEYS``, start_cs, end_cs, speaker, words): ``_KEYS``, start_cs, speaker, words; see ``speaker_turns``."""
    pieces = _swept(rows, pause_cs, rolling_words)
    opens = F.when(F.col("turn").isNotNull(), F.col("number"))
    opened = pieces.groupBy(PARTITION, *_KEYS).agg(F.max_by(F.struct("turn", "start_cs"), opens).alias("_o"))
    began = with_carried(pieces, carried(opened, _KEYS, {"_began": F.last("_o", ignorenulls=True)}))
    began = began.withColumns({"start_cs": F.when(F.col("turn").isNull(), F.col("_began.start_cs")).otherwise(F.col("start_cs")), "turn": F.coalesce("turn", "_began.turn")})
    part = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(PARTITION, "number", c))), lambda x: x[c]), " ")
    joined = began.groupBy(*_KEYS, "turn", "start_cs", "speaker").agg(part("words").alias("words"), part("trimmed").alias("trimmed"))
    shares = pieces.groupBy(*_KEYS).agg((F.sum("rolled") / F.greatest(F.sum("pairs"), F.lit(1))).alias("_share")).where(F.col("_share") >= rolling_share)
    chosen = sized_join(joined, shares, _KEYS)
    return chosen.select(*_KEYS, "start_cs", "speaker", F.when(F.col("_share").isNotNull(), F.col("trimmed")).otherwise(F.col("words")).alias("words"))


def calibrated_turns(rows: DataFrame, share: float = 0.9) -> DataFrame:
    """``merged_turns`` split also at pauses longer than ``share`` of all silences between the periods of takes are."""
    silences = periods_and_gaps(rows, _KEYS, "start_cs", "end_cs")
    return merged_turns(rows, typical_pause(silences, share))


def speaker_turns(turns: DataFrame, sources: DataFrame, speaker_names: DataFrame, pause_cs: float | None = None, rolling_words: int = 3, rolling_share: float = 0.5) -> DataFrame:
    """The clean turns of each take in time order: source_id, take, start_cs, speaker, words.

    A row's start is ``start_s`` or else the time in its text; rows with neither are left out, as
    are rows without a spoken word and those with a null text. The speaker is the number or the
    name in ``speaker``, or else in the label at the head of the text; 0 if unknown. Rows that
    agree in take, start, speaker and words are one row delivered twice. Rows with equal starts
    keep the order of ``turn_id``. Successive rows of one speaker are one turn, unless the silence
    between them is longer than ``pause_cs`` (None: never; ``typical_pause`` calibrates it).
    Rows of a source that isn't in ``sources`` are taken as English and unnamed. Other columns are
    ignored; an empty table gives an empty result.

    Captions that roll up repeat the end of the row before. Where at least ``rolling_share`` of a
    take's successive rows repeat ``rolling_words`` words or more of a row of the same speaker
    that isn't over, the longest suffix of one that is a prefix of the other is removed.

    Method: the timed rows are swept in start order over all takes at once, range-sorted, so that
    a long recording spreads over partitions; each partition starts from the last row before it.
    """
    rows = spoken_rows(turns, profiles(sources, speaker_names))
    once = rows.groupBy("source_id", "take", "start_cs", "speaker", "words").agg(F.min("turn_id").alias("turn_id"), F.max("end_cs").alias("end_cs"), F.bool_or((F.col("words") != "") & F.col("start_cs").isNotNull()).alias("_spoken"))
    # As an aggregate the test stays above: below it every pattern would be matched once for the test and once more for the row.
    once = once.where("_spoken").drop("_spoken")
    return merged_turns(once, pause_cs, rolling_words, rolling_share)


def typical_pause(intervals: DataFrame, share: float = 0.9) -> float | None:
    """The length of silence that ``share`` of the gaps don't exceed, null without gaps; ``intervals`` as from ``periods_and_gaps`` with start_cs and end_cs."""
    gap = intervals.where("kind = 'gap'").select((F.col("end_cs") - F.col("start_cs")).alias("gap"))
    return gap.agg(F.percentile("gap", F.lit(share))).first()[0]
