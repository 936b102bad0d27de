"""Searches whose queries and documents grow together: right results, and no pair of both stored."""

import math
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tessaro.operators.search import bm25, held_by_any, identifier_hits
from tessaro.plans.packing import search_trace
from tessaro.plans.search import _places, hybrid_search, search_modes

NAMES = "pump valve crate hall dock mill yard annex".split()


def shuffled(spark, run):
    """What ``run`` returns, and how many rows were shuffled meanwhile."""
    sc = spark.sparkContext._jsc.sc()

    def rows():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = rows()
    return run(), rows() - before


def stored(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    return spark.read.parquet(str(tmp_path / f"{name}.parquet"))


def tables(spark, tmp_path, n=300):
    """``n`` documents, some of them alike, and 60 queries that share common terms with nearly all of them and differ in rare ones."""
    texts = {i: ["pump", NAMES[i % 8], NAMES[i % 3], *["hall"] * (i % 4), f"no-{i // 2}"] for i in range(n)} | {n: None, n + 1: []}
    asked = {i: ["pump", NAMES[i % 5], f"no-{i}", *([f"no-{i + 1}"] if i % 2 else []), "unheard"] for i in range(60)} | {60: ["unheard"], 61: []}
    return texts, asked, stored(spark, tmp_path, "t", list(texts.items()), "id long, t array<string>"), stored(spark, tmp_path, "a", list(asked.items()), "q long, a array<string>")


def ranks(texts, asked, k):
    held = {i: t or [] for i, t in texts.items()}
    mean = sum(map(len, held.values())) / len(held)
    df = {}
    for t in held.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = {}
    for q, terms in asked.items():
        scores = []
        for i, t in held.items():
            if common := set(terms) & set(t):
                w = (max(math.log((len(held) - df[x] + 0.5) / (df[x] + 0.5)), 1e-6) * t.count(x) * 2.2 / (t.count(x) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for x in common)
                scores.append((-round(sum(w), 6), i))
        out |= {(q, n): (i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_bm25_stores_no_pairs(spark, tmp_path):
    texts, asked, docs, queries = tables(spark, tmp_path)
    found, rows = shuffled(spark, lambda: bm25(docs, "id", F.col("t"), queries, "q", F.col("a"), 7).collect())
    assert {(r["q"], r["rank"]): (r["id"], r["score"]) for r in found} == ranks(texts, asked, 7)
    assert rows < 60 * 300 / 2
    found = bm25(docs, "id", F.col("t"), queries, "q", F.col("a"), 7, block=9).collect()
    assert {(r["q"], r["rank"]): (r["id"], r["score"]) for r in found} == ranks(texts, asked, 7)
    assert bm25(docs, "id", F.col("t"), queries.limit(0), "q", F.col("a")).count() == 0 == bm25(docs.limit(0), "id", F.col("t"), queries, "q", F.col("a")).count()


def test_terms_held_store_no_pairs(spark, tmp_path):
    texts, asked, docs, queries = tables(spark, tmp_path)
    held = {q: [max(t.count(x) for x in a) for t in texts.values() if t and set(a) & set(t)] for q, a in asked.items()}
    want = {q: (len(n), max(n)) for q, n in held.items() if n}
    for block in (16384, 9):
        assert {r["q"]: (r["documents"], r["most"]) for r in held_by_any(docs, F.col("t"), queries, "q", F.col("a"), block).collect()} == want
    assert held_by_any(docs, F.col("t"), queries.limit(0), "q", F.col("a")).count() == 0 == held_by_any(docs.limit(0), F.col("t"), queries, "q", F.col("a")).count()
    stored(spark, tmp_path, "chunks", [(i, " ".join(t or [])) for i, t in texts.items()], "id long, text string")
    stored(spark, tmp_path, "qa_turns", [(50 * i, " ".join(a)) for i, a in asked.items()], "id long, question string")
    found, rows = shuffled(spark, lambda: search_trace(spark, str(tmp_path)).collect())
    assert {r["qa_id"] // 50: (r["chunks"], r["most"]) for r in found} == want
    assert rows < 60 * 300 / 2


@pytest.mark.parametrize("query", [hybrid_search, search_modes])
def test_fused_searches_store_no_pairs(spark, tmp_path, query):
    texts, asked, *_ = tables(spark, tmp_path, 3000)
    stored(spark, tmp_path, "chunks", [(i, " ".join(t or []), None) for i, t in texts.items()], "id long, text string, context string")
    stored(spark, tmp_path, "qa_turns", [(50 * i, " ".join(a)) for i, a in asked.items()], "id long, question string")
    stored(spark, tmp_path, "embeddings", [(i, [1.0, float(i % 7)], 1) for i in range(100)], "vec_id long, embedding array<double>, label int")
    found, rows = shuffled(spark, lambda: query(spark, str(tmp_path)).collect())
    best = ranks(texts, asked, 1)
    assert {r["qa_id"] // 50 for r in found} >= {q for q, _ in best}
    # The two that hold the identifier are ahead in two lists.
    assert {r["id"] for r in found if r["qa_id"] == 50 * 40 and r["rank"] <= 2 and r.asDict().get("mode") != "vectors"} == {80, 81}
    assert rows < 60 * 3000 / 2


def test_scores_round_as_in_sql(spark):
    values = [8.735615, 8.203945, 17.810145, 0.015625, -0.000015, *(i / 1e6 for i in range(5, 30_000_000, 99_990))]
    found = spark.createDataFrame([(v,) for v in values], "v double").select(_places(F.col("v"), 5)).collect()
    assert [r[0] for r in found] == [r[0] for r in duckdb.execute("SELECT round(v, 5) FROM (SELECT unnest($1::DOUBLE[]) AS v)", [values]).fetchall()]


def held_ranks(texts, asked, k):
    """What ``identifier_hits`` gives, by brute force."""
    held = {i: t.lower() for i, t in texts.items() if t and len(t) > 2}
    mean = sum(len(t) - 2 for t in held.values()) / len(held)
    terms = {q: {x.lower() for x in a if len(x) > 2 and any(c in "0123456789" for c in x)} for q, a in asked.items()}
    tf = {x: {i: n for i, t in held.items() if (n := t.count(x))} for x in set().union(*terms.values())}
    idf = {x: max(math.log((len(held) - len(n) + 0.5) / (len(n) + 0.5)), 1e-6) for x, n in tf.items()}
    out = {}
    for q, own in terms.items():
        best = {}
        for x in own:
            for i, n in tf[x].items():
                best[i] = max(best.get(i, 0), round(idf[x] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * (len(held[i]) - 2) / mean)), 6))
        out |= {(q, n): (i, -s) for n, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k], 1)}
    return out


def checkpointed(spark):
    """Bytes in the checkpoint folder."""
    folder = spark.sparkContext.getCheckpointDir()
    return sum(p.stat().st_size for p in Path(folder.removeprefix("file:")).rglob("*") if p.is_file()) if folder else 0


def test_identifiers_store_neither_pairs_nor_runs(spark, tmp_path):
    """One identifier is in each text and asked by each query; the texts hold ten codes each that are all different."""
    texts = {i: " ".join(["Crate ZZ-77", *(f"tk-{i * 10 + j:05}/{i % 7}" for j in range(10))]) for i in range(2000)}
    asked = {q: ["zz-77", f"TK-{q * 31:05}"] for q in range(60)}
    docs, queries = stored(spark, tmp_path, "t", list(texts.items()), "id long, t string"), stored(spark, tmp_path, "a", list(asked.items()), "q long, a array<string>")
    before = checkpointed(spark)
    found, rows = shuffled(spark, lambda: identifier_hits(docs, "id", F.col("t"), queries, "q", F.col("a"), 7).collect())
    assert {(r["q"], r["rank"]): (r["id"], r["score"]) for r in found} == held_ranks(texts, asked, 7)
    assert rows < 2000
    assert checkpointed(spark) - before < 300_000


@pytest.mark.parametrize("block", [131072, 5])
def test_identifiers_as_brute_force_finds_them(spark, tmp_path, block):
    """Few characters, so that they overlap, repeat, stand at the ends of texts and share their last bytes; some of several bytes."""
    rng = random.Random(5)
    some = lambda least, most: "".join(rng.choice("aB1-é2. ") for _ in range(rng.randint(least, most)))
    texts = {i: some(0, 40) for i in range(400)} | {400: None, 401: "a-1", 402: "1-a", 403: "xx-AB12-1212-1212", 404: "-1212-1212", 405: "1é", 406: "日本1日本1日本1", 407: ""}
    asked = {q: [some(1, 6).strip() for _ in range(3)] for q in range(80)} | {80: ["xx-ab12-1212-1212", "yy-ab12-1212-1212", "12-1212"], 81: ["本1日", "1-a", "a-1"], 82: ["aBa", "---"], 83: [], 84: None, 85: ["111", "1aaaaaaaaaaaa", "xx-AB12-1212-1212z"]}
    docs, queries = stored(spark, tmp_path, "t", list(texts.items()), "id long, t string"), stored(spark, tmp_path, "a", list(asked.items()), "q long, a array<string>")
    found = identifier_hits(docs, "id", F.col("t"), queries, "q", F.col("a"), 9, block=block).collect()
    want = held_ranks(texts, {q: a or [] for q, a in asked.items()}, 9)
    assert {(r["q"], r["rank"]): r["id"] for r in found} == {at: i for at, (i, _) in want.items()}
    assert all(abs(r["score"] - want[r["q"], r["rank"]][1]) < 2e-6 for r in found)
    assert identifier_hits(docs, "id", F.col("t"), queries.limit(0), "q", F.col("a")).count() == 0 == identifier_hits(docs.limit(0), "id", F.col("t"), queries, "q", F.col("a")).count()
