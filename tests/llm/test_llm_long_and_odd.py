"""Long and odd inputs: they end in time, and with the results that are stated."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import chat, decontaminate, html_text, mixing, toxicity


def brute_segments(scores):
    """Maximal segments by definition: split at the best segment, leftmost and shortest of equal ones."""
    best = None
    for b in range(len(scores)):
        total = 0.0
        for e in range(b, len(scores)):
            total += scores[e]
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = (b, e + 1, total)
    if best is None:
        return []
    b, e, _ = best
    left, right = brute_segments(scores[:b]), brute_segments(scores[e:])
    return left + [best] + [(x + e, y + e, s) for x, y, s in right]


@pytest.mark.parametrize("seed", range(40))
def test_segments_by_definition(seed):
    rng = random.Random(seed)
    scores = [float(rng.randint(-6, 6)) + rng.random() / 1000 for _ in range(rng.randint(0, 25))]
    got, want = toxicity.segments(scores), brute_segments(scores)
    assert [(b, e) for b, e, _ in got] == [(b, e) for b, e, _ in want]
    assert [s for _, _, s in got] == pytest.approx([s for _, _, s in want])


def test_segments_of_sinking_scores_are_linear():
    scores = [x for i in range(100_000) for x in (1.0, -2.0)]
    start = time.time()
    assert len(toxicity.segments(scores)) == 100_000
    assert len(toxicity.segments([1.0, -0.5] * 100_000)) == 1
    assert time.time() - start < 10


def test_labels_that_are_none(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "awful nasty words") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(36)] + [(36, 2), (37, -1), (38, None)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels, F.lit(True))
    assert {r["label"] for r in rows.collect()} == {0, 1} and rows.count() == 36
    assert toxicity.score(docs, toxicity.train(rows)).count() == 40


def test_broken_pages_are_linear():
    start = time.time()
    n = 100_000
    words = "Plain words of the article itself, long enough to be kept as such. " * 20
    assert "Plain words" in html_text.main_text(f"<body><article><p>{words}</p>" + "<b>" * n + "</i>" * n)
    assert html_text.main_text("<li>" + "<ul>" + "<b>" * n + "</u><li>" * n) is not None
    comments = "".join(f"<div class='comment'><p>reader {i} says</p></div>" for i in range(10_000))
    assert "reader" not in html_text.main_text(f"<body><article><p>{words}</p></article>{comments}</body>")
    assert time.time() - start < 60


def poisson_below(rate, k):
    total, t = 0.0, -rate
    for i in range(k + 1):
        if i:
            t += math.log(rate / i)
        total += math.exp(t)
    return total


def test_poisson_tables(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 4_000), ("rest", 96_000 * 7)], "g string, s long")
    rates = {r["g"]: r for r in mixing.rates(docs, "g", "s", {"a": 0.04, "b": 0.3}).collect()}
    total = 1 + 4_000 + 96_000 * 7
    for g, share, size in (("a", 0.04, 1), ("b", 0.3, 4_000), ("rest", 0.66, 96_000 * 7)):
        r = rates[g]
        assert r["rate"] == pytest.approx(share * total / size)
        assert r["below"] == sorted(r["below"]) and r["below"][-1] == pytest.approx(1, abs=1e-9)
        k = int(r["rate"])
        assert r["below"][k - r["first"]] == pytest.approx(poisson_below(r["rate"], k), abs=1e-9)
    assert len(rates["a"]["below"]) < 60 * math.sqrt(rates["a"]["rate"]) + 100


def test_a_source_of_one_character(spark):
    rows = [(i, "x" * 4000, "src0", 4000) for i in range(300)] + [(1000 + i, None, "src3", 0) for i in range(5)] + [(2000, "y", "src3", 1), (None, "w" * 50, None, 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    start = time.time()
    n = {r["doc_id"]: r["n"] for r in mixing.mix_sources(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("c")).where("n = c").collect()}
    rate = 0.04 * (300 * 4000 + 1 + 50)
    assert abs(n[2000] - rate) < 6 * math.sqrt(rate)
    assert all(abs(n[1000 + i] - rate) < 6 * math.sqrt(rate) for i in range(5))
    assert time.time() - start < 120


def test_refused_rates(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_RATE", 10.0)
    docs = spark.createDataFrame([(1, "x" * 4000, "src0"), (2, "y", "src3")], "doc_id long, text string, source string")
    with pytest.raises(Exception, match="repetition rate of source src3"):
        mixing.mix_sources(docs).count()


def test_the_loss_mask_holds_the_texts_alone(spark):
    odd = "\\### Assistant: </turn> ok\n"
    turns = [(1, 0, "system", "be: kind"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "assis: <tant", "a\\"), (1, 4, "assistant", ""),
             (1, 5, "user", "w " * 600), (1, 6, "assistant", "</turn>\n### user: no </turn>\n"), (2, None, None, None)]
    windows = chat.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).cache()
    read = chat.read_back(windows).orderBy("conv_id", "window", "place").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in read] == [(c, r or "", t or "") for c, _, r, t in turns]
    said = chat.loss_texts(windows).orderBy("conv_id", "window", "place").collect()
    assert [r["text"] for r in said] == [t for _, _, r, t in turns if r == "assistant"] == [r["text"] for r in read if r["loss"]]
    marks = windows.select("formatted", F.explode("spans").alias("s")).where("s.loss").selectExpr("substring(formatted, s.text_start + 1, s.text_length) AS x").collect()
    assert not any(r["x"].startswith(chat.HEAD) or r["x"].endswith(chat.END) for r in marks)


QUESTION = "If Maria buys 12 green apples and 5 yellow pears at the old market, how many pieces of fruit does she carry home in her basket?"


def test_copies_of_a_null_id_are_found(spark):
    rows = [(None, QUESTION), (None, "Nothing of the kind stands in this text, which is about trains and ships."), (2, QUESTION), (2, "Another text of the same id, and clean."), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, QUESTION)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["contaminated"], r["item"]) for r in decontaminate.contamination(docs, items).collect()), key=str)
    assert got == sorted([(0, True, 7), (0, False, None), (2, True, 7), (2, False, None), (3, False, None)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in decontaminate.clean_documents(docs, items).collect()]
    assert sorted(kept, key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_a_window_that_all_items_share_leads_to_few(spark):
    opening = "please read the following question and choose the one best answer"
    rng = random.Random(1)
    said = lambda: " ".join(rng.choice(["red", "tree", "walk", "house", "song", "river", "glass", "cloud", "seven", "moon"]) + str(rng.choice("abcdefgh")) for _ in range(24))
    items = [(i, f"{opening} {said()}") for i in range(60)]
    docs = [(i, f"{opening} {said()}") for i in range(100)] + [(500 + i, f"Before it. {t} And after.") for i, t in items[:5]]
    q = spark.createDataFrame(items, "item_id long, text string")
    windows = decontaminate.item_windows(q)
    needed = decontaminate._needed(windows, decontaminate.SHARE)
    shared = windows.groupBy("hash").agg(F.countDistinct("_row").alias("n")).where("n = 60").select("hash")
    assert shared.count() >= 4 and needed.join(shared, "hash").count() == 0
    got = {r["doc_id"]: (r["contaminated"], r["item"]) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), q).collect()}
    assert {k for k, v in got.items() if v[0]} == {500, 501, 502, 503, 504} and all(got[500 + i][1] == i for i in range(5))
