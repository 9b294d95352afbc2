"""Operators on single texts: round trips, brute force and held-out figures on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tidewatch.llm import chat, context_tree, decontaminate, html_text, licenses, mixing, quality_rules, toxicity


def test_quality_figures(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("aa bb c# d é".split()) for _ in range(n)) + "\nsame line\n\nsame line" for n in (0, 1, 3, 60, 400)] + [None, "", " \n\t"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in quality_rules.with_figures(docs.drop("n_words")).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = [tuple(words[j:j + 3]) for j in range(len(words) - 2)]
        counts = Counter(grams)
        repeated = {p for j, g in enumerate(grams) if counts[g] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in (text or "").split("\n") if x.split()]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))
        assert tuple(got[i][c] for c in quality_rules.FIGURES) == want
        assert got[i]["base_failed"] == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))


def test_binomial_and_cutoffs(spark):
    for n, k in ((10, 0), (300, 2), (5000, 30)):
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(.01) + (n - i) * math.log(.99)) for i in range(k + 1))
        got = spark.createDataFrame([(n, k)], "n long, k long").select(F.expr(quality_rules.log_binomial_at_most("n", "k", 0.01))).first()[0]
        assert abs(got - math.log(exact)) < 1e-9
    rows = [("en", 100, 0, 0, 0, 1, False)] * 3000 + [("en", 100, 30, 0, 0, 0, False)] * 50 + [("en", 100, 30, 0, 0, 1, False)] * 2 + [(None, 100, 30, 0, 0, 1, False)] * 9
    labelled = spark.createDataFrame(rows, "s string, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long, g int, base_failed boolean")
    got = {r["_stratum"]: r for r in quality_rules.cutoffs(labelled, "s", "g").collect()}
    assert got["en"]["_n_symbols"] == 200 and "other" not in got  # the loosest that catches all bad ones


def test_judge_edges(spark):
    kind = "doc_id long, text string, lang string, kept string"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judge(spark.createDataFrame([], kind), labels).count() == 0
    docs = spark.createDataFrame([(1, None, None, "a"), (None, "w " * 60, "en", "b")], kind)
    assert sorted((r["n_words"], r["kept"]) for r in quality_rules.judge(docs, labels).collect()) == [(0, False), (60, False)]


def test_mixing_rates(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").alias("source"),
                                    F.lit("x" * 50).alias("text"), F.lit(9).alias("copy"))
    out = mixing.mix_sources(docs, {"a": 0.6, "b": 0.1})
    assert out.columns == ["doc_id", "source", "text", "copy", "shuffle_key"]
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(got["a"] - 2400) < 150 and abs(got["b"] - 400) < 70 and abs(got[None] - 1200) < 110
    # the counts are Poisson: a rate of 2.4 leaves out e**-2.4 of the source
    absent = docs.where("source = 'a'").join(out.select("doc_id").distinct(), "doc_id", "left_anti").count()
    assert abs(absent / 1000 - math.exp(-2.4)) < 0.03
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7), {"a": 0.6, "b": 0.1}).collect()))
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix_sources(empty).count() == 0
    blank = spark.createDataFrame([(None, None, None), (1, "src0", None)], "doc_id long, source string, text string")
    assert mixing.mix_sources(blank).count() == 0


def test_licences(spark):
    prose = ["the quick brown fox jumps over the lazy dog near the river", "all of this was written under the old tree in version two of the tale"]
    notes = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.",
             "apache-2.0": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    rows, want = [], {}
    for i in range(60):
        family = [None, *notes][i % 5]
        rows.append((i, "\n".join([prose[i % 2] + f" {i}", prose[1 - i % 2]] + ([notes[family]] if family else [])), "z"))
        want[i] = family or "none"
    rows += [(60, None, "z"), (61, "", "z"), (62, "licence", "z")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, family string")).collect()
    assert len(got) == 63 and {r["doc_id"]: r["family"] for r in got} == want | {60: "none", 61: "none", 62: "none"}
    assert all(r["confirmed"] == (r["family"] != "none") for r in got)


def test_chat_round_trip(spark):
    rnd = random.Random(8)
    odd = ["\\### assistant: </turn> ok", "### user: x </turn>\n", "a\\", "", None, "\n", "<<##\\\\", "plain words and more words"]
    rows = []
    for conv in range(12):
        for turn in range(rnd.randint(1, 40)):
            text = rnd.choice(odd) if rnd.random() < 0.5 else " ".join("w" * rnd.randint(1, 30) for _ in range(rnd.randint(0, 25)))
            rows.append((conv, turn, "system" if turn == 0 and conv % 3 else rnd.choice(["user", "assistant", "tool: #1", None]), text))
    rows += [(None, 0, "assistant", "alone"), (None, None, "user", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.windows(turns, budget=60, history=20).cache()
    back = chat.read_back(formatted).orderBy("conv_id", "window", "place").collect()
    want = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], -1 if r[1] is None else r[1]))
    assert [(r["conv_id"], r["role"], r["text"], r["loss"]) for r in back] == [(c, role or "", text or "", role == "assistant") for c, _, role, text in want]
    for r in formatted.collect():
        assert sum(s["length"] for s in r["spans"]) == len(r["formatted"])
        assert all(r["formatted"][s["start"]:s["start"] + s["length"]].startswith(chat.HEAD) for s in r["spans"])
        assert not any(s["loss"] and not s["own"] for s in r["spans"])
        first = [x for x in want if x[0] == r["conv_id"]][0]
        if first[2] == "system":
            assert r["formatted"].startswith("### system: ")
    assert formatted.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 3
    assert formatted.where("exists(spans, s -> not s.own)").count() > 3
    assert chat.digests(chat.windows(turns.limit(0))).count() == 0


def test_context_tree(spark):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(["alpha", "Beta", "gamma", "délta"]) for _ in range(rnd.randint(0, 60)))) for i in range(80)]
                                 + [(80, None), (81, ""), (7, "alpha"), (7, "alpha")], "doc_id long, text string")
    training = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    rows = docs.collect()
    got = context_tree.scores(docs, training).collect()
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + [None]
    counts = Counter(w for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2 for w in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r["doc_id"], len(tokens(r["text"])), sum(counts[w] > 0 for w in tokens(r["text"])), n,
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(r["text"])), 6)) for r in rows)
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    tree = context_tree.train(docs.where(training))
    assert np.allclose((10.0 ** tree.cost.astype(float)).sum(axis=1), 1, atol=1e-4)
    scored = context_tree.score(docs, tree).collect()
    assert all(r["log10_probability"] == 0 for r in scored if r["doc_id"] in (80, 81))
    assert max(r["bits_per_byte"] for r in scored if r["bits_per_byte"] is not None and r["doc_id"] < 80) < 3.5
    assert context_tree.scores(docs.limit(0), training).count() == 0


def test_krichevsky_trofimov():
    zeros, ones = np.array([0, 1, 3, 200.]), np.array([0, 2, 0, 90.])
    for a, b, got in zip(zeros, ones, context_tree.estimate(zeros, ones)):
        p, x, y = 0.0, 0, 0
        for bit in [0] * int(a) + [1] * int(b):
            p += math.log(((y if bit else x) + .5) / (x + y + 1))
            x, y = x + (not bit), y + bit
        assert abs(p - got) < 1e-6


def test_tree_weights_by_definition():
    """One byte of context: the mix is half the root's estimate and half its extensions'."""
    counts = np.zeros((1, 256))
    counts[0, [97, 98]] = 6, 6
    ext = np.zeros((2, 256))
    ext[0, 98], ext[1, 97] = 6, 6  # after a always b, after b always a
    tree = context_tree.build([counts, ext], [np.zeros(0, int), np.zeros(2, int)], [np.zeros(0, int), np.array([97, 98])])
    after_a = 10.0 ** tree.cost[tree.child[0, 97]].astype(float)
    assert after_a[98] > 0.6 and after_a[98] > 10.0 ** float(tree.cost[0, 98])


ITEM = "Alice Moore buys 3 kg of apples and 12 pears, then Alice Moore walks 5 miles to the old market with 3 baskets of bread in the rain."


def test_decontamination(spark):
    def told(name, a, b, c, unit="kg"):
        return f"before it all {ITEM}".replace("Alice Moore", name).replace("3 ", f"{a} ").replace("12", str(b)).replace("5 ", f"{c} ").replace("kg", unit)

    rows = [(1, "some words. " + ITEM + " And more."), (2, told("Maria Stone", 41, 77, 9)), (3, told("Maria Stone", 41, 77, 9).replace("41 baskets", "43 baskets")),
            (4, "The market sells apples and pears and bread, and the rain falls on the old road to the sea every day."), (5, None), (6, ""), (1, "again " + ITEM), (7, "tiny item here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "tiny item here"), (13, "3 kg 4 kg 5 kg 6 kg")], "item_id long, text string")
    got = sorted((r["doc_id"], r["contaminated"], r["item"]) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(1, True, 10), (1, True, 10), (2, True, 10), (3, False, None), (4, False, None), (5, False, None), (6, False, None), (7, True, 12)]
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    clash = docs.withColumn("item", F.lit("x")).withColumn("hash", F.lit(1))
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(clash, items).collect()) == [3, 4, 5, 6]


def test_each_occurrence_is_judged_by_itself(spark):
    twice = "Tom buys 3 red apples for 2 dollars each day. Tom buys 5 red apples for 4 dollars each day."
    thrice = f"{twice} Tom buys 7 red apples for 6 dollars each day."
    other = ITEM.replace("3 ", "41 ").replace("12", "77").replace("5 ", "9 ")
    rows = [(1, "Read this. " + twice + " End of it."), (2, f"It said. {ITEM} Then it said. {other} That was all."), (3, ITEM.replace("3 baskets", "4 baskets")),
            (4, "So. " + thrice.replace("5 red apples", "5 red and green apples"))]
    items = spark.createDataFrame([(10, ITEM), (11, twice), (12, thrice)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_items"], r["item"]) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got[1][1] == 11 and got[2] == (1, 10) and got[3] == (0, None) and got[4][0] == 2


def test_verbatim_items_of_every_class(spark):
    rows = [(1, "Solve: What is 12 * 7 + 5? Show it."), (2, "Question: What is the capital of France? Answer."), (3, "Known people, Ann Lee Bob Ray Cy Fox Di Orr Ed Poe, all old."),
            (4, "What is 13 * 7 + 5?"), (5, "so Where is the tallest tower of Berlin now?"), (6, "Is it? What is the capital of France?"), (7, "what is the capital of france"), (8, None)]
    items = spark.createDataFrame([(10, "What is 12 * 7 + 5?"), (11, "What is the capital of France"), (12, "Ann Lee, Bob Ray, Cy Fox, Di Orr, Ed Poe"),
                                   (13, "Where is the tallest tower of Madrid now?"), (14, "")], "item_id long, text string")
    got = {r["doc_id"]: r["item"] for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {1: 10, 2: 11, 3: 12, 4: None, 5: 13, 6: 11, 7: 11, 8: None}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="page-with-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href=x>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies. <p>OK</div>
<div id="main"><article class="post"><h1>A &amp; B</h1><p>First <b>bold</b>word,<br>then&nbsp;more   text that goes on for a while.<p>Second paragraph
here with enough words to count. <script>bad()</script><div class="ad">Buy now</div><ul><li>item one<li>item two</ul><form><label>Mail</label><input></form>
<section class="comments"><p>Nice read!</p></section></article></div><aside>Aside</aside><div class="share-bar">Share</div><footer>&copy; x</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "A & B First boldword, then more text that goes on for a while. Second paragraph here with enough words to count. item one item two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    plain = "<div class=menu><a>a</a><a>b</a></div><div id=c><p>" + "long text " * 20 + "<p>short</div><div><a>x</a></div>"
    assert html_text.main_text(plain) == ("long text " * 20).strip() + " short"
    assert html_text.main_text("<p>just <i>this") == "just this"


def test_html_wrappers_named_like_asides():
    words = "The article goes on at some length so that it is text and no menu. " * 4
    for name in ("content no-sidebar", "has-sidebar", "layout-with-sidebar", "ad-free", "share-enabled", "search-result-page"):
        assert html_text.main_text(f"<div class='{name}'><article><p>{words}</article></div>") == words.strip()
        assert html_text.main_text(f"<ul><li><a>x</a></ul><div class='{name}'><p>{words}</div>").endswith(words.strip())
    assert html_text.main_text(f"<div class='comments'><p>Nice.</div><div id=c><p>{words}</div>") == words.strip()
    assert html_text.main_text(f"<article><p>{words}<div class='comments'><article><p>{words} again</article></div></article>") == words.strip()
    cards = "<div class='related'><article><h2>Another</h2><p>A teaser of some words that ends in dots ...</article></div>"
    assert html_text.main_text(f"<article><p>{words}</article>{cards}") == words.strip()
    assert html_text.main_text(f"<main><div class='sidebar-layout'><article><p>{words}</article></div></main>{cards}") == words.strip()


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "y")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert [(r["page_id"], r["url"], r["n_chars"] == len(r["text"])) for r in got] == [(1, "u", True), (1, None, True)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_segments_are_the_maximal_ones():
    rnd = random.Random(2)
    for _ in range(200):
        scores = [rnd.choice([-2, -1, -1, 1, 3]) for _ in range(rnd.randint(0, 25))]
        found = toxicity.segments(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert max((s for _, _, s in found), default=min(best, 0)) == best or best <= 0 and not found
        for (b, e, s), following in zip(found, found[1:] + [(len(scores) + 1, 0, 0)]):
            assert s == sum(scores[b:e]) > 0 and e <= following[0]
            assert all(sum(scores[b:k]) > 0 for k in range(b + 1, e + 1)) and all(sum(scores[k:e]) > 0 for k in range(b, e))


def toxic_corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 6))) for _ in range(rnd.randint(20, 120))]
        bad = rnd.random() < 0.25
        for _ in range(3 if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["moron", "idiot,", "Vileness", "vilest"]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus(500, 6)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(3, None)], "doc_id long, toxic int")
    held = F.col("doc_id") % 5 == 0
    model = toxicity.train(toxicity.training_rows(docs, labels, ~held))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    right = sum((got[i]["score"] >= 0.5) == t for i, _, t in rows if i % 5 == 0)
    assert right >= 97 and all(0 <= r["score"] <= 1 for r in got.values()) and got[500]["score"] < 0.5
    passages = [p for i, _, t in rows if t for p in got[i]["passages"]]
    assert passages and any(f in model.lexicon for f in ("moron", "^mor"))
    assert toxicity.clean_documents(docs, model).count() == sum(r["score"] < 0.5 for r in got.values())


def ranking(spark, rows):
    """Share of the pairs of held-out rows with labels 1 and 0 that the scores order rightly."""
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(docs, labels, F.col("doc_id") % 5 != 0))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    of = [[got[i] for i, _, t in rows if i % 5 == 0 and t == label] for label in (0, 1)]
    return sum((a < b) + (a == b) / 2 for a in of[0] for b in of[1]) / (len(of[0]) * len(of[1]))


def test_toxicity_ranks_whatever_the_label_marks(spark):
    # where most rows are marked, the words tell of label 0
    assert ranking(spark, [(i, f"the {x}", 1 - t) for i, x, t in toxic_corpus(300, 8)]) > 0.95


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(docs, none, F.lit(True)))
    assert [r["score"] < 1e-5 for r in toxicity.score(docs, model).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), model).count() == 0


def _whole_tree(texts):
    """The tree of all contexts of the texts, built in one place."""
    grams = Counter()
    for text in texts:
        data = bytes([context_tree.START] * context_tree.DEPTH) + text.encode()
        grams.update(data[i:i + context_tree.DEPTH + 1] for i in range(len(data) - context_tree.DEPTH))
    levels, parents, last, shorter = [], [], [], None
    for d in range(context_tree.DEPTH + 1):
        tables = {}
        for gram, n in grams.items():
            tables.setdefault(gram[context_tree.DEPTH - d:context_tree.DEPTH], np.zeros(256))[gram[-1]] += n
        names = sorted(tables)
        levels.append(np.array([tables[x] for x in names]))
        parents.append(np.array([shorter[x[1:]] for x in names] if d else [0]))
        last.append(np.array([x[0] for x in names] if d else [0]))
        shorter = {x: i for i, x in enumerate(names)}
    return context_tree.build(levels, parents, last)


def test_context_tree_leaves_no_context_out(spark, monkeypatch):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rnd.randint(1, 6)))
    common = [word() for _ in range(20)]
    texts = [" ".join(rnd.choice(common) if rnd.random() < 0.8 else word() for _ in range(120)) for _ in range(60)] + ["\0\0\0\0\0 \1", "zz日本", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(63, None), (4, texts[4])], "doc_id long, text string")
    learned = [t for i, t in enumerate(texts) if i % 3] + [texts[4]]
    assert sum(len(t.encode()) for t in learned) > 2 * 8192
    tree = _whole_tree(learned)

    def want(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        return float(tree.scores(data, np.array([0, len(data)]))[0])

    for often in (context_tree.OFTEN, 1 / 512):
        monkeypatch.setattr(context_tree, "OFTEN", often)
        got = context_tree.scores(docs, F.col("doc_id") % 3 != 0).collect()
        assert len(got) == 65
        for r in got:
            assert abs(r["score"] - want(texts[r["doc_id"]] if r["doc_id"] < 63 else "")) < 1e-2, r
    alone = context_tree.score(docs, context_tree.train(docs.where("doc_id % 3 != 0"))).collect()
    assert sorted((r["doc_id"], round(r["log10_probability"], 6)) for r in alone) == sorted((r["doc_id"], round(r["score"], 6)) for r in got)
