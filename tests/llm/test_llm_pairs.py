"""Near-duplicate operators against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tidewatch.llm import graph, ngram_jaccard, suffix_dedup

KIND = "doc_id long, text string"


def brute_components(rows):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[j:j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(sets[i]), root(i)) for i in ids}


def near_copies(seed, families=6, size=14):
    """Families of texts with a few words changed, some sharing a passage."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 6)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rnd.choice([6, 30, 80, 150]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 12))):
                text[rnd.randrange(len(text))] = word()
            if rnd.random() < 0.3:
                text += passage
            rows.append((len(rows), " ".join(text).title() if rnd.random() < 0.2 else "\n".join(text)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t"), (len(rows) + 3, "one Two"), (len(rows) + 4, "ONE two"), (len(rows) + 5, "one")]
    return rows


def test_link_components(spark, monkeypatch):
    # few rare tokens and small blocks, so that every path is taken
    frequent = 1
    monkeypatch.setattr(ngram_jaccard, "TOGETHER", 3)
    rows = near_copies(2)
    docs = spark.createDataFrame(rows, KIND)
    got = {tuple(r) for r in ngram_jaccard.link_components(docs, frequent=frequent).collect()}
    assert got == brute_components(rows)


def test_link_components_edges(spark):
    assert ngram_jaccard.link_components(spark.createDataFrame([], KIND)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 3), (1, "a b c d e f", "y", 3), (2, "A b c d e f", None, None)],
                                 "doc_id long, text string, set_id string, n long")
    assert sorted(tuple(r) for r in ngram_jaccard.link_components(docs).collect()) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert sorted(r["doc_id"] for r in ngram_jaccard.keep_first(docs).collect()) == [1, 1]


def test_keep_one_row_of_each_group(spark):
    rnd = random.Random(8)
    prose = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(40))
    a, b, c, d, e = (prose() for _ in range(5))
    chain = a.split()
    near, nearer = " ".join(chain[:-3] + ["x"] * 3), " ".join(["y"] * 3 + chain[3:-3] + ["x"] * 3)
    rows = [(1, b, "p"), (1, b, "p"), (1, b, "q"), (None, c, "p"), (None, c, "p"), (None, d, "p"), (4, d, "p"), (None, e, "p"),
            (5, a, "p"), (None, near, "p"), (6, nearer, "p"), (7, None, "p"), (None, "", "p"), (8, " ", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = ngram_jaccard.keep_one(docs)
    got = [(r["doc_id"], r["text"]) for r in suffix_dedup.without_repeats(kept.where("coalesce(doc_id, 0) <> 5")).collect()]
    assert sorted(got, key=str) == sorted([(1, b), (None, c), (4, d), (None, e), (7, None), (None, ""), (8, " ")], key=str)
    assert [r["text"] for r in kept.where("doc_id IN (5, 6)").collect()] == [a]  # 5 and 6 are linked through the null id
    assert ngram_jaccard.keep_one(docs.limit(0)).count() == 0


def test_prefix_holds_enough():
    for n in range(2, 400):
        tokens = np.sort(np.random.default_rng(n).integers(0, 2 ** 64, n, dtype=np.uint64))
        part, _ = ngram_jaccard.prefix(np.unique(tokens))
        assert len(part) > ngram_jaccard.missing(n) + ngram_jaccard.band_classes(n)[-1][1] or len(part) == n


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(5, 5), (100, 101)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 120)}


def brute_removals(rows, length=200):
    starts = Counter()
    for _, text in rows:
        data = (text or "").encode()
        starts.update(data[i:i + length] for i in range(len(data) - length + 1))
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - length + 1):
            if starts[data[j:j + length]] > 1:
                gone[j:j + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeated_texts(seed):
    rnd = random.Random(seed)
    prose = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    passages = [prose(k) for k in (190, 200, 230, 420)]
    rows = []
    for i in range(40):
        text = prose(rnd.randint(0, 500))
        for _ in range(rnd.randint(0, 3)):
            text += rnd.choice(passages) + prose(rnd.randint(0, 60))
        rows.append((i, text))
    rows += [(40, "a" * 900), (41, "ab" * 300), (42, rows[3][1]), (43, rows[3][1]), (44, None), (45, ""), (46, passages[3][150:] + "é" * 150)]
    return rows


def test_removals(spark, monkeypatch):
    # anchors of two regions are sorted, others go window by window
    monkeypatch.setattr(suffix_dedup, "MOST_REGIONS", 2)
    rows = repeated_texts(2)
    assert sorted(tuple(r) for r in suffix_dedup.removals(spark.createDataFrame(rows, KIND)).collect()) == brute_removals(rows)


def test_removals_edges(spark):
    assert suffix_dedup.removals(spark.createDataFrame([], KIND)).count() == 0
    text = "".join(random.Random(3).choice("xyz ") for _ in range(300))
    docs = spark.createDataFrame([(1, text, "p", 1), (1, text, "q", 2), (2, "short", "r", 3)], "doc_id long, text string, k1 string, runs long")
    assert sorted(tuple(r) for r in suffix_dedup.without_repeats(docs).collect()) == [(1, "", "p", 1), (1, "", "q", 2), (2, "short", "r", 3)]


@pytest.mark.parametrize("seed", range(12))
def test_two_stage_suffixes(seed):
    rnd = random.Random(seed)
    raw = bytes(rnd.choice(range(97, 97 + rnd.choice([2, 3, 26]))) for _ in range(rnd.randint(5, 1500)))
    raw = (raw[:len(raw) // 2] * 2 if seed % 3 == 0 else raw) + b"\xff"
    text = np.frombuffer(raw, dtype=np.uint8)
    wanted = np.zeros(len(text), dtype=bool)
    for _ in range(3):
        a = rnd.randrange(len(text) - 1)
        wanted[a:rnd.randint(a + 1, len(text) - 1)] = True
    order = suffix_dedup.two_stage_suffixes(text, wanted)
    want = sorted(np.flatnonzero(wanted).tolist(), key=lambda i: raw[i:i + 200])
    assert sorted(order.tolist()) == sorted(want)
    assert [raw[i:i + 200] for i in order] == [raw[i:i + 200] for i in want]


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(9)
    text = "".join(rnd.choice("ab") for _ in range(400)).encode() * 2
    data = np.frombuffer(text, dtype=np.uint8)
    _, lo, hi, place, grams, _ = suffix_dedup.regions(data, np.array([0, len(data)]))
    seen = defaultdict(set)
    for a, b, p, g in zip(lo, hi, place, grams):
        for i in range(a, b + 1):
            seen[text[i:i + 200]].add((p - i, g))
    assert sum(hi - lo + 1) == len(text) - 199 and all(len(v) == 1 for v in seen.values())
