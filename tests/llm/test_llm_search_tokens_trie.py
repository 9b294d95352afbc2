"""Lexical ranking, token counts at prefixes and the prefix trie against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import lexical_search, prefix_trie, token_counts

sentencepiece = pytest.importorskip("sentencepiece")


def _terms(text):
    return [t.decode("utf-8", "surrogatepass") for piece in lexical_search.terms(text) for t in piece]


def _ranking(docs, items, k):
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    N, L = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10 ** 9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(_terms(text)) if t in b)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_terms_are_runs_of_letters_digits_and_other_characters():
    assert _terms("A-b c_d Été x 9.5\n\x7f日本") == ["a", "b", "c", "d", "Été x", "9", "5", "日本"]
    assert _terms(None) == _terms("., ") == []


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_is_that_of_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(lexical_search, "DOCUMENT_TILE", 7)
    monkeypatch.setattr(lexical_search, "ITEM_TILE", 3)
    monkeypatch.setattr(lexical_search, "VOCABULARY_TILE", 4)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 200)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["Été", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(90)]
    docs += [(200 + i, docs[3][1]) for i in range(15)] + [(5, docs[5][1]), (None, docs[3][1]), (300, None), (301, ""), (302, "... !")]
    docs.append((303, "w1 " * 5000))
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(0, docs[3][1]), (50, None), (51, "nowhere"), (None, "w1 w2")]
    d = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, term string, score int").repartition(5)
    q = spark.createDataFrame([(a, b, 9) for a, b in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in lexical_search.search(d, q, k=4).collect()]
    assert sorted(got, key=str) == _ranking(docs, items, 4)


def test_search_of_nothing_and_in_nothing(spark):
    none_d = spark.createDataFrame([], "doc_id long, text string")
    none_q = spark.createDataFrame([], "item_id long, text string")
    one_d, one_q = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(none_d, one_q).collect() == []
    assert lexical_search.search(one_d, none_q).collect() == []
    assert lexical_search.search(one_d.where("false"), none_q).columns == ["item_id", "rank", "doc_id", "score"]


def test_vocabulary_tiles_stay_where_floats_are_exact():
    """A sum of the largest impacts over a tile's terms is below 2**53 for the largest weight of 10**12 documents."""
    weight = math.floor(1000 * math.log(2 * 10 ** 12 + 2))
    width = max(1, min(lexical_search.VOCABULARY_TILE, (lexical_search.EXACT - 1) // (lexical_search.SATURATION * weight)))
    assert width * weight * lexical_search.SATURATION < 2 ** 53


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())


@pytest.fixture(scope="module")
def encoder():
    return token_counts.Encoder(token_counts.read_vocabulary(token_counts.default_model()))


PARTS = ["a", "b", "the ", "  ", "\n", "é", "🙂", "日本", "▁", "\t", "<s>", "</s>", "<0x0A>", "ing", "tion", " 12", "\x00", "ﬀ", "Ünter", "aaaa", " " * 20]


def test_counts_at_every_prefix_are_the_library_s(library, encoder):
    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        counts = [c for piece in encoder.prefixes(text) for c in piece]
        assert counts == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text
        assert encoder.tokens(text) == counts[-1]


def test_long_words_in_pieces(library, encoder, monkeypatch):
    text = "abcdeé日intheto" * 500 + " " * 300 + "x" * 1000
    want = len(library.encode(text))
    assert encoder.tokens(text) == want
    monkeypatch.setattr(token_counts, "PIECE", 37)
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    monkeypatch.setattr(token_counts, "AT_ONCE", 10)
    assert token_counts.Encoder(encoder.score).tokens(text) == want
    assert [c for p in encoder.prefixes(text[:400]) for c in p] == [len(library.encode(text[:i])) for i in range(401)]


def test_whole_texts_and_questions(spark, library, monkeypatch):
    rng = random.Random(8)
    texts = ["", None, " ", "\n\n", "one two  three", "日" * 50, "the internationalisation " * 700] + ["".join(rng.choice(PARTS) for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)] + [(None, "a b", 1, "z")], "doc_id long, text string, n_tokens int, piece string").repartition(3)
    rows = {r["doc_id"]: r for r in token_counts.token_counts(docs).collect()}
    assert len(rows) == len(texts) + 1 and rows[None]["n_tokens"] == 2
    for i, t in enumerate(texts):
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"]) == (len((t or "").encode()), len(library.encode(t or ""))), t
    prefixes = token_counts.prefix_counts(docs.where("doc_id IS NOT NULL")).cache()
    asked = [(i, c) for i, t in enumerate(texts) for c in (0, 1, len(t or "") // 2, len(t or ""), len(t or "") + 1)] + [(1, None), (1, -1)]
    questions = spark.createDataFrame(asked, "doc_id long, chars long")
    got = Counter((r["doc_id"], r["chars"], r["n_tokens"]) for r in token_counts.tokens_at(prefixes, questions).collect())
    want = Counter((i, c, len(library.encode((texts[i] or "")[:c])) if c is not None and 0 <= c <= len(texts[i] or "") else None) for i, c in asked)
    assert got == want
    for budget in (0, 3, 900):
        fit = {r["doc_id"]: (r["chars"], r["n_tokens"]) for r in token_counts.longest_within(prefixes, budget).collect()}
        for i, t in enumerate(texts):
            t = t or ""
            if len(t) < 1000:
                best = max(c for c in range(len(t) + 1) if len(library.encode(t[:c])) <= budget)
                assert fit[i] == (best, len(library.encode(t[:best])))
    assert token_counts.longest_within(prefixes, -1).count() == 0
    assert token_counts.token_counts(docs.limit(0)).collect() == []


def _nodes(rows):
    """The contract's rows for turns (conv_id, turn, role, text), by definition."""
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + own[h:]
    members, stops = {}, {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        stops.setdefault(tuple(path), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode().split()) if p else 0
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(stops.get(p, [])))).encode()).hexdigest()) for p, own in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _trie(rows, spark):
    turns, members = prefix_trie.graft(prefix_trie.numbered(spark.createDataFrame(
        [(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, c int").repartition(3)))
    nodes = prefix_trie.trie(turns, members)
    return turns, nodes


def _sorted(nodes):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in nodes.select(*COLUMNS).collect()), key=key)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_is_that_of_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "BLOCKS", 2)
    monkeypatch.setattr(prefix_trie, "PACKED", 3)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(120), 70):
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "a b c", "", None, "x  y"])) for t in range(rng.randint(1, 12))]
    rows += [(c, t, "user", "same text") for c in range(140, 180) for t in range(5)]
    rows += [(None, 1, "user", "nobody's"), rows[0], rows[1]]
    rows += [(7, t, "user", f"{t % 2}") for t in range(60)]
    turns, nodes = _trie(rows, spark)
    assert _sorted(nodes) == sorted(_nodes(rows), key=lambda r: tuple((x is not None, x) for x in r))
    named = prefix_trie.last_turns(nodes, turns)
    assert named.count() == nodes.count() - 1
    assert named.where(F.col("text").isNull() | F.col("role").isNull()).count() == 0


def test_trie_of_turnless_and_of_no_conversations(spark):
    # conversations whose own turns are all replaced, with no family to take any from
    alone = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    rows = [(c, 0, "user", "a") for c in alone]
    _, nodes = _trie(rows, spark)
    assert _sorted(nodes) == [(alone[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest())]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    turns, members = prefix_trie.graft(prefix_trie.numbered(empty))
    assert prefix_trie.trie(turns, members).collect() == []
