"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each a node of the byte's binary tree. For every
context of 0 to ``DEPTH`` bytes before it, each node has a Krichevsky-Trofimov
estimate of its training counts. Context-tree weighting mixes them over all depths:
a node's weighted probability is half its own estimate's and half the product of its
extensions', so its share of the prediction is learned from the training text. With
the counts fixed, a text's log-probability is a sum over its bytes.

Every context counts. Spark groups the strings of ``DEPTH + 1`` bytes by the last
``DEPTH - 1`` bytes before the predicted one: a group has at most 256 * 256 of them,
whatever the corpus, holds all that extends its context, and hands one row of weights
to the next shorter context, until the tables of at most one byte are known everywhere.
A second look at the groups gives each string its cost. After a context that training
never saw the longest one it did see decides.

The costs are a table that grows with the corpus. Strings with at least ``OFTEN`` of the
training bytes (``1 / OFTEN`` at most) are looked up in the tasks; a text's other ones
meet the table in a join, where none is hot any more.

Beside it stands the add-one word model over the same training texts, with words of
``SHARE`` of all tokens (``1 / SHARE`` at most) looked up and the others joined alike.

Null is the empty text: no bytes, log-probability 0. Repeated rows score alike. Without
training texts every byte has 1/256 and every token 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, small_batches, staged, words

DEPTH = 3
#: Shares from which words and strings are looked up in the tasks; no other is left out for it.
SHARE = 1 / 8192
OFTEN = 2.0 ** -20
#: Strings a counting task holds at once.
HELD = 1 << 20
#: Byte before a text's first ones.
START = 10
#: Hash that stands for the end of a text among the words.
END = 0
#: Kinds of keys in the join.
WORD, STRING = 0, 1


def contexts(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> list[np.ndarray]:
    """The byte 1, 2, .. ``depth`` places before each byte of a run of texts."""
    out = []
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(len(data))
    for d in range(1, depth + 1):
        shifted = np.full(len(data), START, dtype=np.uint8)
        shifted[d:] = data[:-d] if len(data) > d else data[:0]
        shifted[at - d < begin] = START
        out.append(shifted)
    return out


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The DEPTH + 1 bytes that end at each byte of a run of texts as a number, the last byte lowest."""
    code = data.astype(np.uint32)
    for d, before in enumerate(contexts(data, offsets), 1):
        code |= before.astype(np.uint32) << np.uint32(8 * d)
    return code


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of DEPTH + 1 bytes and how often training has them (0 in other texts); a task's runs are merged now and then."""
    none = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    held, waiting = none, []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        values, place = np.unique(np.concatenate([held[0], *(w[0] for w in waiting)]), return_inverse=True)
        return values, np.bincount(place, weights=np.concatenate([held[1], *(w[1] for w in waiting)]).astype(float), minlength=len(values)).astype(np.int64)

    def told() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(held[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(held[0][i:i + 100_000].astype(np.int64)), pa.array(held[1][i:i + 100_000])], ["gram", "n"])

    for batch in batches:
        flags = batch.column("training").to_numpy(zero_copy_only=False).astype(bool)
        for first, end, data, offsets in chunks(batch.column("text")):
            code, learned = gram_codes(data, offsets), np.repeat(flags[first:end], np.diff(offsets))
            waiting.append(np.unique(code[learned], return_counts=True))
            other = np.unique(code[~learned])
            waiting.append((other, np.zeros(len(other), np.int64)))
            if len(waiting) >= 16:
                held, waiting = merged(), []
                if len(held[0]) > HELD:
                    yield from told()
                    held = none
    held = merged()
    yield from told()


class Tree:
    """Kept contexts as rows; ``child[row, byte]`` is the row one byte longer, or -1; ``cost[row, byte]`` in log10."""

    def __init__(self, child: np.ndarray, cost: np.ndarray) -> None:
        self.child, self.cost = child, cost

    def rows(self, before: list[np.ndarray]) -> np.ndarray:
        row = np.zeros(len(before[0]), dtype=np.int32)
        live = np.ones(len(row), dtype=bool)
        for byte in before:
            after = self.child[row, byte]
            live &= after >= 0
            row = np.where(live, after, row)
        return row

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        each = self.cost[self.rows(contexts(data, offsets)), data].astype(np.float64) if len(data) else np.zeros(0)
        sums = np.concatenate([[0.0], np.cumsum(each)])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) - log Gamma(1/2), elementwise for whole n."""
    n = n.astype(np.float64)
    x = n + 0.5
    small = np.cumsum(np.concatenate([[0.0], np.log(np.arange(0, 64) + 0.5)]))
    with np.errstate(divide="ignore", invalid="ignore"):
        stirling = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) - 0.5 * math.log(math.pi)
    return np.where(n < 64, small[np.minimum(n, 63).astype(int)], stirling)


def _log_factorial(n: np.ndarray) -> np.ndarray:
    n = n.astype(np.float64)
    small = np.cumsum(np.concatenate([[0.0], np.log(np.arange(1, 64))]))
    x = n + 1
    with np.errstate(divide="ignore", invalid="ignore"):
        stirling = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)
    return np.where(n < 64, small[np.minimum(n, 63).astype(int)], stirling)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma_half(zeros) + _log_gamma_half(ones) - _log_factorial(zeros + ones)


def bit_counts(bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of zeros and ones at the 255 nodes of the byte's tree, from counts of bytes (rows x 256)."""
    zeros, ones = np.zeros((len(bytes_), 255)), np.zeros((len(bytes_), 255))
    node = 0
    for level in range(8):
        sums = bytes_.reshape(len(bytes_), 1 << level, 2, 128 >> level).sum(axis=3)
        zeros[:, node:node + (1 << level)], ones[:, node:node + (1 << level)] = sums[:, :, 0], sums[:, :, 1]
        node += 1 << level
    return zeros, ones


def folded(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log-probability of nodes and their own estimates' shares, from both halves."""
    top = np.maximum(own, below)
    total = top + np.log(np.exp(own - top) + np.exp(below - top))
    return total + math.log(0.5), np.exp(own - total)


def chance(bits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated chance of a one at each node."""
    return (bits[1] + 0.5) / (bits[0] + bits[1] + 1.0)


def mixed(shares: list[np.ndarray], ones: list[np.ndarray]) -> np.ndarray:
    """Chance of a one, from the shortest context to the longest: own estimate by its share, the longer context's otherwise."""
    weight, value = np.ones_like(ones[-1]), np.zeros_like(ones[-1])
    for s, one in zip(shares, ones):
        value = value + weight * s * one
        weight = weight * (1 - s)
    return value + weight * ones[-1]


def byte_costs(one: np.ndarray) -> np.ndarray:
    """log10 of the probability of each byte (rows x 256) from the chances at the 255 nodes."""
    logs, node = np.zeros((len(one), 1)), 0
    for level in range(8):
        p = np.clip(one[:, node:node + (1 << level)], 1e-12, 1 - 1e-12)
        logs = np.stack([logs + np.log10(1 - p), logs + np.log10(p)], axis=2).reshape(len(one), 2 << level)
        node += 1 << level
    return logs


def build(levels: list[tuple[np.ndarray, np.ndarray]], parents: list[np.ndarray], last: list[np.ndarray]) -> Tree:
    """The weighted tree of given contexts, in one place.

    ``levels[d]`` has the byte counts (rows x 256) of the contexts of ``d`` bytes;
    ``parents[d]`` their rows among the shorter by their oldest byte, ``last[d]`` that byte.
    """
    starts = np.concatenate([[0], np.cumsum([len(x) for x in levels])])
    child = np.full((starts[-1], 256), -1, dtype=np.int32)
    for d in range(1, len(levels)):
        child[starts[d - 1] + parents[d], last[d]] = starts[d] + np.arange(len(levels[d]))
    weighted: list[np.ndarray] = [np.zeros(0)] * len(levels)
    share: list[np.ndarray] = [np.zeros(0)] * len(levels)
    bits = [bit_counts(x) for x in levels]
    for d in range(len(levels) - 1, -1, -1):
        own = estimate(*bits[d])
        if d == len(levels) - 1:
            weighted[d], share[d] = own, np.ones_like(own)
            continue
        # what no given extension has stays with a leaf that follows this context's own estimate
        below = np.zeros_like(own)
        rest0, rest1 = bits[d][0].copy(), bits[d][1].copy()
        np.add.at(below, parents[d + 1], weighted[d + 1])
        np.subtract.at(rest0, parents[d + 1], bits[d + 1][0])
        np.subtract.at(rest1, parents[d + 1], bits[d + 1][1])
        below += estimate(np.maximum(rest0, 0), np.maximum(rest1, 0))
        weighted[d], share[d] = folded(own, below)
    cost = np.zeros((starts[-1], 256), dtype=np.float32)
    one = [chance(b) for b in bits]
    for d in range(len(levels)):
        chain, at = [], np.arange(len(levels[d]))
        for e in range(d, -1, -1):
            chain.append((e, at))
            if e:
                at = parents[e][at]
        chain.reverse()
        cost[starts[d]:starts[d + 1]] = byte_costs(mixed([share[e][at] for e, at in chain[:-1]], [one[e][at] for e, at in chain]))
    return Tree(child, cost)


LEVEL = "context int, counts array<double>, weighted array<double>"


def _rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _level(context: int, counts: np.ndarray, weighted: np.ndarray) -> pa.Table:
    return pa.table({"context": pa.array([context], pa.int32()), "counts": [counts], "weighted": [weighted]}, pa.schema(
        [("context", pa.int32()), ("counts", pa.list_(pa.float64())), ("weighted", pa.list_(pa.float64()))]))


def _longest(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A group's strings as (row, byte, times) and the byte counts of its rows, the contexts of DEPTH bytes."""
    gram = group.column("gram").to_numpy()
    context, row = np.unique(gram >> 8, return_inverse=True)
    byte, n = gram & 255, group.column("n").to_numpy().astype(float)
    table = np.zeros((len(context), 256))
    table[row, byte] = n
    return row, byte, n, table


def _shorter_by_one(group: pa.Table) -> pa.Table:
    """Counts and weights of a context of DEPTH - 1 bytes from those of its extensions."""
    _, _, _, table = _longest(group)
    counts = table.sum(axis=0)
    weighted, _ = folded(estimate(*bit_counts(counts[None])), estimate(*bit_counts(table)).sum(axis=0)[None])
    return _level(int(group.column("gram")[0].as_py() >> 8 & 0xFFFF), counts, weighted[0])


def _shortest(group: pa.Table) -> pa.Table:
    """Counts of a context of one byte and the weights below it."""
    order = np.argsort(group.column("context").to_numpy())
    return _level(int(group.column("context")[0].as_py() & 255), _rows(group.column("counts"), 256)[order].sum(axis=0),
                  _rows(group.column("weighted"), 255)[order].sum(axis=0))


class Model:
    """A corpus's strings with their counts (a table), and the tree's contexts of no and of one byte.

    ``counts``, ``share``, ``one`` and ``cost`` have a row for the empty context, then one for each byte.
    """

    def __init__(self, grams: DataFrame) -> None:
        """``grams`` has ``(gram, n)``, once each; strings with n = 0 teach nothing."""
        self.grams = grams
        pairs = grams.groupBy(F.shiftright("gram", 8).bitwiseAND(0xFFFF).alias("pair")).applyInArrow(_shorter_by_one, LEVEL)
        short = pairs.groupBy(F.col("context").bitwiseAND(255).alias("byte")).applyInArrow(_shortest, LEVEL).collect()  # 256 rows at most
        self.counts, below = np.zeros((257, 256)), np.zeros((257, 255))
        for r in short:
            self.counts[1 + r["context"]], below[1 + r["context"]] = r["counts"], r["weighted"]
        self.counts[0] = self.counts[1:].sum(axis=0)
        bits = bit_counts(self.counts)
        own = estimate(*bits)
        weighted, _ = folded(own, below)
        below[0] = weighted[1:].sum(axis=0)
        _, self.share = folded(own, below)
        self.one = chance(bits)
        self.cost = byte_costs(np.concatenate([self.one[:1], mixed([self.share[:1]], [np.repeat(self.one[:1], 256, axis=0), self.one[1:]])]))

    def costs(self, grams: DataFrame) -> DataFrame:
        """``(gram, n, cost)``: the log10 probability of each string's last byte after the others.

        ``grams`` has this model's strings, and others with n = 0.
        """
        seen, share, one, cost = self.counts.sum(axis=1) > 0, self.share, self.one, self.cost

        def priced(group: pa.Table) -> pa.Table:
            row, byte, n, table = _longest(group)
            last = 1 + int(group.column("gram")[0].as_py() >> 8 & 255)
            counts = table.sum(axis=0)[None]
            if n.any():
                bits, below = bit_counts(counts), bit_counts(table)
                _, own = folded(estimate(*bits), estimate(*below).sum(axis=0)[None])
                # an unseen context is not weighed in: its rows follow the shorter one
                wide = lambda x: np.repeat(x, len(table), axis=0)
                shares, ones = [share[:1], share[last:last + 1]], [one[:1], one[last:last + 1], chance(bits)]
                short = byte_costs(mixed(shares, [wide(x) for x in ones]))
                long = byte_costs(mixed([*shares, own], [*(wide(x) for x in ones), chance(below)]))
                found = np.where(table.any(axis=1)[:, None], long, short)[row, byte]
            else:
                found = cost[last if seen[last] else 0, byte]
            return pa.table({"gram": group.column("gram"), "n": group.column("n"), "cost": pa.array(found, pa.float64())})

        return grams.groupBy(F.shiftright("gram", 8).bitwiseAND(0xFFFF).alias("pair")).applyInArrow(priced, "gram long, n long, cost double")


def grams(docs: DataFrame, training: Column | None = None, text_col: str = "text") -> DataFrame:
    """``(gram, n)``: every string of DEPTH + 1 bytes of the texts, and how often the training rows (all by default) have it."""
    learned = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    return docs.select(F.col(text_col).alias("text"), learned.alias("training")).mapInArrow(
        _count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """The tree of a corpus; its strings stay a table."""
    return Model(staged(grams(docs, text_col=text_col), "grams", large=True))


class Lookup:
    """Costs of frequent strings in a table of slots; of those that meet in a slot the most frequent stays."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, cost: np.ndarray) -> None:
        self.bits = max(8, int(len(gram)).bit_length() + 2)
        self.key, self.cost = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits)
        self.key[0] = 1  # an empty slot has a string of another slot
        order = np.lexsort((gram, n))
        at = self.slot(gram[order].astype(np.uint32))
        self.key[at], self.cost[at] = gram[order], cost[order]

    def slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the costs found for each text; then row, string and times of those not found."""
        code = gram_codes(data, offsets)
        at = self.slot(code)
        missing = np.flatnonzero(self.key[at] != code)
        each = self.cost[at]
        each[missing] = 0.0
        sums = np.concatenate([[0.0], np.cumsum(each)])
        row = np.searchsorted(offsets, missing, side="right") - 1
        pair, n = np.unique((row.astype(np.uint64) << np.uint64(32)) | code[missing], return_counts=True)
        return sums[offsets[1:]] - sums[offsets[:-1]], (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64), n


def lookup(costs: DataFrame, total: int) -> Lookup:
    """The strings with at least ``OFTEN`` of the training bytes."""
    often = costs.where(F.col("n") >= max(OFTEN * total, 1)).toPandas()  # 1 / OFTEN rows at most
    return Lookup(often["gram"].to_numpy(dtype=np.int64), often["n"].to_numpy(dtype=np.int64), often["cost"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, log10_probability, bits_per_byte)`` for each row; no bits per byte for empty texts."""
    strings = model.grams.unionAll(grams(docs, F.lit(False), text_col)).groupBy("gram").agg(F.sum("n").alias("n"))
    costs = staged(model.costs(strings), "costs", large=True)
    told = _met(docs, F.lit(True), costs, int(model.counts[0].sum()), None, id_col, text_col)
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes"))
    return told.select(id_col, F.col("score").alias("log10_probability"), bits.alias("bits_per_byte"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column("text")):
            code, _, _, _ = words(data, offsets)
            values, n = np.unique(np.append(code, np.full(end - first, END, np.uint64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["word", "n"])


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(word, c)``: how often each token occurs, by its hash; a text's end counts as one."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _met(docs: DataFrame, training: Column, costs: DataFrame, n_bytes: int, counts: DataFrame | None, id_col: str, text_col: str,
         n_words: int = 0) -> DataFrame:
    """``(id, training, n, known, part, score, n_bytes)`` for each row: its words met with ``counts``, its strings with ``costs``.

    Frequent ones are looked up in the tasks, the others joined; without ``counts`` words are not looked at.
    """
    small_batches(docs.sparkSession)
    with_words = counts is not None
    often = counts.where(F.col("c") >= SHARE * n_words).orderBy("word").toPandas() if with_words else None  # 1 / SHARE rows at most
    hot_words = (often["word"].to_numpy(dtype=np.int64), np.log10(often["c"].to_numpy(dtype=float) + 1)) if with_words else (None, None)
    shared = docs.sparkSession.sparkContext.broadcast((lookup(costs, n_bytes), *hot_words))
    kind = docs.schema[id_col].dataType
    names = ["k", "of", "word", "n", "part", "score", "n_bytes", "id", "training"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, logs = shared.value
        for batch in batches:
            key, ids, flags = batch.column("k").to_numpy(), batch.column("id"), batch.column("training")

            def left(rows: np.ndarray, of: int, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
                many = len(rows)
                nothing = [pa.nulls(many, pa.float64()), pa.nulls(many, pa.float64()), pa.nulls(many, pa.int64()), pa.nulls(many, ids.type), pa.nulls(many, pa.bool_())]
                return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(np.full(many, of, np.int8)), pa.array(code), pa.array(n.astype(np.int64)), *nothing], names)

            for first, end, data, offsets in chunks(batch.column("text")):
                docs_here = end - first
                found, string_row, string, times = table.scores(data, offsets)
                n_hot, part = np.zeros(docs_here, dtype=np.int64), np.zeros(docs_here)
                if with_words:
                    code, row, _, _ = words(data, offsets)
                    row, code = np.append(row, np.arange(docs_here)), np.append(code, np.full(docs_here, END, np.uint64)).view(np.int64)
                    place = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
                    hot = known[place] == code if len(known) else np.zeros(len(code), dtype=bool)
                    n_hot = np.bincount(row[hot], minlength=docs_here)
                    part = np.bincount(row[hot], weights=logs[place[hot]], minlength=docs_here)
                nothing = pa.nulls(docs_here, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first:end]), pa.nulls(docs_here, pa.int8()), nothing, pa.array(n_hot.astype(np.int64)), pa.array(part), pa.array(found),
                     pa.array(np.diff(offsets)), ids.slice(first, docs_here), flags.slice(first, docs_here)], names)
                yield left(first + string_row, STRING, string, times)
                if with_words:
                    row, code = row[~hot], code[~hot]
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])) if len(row) else np.zeros(0, dtype=np.int64)
                    yield left(first + row[new], WORD, code[new], np.diff(np.append(new, len(row))))

    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.xxhash64(F.col(id_col), text).alias("k"), F.col(id_col).alias("id"), training.alias("training"), text.alias("text"))
    rows = keyed.mapInArrow(run, f"k long, of byte, word long, n long, part double, score double, n_bytes long, id {kind.simpleString()}, training boolean")
    summary = F.col("of").isNull()
    told = rows.where(summary).select("k", "n", F.col("n").alias("known"), "part", "score", "n_bytes", "id", "training", F.lit(1).alias("row"))
    table = costs.select(F.lit(STRING).cast("byte").alias("of"), F.col("gram").alias("word"), F.lit(0).cast("long").alias("c"), "cost")
    if with_words:
        table = table.unionAll(counts.select(F.lit(WORD).cast("byte").alias("of"), "word", "c", F.lit(None).cast("double").alias("cost")))
    word = F.col("of") == WORD
    met = (rows.where(~summary).select("k", "of", "word", "n").join(table, ["of", "word"], "left")
           .groupBy("k").agg(F.sum(F.when(word, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
                             F.sum(F.when(word, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).otherwise(0.0)).alias("part"),
                             F.sum(F.when(~word, F.col("n") * F.col("cost")).otherwise(0.0)).alias("score")))
    blank = [F.lit(None).cast("long").alias("n_bytes"), F.lit(None).cast(kind).alias("id"), F.lit(None).cast("boolean").alias("training"), F.lit(0).alias("row")]
    # a repeated row has its counts as often as it occurs
    whole = told.unionAll(met.select("k", "n", "known", "part", "score", *blank)).groupBy("k").agg(
        F.sum("row").alias("times"), *[F.sum(c).alias(c) for c in ("n", "known", "part", "score")],
        F.max("n_bytes").alias("n_bytes"), F.max("id").alias("id"), F.max("training").alias("training"))
    one = whole.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return one.select(F.col("id").alias(id_col), "training", *[(F.col(c) / F.col("times")).cast("long").alias(c) for c in ("n", "known")],
                      *[(F.col(c) / F.col("times")).alias(c) for c in ("part", "score")], "n_bytes")


def scores(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, training, n_tokens, n_known, train_tokens, base_score, score)`` for each row; learns from the training rows."""
    small_batches(docs.sparkSession)
    # strings of the other rows come along uncounted: their costs are asked for as well
    model = Model(staged(grams(docs, training, text_col), "grams", large=True))
    costs = staged(model.costs(model.grams), "costs", large=True)
    counts = staged(word_counts(docs.where(training), text_col), "words", large=True)
    corpus = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count(F.lit(1)).alias("V")).first()
    total, distinct = int(corpus["N"]), int(corpus["V"])
    told = _met(docs, training, costs, int(model.counts[0].sum()), counts, id_col, text_col, total)
    return told.select(id_col, "training", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                       (F.col("part") - F.col("n") * F.lit(math.log10(total + distinct + 1))).alias("base_score"), "score")
