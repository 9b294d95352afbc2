"""Ranked lexical search by dense, blocked matrix products.

The queries ("items") are a stated set that is searched against all documents, in
blocks of bounded size. A task reads the texts once for a block, keeps the counts of
the block's terms, and these sparse rows are staged, so that corpus figures (documents,
terms, documents holding a term) and scores come from one reading of the text.

Scoring multiplies tiles in float64: the 0/1 matrix of an item tile over a tile of
its compact vocabulary times the impacts of a document tile over the same terms. All
entries are whole numbers. A vocabulary tile is so narrow that no sum over it can reach
2**53, hence every partial sum is exact whatever order BLAS adds in; tiles are summed as
64-bit integers. Of each document tile an item keeps its ``k`` best by (score, id): the
threshold is the k-th best score, all its ties are ordered by id before the cut, and
that order is total, so no tile loses a document that the whole ranking holds.

Defined results: a null text, or one without terms, has no terms: such a document
counts nowhere, such an item has no rows. Repeated rows, on either side, are each ranked
(a repeated item's rows are listed for each of its rows); documents of a null id come
last among equal scores. An empty table on either side gives no rows. Other columns,
whatever their names, are not read. Figures are 64-bit: 90 * terms of a document * number
of documents has to stay below 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches, staged, unstage

#: Items searched in one pass over the documents: about so many bytes of their texts.
BLOCK_BYTES = 1 << 22
#: Rows and columns of the tiles; they bound a task's matrices (8, 4 and 2 MB).
VOCABULARY_TILE, DOCUMENT_TILE, ITEM_TILE = 2048, 512, 256
#: tf's share of an impact is below this.
SATURATION = 1_000_000
#: Partial sums stay below this, where float64 is exact.
EXACT = 1 << 53
#: Texts are split into terms in pieces of about this many bytes.
PIECE = 1 << 20

_TERM_BYTES = {*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)}
#: Lower-cases A-Z and turns every byte that no term has into a space.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b in _TERM_BYTES else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, a piece of it at a time: runs of ASCII letters, digits and all other characters."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items as (id, distinct terms), a block of about ``BLOCK_BYTES`` at a time (one longer item stays whole).

    Items are dealt to blocks by a hash of their row, so a block's size is its share of all.
    """
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = int(-(-size // BLOCK_BYTES))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(max(blocks, 1))))
    for block in range(blocks):
        found = [(r["id"], sorted({t for piece in terms(r["text"]) for t in piece})) for r in dealt.where(F.col("block") == block).collect()]
        yield [x for x in found if x[1]]


def term_counts(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``(id, n, term, tf)`` for each document with a term: its number of terms and its counts of the vocabulary's."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value
        for batch in batches:
            keep, n_terms, found, tf = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                n, ids = 0, []
                for piece in terms(text.as_py()):
                    n += len(piece)
                    got = np.fromiter(map(place.get, piece, repeat(-1)), dtype=np.int32, count=len(piece))
                    ids.append(np.unique(got[got >= 0], return_counts=True))
                if n == 0:
                    continue
                if len(ids) > 1:
                    which, back = np.unique(np.concatenate([i for i, _ in ids]), return_inverse=True)
                    counts = np.bincount(back, weights=np.concatenate([c for _, c in ids]), minlength=len(which)).astype(np.int64)
                else:
                    which, counts = ids[0]
                keep.append(row)
                n_terms.append(n)
                found.append(which)
                tf.append(counts)
            if keep:
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keep)), pa.array(n_terms, pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tf).astype(np.int64)))], ["id", "n", "term", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, term array<int>, tf array<long>")


class ItemTile:
    """Some items and their compact vocabulary, cut into tiles of ``width`` terms."""

    def __init__(self, items: list[tuple[int, np.ndarray]], width: int) -> None:
        self.items = np.array([i for i, _ in items])
        row = np.repeat(np.arange(len(items)), [len(t) for _, t in items])
        self.vocabulary, column = np.unique(np.concatenate([t for _, t in items]), return_inverse=True)
        self.width = width
        self.cells = [(row[column // width == v], column[column // width == v] % width) for v in range(-(-len(self.vocabulary) // width))]

    def scores(self, term: np.ndarray, document: np.ndarray, impact: np.ndarray, n_documents: int) -> np.ndarray:
        """Scores (items x documents) of a document tile given by its (term, document, impact) triples."""
        out = np.zeros((len(self.items), n_documents), dtype=np.int64)
        place = np.searchsorted(self.vocabulary, term)
        place[place == len(self.vocabulary)] = 0
        mine = self.vocabulary[place] == term
        place, document, impact = place[mine], document[mine], impact[mine]
        for tile, (row, column) in enumerate(self.cells):
            here = place // self.width == tile
            if not here.any():
                continue
            n = min(self.width, len(self.vocabulary) - tile * self.width)
            holds, impacts = np.zeros((len(self.items), n)), np.zeros((n, n_documents))
            holds[row, column] = 1
            impacts[place[here] % self.width, document[here]] = impact[here]
            out += (holds @ impacts).astype(np.int64)
        return out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's positive scores from its k-th best upwards, ties with it included."""
    if scores.shape[1] <= k:
        return np.nonzero(scores > 0)
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    return np.nonzero(scores >= np.maximum(least, 1)[:, None])


def _search_block(docs: DataFrame, block: list[tuple[object, list[bytes]]], k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(item, id, score)`` of the block's items (by place in it), the k best of each task; and the staged counts it reads."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, own in block for t in own})
    place = {t: i for i, t in enumerate(vocabulary)}
    counts = staged(term_counts(docs, vocabulary, id_col, text_col), "term-counts")
    corpus = counts.agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    N, L = int(corpus["N"]), int(corpus["L"])
    # one row for each term of the block at most
    holders = np.zeros(len(vocabulary), dtype=np.int64)
    for t, df in counts.select(F.explode("term").alias("t")).groupBy("t").count().collect():
        holders[t] = df
    weight = np.floor(1000 * np.log((2 * N + 2) / (2 * holders + 1))).astype(np.int64)
    width = max(1, min(VOCABULARY_TILE, (EXACT - 1) // (SATURATION * max(int(weight.max()), 1))))
    owned = [(i, np.array([place[t] for t in own])) for i, (_, own) in enumerate(block)]
    shared = spark.sparkContext.broadcast((weight, [ItemTile(owned[i:i + ITEM_TILE], width) for i in range(0, len(owned), ITEM_TILE)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, tiles = shared.value
        kept: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        size = 0
        kind = pa.int64()

        def cut() -> pa.RecordBatch:
            """The k best of each item among those kept: the order is total, so nothing of the whole ranking is lost."""
            merged = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([x[0] for x in kept])), pa.concat_arrays([x[1] for x in kept]), pa.array(np.concatenate([x[2] for x in kept]))], ["item", "id", "score"])
            merged = merged.sort_by([("item", "ascending"), ("score", "descending"), ("id", "ascending")])
            item = merged.column(0).to_numpy()
            new = np.concatenate([[True], item[1:] != item[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(item)), 0))
            return merged.filter(pa.array(np.arange(len(item)) - start < k))

        for whole in batches:
            kind = whole.column(0).type
            for first in range(0, whole.num_rows, DOCUMENT_TILE):
                batch = whole.slice(first, DOCUMENT_TILE)
                many = batch.num_rows
                ids, n = batch.column(0), batch.column(1).to_numpy()
                term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
                document = np.repeat(np.arange(many), batch.column(2).value_lengths().to_numpy())
                m = 10 + (90 * n * N) // L
                impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[document]))
                for tile in tiles:
                    scores = tile.scores(term, document, impact, many)
                    row, column = best(scores, k)
                    if len(row):
                        kept.append((tile.items[row], ids.take(pa.array(column)), scores[row, column]))
                        size += len(row)
                if size > 4 * k * sum(len(t.items) for t in tiles):
                    rows = cut()
                    kept, size = [(rows.column(0).to_numpy(), rows.column(1), rows.column(2).to_numpy())], 0
        if kept:
            yield cut().cast(pa.schema([("item", pa.int64()), ("id", kind), ("score", pa.int64())]))

    kind = counts.schema["id"].dataType.simpleString()
    return counts.mapInArrow(run, f"item long, id {kind}, score long"), counts


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ``k`` best documents of positive score, equal scores by ascending id."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    item_kind = items.schema[item_id_col].dataType.simpleString()
    id_kind = docs.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"{item_id_col} {item_kind}, rank int, {id_col} {id_kind}, score long")
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    for block in item_blocks(items, item_id_col, item_text_col):
        if not block:
            continue
        found, counts = _search_block(docs, block, k, id_col, text_col)
        top = staged(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "ranked")
        unstage(counts)
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item long, item_id {item_kind}")
        out = out.unionAll(top.join(names, "item").select(F.col("item_id").alias(item_id_col), "rank", F.col("id").alias(id_col), "score"))
    return out
