"""Suffix-array deduplication of repeated byte strings.

Every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere goes.
Such a string holds an anchor: the place whose ``GRAM`` bytes hash lowest among those
inside it, the leftmost among equals. Equal strings have equal anchors at equal
offsets, so only texts around equal anchors need to meet:

1. Each run of window starts with one anchor is a *region*: its bytes are all its
   windows. Regions are counted by anchor and content, pre-aggregated. Equal regions
   are repeated throughout.
2. Where an anchor has several different regions, one of each is suffix-sorted with
   its anchor's others, in two stages: suffixes smaller than their successors are
   sorted directly, the others induced by scans over the buckets of first bytes.
   Adjacent suffixes with a common prefix of ``LENGTH`` are repeated windows.
   An anchor with more than ``MOST_REGIONS`` regions is not sorted in one place: its
   single windows are grouped by content instead, pre-aggregated.
3. Repeated windows go back to their documents, where their bytes are removed.

Work is on UTF-8 bytes; null is the empty text; matches never cross documents. Texts
shorter than ``LENGTH`` keep everything. Repeated rows are documents of their own.
Regions meet by 128 bits of content hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BASE, BASE_INVERSE, BYTE_CODE, cached_powers, chunks, mix, small_batches, staged, unstage

LENGTH, GRAM = 200, 24
#: Different regions of one anchor that are sorted in one place at most.
MOST_REGIONS = 8000
#: Bytes that are suffix-sorted together, about (an anchor's regions stay together).
BLOCK = 1 << 20
_POSITION = np.uint64((1 << 28) - 1)


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums by which any substring's hash can be had."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODE[data] * cached_powers(BASE, len(data)), out=sums[1:])
    return sums


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * cached_powers(BASE_INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def regions(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, first and last window start, anchor place, anchor hash of every region of a run of texts."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64), np.zeros(1, np.uint64)
    sums = rolling(data)
    at = np.arange(len(data) - gram + 1)
    grams = substring_hash(sums, at, at + gram)
    keys = (grams & ~_POSITION) | at.astype(np.uint64)
    place = (window_minima(keys, length - gram + 1) & _POSITION).astype(np.int64)
    # windows that stay inside their text
    row = np.repeat(np.arange(len(offsets) - 1), np.maximum(np.diff(offsets) - length + 1, 0))
    base = np.repeat(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))
    before = np.cumsum(np.maximum(np.diff(offsets) - length + 1, 0)) - np.maximum(np.diff(offsets) - length + 1, 0)
    start = base + (np.arange(len(row)) - np.repeat(before, np.maximum(np.diff(offsets) - length + 1, 0)))
    if not len(start):
        return none, none, none, none, none.astype(np.uint64), sums
    anchor = place[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    return row[new], start[new], start[last], anchor[new], grams[anchor[new]], sums


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        for first, _, data, offsets in chunks(batch.column("text")):
            row, lo, hi, place, grams, sums = regions(data, offsets)
            if not len(row):
                continue
            end = hi + LENGTH
            shape = ((place - lo).astype(np.uint64) << np.uint64(32)) | (end - lo).astype(np.uint64)
            content = mix(substring_hash(sums, lo, end) ^ mix(shape))
            yield pa.RecordBatch.from_arrays(
                [_signed(grams), _signed(content), pa.array(k1[first + row]), pa.array(k2[first + row]),
                 pa.array((lo - offsets[row]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32))], ["anchor", "content", "k1", "k2", "lo", "n"])


def two_stage_suffixes(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The wanted places (a mask) of ``text``, sorted by the suffixes there, by ``depth`` bytes at least.

    Suffixes smaller than their successor are sorted directly. Each other suffix is
    induced from its successor, in a scan over the buckets of first bytes: what
    precedes smaller buckets comes first, then runs of the bucket's byte, then the
    directly sorted. The text must end with its largest byte, found only as an end mark.
    """
    raw, n = text.tobytes(), len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    after = np.append(differs, n - 1)[np.searchsorted(differs, np.arange(n))]  # last place of the run of equal bytes
    smaller = np.ones(n, dtype=bool)
    inner = after < n - 1
    smaller[inner] = text[after[inner]] < text[after[inner] + 1]
    # a wanted place that is induced needs its successor
    edge = np.flatnonzero(smaller)
    places = np.flatnonzero(wanted)
    until = edge[np.searchsorted(edge, places)]
    depth_of = np.zeros(n + 1, dtype=np.int32)
    np.add.at(depth_of, places, 1)
    np.add.at(depth_of, until + 1, -1)
    needed = np.cumsum(depth_of[:n]) > 0
    seeds = np.array(sorted(np.flatnonzero(needed & smaller).tolist(), key=lambda i: raw[i:i + depth + 1]), dtype=np.int64)
    others = np.flatnonzero(needed & ~smaller)
    others = others[np.argsort(text[others], kind="stable")]
    rank = np.zeros(n + 1, dtype=np.int64)
    out, done = [], 0
    bounds = np.arange(257)
    seed_cuts, other_cuts = np.searchsorted(text[seeds], bounds), np.searchsorted(text[others], bounds)
    for byte in range(256):
        bucket = others[other_cuts[byte]:other_cuts[byte + 1]]
        order = []
        if len(bucket):
            ready = bucket[text[bucket + 1] < byte]
            ready = ready[np.argsort(rank[ready + 1], kind="stable")]
            while len(ready):
                order.append(ready)
                before = ready - 1
                before = before[before >= 0]
                ready = before[needed[before] & (text[before] == byte)]
        order.append(seeds[seed_cuts[byte]:seed_cuts[byte + 1]])
        whole = np.concatenate(order)
        rank[whole] = np.arange(done, done + len(whole))
        done += len(whole)
        out.append(whole)
    whole = np.concatenate(out)
    return whole[wanted[whole]]


def repeated_suffixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Mask over ``order``: whether a neighbour's common prefix has ``length`` bytes. ``text`` goes on ``length`` bytes after each."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eights = np.ndarray(shape=(len(text) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    same = np.arange(len(order) - 1)
    steps = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    for step in steps:
        a, b = order[same] + step, order[same + 1] + step
        same = same[eights[a] == eights[b]]
    out = np.zeros(len(order), dtype=bool)
    out[same] = True
    out[same + 1] = True
    return out


def _sort_block(rows: list[tuple], length: int) -> pa.RecordBatch | None:
    """Repeated windows of the regions (k1, k2, lo, n, needed, body) of whole anchors, as runs."""
    sizes = np.array([len(r[5]) for r in rows])
    begin = np.cumsum(sizes + 1) - sizes - 1
    text = np.frombuffer(b"\xff".join(r[5] for r in rows) + b"\xff", dtype=np.uint8)
    windows = np.array([r[3] for r in rows])
    wanted = np.zeros(len(text), dtype=bool)
    owner = np.repeat(np.arange(len(rows)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    wanted[begin[owner] + inside] = True
    order = two_stage_suffixes(text, wanted, length)
    hit = np.zeros(len(text), dtype=bool)
    hit[order[repeated_suffixes(text, order, length)]] = True
    marks = hit[begin[owner] + inside] & np.array([r[4] for r in rows])[owner]
    place = np.flatnonzero(marks)
    if not len(place):
        return None
    # runs of successive windows of one region
    new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(owner[place]) != 0)])
    first = place[new]
    run = np.diff(np.append(np.flatnonzero(new), len(place)))
    who = owner[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array([r[0] for r in rows], dtype=np.int64)[who]), pa.array(np.array([r[1] for r in rows], dtype=np.int64)[who]),
         pa.array((np.array([r[2] for r in rows])[who] + inside[first]).astype(np.int32)), pa.array(run.astype(np.int32))], ["k1", "k2", "lo", "n"])


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; blocks of whole anchors are suffix-sorted."""
    rows, held, last = [], 0, None
    for batch in batches:
        for anchor, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "k1", "k2", "lo", "n", "needed", "body"))):
            if held > BLOCK and anchor != last:
                if (out := _sort_block(rows, LENGTH)) is not None:
                    yield out
                rows, held = [], 0
            rows.append(tuple(row))
            held += len(row[5])
            last = anchor
    if rows and (out := _sort_block(rows, LENGTH)) is not None:
        yield out


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[] for _ in range(8)]
        for k1, k2, text, regions_ in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "regions"))):
            data = (text or "").encode()
            for r in regions_:
                body = data[r["lo"]:r["lo"] + r["n"] + LENGTH - 1]
                for column, value in zip(out, (r["anchor"], k1, k2, r["lo"], r["n"], r["needed"], r["crowded"], body)):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["anchor", "k1", "k2", "lo", "n", "needed", "crowded", "body"])


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k1, k2, lo, n, needed, body in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "lo", "n", "needed", "body"))):
            hashes = [xxhash.xxh3_128_intdigest(body[i:i + LENGTH]) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(h & (1 << 64) - 1) - (1 << 63) for h in hashes], pa.int64()), pa.array([(h >> 64) - (1 << 63) for h in hashes], pa.int64()),
                 pa.array([k1] * n, pa.int64()), pa.array([k2] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int32()), pa.array([needed] * n)],
                ["w1", "w2", "k1", "k2", "lo", "needed"])


def _keyed(docs: DataFrame, id_col: str, text_col: str, k1: str, k2: str) -> DataFrame:
    """Rows with the same key (128 bits of id and text) are the same document again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(k1, F.xxhash64(F.col(id_col), text)).withColumn(k2, F.xxhash64(text, F.col(id_col), F.lit(7)))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(k1, k2, runs)``: for each document with repeated strings, its runs (first start, number of starts)."""
    small_batches(docs.sparkSession)
    texts = _keyed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "_id", "text", "k1", "k2")
    found = texts.select("k1", "k2", "text").mapInArrow(_region_rows, "anchor long, content long, k1 long, k2 long, lo int, n int")
    # written first, so that adaptive execution can split a hot anchor in the join
    shared = staged(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "anchors", large=True)
    found = staged(found.join(shared, "anchor"), "regions", large=True)
    equal = staged(found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "lo", "n")).alias("r")), "contents", large=True)
    whole = found.join(equal.where("c > 1").select("anchor", "content"), ["anchor", "content"], "left_semi").select("k1", "k2", "lo", "n")
    several = equal.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    mixed = equal.join(several, "anchor").select(
        "r.k1", "r.k2", F.struct("anchor", "r.lo", "r.n", (F.col("c") == 1).alias("needed"), (F.col("d") > MOST_REGIONS).alias("crowded")).alias("g"))
    wanted = mixed.groupBy("k1", "k2").agg(F.collect_list("g").alias("regions"))
    # the same document again is one text here
    bodies = staged(texts.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).mapInArrow(
        _bodies, "anchor long, k1 long, k2 long, lo int, n int, needed boolean, crowded boolean, body binary"), "bodies", large=True)
    sorted_ = (bodies.where("NOT crowded").drop("crowded").repartition("anchor").sortWithinPartitions("anchor")
               .mapInArrow(_sorted_windows, "k1 long, k2 long, lo int, n int"))
    single = bodies.where("crowded").select("k1", "k2", "lo", "n", "needed", "body").mapInArrow(
        _single_windows, "w1 long, w2 long, k1 long, k2 long, lo int, needed boolean")
    again = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("w1", "w2")
    crowded = single.where("needed").join(again, ["w1", "w2"]).select("k1", "k2", "lo", F.lit(1).alias("n"))
    runs = staged(whole.unionAll(sorted_).unionAll(crowded).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "n")).alias("runs")), "runs", large=True)
    unstage(shared, found, equal, bodies)
    return runs


def kept_bytes(text: str | None, runs: list[dict] | None, length: int = LENGTH) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, removed spans, and what is left."""
    data = (text or "").encode()
    if not runs:
        return len(data), 0, 0, data
    change = np.zeros(len(data) + 1, dtype=np.int32)
    lo = np.array([r["lo"] for r in runs])
    np.add.at(change, lo, 1)
    np.add.at(change, lo + np.array([r["n"] for r in runs]) + length - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    return len(data), int(gone.sum()), spans, np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    runs = repeated_windows(docs, id_col, text_col)
    keyed = _keyed(docs, id_col, text_col, "__k1", "__k2")
    other = runs.withColumnsRenamed({"k1": "__r1", "k2": "__r2", "runs": "__runs"})
    return keyed.join(other, (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")), "left").drop("__k1", "__k2", "__r1", "__r2")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` for each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [kept_bytes(t, r) for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([m[i] for m in made], pa.int64()) for i in range(3)),
                 pa.array([hashlib.sha256(m[3]).hexdigest() for m in made], pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _joined(docs.select(id_col, text_col), id_col, text_col).select(id_col, text_col, "__runs")
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept text; bytes of characters that were cut through are left out. Null stays null."""
    at, last = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            kept = [t if not r else kept_bytes(t, r)[3].decode(errors="ignore") for t, r in zip(texts, batch.column(last).to_pylist())]
            columns = [pa.array(kept, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return _joined(docs, id_col, text_col).mapInArrow(run, docs.schema)
