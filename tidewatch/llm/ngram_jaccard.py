"""N-gram Jaccard join: token-combination prefixes, then verification.

Texts become sets of hashed word shingles; equal sets are one class, kept once.
Tokens (shingle hashes) have one order over the whole corpus: zones of the hash
range come first, then rare before frequent tokens. A set indexes the tokens of its
first zones, its *prefix*:

* a rare token by itself,
* frequent tokens only in combinations of two that fall into the same of ``m``
  sub-classes, and only where the rare ones of the prefix are too few.

``n`` tokens may miss ``n // 4`` of any partner's at a similarity of 0.75. A prefix
with ``L`` tokens and ``m`` sub-classes is long enough when ``L - m > n // 4``: what
a partner misses cannot break every rare token and every combination. So each link
shares an index entry, whatever the classes are; they only decide the cost.

A set whose prefix has ``f`` frequent tokens shares at least ``L - f - n // 4`` rare
ones with a partner of as many zones or more; pairs that share fewer are no links.

Within an index entry, all sets are first compared with one pivot, the smallest, which
joins groups of near copies without pairing them off. What is still in different
components is compared whole: pairs that share rare entries (in ``FREQUENT`` sets at
most), and the sets of combined entries whose pivots are in one component, in blocks
of at most ``TOGETHER`` by ``TOGETHER`` sets that tasks compare without emitting pairs. Nothing is
capped, and every link between different sets is found or implied by its component.

Null and empty texts, and texts without words, have the empty set and link with
nothing. Repeated rows are rows of one class; repeated ids give repeated rows. Rows of a
null id link like others; a component of such rows only has the null ``component_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import chunks, mix, odd, small_batches, staged, unstage, words
from tidewatch.llm.graph import components

SHINGLE = 5
#: Similarity as a fraction of whole numbers.
SHARE = (3, 4)
#: A token in more sets than this is of the frequent class.
FREQUENT = 4
#: Up to so many ids (8 bytes each) are broadcast to pick out their texts; beyond, the join shuffles.
BROADCAST_IDS = 1 << 18
#: Sets of one block.
TOGETHER = 1000
#: Ends of the zones, as shares of the hash range.
ZONES = np.array([0.34, 0.45, 0.65])
_ZONE_ENDS = (ZONES * 2.0 ** 64).astype(np.uint64)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text; texts of fewer words have one."""
    steps = odd(size, 5)
    for first, end, data, offsets in chunks(column):
        code, row, _, _ = words(data, offsets)
        if len(code) >= size:
            n = len(code) - size + 1
            whole = row[:n] == row[size - 1:]
            sums = code[:n] * steps[0]
            for j in range(1, size):
                sums += code[j:j + n] * steps[j]
            sums, at = mix(sums[whole]), row[:n][whole]
        else:
            sums, at = code[:0], row[:0]
        bounds = np.searchsorted(at, np.arange(end - first + 1))
        counts = np.searchsorted(row, np.arange(end - first + 1))
        for i in range(end - first):
            if bounds[i + 1] > bounds[i]:
                yield first + i, np.unique(sums[bounds[i]:bounds[i + 1]])
            elif counts[i + 1] > counts[i]:
                short = code[counts[i]:counts[i + 1]]
                yield first + i, mix(np.array([np.sum(short * steps[:len(short)]) + np.uint64(len(short))]))
            else:
                yield first + i, code[:0]


def set_id(tokens: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def band_classes(n: int) -> list[tuple[int, int]]:
    """(band, sub-classes) of the size bands in which partners of a set of ``n`` lie."""
    low, high = -(-n * SHARE[0] // SHARE[1]), n * SHARE[1] // SHARE[0]
    return [(b, max(1, (1 << b) // 12)) for b in range(max(low, 1).bit_length() - 1, max(high, 1).bit_length())]


def missing(n: int) -> int:
    """Tokens of a set of ``n`` that a partner may lack."""
    return n - -(-n * SHARE[0] // SHARE[1])


def prefix(tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """The tokens of the zones that a set indexes, and the number of the last zone."""
    n = len(tokens)
    need = missing(n) + 1 + band_classes(n)[-1][1]
    ends = np.searchsorted(tokens, _ZONE_ENDS)
    for zone, end in enumerate(ends):
        if end >= need:
            return tokens[:end], zone
    return tokens, len(ends)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _classes(names: list[str]):
    """Size and digest of the set of ``_text`` beside the columns ``names``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = [], []
            for _, tokens in shingle_sets(batch.column("_text")):
                sizes.append(len(tokens))
                ids.append(set_id(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], [*names, "n_shingles", "set_id"])
    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, ids, packs, held = [], [], [], 0
        for _, whole in shingle_sets(batch.column("_text")):
            if not len(whole):
                continue
            part, zone = prefix(whole)
            tokens.append(part)
            ids.append(np.full(len(part), set_id(whole), dtype=np.int64))
            # size, prefix length and last zone in one number
            packs.append(np.full(len(part), (len(whole) << 34) | (len(part) << 4) | zone, dtype=np.int64))
            held += len(part)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(tokens))), pa.array(np.concatenate(ids)), pa.array(np.concatenate(packs))], ["token", "set_id", "pack"])
                tokens, ids, packs, held = [], [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(np.concatenate(tokens))), pa.array(np.concatenate(ids)), pa.array(np.concatenate(packs))], ["token", "set_id", "pack"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets = [], []
        for _, tokens in shingle_sets(batch.column("_text")):
            ids.append(set_id(tokens))
            sets.append(tokens.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["set_id", "tokens"])


def _entries(tokens: np.ndarray, often: np.ndarray, pack: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Index entries of a set's shared prefix tokens, which of them are single rare tokens, and the set's new pack.

    Where the pack had the prefix's length, it then has the rare tokens that a partner must share.
    """
    n, length, zone = pack >> 34, (pack >> 4) & ((1 << 30) - 1), pack & 15
    rare, frequent = tokens[~often], tokens[often]
    need = max(0, length - len(frequent) - missing(n))
    if need:
        # rare tokens suffice within the last zone; partners with fewer zones may need the others
        frequent = frequent[frequent < _ZONE_ENDS[zone - 1]] if zone else frequent[:0]
    out = [rare]
    for band, m in band_classes(n):
        scrambled = mix(frequent)
        sub = scrambled % np.uint64(m)
        order = np.lexsort((scrambled, sub))
        t, s = scrambled[order], sub[order]
        gap = 1
        while gap < len(t):
            same = s[gap:] == s[:-gap]
            if not same.any():
                break
            out.append(mix(t[:-gap][same] * np.uint64(3) + t[gap:][same] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)))
            gap += 1
    entries = np.concatenate(out)
    return entries, np.arange(len(entries)) < len(rare), (n << 34) | (need << 4) | zone


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the sets; rows come sorted by set, which may go on in the next batch."""
    def made(parts: list[tuple]) -> pa.RecordBatch:
        sizes = [len(p[1]) for p in parts]
        return pa.RecordBatch.from_arrays([
            pa.array(_signed(np.concatenate([p[1] for p in parts]))), pa.array(np.repeat(np.array([p[0] for p in parts], dtype=np.int64), sizes)),
            pa.array(np.repeat(np.array([p[3] for p in parts], dtype=np.int64), sizes)), pa.array(np.concatenate([p[2] for p in parts]))],
            ["entry", "set_id", "pack", "single"])

    rest: list[np.ndarray] | None = None
    ready, held = [], 0
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("set_id", "token", "frequent", "pack")]
        if rest is not None:
            columns = [np.concatenate(pair) for pair in zip(rest, columns)]
        sid = columns[0]
        cuts = np.flatnonzero(sid[1:] != sid[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts[:-1]]), cuts
        for a, b in zip(starts[:len(ends)], ends):
            entries, single, pack = _entries(columns[1][a:b].view(np.uint64), columns[2][a:b], int(columns[3][a]))
            ready.append((sid[a], entries, single, pack))
            held += len(entries)
            if held > 200_000:
                yield made(ready)
                ready, held = [], 0
        rest = [c[cuts[-1] if len(cuts) else 0:] for c in columns]
    if rest is not None and len(rest[0]):
        entries, single, pack = _entries(rest[1].view(np.uint64), rest[2], int(rest[3][0]))
        ready.append((rest[0][0], entries, single, pack))
    if ready:
        yield made(ready)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("tokens_u"), batch.column("tokens_v")):
            x, y = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int(np.count_nonzero(y[at] == x))
            keep.append(SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both))
        out = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"])
        yield out.filter(pa.array(keep, pa.bool_()))


def _size(pack: str) -> Column:
    return F.shiftright(pack, 34)


def _counted(pairs: DataFrame) -> DataFrame:
    """The pairs of (u, pu, v, pv, singles) that share enough rare tokens, once each."""
    nu, nv = _size("pu"), _size("pv")
    near = (nu * SHARE[1] >= nv * SHARE[0]) & (nv * SHARE[1] >= nu * SHARE[0])
    counted = pairs.where(near).groupBy("u", "v").agg(F.sum("singles").alias("c"), F.max("pu").alias("pu"), F.max("pv").alias("pv"))
    need = lambda p: F.shiftright(p, 4).bitwiseAND((1 << 30) - 1)
    zone = lambda p: F.col(p).bitwiseAND(15)
    u_holds, v_holds = (zone("pu") > zone("pv")) | (F.col("c") >= need("pu")), (zone("pv") > zone("pu")) | (F.col("c") >= need("pv"))
    return counted.where(u_holds & v_holds).select("u", "v")


def _by_pivot(index: DataFrame) -> DataFrame:
    """Each set with the smallest set of its index entry."""
    pivot = index.where("set_id = pivot").select("entry", F.col("pack").alias("pu"))
    return _counted(index.where("set_id > pivot").join(pivot, "entry").select(
        F.col("pivot").alias("u"), "pu", F.col("set_id").alias("v"), F.col("pack").alias("pv"), "singles"))


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of sets that share rare entries but no component so far."""
    u = rows.where("singles > 0").select("entry", F.col("set_id").alias("u"), F.col("pack").alias("pu"), F.col("component").alias("cu"), "singles")
    v = rows.where("singles > 0").select("entry", F.col("set_id").alias("v"), F.col("pack").alias("pv"), F.col("component").alias("cv"))
    return _counted(u.join(v, "entry").where("u < v AND cu <> cv"))


def _compare(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray, crossed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of different components that reach the similarity; of different sides only, if ``crossed``."""
    m, sizes = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both, width = np.zeros((m, m), dtype=np.float32), 2048
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for i in range(len(cuts) - 1):
        part = np.zeros((m, width), dtype=np.float32)
        part[owner[cuts[i]:cuts[i + 1]], column[cuts[i]:cuts[i + 1]] - i * width] = 1
        both += part @ part.T
    near = (SHARE[0] + SHARE[1]) * both >= SHARE[0] * (sizes[:, None] + sizes[None, :])
    near &= component[:, None] != component[None, :]
    if crossed:
        near &= side[:, None] != side[None, :]
    return np.nonzero(np.triu(near, 1))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each block (family, bi, bj); rows come sorted by block."""
    def links(rows: list[tuple]) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        u, v = _compare([r[3] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), rows[0][4])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[u], ids[v])), pa.array(np.maximum(ids[u], ids[v]))], ["u", "v"])

    rows, last = [], None
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in ("family", "bi", "bj", "set_id", "component", "side")]
        for family, bi, bj, sid, component, side, tokens in zip(*values, batch.column("tokens")):
            if (family, bi, bj) != last and rows:
                yield links(rows)
                rows = []
            last = (family, bi, bj)
            rows.append((sid, component, side, np.frombuffer(tokens.as_buffer(), dtype=np.uint64), bi != bj))
    if rows:
        yield links(rows)


def _key() -> Column:
    """A number that rows of a set can be found by: of the id, or of the text where the id is null."""
    return F.coalesce(F.when(F.col("_id").isNotNull(), F.xxhash64("_id")), F.xxhash64("_text"))


def _sets_of(ids: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """``(set_id, tokens)`` of the wanted sets, made again from the text of one document each."""
    wanted = staged(ids.distinct().join(first, "set_id").select("_key").distinct(), "wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    keyed = texts.withColumn("_key", _key())
    return staged(keyed.join(wanted, "_key", "left_semi").select("_text").mapInArrow(_sets, "set_id long, tokens binary").dropDuplicates(["set_id"]), "sets", large=True)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("set_id")).unionAll(pairs.select(F.col("v").alias("set_id")))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets that reach the similarity, by their whole sets."""
    left = sets.select(F.col("set_id").alias("u"), F.col("tokens").alias("tokens_u"))
    right = sets.select(F.col("set_id").alias("v"), F.col("tokens").alias("tokens_v"))
    return pairs.join(left, "u").join(right, "v").mapInArrow(_verify, "u long, v long")


def _families(rows: DataFrame) -> DataFrame:
    """The sets of combined entries whose pivots are in one component, dealt to blocks: (family, bi, bj, side, set_id, component)."""
    rows = rows.where("combined")
    home = rows.where("set_id = pivot").select("entry", F.col("component").alias("family"))
    members = rows.join(home, "entry").select("family", "set_id", "component").distinct()
    sizes = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("b"))
    dealt = members.join(sizes, "family").withColumn("side", F.pmod(F.xxhash64("set_id"), F.col("b")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).select(
        "family", F.least("side", "other").alias("bi"), F.greatest("side", "other").alias("bj"), "side", "set_id", "component")


def _labelled(texts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """The columns of ``texts`` but ``_text``, with ``n_shingles``, ``set_id``, ``component`` (a set) and ``component_id`` for each row."""
    small_batches(texts.sparkSession)
    names = [c for c in texts.columns if c != "_text"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)
    texts, carried = texts.select("_id", "_text"), texts
    classes = staged(carried.withColumn("_key", _key()).mapInArrow(
        _classes([*names, "_key"]), f"{kinds}, _key long, n_shingles long, set_id long"), "classes")
    # the key of the smallest id, which is fetched for the set
    first = classes.where("set_id is not null").groupBy("set_id").agg(F.min("_id").alias("_id"), F.min_by("_key", "_id").alias("_k"), F.min("_key").alias("_any")).select(
        "set_id", "_id", F.coalesce("_k", "_any").alias("_key"))

    rows = texts.mapInArrow(_prefixes, "token long, set_id long, pack long")
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token", (F.col("c") > frequent).alias("frequent"))
    rows = staged(rows.join(shared, "token").distinct(), "tokens", large=True)
    index = staged(rows.repartition("set_id").sortWithinPartitions("set_id").mapInArrow(
        _index, "entry long, set_id long, pack long, single boolean"), "entries", large=True)
    # entries with the same sets are one, with the number of single tokens among them
    listed = index.groupBy("entry").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"),
        F.max("single").alias("single"), F.min("set_id").alias("pivot")).where("k > 1")
    kept = listed.groupBy("k", "x", "y").agg(
        F.min("entry").alias("entry"), F.count_if("single").alias("singles"), (~F.min("single")).alias("combined"), F.min("pivot").alias("pivot")).select(
        "entry", "singles", "combined", "pivot")
    index = staged(index.select("entry", "set_id", "pack").join(kept, "entry"), "index", large=True)
    unstage(rows)

    pairs = staged(_by_pivot(index), "pairs")
    links = staged(_linked(pairs, _sets_of(_ends(pairs), first, texts)), "links")
    so_far = staged(components(links), "components")

    rows = index.join(so_far.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    open_entries = rows.groupBy("entry").agg(F.min("component").alias("a"), F.max("component").alias("z")).where("a < z").select("entry")
    rows = staged(rows.join(open_entries, "entry", "left_semi"), "open", large=True)
    pairs, families = staged(_across(rows), "pairs"), staged(_families(rows), "families")
    sets = _sets_of(_ends(pairs).unionAll(families.select("set_id")), first, texts)
    within = (families.join(sets, "set_id").repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj")
              .mapInArrow(_blocks, "u long, v long"))
    more = staged(_linked(pairs, sets).unionAll(within).distinct(), "links")
    unstage(index, rows, sets, families)
    joined = staged(components(links.unionAll(more)), "components")
    group = first.join(joined.select(F.col("node").alias("set_id"), "component"), "set_id", "left").withColumn(
        "component", F.coalesce("component", "set_id"))
    smallest = group.groupBy("component").agg(F.min("_id").alias("component_id"))
    label = group.join(smallest, "component").select("set_id", "component", "component_id")
    return classes.join(label, "set_id", "left").select(*names, "n_shingles", "set_id", "component", F.coalesce("component_id", "_id").alias("component_id"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """``(id, n_shingles, component_id)`` for each row; ``component_id`` is the smallest id reachable by links.

    Rows of equal ids are told apart by nothing: each gets the component of its text.
    """
    labelled = _labelled(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), frequent)
    return labelled.select(F.col("_id").alias(id_col), "n_shingles", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are first of their group: one document of each group stays."""
    first = link_components(docs, id_col, text_col).where(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(first, docs[id_col] == first["_kept"], "left_semi")


def _row_hashes(docs: DataFrame) -> list[Column]:
    """Two numbers of a row's values; maps have no hash and do not count."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return [F.xxhash64(*columns), F.xxhash64(*[c.isNull() for c in columns], *columns)]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group: of the smallest id, and among rows of that id of the smallest row hash.

    A null id is the largest: such a row stays where its group has no other. Rows without
    words link with nothing and all stay.
    """
    h, g = _row_hashes(docs)
    rows = staged(_labelled(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), h.alias("_h"), g.alias("_g"))), "labelled")
    same = rows.where("set_id IS NOT NULL").groupBy("component", "_id", "_h", "_g").agg(F.count(F.lit(1)).alias("c"))
    best = same.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_h", "_g", "c")).alias("b")).select("b._h", "b._g", (F.col("b.c") > 1).alias("_again"))
    kept = staged(best.unionAll(rows.where("set_id IS NULL").select("_h", "_g", F.lit(False).alias("_again")).distinct()), "kept")
    keyed = docs.withColumns({"_h": h, "_g": g})
    once = keyed.join(kept.where("NOT _again"), ["_h", "_g"], "left_semi")
    again = keyed.join(kept.where("_again"), ["_h", "_g"], "left_semi").dropDuplicates(["_h", "_g"])
    return once.unionAll(again).select(*[F.col(f"`{c}`") for c in docs.columns])
