"""Token counts at every prefix of a text, by dynamic programming over a BPE vocabulary.

A merge never crosses the end of a prefix, so the encoding of a prefix ends in one token
and, without it, is the encoding of a shorter prefix. Two tokens may stand side by side
exactly if encoding their joint string gives these two, and a sequence of which all
neighbours may stand side by side is the encoding of its string: the first merge across
a boundary would also be made when those two are encoded alone. So, from left to right,
each prefix has exactly one last token that fits the last token of the prefix before it,
and its count is that prefix's plus one. One pass stores all counts; asking what a cut
text costs, or how much text fits a budget, needs no further encoding.

The vocabulary is that of a sentencepiece BPE model with byte fallback, without
normalisation, with a space before the text (``▁``). A character outside the vocabulary
costs its bytes and parts its neighbours. Where no token has a ``▁`` after another
character, words are encoded apart, and a task computes a repeated word once (a bounded
cache). The tables of a model are a few MB, whatever the corpus, and go to the tasks by
broadcast; the file is read by the driver alone.

Null and empty texts have no token and one prefix, the empty one. Repeated rows count
alike; rows of a null id keep it. Empty tables give no rows. Only the id and the text
are read, whatever other columns are called. A text of any length needs memory for the
text and for ``PIECE`` characters of counts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import small_batches

SPACE = "▁"
#: Characters of a text whose counts are at hand at once; a row of ``prefix_counts`` has as many.
PIECE = 8192
#: Words and token pairs that a task remembers; forgotten ones are computed again.
REMEMBERED = 400_000
#: Longer words are not remembered.
WORD = 64
#: A text up to this long has its words listed, a longer one word after word.
AT_ONCE = 1 << 20
LIMIT = 4096

#: A run of spaces and what follows up to the next.
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> dict[str, float]:
    """Score of each token that merging can give, from a sentencepiece model file."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    how = model.normalizer_spec
    normal, byte = 1, 6
    kinds = {p.type for p in model.pieces}
    plain = not how.precompiled_charsmap and how.add_dummy_prefix and not how.remove_extra_whitespaces and how.escape_whitespaces
    if model.trainer_spec.model_type != 2 or not plain or byte not in kinds or kinds & {4, 5} or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError(f"{path}: needs a BPE model with byte fallback, a space before the text and no normalisation or own symbols")
    return {p.piece: p.score for p in model.pieces if p.type == normal}


class Encoder:
    """The dynamic program over one vocabulary."""

    def __init__(self, score: dict[str, float]) -> None:
        self.score = score
        self.longest = max(map(len, score), default=1)
        #: May words be encoded apart?
        self.apart = all(SPACE not in p.lstrip(SPACE) for p in score)
        self.edges: dict[str, tuple[list[float], list[str], list[str]] | None] = {}
        self.fits: dict[tuple[str | None, str], bool] = {}
        self.totals = _Totals(self)
        self.ends = ahocorasick.Automaton()
        for token in score:
            self.ends.add_word(token, (len(token), token))
        self.ends.make_automaton()

    def merge(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """The encoding of a short string, and of each step of it the score, the first and the last part before it.

        The best-scored neighbours merge first, the leftmost of equal ones.
        """
        parts, steps, left, right = list(text), [], [], []
        while True:
            left.append(parts[0])
            right.append(parts[-1])
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts, steps, left, right
            steps.append(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _edge(self, token: str) -> tuple[list[float], list[str], list[str]] | None:
        """How the ends of a token's string change while it is encoded; None if that does not give the token."""
        if token not in self.edges:
            parts, steps, left, right = self.merge(token)
            self.edges[token] = (steps, left, right) if len(parts) == 1 else None
        return self.edges[token]

    def _side_by_side(self, before: str | None, token: str) -> bool:
        b = self._edge(token)
        if before is None or b is None:
            return b is not None
        a = self._edge(before)
        if a is None:
            return False
        (a_steps, _, a_last), (b_steps, b_first, _) = a, b
        i = j = 0
        while True:
            across = self.score.get(a_last[i] + b_first[j])
            in_a = a_steps[i] if i < len(a_steps) else None
            in_b = b_steps[j] if j < len(b_steps) else None
            # the merge across is made once it is the best; of equal ones the leftmost is
            if across is not None and (in_a is None or across > in_a) and (in_b is None or across >= in_b):
                return False
            if in_a is None and in_b is None:
                return True
            if in_b is None or (in_a is not None and in_a >= in_b):
                i += 1
            else:
                j += 1

    def may_follow(self, before: str | None, token: str) -> bool:
        """Do these tokens stand side by side in an encoding? None is the start of a text."""
        key = (before, token)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            known = self.fits[key] = self._side_by_side(before, token)
        return known

    def steps(self, text: str, tail: str = "", last: list[str | None] | None = None, count: list[int] | None = None) -> tuple[list[str | None], list[int]]:
        """Last token and number of tokens of each prefix of ``tail + text`` from the end of ``tail`` on.

        ``tail`` is what stood before, with ``last`` and ``count`` of each of its prefixes.
        """
        may_follow, whole, n = self.may_follow, tail + text, len(tail)
        last, count = list(last or [None]), list(count or [0])

        def outside(until: int) -> None:
            """Characters that no token has cost their bytes; what follows starts anew."""
            while len(count) < until:
                last.append(None)
                count.append(count[-1] + len(whole[len(count) - 1].encode("utf-8", "surrogatepass")))

        # tokens by the place where they end, the longest first; each place has exactly one that fits
        known, have = self.fits.get, len(count)
        for at, (size, token) in self.ends.iter(whole):
            if at + 1 < have:
                continue
            if at + 1 > have:
                outside(at + 1)
            start = at + 1 - size
            before = last[start]
            fits = known((before, token))
            if fits or (fits is None and may_follow(before, token)):
                last.append(token)
                count.append(count[start] + 1)
            have = len(count)
        outside(len(whole) + 1)
        return last[n:], count[n:]

    def total(self, chunk: str) -> int:
        """Number of tokens of a chunk."""
        count = 0
        for counts in self.counts(chunk):
            count = counts[-1]
        return count

    def counts(self, chunk: str) -> Iterator[list[int]]:
        """Number of tokens of each non-empty prefix of a chunk, ``PIECE`` of them at a time."""
        tail, last, count = "", [None], [0]
        for at in range(0, len(chunk), PIECE):
            piece = chunk[at:at + PIECE]
            ends, numbers = self.steps(piece, tail, last, count)
            yield numbers[1:]
            seen = tail + piece
            last, count = (last + ends[1:])[-self.longest - 1:], (count + numbers[1:])[-self.longest - 1:]
            tail = seen[len(seen) - (len(last) - 1):]

    def chunks(self, text: str) -> Iterator[str]:
        """The parts of the text, its leading space included, that are encoded apart."""
        if not text:
            return
        whole = SPACE + text.replace(" ", SPACE)
        if not self.apart:
            yield whole
            return
        for found in _CHUNK.finditer(whole):
            yield found.group()

    def tokens(self, text: str) -> int:
        """Number of tokens of a whole text."""
        if self.apart and text and len(text) <= AT_ONCE:
            return sum(map(self.totals.__getitem__, _CHUNK.findall(SPACE + text.replace(" ", SPACE))))
        return sum(map(self.totals.__getitem__, self.chunks(text)))

    def prefixes(self, text: str) -> Iterator[list[int]]:
        """Number of tokens of each prefix of a text, the empty one first, in lists of at most ``PIECE``."""
        out, before, first = [0], 0, True
        for chunk in self.chunks(text):
            count = 0
            for counts in self.counts(chunk):
                count = counts[-1]
                # the space before the text is no character of it
                out += [before + c for c in (counts[1:] if first else counts)]
                first = False
                while len(out) >= PIECE:
                    yield out[:PIECE]
                    out = out[PIECE:]
            before += count
        if out:
            yield out


class _Totals(dict):
    """Number of tokens by chunk, for the short ones met so far."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, chunk: str) -> int:
        n = self.encoder.total(chunk)
        if len(chunk) <= WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = n
        return n


#: The encoder that this Python worker used last, by its vocabulary's number.
_used: dict[str, Encoder] = {}


def _encoders(docs: DataFrame, model: str | None):
    """A function that gives a task's encoder; the tasks of a Python worker share what it remembers."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model or default_model()))
    number = uuid.uuid4().hex

    def make() -> Encoder:
        if number not in _used:
            _used.clear()
            _used[number] = Encoder(shared.value)
        return _used[number]

    return make


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of each whole text: the count at its longest prefix."""
    small_batches(docs.sparkSession)
    make = _encoders(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            n = [encoder.tokens(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return (docs.select(F.col(id_col).alias("id"), size.alias("n_bytes"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col))


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(id, piece, counts)``: ``counts[i]`` tokens has the prefix of ``piece * PIECE + i`` characters.

    A row has the counts of at most ``PIECE`` prefixes. Ids should name one row each.
    """
    small_batches(docs.sparkSession)
    make = _encoders(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                for piece, counts in enumerate(encoder.prefixes(text.as_py() or "")):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, 1), pa.array([piece], pa.int64()), pa.array([counts], pa.list_(pa.int32()))], ["id", "piece", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, piece long, counts array<int>").withColumnRenamed("id", id_col))


def tokens_at(prefixes: DataFrame, questions: DataFrame, id_col: str = "doc_id", chars_col: str = "chars") -> DataFrame:
    """The questions with ``n_tokens``: what the first ``chars`` characters cost; null beyond a text's end.

    Questions of a null id, or of a negative or null number, have null.
    """
    asked = questions.withColumn("_piece", F.floor(F.col(chars_col) / PIECE).cast("long"))
    there = prefixes.select(F.col(id_col).alias("_id"), F.col("piece").alias("_at"), F.col("counts").alias("_counts"))
    met = asked.join(there, (F.col(id_col) == F.col("_id")) & (F.col("_piece") == F.col("_at")), "left")
    return met.select(*questions.columns, F.get("_counts", F.pmod(F.col(chars_col), F.lit(PIECE)).cast("int")).alias("n_tokens"))


def longest_within(prefixes: DataFrame, budget: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """``(id, chars, n_tokens)``: the longest prefix of at most ``budget`` tokens, and its count.

    Counts may fall when a text goes on (a longer token replaces two), so the last prefix
    that fits is looked for, not the first that does not. Each piece answers for itself;
    a text's pieces meet as one number each. A negative budget gives no rows.
    """
    fits = F.filter(F.transform("counts", lambda c, i: F.when(c <= budget, F.struct((F.col("piece") * PIECE + i).alias("chars"), c.alias("n_tokens")))), lambda x: x.isNotNull())
    best = prefixes.select(id_col, F.array_max(fits).alias("best")).where(F.col("best").isNotNull())
    return best.groupBy(id_col).agg(F.max("best").alias("best")).select(id_col, F.col("best.chars").alias("chars"), F.col("best.n_tokens").cast("long").alias("n_tokens"))
