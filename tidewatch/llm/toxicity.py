"""Toxicity by maximum-scoring segments.

A word's forms are itself and its beginnings of 3 to 8 letters, so that inflected words
share evidence. Forms get log-odds of toxic against clean training texts, by the texts
that hold them (a text that repeats a word counts once), under a Dirichlet prior with the
forms' overall shares; forms whose two counts differ clearly from equal shares, by their
likelihood ratio, make the lexicon, towards toxic and towards clean. A word scores its
longest form in the lexicon; any other word costs a little.

One linear pass finds all maximal segments of a text's scores (Ruzzo and Tompa). In
clean texts the best segment follows an extreme-value law ``1 - exp(-K n exp(-lambda
S))``: ``lambda`` solves the score equation of the clean words, ``K`` comes from their
segments. Segments whose expected number by chance is small are the toxic passages;
the evidence of all, with the share of words they cover and the evidence of clean words,
gives the score by a logistic curve fitted to the training texts.

The classifier is fitted on at most about ``TRAINING`` labelled texts, chosen by a hash
of their id. Null and empty texts have no segments and the score of no evidence.
Repeated rows score alike; labels that are null or repeated with contradiction count
as given. Without labels of both kinds every score is the share of toxic labels, 0 if
there are none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, small_batches

TRAINING = 20_000
#: Weight of the prior in texts, and the root of twice the log-likelihood ratio that a form must reach.
PRIOR, CLEAR = 10.0, 4.0
#: Forms in the lexicon at most (the clearest), which bounds what tasks receive.
MOST_FORMS = 20_000
SHORTEST, LONGEST = 3, 8
#: What a word outside of the lexicon costs, in nats.
COST = 0.15
#: A segment expected less often than this in clean text is a toxic passage.
EXPECTED = 0.05
#: Figures of a text that the curve weighs.
EVIDENCE = 5
_WORD = re.compile(WORD)
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def forms(word: str) -> list[str]:
    """A word and its beginnings (marked ``^``), longest first; edges without letters are cut off."""
    word = _EDGES.sub("", word)
    if not word:
        return []
    return [word] + ["^" + word[:n] for n in range(min(LONGEST, len(word)), SHORTEST - 1, -1)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0
    rate: float = 1.0
    curve: tuple[float, ...] = (0.0,) * (EVIDENCE + 1)

    def word_scores(self, words: list[str], seen: dict[str, float]) -> list[float]:
        out = []
        for word in words:
            score = seen.get(word)
            if score is None:
                score = next((self.lexicon[f] for f in forms(word) if f in self.lexicon), -COST)
                if len(seen) < 200_000:
                    seen[word] = score
            out.append(score)
        return out

    def expected(self, score: float, n: int) -> float:
        """Segments of at least this score expected in a clean text of ``n`` words."""
        return self.rate * max(n, 1) * math.exp(-self.scale * score)

    def evidence(self, scores: list[float]) -> tuple[float, ...]:
        """Surprise of the best segment, of all toxic passages together, the share of words with evidence; weight and share of clean words."""
        n = len(scores)
        best = total = 0.0
        for begin, end, score in segments(scores):
            best = max(best, -math.log(max(self.expected(score, n), 1e-300)))
            total += self.scale * score
        hits = sum(s > 0 for s in scores)
        clean = [s for s in scores if s < -COST]
        return max(best, 0.0), math.log1p(total), hits / n if n else 0.0, math.log1p(-sum(clean)), len(clean) / n if n else 0.0

    def score(self, scores: list[float]) -> float:
        x = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], self.evidence(scores)))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, x))))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) in one linear pass.

    Each candidate links to the last one before it whose sum before is smaller: what lies
    between can join no later segment without it, and is never looked at again.
    """
    found: list[tuple[int, int, float, float, int]] = []  # begin, end, sum before, sum through, link
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        begin, start, j = i, before, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= start:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            begin, _, start, _, link = found[j]
            del found[j:]
            j = link
        found.append((begin, i + 1, start, total, j))
    return [(b, e, through - before) for b, e, before, through, _ in found]


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_label = (Counter(), Counter())
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            by_label[label].update({form for word in set(words_of(text)) for form in forms(word)})
        out: dict[str, list[int]] = {}
        for label, counts in enumerate(by_label):
            for form, n in counts.items():
                out.setdefault(form, [0, 0])[label] = n
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(out), pa.string()), pa.array([c[0] for c in out.values()], pa.int64()), pa.array([c[1] for c in out.values()], pa.int64())],
            ["form", "clean", "toxic"])


def _lexicon(training: DataFrame, prior: float) -> dict[str, float]:
    """Log-odds of the forms that stand clear of zero: above towards toxic, below towards clean."""
    sums = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = float(sums.get(0, 0)), float(sums.get(1, 0))
    if not n_clean or not n_toxic:
        return {}
    counts = training.mapInArrow(_count_forms, "form string, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    share = (F.col("c") + F.col("t")) / (n_clean + n_toxic)
    t, c = F.col("t") + prior * share, F.col("c") + prior * share
    # a form of every text leaves nothing below the line
    odds = F.log(t / F.greatest(n_toxic + prior - t, F.lit(0.5))) - F.log(c / F.greatest(n_clean + prior - c, F.lit(0.5)))
    part = lambda x, n: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (share * n))).otherwise(0.0)
    gain = F.sqrt(F.greatest(2 * (part("t", n_toxic) + part("c", n_clean)), F.lit(0.0)))
    clear = counts.where("t > 1 OR c > 1").select("form", odds.alias("o"), gain.alias("g")).where((F.abs("o") > 1.0) & (F.col("g") > CLEAR))
    return {r["form"]: float(r["o"]) for r in clear.orderBy(F.desc("g"), "form").limit(MOST_FORMS).collect()}


def _tail_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of ``sum p exp(x s) = 1`` over the clean words' scores."""
    p = counts / counts.sum()
    low, high = 1e-6, 1.0
    value = lambda x: float(np.sum(p * np.exp(np.minimum(x * scores, 700)))) - 1.0
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return max(low, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps; the first coefficient is the intercept."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def train(labelled: DataFrame, prior: float = PRIOR) -> Model:
    """A model from ``labelled`` (text, label); the caller bounds its rows."""
    small_batches(labelled.sparkSession)
    model = Model()
    share = labelled.agg(F.avg("label").cast("double")).first()[0]
    base = min(max(share or 0.0, 1e-6), 1 - 1e-6)
    model.curve = (math.log(base / (1 - base)), *[0.0] * EVIDENCE)
    model.lexicon = _lexicon(labelled, prior)
    if not model.lexicon:
        return model
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def clean_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, {}
        for batch in batches:
            counts: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                if not label:
                    counts.update(own.word_scores(words_of(text), seen))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.float64()), pa.array(list(counts.values()), pa.int64())], ["s", "n"])

    # as many different scores as the lexicon has, and one
    rows = labelled.mapInArrow(clean_segments, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    scores, counts = np.array([r["s"] for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    positive = scores > 0
    if positive.any() and float(scores @ counts) < 0:
        model.scale = _tail_rate(scores, counts)
    else:
        model.scale = 1.0
    # a segment begins with a scoring word; half a count keeps the rate above zero
    model.rate = float((np.sum(counts[positive] * np.exp(model.scale * scores[positive])) + 0.5) / (counts.sum() + 1.0))
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, {}
        for batch in batches:
            x = [own.evidence(own.word_scores(words_of(t), seen)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in x], pa.float64()) for i in range(EVIDENCE)] + [batch.column("label")], [*names, "label"])

    names = [f"e{i}" for i in range(EVIDENCE)]
    rows = labelled.mapInArrow(features, ", ".join(f"{n} double" for n in names) + ", label int").collect()  # bounded by TRAINING
    x = np.array([[r[n] for n in names] for r in rows])
    model.curve = _logistic(x, np.array([r["label"] for r in rows], dtype=float))
    return model


def training_rows(docs: DataFrame, labels: DataFrame, eligible: Column, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic", most: int = TRAINING) -> DataFrame:
    """Texts and labels of the eligible labelled rows, about ``most`` of them at most, by a hash of the id.

    Labels other than 0 and 1 are no labels.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & eligible).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    every = max(1, math.ceil(known.count() / most))
    chosen = lambda c: F.pmod(F.xxhash64(c.cast("string"), F.lit("toxicity")), F.lit(every)) == 0
    texts = docs.where(chosen(F.col(id_col))).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return texts.join(known.where(chosen(F.col("_id"))), "_id").select("text", "label")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, passages)``: passages are (begin, end, expected) in words, all that clean text would hardly have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, {}
        for batch in batches:
            out, spans = [], []
            for text in batch.column(1).to_pylist():
                scores = own.word_scores(words_of(text), seen)
                out.append(own.score(scores))
                n = len(scores)
                spans.append([{"begin": b, "end": e, "expected": own.expected(s, n)} for b, e, s in segments(scores) if own.expected(s, n) <= EXPECTED])
            kinds = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(spans, kinds)], ["id", "score", "passages"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, score double, passages array<struct<begin: int, end: int, expected: double>>").withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``most``, judged where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value, {}
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            keep = [own.score(own.word_scores(words_of(t), seen)) < most for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
