"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learnt from labelled texts: whole words and word beginnings of 3 to 8 letters whose share of
toxic documents stands out. Features are lexicon densities, nearness to second-person words, and rates of
capitals, punctuation, repetition and obfuscation. The model is fitted on at most ``FIT_ROWS`` labelled
documents, drawn by a hash over all labelled rows outside the held-out part. Lexicon and trees are fitted
crosswise in two folds, so that features and calibration see no label they are fitted on.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, isotonic
from .common import text_of, written
from .pretokens import Memo

#: At most so many labelled documents fit the model.
FIT_ROWS = 20_000
#: At most so many candidate lexemes are counted, the most frequent in toxic documents.
CANDIDATES = 20_000
LEXICON = 3_000
THRESHOLD = 0.7
Z = 3.5
LEAST = 4
NEAR = 5
#: Words that address a reader, in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tus vosotros".split())
#: Characters that stand in for letters.
STAND_INS = str.maketrans("01345789@$!|+", "oleastbgasiit")
FEATURES = 22
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[^\W\d_][\d@$!|*#+]+[^\W\d_]")
_DOUBLED = re.compile(r"(.)\1{2,}")
_UPPER = bytes(range(0x41, 0x5B))
_PUNCT = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def bare(word: str) -> str:
    return _EDGE.sub("", word).lower()


def lexemes(word: str) -> list[str]:
    """'=word' and the word's beginnings, for a bare word."""
    return ["=" + word] + [word[:k] + "*" for k in range(3, 9) if len(word) > k] if word else []


def log_odds(toxic: float, clean: float, all_toxic: float, all_clean: float) -> tuple[float, float]:
    """Log ratio of document rates and its z."""
    a, b = toxic + 0.5, clean + 0.5
    ratio = math.log(a / (all_toxic + 1)) - math.log(b / (all_clean + 1))
    return ratio, ratio / math.sqrt(1 / a + 1 / b)


def build_lexicon(counts: dict[str, tuple[int, int]], all_toxic: int, all_clean: int) -> dict[str, float]:
    found = []
    for name, (toxic, clean) in counts.items():
        ratio, z = log_odds(toxic, clean, all_toxic, all_clean)
        if toxic >= LEAST and z > Z and ratio > 1:
            found.append((-z, name, ratio))
    return {name: ratio for _, name, ratio in sorted(found)[:LEXICON]}


class Extractor:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.word = Memo(self._word)

    def best(self, word: str) -> float:
        return max([self.lexicon.get(x, 0.0) for x in lexemes(word)], default=0.0)

    def _word(self, raw: str) -> tuple:
        """(lexicon weight, disguised weight, second person, upper case, inner stand-in, repeated letter, length)."""
        word = bare(raw)
        weight = self.best(word)
        plain = re.sub(r"[\W\d_]", "", raw.lower().translate(STAND_INS))
        plain = _DOUBLED.sub(r"\1", plain)
        disguised = 0.0 if weight or plain == word else self.best(plain)
        return weight, disguised, word in SECOND_PERSON, len(raw) > 1 and raw.isupper(), bool(_INNER.search(raw)), bool(_DOUBLED.search(word)), len(word)

    def __call__(self, data: bytes) -> list[float]:
        text = data.decode("utf-8", "replace")
        words = text.split()
        n = max(1, len(words))
        held = Counter(words)
        total = strong = strong_kinds = weak = most = hidden = second = upper = inner = doubled = letters = 0.0
        top = 0
        for raw, times in held.items():
            weight, disguised, is_second, is_upper, is_inner, is_doubled, size = self.word(raw)
            if weight:
                total += weight * times
                most = max(most, weight)
                if weight >= 3:
                    strong += times
                    strong_kinds += 1
                else:
                    weak += times
            hidden += times * (disguised >= 3)
            second += times * is_second
            upper += times * is_upper
            inner += times * is_inner
            doubled += times * is_doubled
            letters += times * size
            top = max(top, times)
        near = gap = 0.0
        if strong and second:
            at_second = [i for i, w in enumerate(words) if self.word(w)[2]]
            hits = [i for i, w in enumerate(words) if self.word(w)[0] >= 3]
            marks = np.array(at_second)
            place = np.searchsorted(marks, hits)
            away = np.minimum(np.abs(marks[np.minimum(place, len(marks) - 1)] - hits), np.abs(marks[np.maximum(place - 1, 0)] - hits))
            near, gap = float((away <= NEAR).mean()), 1 / (1 + float(away.min()))
        size = max(1, len(data))
        capitals = len(data) - len(data.translate(None, _UPPER))
        punctuation = len(data) - len(data.translate(None, _PUNCT))
        return [
            total / n, strong / n, math.log1p(strong), strong_kinds, weak / n, math.log1p(weak), most, total / math.sqrt(n), hidden / n, math.log1p(hidden),
            second / n, near, gap, capitals / size, upper / n, punctuation / size, data.count(b"!") / n, data.count(b"?") / n,
            inner / n, doubled / n, letters / n, top / n if n > 20 else 0.0,
        ]


class Model:
    """Lexicon, trees and calibration knots; without both classes the score is the share of toxic labels."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, knots: tuple[np.ndarray, np.ndarray], prior: float):
        self.lexicon, self.trees, self.knots, self.prior = lexicon, trees, knots, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0.0, 1.0)


def remainder() -> Column:
    """crc32 of doc_id as text, modulo 3; null ids have none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """labels: doc_id, toxic. Rows without id or label, and those whose crc32(doc_id) mod 3 is 1, teach nothing."""
    known = labels.where("doc_id is not null and toxic is not null").where(remainder() != 1).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(fit_rows).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(2)).cast("int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().cast("binary").alias("text")).join(F.broadcast(drawn), "id")
    sample = written(rows.select("y", "fold", "text"), "toxicity-sample")  # at most fit_rows documents

    def tally(only: frozenset[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in batches:
                for y, fold, text in zip(*[c.to_pylist() for c in batch.columns]):
                    found = {x for w in set(text.decode("utf-8", "replace").split()) for x in lexemes(bare(w))}
                    counts.update((x, fold, y) for x in (found & only if only is not None else found))
                    counts["", fold, y] += 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["lexeme", "fold", "y", "n"])

        return run

    schema = "lexeme string, fold int, y int, n long"
    often = sample.where("y = 1").mapInArrow(tally(None), schema).where("lexeme <> ''").groupBy("lexeme").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "lexeme").limit(CANDIDATES)
    only = frozenset(r[0] for r in often.select("lexeme").collect())
    counted = {(r[0], r[1], r[2]): r[3] for r in sample.mapInArrow(tally(only), schema).groupBy("lexeme", "fold", "y").agg(F.sum("n")).collect()}
    of = lambda name, folds, y: sum(counted.get((name, f, y), 0) for f in folds)
    lexicons = []
    for folds in ((1,), (0,), (0, 1)):  # fold 0 is read with the lexicon of fold 1, and the other way round
        lexicons.append(build_lexicon({x: (of(x, folds, 1), of(x, folds, 0)) for x in only}, of("", folds, 1), of("", folds, 0)))
    toxic, clean = of("", (0, 1), 1), of("", (0, 1), 0)
    prior = toxic / max(1, toxic + clean)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [Extractor(lexicons[0]), Extractor(lexicons[1])]
        for batch in batches:
            y, fold, text = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(fold, pa.int32()), pa.array([read[f](t) for f, t in zip(fold, text)], pa.list_(pa.float64()))], ["y", "fold", "x"])

    got = sample.mapInArrow(features, "y int, fold int, x array<double>").toPandas()  # fit_rows rows of FEATURES numbers at most
    if not len(got) or got["y"].nunique() < 2:
        return Model({}, None, (np.zeros(1), np.zeros(1)), prior)
    got["line"] = [tuple(x) for x in got["x"]]
    got = got.sort_values(["fold", "y", "line"], kind="stable")  # the order of tasks doesn't matter
    x, y, fold = np.array(got["x"].tolist()), got["y"].to_numpy(float), got["fold"].to_numpy()
    trees = Trees().fit(x, y)
    margins = trees.margin(x)
    for f in (0, 1):
        if len(set(y[fold != f])) == 2:
            margins[fold == f] = Trees().fit(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model(lexicons[2], trees, isotonic(margins, y), prior)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs.

    Null texts count as empty and get a score as well; a null doc_id is not held out. Without labels of both
    classes all scores are the share of toxic ones (0 without labels). An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Extractor(model.value.lexicon)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = np.array([read(t) for t in batch.column(2).to_pylist()]).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.value.score(x))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), text_of().cast("binary").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs whose score stays below the threshold, with all columns, in one pass over the texts.

    Null and empty texts are scored like others; rows of repeated or null doc_id are judged one by one, and a score on
    the threshold goes. Without labels of both classes all rows share one score. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Extractor(model.value.lexicon)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [(t or "").encode() if not isinstance(t, bytes) else t for t in batch.column(at_text).to_pylist()]
                x = np.array([read(t) for t in texts]).reshape(-1, FEATURES)
                yield batch.filter(pa.array(model.value.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
