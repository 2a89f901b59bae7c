"""Languages of a document as a mixture, by expectation-maximisation over n-gram likelihoods.

Each language is a model of letter trigrams, counted over all labelled training texts. A text's words are draws from a mixture of the
languages; expectation-maximisation estimates the proportions. The set of languages starts with the one that explains the text
best alone and grows by the one that raises the likelihood most, as long as the gain outweighs a penalty per language that rises with
the logarithm of the number of words.

The models are counts of at most 64 x 64 x 64 trigram classes for each language, whatever the size of the corpus, summed by Spark.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.llm.common import bounded

CLASSES = 64
GRAMS = CLASSES**3
FOLDS = 5
UNKNOWN = "und"
SCHEMA = "doc_id bigint, lang_pred string, score double, proportions map<string,double>, n_words bigint"


@dataclass(frozen=True)
class Settings:
    """`smoothing`: added count of every trigram; `penalty`: factor of the logarithm of the words that a further language must gain."""

    smoothing: float = 0.1
    penalty: float = 2.0
    rounds: int = 12


def _letter_classes() -> np.ndarray:
    """Class of every code point: 0 for what is no letter, else 1 to CLASSES - 1, apart for a-z and the letters beyond by remainder."""
    classes = np.zeros(sys.maxunicode + 1, np.uint8)
    points = np.array([i for i in range(sys.maxunicode + 1) if chr(i).isalpha()])
    classes[points] = np.where(points < 128, points % 32, 27 + points % (CLASSES - 27))
    return classes


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(_letter_classes())
    return _CLASSES[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Trigram numbers of a text's words in lower case, a word being a run of letters with a boundary at each end; and each word's first place.

    A word of n letters has n trigrams: every letter with its two neighbours.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    c = np.concatenate(([0], _classes()[codes], [0])).astype(np.int32)
    inside = c > 0
    at = np.nonzero(inside)[0]
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    numbers = (c[at - 1] * CLASSES + c[at]) * CLASSES + c[at + 1]
    return numbers, np.nonzero(~inside[at - 1])[0]


def training_fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def count_grams(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of rows (text, lang), sorted, and the counts of their trigrams; rows without lang are passed over."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                total = totals.setdefault(lang, np.zeros(GRAMS, np.int64))
                numbers, _ = grams(text.as_py())
                if len(numbers) > 4096:
                    total += np.bincount(numbers, minlength=GRAMS)
                else:
                    np.add.at(total, numbers, 1)
        for lang, total in totals.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "gram", "n"])

    rows = docs.filter("lang is not null").select("text", "lang").mapInArrow(count, "lang string, gram int, n bigint")
    found = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(docs.filter("lang is not null").select("lang").distinct().toPandas()["lang"])
    counts = np.zeros((len(langs), GRAMS))
    if len(found):
        counts[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), found["gram"].to_numpy()] = found["n"].to_numpy()
    return langs, counts


def log_likelihoods(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """log P(third letter, given the two before) for every trigram and language: (GRAMS, languages)."""
    by_pair = counts.reshape(len(counts), CLASSES * CLASSES, CLASSES) + smoothing
    return np.log(by_pair / by_pair.sum(2, keepdims=True)).reshape(len(counts), GRAMS).T.astype(np.float32)


def _mixture(p: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of a mixture of the columns of p."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        weighted = p * share
        share = (weighted / weighted.sum(1, keepdims=True)).mean(0)
    return share, float(np.log(p @ share).sum())


def infer(logs: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Languages and their proportions, largest first, for the words' log likelihoods (words, languages)."""
    top = logs.max(1, keepdims=True)
    p = np.exp(np.maximum(logs - top, -60.0)).astype(np.float64)
    chosen = [int(np.argmax(logs.sum(0)))]
    share, likelihood = np.ones(1), float(np.log(p[:, chosen[0]]).sum())
    cost = settings.penalty * np.log(len(p) + 1)
    while len(chosen) < p.shape[1]:
        # A language that is no word's best, or whose words could gain less than the penalty, cannot enter.
        current = np.log(p[:, chosen] @ share)
        room = np.maximum(np.log(p) - current[:, None], 0).sum(0)
        others = [k for k in np.argsort(-room, kind="stable").tolist() if k not in chosen and room[k] > cost]
        tried = [(*_mixture(p[:, [*chosen, k]], settings.rounds), k) for k in others]
        best = max(tried, key=lambda x: x[1], default=None)
        if best is None or best[1] - likelihood <= cost:
            break
        share, likelihood = best[0], best[1]
        chosen.append(best[2])
    order = np.argsort(-share, kind="stable")
    return np.array(chosen)[order], share[order]


def identify(docs: DataFrame, training: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The languages of every document, one row per row of `docs`, as SCHEMA names them.

    `training` has rows (text, lang). `lang_pred` is the language of the largest proportion, `score` that proportion; ties go to the first
    language by name. Texts that are null or have no letter, and all texts when nothing is learned, give `und`, score 0 and
    no proportions. Texts of any length are read whole. Repeated rows and null ids are rows like any others; only doc_id and text are
    read of `docs`, so that columns of any other name change nothing. An empty table gives an empty table.
    """
    settings = settings or Settings()
    langs, counts = count_grams(training)
    model = docs.sparkSession.sparkContext.broadcast((langs, log_likelihoods(counts, settings.smoothing) if langs else np.zeros((GRAMS, 0), np.float32)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = model.value
        for batch in bounded(batches, "text"):
            out: tuple[list, ...] = ([], [], [], [])
            for text in batch.column("text").to_pylist():
                numbers, starts = grams(text)
                if not len(numbers) or not names:
                    found, row = [], (UNKNOWN, 0.0, [], len(starts))
                else:
                    which, share = infer(np.add.reduceat(table[numbers], starts, axis=0), settings)
                    found = [(names[k], float(s)) for k, s in zip(which, share, strict=True)]
                    row = (found[0][0], min(1.0, found[0][1]), found, len(starts))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64()), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
                                             names=["doc_id", "lang_pred", "score", "proportions", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(of, SCHEMA)


def labelled(docs: DataFrame) -> DataFrame:
    """Training rows: those whose fold is not held out and whose lang is known. A null doc_id is in no fold and not learned from."""
    return docs.filter((training_fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull()).select("text", "lang")


def keep_identified(docs: DataFrame, least: float = 1 / 3) -> DataFrame:
    """The rows of `docs` whose language is known: letters in the text, and one language with at least `least` of its words.

    A text in two languages stays; null texts and texts without letters go. Where nothing can be learned, every text with
    letters stays. The model is learned from the training rows of `docs` itself. All columns are kept, whatever their names. Prediction and
    filter happen in one pass: nothing is joined back.
    """
    settings = Settings()
    langs, counts = count_grams(labelled(docs))
    model = docs.sparkSession.sparkContext.broadcast((len(langs), log_likelihoods(counts, settings.smoothing) if langs else np.zeros((GRAMS, 0), np.float32)))

    @F.pandas_udf("boolean")
    def known(texts: pd.Series) -> pd.Series:
        many, table = model.value

        def one(text: str | None) -> bool:
            numbers, starts = grams(text)
            if not len(numbers) or not many:
                return len(numbers) > 0
            return bool(infer(np.add.reduceat(table[numbers], starts, axis=0), settings)[1][0] >= least)

        return pd.Series([one(t) for t in texts], dtype=bool)

    return docs.filter(known(F.col("text")))
