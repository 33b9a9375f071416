"""Toxicity: subword bags of short segments, averaged into a linear softmax.

A few toxic words vanish in the average of a long text, so the bag is one of a segment of
``SEGMENT`` words, and a text is as toxic as its most toxic segment, in learning as in
scoring. Byte n-grams let misspellings that were never seen share the vectors of known words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from factloom.llm import subword
from factloom.llm._io import release

SEGMENT = 8
FEATURES = subword.Features(table="lower", sizes=(3, 4, 5), segment=SEGMENT)
#: Rows sampled for fitting, of label 0 and 1, and bytes of their texts.
SAMPLE_ROWS = (3000, 2000)
SAMPLE_BYTES = 16 << 20
THRESHOLD = 0.5


def fit(docs: DataFrame, labels: DataFrame) -> subword.Model:
    """Learns from a sample of labelled rows outside the held-out fold. Without any, all scores are near 0.5."""
    texts, y = subword.labelled(docs, labels, "toxic", SAMPLE_ROWS, SAMPLE_BYTES)
    model = subword.train(texts, y, FEATURES, epochs=30, rate=5.0, batch=64, warm=4)
    del texts
    release()
    return model


def score_toxicity(docs: DataFrame, model: subword.Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted (and the columns to keep).

    A null or empty text gets the share of toxic ones among the fitted rows, a repeated row
    equal results; an empty table gives no rows. A kept column gives way to a result of its name.
    """
    return subword.score(docs, model, threshold, keep=keep)


def toxic(text: Column, model: subword.Model, threshold: float = THRESHOLD) -> Column:
    """Whether the classifier calls the text toxic; for null and empty ones as for an empty bag."""
    return subword.judged(text, model, threshold)["predicted"] == 1
