"""Quality classifier: word and byte n-gram embeddings of a document, averaged into a linear softmax."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.llm import subword
from factloom.llm._io import release

FEATURES = subword.Features(table="raw", sizes=(2, 3, 4), bigrams=True)
#: Rows sampled for fitting, of label 0 and 1, and bytes of their texts.
SAMPLE_ROWS = (1500, 3000)
SAMPLE_BYTES = 12 << 20
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame) -> subword.Model:
    """Learns from a sample of labelled rows outside the held-out fold. Without any, all scores are near 0.5."""
    texts, y = subword.labelled(docs, labels, "quality", SAMPLE_ROWS, SAMPLE_BYTES)
    model = subword.train(texts, y, FEATURES, epochs=8, rate=4.0, warm=0)
    del texts
    release()
    return model


def score_quality(docs: DataFrame, model: subword.Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, score, predicted (and the columns to keep).

    A null or empty text gets the share of good ones among the fitted rows, a repeated row
    equal results; an empty table gives no rows. A kept column gives way to a result of its name.
    """
    return subword.score(docs, model, threshold, keep=keep)
