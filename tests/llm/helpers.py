"""Small tables for the operators' tests."""

import json

import pytest

HARD = ["", None, " ", "\n\n", "a", "one two", "One  two\tthree\n", "x" * 5000, "the same words again and again " * 400, "日本語 и кириллица ñandú", "a | b | c | d", "THE!! END!! NOW!!"]


def documents(spark, texts, first=0, **more):
    """doc_id, text and an extra column whose name clashes with inner ones."""
    rows = [(first + i, t, "pair") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")


def as_json(rows):
    return sorted(json.dumps(r.asDict(), sort_keys=True, default=str) for r in rows)


def words(n, seed=0, vocabulary=400):
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


__all__ = ["HARD", "as_json", "documents", "pytest", "words"]
