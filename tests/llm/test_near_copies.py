"""The pipeline's near copies against brute force over five-word shingles."""

import random

import pytest

import corpus_pipeline
from tallyloom.llm import near_copies
from tests.llm.helpers import documents, words
from tests.llm.test_brute_force import groups


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("block", [128, 4])
def test_copies_like_brute_force(spark, block):
    r = random.Random(3)
    texts = ["", None, "one two", "One  TWO", "one two three"]
    for seed in range(12):
        base = words(300, seed)
        texts += [base, base.upper(), *(edited(base, r, k) for k in (1, 3, 5, 6, 7, 8, 10, 14))]
    base = words(200, 50)
    texts += [edited(base, r, 3) for _ in range(60)]  # a large group whose members are just about alike
    texts += [words(150, 100 + i) for i in range(30)]
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    want = dict(enumerate(groups(len(sets), linked)))
    got = {x["doc_id"]: x["component_id"] for x in near_copies.near_components(documents(spark, texts), block=block).collect()}
    assert got == want


def test_stage_drops_copies_of_similarity_08(spark):
    r = random.Random(4)
    texts = []
    for seed in range(40):
        base = words(400, seed)
        copy = base
        while jaccard(shingle_set(base), shingle_set(copy)) > 0.85:
            copy = edited(copy, r, 1)
        texts += [base, copy]
    assert all(0.8 <= jaccard(shingle_set(a), shingle_set(b)) <= 0.85 for a, b in zip(texts[::2], texts[1::2]))
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_copies(spark, documents(spark, texts), "").collect()}
    assert kept == set(range(0, 80, 2))
