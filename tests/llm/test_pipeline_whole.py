"""The pipeline from end to end against plain loops over the same documents."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import language_id, near_copies, quality
from tallyloom.llm.common import table
from tests.llm.test_brute_force import groups
from tests.llm.test_near_copies import jaccard, shingle_set

DATA = "/root/testdata/sf0.001"


def test_run_by_plain_loops(spark):
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    model = quality.train(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
    good = [r for r in rows if r["text"] is not None and model.score([r["text"]])[0][0] >= corpus_pipeline.QUALITY_FROM]
    assert 0 < len(good) < len(rows)

    docs = spark.createDataFrame(good, table(spark, DATA, "documents").schema)
    langs = language_id.train(docs)
    floors = language_id.floors(docs, langs)
    known = []
    for r in good:
        lang, score = langs.predict(r["text"])
        least = [v for n, v in sorted(floors.items()) if len(r["text"]) >= n]
        if lang != language_id.UNKNOWN and score >= (least[-1] if least else 0.0):
            known.append(r)

    sets, bits = [shingle_set(r["text"]) for r in known], [near_copies.majority(near_copies.shingles(r["text"])) for r in known]
    linked = [(i, j) for i in range(len(known)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8 or ((bits[i] ^ bits[j]) & (2**64 - 1)).bit_count() <= 3]
    first: dict[int, int] = {}
    for r, group in zip(known, groups(len(known), linked)):
        first[group] = min(first.get(group, r["doc_id"]), r["doc_id"])
    kept = {r["doc_id"]: r["text"] for r in known if r["doc_id"] in set(first.values())}
    assert 0 < len(kept) <= len(known)

    vocabulary = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in corpus_pipeline.run(spark, DATA).collect():
        pieces[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert pieces.keys() == kept.keys()
    for doc_id, text in kept.items():
        ids, at = [*vocabulary.encode(text, add_special_tokens=False).ids, 1], 0
        for p in sorted(pieces[doc_id], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
