"""The queries of this subpackage, one or more for each operator."""

from tallyloom.llm import byte_bpe, embeddings, language_id, line_dedup, lm_score, packing, quality, simhash, sketches, spelling, token_files, url_filter, whitening

MODULES = (quality, lm_score, url_filter, sketches, packing, embeddings, language_id, simhash, byte_bpe, token_files, line_dedup, whitening, spelling)
QUERIES = {name: run for m in MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
