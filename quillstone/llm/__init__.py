"""Training-data operators: dedup, fingerprints, media, tokens, packing, scans.

Every operator takes a DataFrame and column names and returns a DataFrame.
Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
