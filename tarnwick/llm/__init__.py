"""Training-data operators: token counts, language ID, near-duplicate joins, WARC bundles, fingerprints,
embedding near-dedup, toxicity, BPE coding, quality and source mixing.  Nothing outside this subpackage imports it."""
