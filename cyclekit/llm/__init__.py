"""Training-data operators: URL filters, WARC, tool-call linking, decontamination,
near-duplicate joins, quality rules, sharding, language ID, secret scans, byte BPE, main text
of pages, lexical search, hard negatives.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only
when it can be imported."""
