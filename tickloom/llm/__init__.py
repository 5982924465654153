"""Training-data operators: URL filters, near-duplicates, toxicity, quality
rules, decontamination, byte-level BPE, chat formatting and four exact
deduplicators.  Nothing outside this subpackage imports it."""
