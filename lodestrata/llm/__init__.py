"""Training-data operators: packing, near-dedup, token files, search, chat, toxicity, quality, BPE, language, HTML."""
