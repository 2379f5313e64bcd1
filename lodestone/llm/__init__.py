"""Training-data operators: fingerprints, secrets, packing, chat, tokens, mixing, rules, PII, toxicity, near-copies."""
