"""Training-data operators: decontamination, toxicity, language-model scoring, chat
formatting, near and exact dedup, mixing, sharding, quality and sanitisation.

Nothing outside this subpackage imports it.
"""
