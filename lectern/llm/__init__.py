"""Operators that prepare training text: deduplication, quality, language, licences, tokens, decontamination, URLs, mixing and secrets."""
