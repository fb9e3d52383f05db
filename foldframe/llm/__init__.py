"""Operators for preparing training text: deduplication, decontamination, extraction, classification and tokenization."""
