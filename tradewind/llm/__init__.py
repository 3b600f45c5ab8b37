"""Operators for preparing training corpora: scoring, filtering, mixing, matching and tokenizing documents."""
