"""Operators for building training corpora: chat formatting, decontamination,
near-duplicate removal, licence scans, tokenising, coding, personal data,
toxicity, vector search and language identification."""
