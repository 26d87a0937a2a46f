"""Operators for building training data: near-duplicates, language-model scores, mixing, decontamination, licences,
media columns, toxicity, secrets, chat formatting and quality. Nothing else in the library imports this subpackage."""
