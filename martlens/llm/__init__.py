"""Operators for preparing training text: tokenising, record files, personal data,
decontamination, fingerprints, quality, language, near duplicates, URL lists and
language-model scores. Queries over them are in ``llm.queries``."""
