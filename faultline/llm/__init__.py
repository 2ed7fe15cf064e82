"""Training-data pipeline operators: search, de-duplication, licence and
benchmark scans, extraction, scoring, language identification and mixing."""
