"""Schemas of the engine's tables."""

#: What an index holds: chunks with their terms, embedding and its norm, and the version of their document, if it has one.
INDEX = "chunk_id string, doc_id string, position int, text string, length int, terms array<string>, embedding array<double>, norm double, version bigint"
