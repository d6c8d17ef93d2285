"""Registers queries with the SQL that gives the same rows."""

from __future__ import annotations


def register(table: dict):
    def query(sql: str | None = None):
        def add(f):
            table[f.__name__] = (f, sql)
            return f

        return add

    return query


# parts of SQL that several queries share
WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
TOKENS = f"list_concat({WORDS}, list_transform({WORDS}, lambda w: strip_accents(w)))"
PARAGRAPHS = f"p AS (SELECT doc_id AS id, 'corpus/' || lang || '/' || source AS source, text AS content, lang, length(text) AS n, {TOKENS} AS keywords FROM documents)"
PLAIN = "p AS (SELECT doc_id AS id, 'corpus/' || lang || '/' || source AS source, text AS content, lang, length(text) AS n FROM documents)"
LOW = f"p AS (SELECT doc_id AS id, lang, {WORDS} AS tokens FROM documents)"
BRIDGE = "b AS (SELECT DISTINCT unnest([lang, lang || '--' || source]) AS dataset, 'corpus/' || lang || '/' || source AS file_id FROM documents)"
