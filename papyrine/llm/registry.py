"""All queries of the subpackage, by name."""

from papyrine.llm import q_language, q_markup, q_scans, q_sentences, q_spam, q_tokens

MODULES = [q_language, q_markup, q_scans, q_sentences, q_spam, q_tokens]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
