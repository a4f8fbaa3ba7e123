"""The subpackage's queries and their SQL, by name."""

from stemloom.llm import queries_conversations, queries_decontamination, queries_fill_middle, queries_html, queries_language, queries_minhash, queries_packing, queries_quality, queries_secrets, queries_suffix, queries_token_files, queries_toxicity, queries_weak_labels

MODULES = (queries_toxicity, queries_minhash, queries_packing, queries_html, queries_weak_labels, queries_secrets, queries_quality, queries_decontamination, queries_language, queries_suffix, queries_fill_middle, queries_conversations, queries_token_files)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
