"""All registered queries of this subpackage."""

from scribeframe.llm import q_chat, q_near, q_repeats, q_sampling, q_search, q_texts, q_toxicity, q_urls
from scribeframe.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "q_chat", "q_near", "q_repeats", "q_sampling", "q_search", "q_texts", "q_toxicity", "q_urls"]
