"""Query of the URL filter."""

from __future__ import annotations

from scribeframe.llm.registry import query, table
from scribeframe.llm.url_filter import Rule, judge_urls

#: The rules of the task.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


@query("op8_url_filter")
def url_filter(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), RULES)
