"""DataFrame operators: matching, curation, sampling, scoring, comparison, batches, hooks."""
