"""Readers for audio listings, reference files, timed transcripts and corpora; writers."""
