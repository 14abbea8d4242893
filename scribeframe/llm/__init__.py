"""Operators for building training corpora from documents, chats and vectors."""
