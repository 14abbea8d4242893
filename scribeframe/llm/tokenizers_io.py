"""Tokenizer files on the workers: loaded once per Python process, split at safe places."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

#: An ASCII space after a visible ASCII character.
_BEFORE_SPACE = re.compile(r"(?<=[!-~]) ")


def vocabulary_path(name: str) -> str:
    """``name`` itself if it is a path, else the installed vocabulary file of that name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def json_tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


@lru_cache(maxsize=4)
def rank_encoding(name: str, special: tuple[tuple[str, int], ...]):
    """The encoder of a rank file; ``special`` strings inside texts get their ids."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special)
    )


def cut_before_spaces(text: str, size: int) -> Iterator[str]:
    """Cut a long text just before spaces that follow a visible ASCII character.

    Pieces have about ``size`` characters; a longer stretch without such a
    space stays whole.
    """
    start = 0
    while len(text) - start > size:
        found = _BEFORE_SPACE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]
