"""Places of public vocabulary files, read in the tasks that use them."""

from __future__ import annotations

import os

CACHE_LIMIT = 1_000_000


def vocabulary_path(name: str) -> str:
    """The file of this name in FAHRWERK_TOKENIZERS, or in the installed ``public_tokenizers``."""
    folder = os.environ.get("FAHRWERK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class Bounded(dict):
    """A dict that starts anew when it is full, so that its memory is bounded."""

    def __init__(self, limit: int = CACHE_LIMIT):
        super().__init__()
        self.limit = limit

    def put(self, key, value):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value
        return value
