"""Token ids of the public byte-level BPE vocabulary, computed in Python workers.

``tiktoken`` gives the ids of the vocabulary's rank file several times faster than ``tokenizers`` gives them from the
JSON file; the tests hold both to the same ids.  As in the JSON file, the end-of-text string is one id.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

END_OF_TEXT = "<|endoftext|>"


def public(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def encoder(ranks_path: str, special: bool = True):
    """A function from a text to its ids (uint32); special: the end-of-text string is one id, else ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    end = len(ranks)
    made = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: end})

    def ids(text: str) -> np.ndarray:
        if special and END_OF_TEXT in text:
            return np.array(made.encode(text, allowed_special="all"), np.uint32)
        return made.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)

    return ids
