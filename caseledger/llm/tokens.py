"""Token ids of whole texts by a public byte-level vocabulary."""

import base64
import os
import re
from functools import lru_cache

VOCABULARY = "byte_bpe_50k"
#: Texts with other characters, long gaps or marks of special tokens go through the reference
#: tokenizer itself; for the rest the faster library gives the same ids.
_UNUSUAL = re.compile("[^\\n\\x20-\\x7e¡-ɏ‐-‧]|\\s{200}|<\\|")


def vocabulary_path(name: str) -> str:
    """Where a vocabulary file is: a path as it is given, or a file of the public collection."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _slow(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """Ids of a whole text. Vocabularies other than the default exist for the faster library only."""
    if vocabulary == VOCABULARY and _UNUSUAL.search(text):
        return _slow(vocabulary_path(f"{vocabulary}.json")).encode(text, add_special_tokens=False).ids
    return _fast(vocabulary_path(f"{vocabulary}.tiktoken")).encode_ordinary(text)
