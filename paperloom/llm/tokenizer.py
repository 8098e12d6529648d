"""A tiktoken encoding from a rank file whose path is a parameter."""

from __future__ import annotations

import base64
from pathlib import Path

import tiktoken

#: Where the public vocabularies lie on this machine; callers may name another file.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MAX_BYTES = 64 << 20
#: Fixed value: the split pattern that belongs to these rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The rank file, read on the driver; its size is checked, so it may be broadcast."""
    content = Path(path).read_bytes()
    if len(content) > MAX_BYTES:
        raise ValueError(f"{path} has more than {MAX_BYTES} bytes")
    return content


def encoding(content: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
