"""Byte-level BPE vocabulary files (tokenizers JSON): pre-tokens, merge table, byte strings."""

from __future__ import annotations

import functools
import json

import numpy as np
import regex

#: The pre-token pattern of the byte-level vocabulary, with its special token cut out first. Fixed values.
SPECIAL = "<|endoftext|>"
PRETOKEN = (
    r"<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?(?:[^\s\p{L}\p{N}<]|<(?!\|endoftext\|>))+"
    r"|\s+(?=<\|endoftext\|>)|\s+(?!\S)|\s+"
)
#: Characters after a pre-token that can decide where it ends, at most.
CONTEXT = len(SPECIAL) + 2


@functools.lru_cache(maxsize=1)
def pretokens() -> regex.Pattern:
    return regex.compile(PRETOKEN)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Printable Latin-1 bytes stand for themselves; the others follow from U+0100."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> dict:
    """bytes -> id, ordered merges as (left id, right id, merged id), special id, bytes of every id."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    byte = _byte_of_char()
    as_bytes = lambda s: bytes(byte[c] for c in s)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ids = {as_bytes(s): i for s, i in model["model"]["vocab"].items() if s not in special}
    merges = []
    for m in model["model"]["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        a, b = as_bytes(a), as_bytes(b)
        merges.append((ids[a], ids[b], ids[a + b]))
    text = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for s, i in ids.items():
        text[i] = s
    for s, i in special.items():
        text[i] = s.encode()
    return {"ids": ids, "merges": np.array(merges, np.int64).reshape(-1, 3), "special": special, "text": text}


@functools.lru_cache(maxsize=2)
def library_encoder(path: str):
    """The same vocabulary in tiktoken, whose ids equal those of tokenizers (asserted in the tests)."""
    import tiktoken

    v = vocabulary(path)
    return tiktoken.Encoding("vocabulary", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=v["ids"], special_tokens=v["special"])
