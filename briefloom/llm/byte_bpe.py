"""Token ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit numbers.

A vocabulary whose ids follow the order of its merges is encoded by rank; any other file of this format is left to the
library that wrote it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

#: The pattern by which byte-level files cut words (fixed value of the format).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODERS: dict[str, Callable[[str], bytes]] = {}


def _byte_names() -> dict[str, int]:
    """The character that stands for each byte in such files: itself if it is visible, else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str) -> Callable[[str], bytes]:
    """The encoder of a vocabulary file, equal to the library without added special tokens; loaded once per worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = _load(path)
    return _ENCODERS[path]


def _load(path: str) -> Callable[[str], bytes]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cutter, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    special = {t["content"]: t["id"] for t in added}
    vocabulary = {token: i for token, i in model.get("vocab", {}).items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    merged = [vocabulary.get("".join(m), -1) for m in merges]
    by_rank = (
        model.get("type") == "BPE" and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        and spec.get("normalizer") is None and merged == sorted(set(merged)) and len(merged) == len(vocabulary) - 256
        and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if by_rank:
        import tiktoken

        names = _byte_names()
        ranks = {bytes(names[c] for c in token): i for token, i in vocabulary.items()}
        ranked = tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: np.asarray(ranked.encode(text, allowed_special="all"), "<u4").tobytes()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda text: np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
