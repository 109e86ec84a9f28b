"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import json

import numpy as np

#: The pattern by which byte-level BPE splits a text before merging (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_by_path: dict[str, "Encoder"] = {}


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Byte strings and their ids, if this is plain byte-level BPE whose ids stand in the order of its merges."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    byte_of, specials = _byte_of(), {t["content"] for t in spec["added_tokens"]}
    order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(order, order[1:], strict=False)):
        return None
    return {bytes(byte_of[c] for c in word): i for word, i in model["vocab"].items() if word not in specials}


class Encoder:
    """ids(text): what the tokenizer's encode(text, add_special_tokens=False).ids gives, as an unsigned 32-bit array.

    Plain byte-level BPE files are merged by tiktoken, which takes their vocabulary and gives the same ids several
    times as fast; texts that hold the string of an added token, and files of other kinds, go through tokenizers.
    Null and empty texts have no ids.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.fast, self.added = Tokenizer.from_file(path), None, []
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if ranks := _ranks(spec):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.added = [t["content"] for t in spec["added_tokens"]]

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.fast and not any(a in text for a in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _by_path:
        _by_path[path] = Encoder(path)
    return _by_path[path]
