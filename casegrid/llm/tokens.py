"""Token ids of texts, with a vocabulary file that is a parameter."""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np

#: Fixed value: the pre-split of the byte-level vocabulary family.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: One encoder per worker process and vocabulary file.
_ENCODERS: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabulary files: printable ones are themselves, the rest follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Byte-level pair merging in rank order. Strings of special tokens are ordinary text.

    The vocabulary is the given tokenizer file. A fast merge core is used where the file is a plain byte-level one;
    a text that it refuses goes to the file's own library, which gives the same ids.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        alphabet = _byte_alphabet()
        ranks = {}
        for piece, rank in whole["model"]["vocab"].items():
            if all(c in alphabet for c in piece):
                ranks[bytes(alphabet[c] for c in piece)] = rank
        specials = {t["content"].encode() for t in whole.get("added_tokens", []) if t["special"]}
        ranks = {k: v for k, v in ranks.items() if k not in specials}
        self.fast = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def plain(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
        except BaseException as error:  # the merge core reports a regex limit as a panic
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.asarray(self.plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(text: bytes | None, path: str, end_id: int) -> np.ndarray:
    """The ids of a text and the end id; a null or empty text is the end id alone."""
    ids = encoder(path)(text.decode("utf-8")) if text else np.empty(0, dtype=np.uint32)
    return np.append(ids, np.uint32(end_id))


__all__ = ["Encoder", "default_vocabulary", "encoded", "encoder"]
