"""Ids of whole texts, those of ``tokenizers``, at the price of a merge table.

``tokenizers`` defines the ids: a text is cut into words and byte pairs are merged inside each in the order
of the file's merges. Merging always the pair whose union has the lowest id gives the same for a file in which a
merge's number gives its token's id and each token, encoded by itself, stays one: a pair of neighbours with
a known union cannot arise but by that token's own last merge, else the token would not encode to
itself. ``tiktoken`` merges that way, several times faster, so it takes the texts on whose words both
libraries agree for certain: Latin letters, digits, signs and white space of ASCII, no special string. All others,
and texts with very long words, which take it quadratic time, go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property

#: Fixed value: how byte-level tokenizers of this kind cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The longest run without, and with nothing but, white space that is merged pair by pair.
RUN = 999
_BLACK, _WHITE = "[!-~¡-ɏ]", "[\t-\r ]"
_PLAIN = re.compile(f"{_BLACK}{{0,{RUN}}}+(?:{_WHITE}{{1,{RUN}}}+{_BLACK}{{1,{RUN}}}+)*+{_WHITE}{{0,{RUN}}}+")
_ENCODERS: dict[str, Encoder] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself where it can be printed, else one from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printed)]
    return {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes whole texts with the tokenizer of a JSON file, without added special tokens, truncation or padding."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as file:
            self.settings = json.load(file)
        before = self.settings.get("pre_tokenizer") or {}
        added = self.settings.get("added_tokens") or []
        self.special = [t["content"] for t in added]
        #: Byte level, and nothing that looks left of a word: neither normalizer, prefix nor greedy special strings.
        self.byte_level = (
            self.settings.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and bool(before.get("use_regex"))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        )

    @cached_property
    def whole(self):
        """The tokenizer itself, in one thread."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    @cached_property
    def merging(self):
        """The same vocabulary as merge ranks, or None where the file's ids are not the order of its merges."""
        model = self.settings["model"]
        vocab, merges = model.get("vocab") or {}, model.get("merges") or []
        plain = self.byte_level and model.get("type") == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        letters = _byte_letters()
        known = {t: i for t, i in vocab.items() if t not in self.special}
        if not plain or len(known) != 256 + len(merges) or any(set(t) - letters.keys() for t in known):
            return None
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        if any(known.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in token): i for token, i in known.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def ids(self, texts: list[str]) -> list[list[int]]:
        plain = [self.merging is not None and self._is_plain(t) for t in texts]
        rest = [t for t, p in zip(texts, plain, strict=True) if not p]
        others = iter(self.whole.encode_batch_fast(rest, add_special_tokens=False)) if rest else iter(())
        return [self.merging.encode_ordinary(t) if p else next(others).ids for t, p in zip(texts, plain, strict=True)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        return [_little_endian(i) for i in self.ids(texts)]


def _little_endian(ids: list[int]) -> bytes:
    found = array("I", ids)
    if memoryview(array("I", [1])).tobytes()[0] != 1:
        found.byteswap()
    return found.tobytes()


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
