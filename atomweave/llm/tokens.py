"""Token ids of a public byte-level vocabulary, with the ids of words seen before kept at hand."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

#: White space as the vocabularies' own pattern has it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Words remembered by a worker: some 100 MB. Then it starts afresh.
REMEMBERED = 500_000
SPECIAL = "<|endoftext|>"


class Tokens:
    """Encoder for ``<name>.json`` of the tokenizers library, through the same vocabulary's rank file beside it.

    The vocabulary's pattern never joins what stands before a space and after it, unless the space ends a run of white
    space or is followed by some; so texts can be cut before each space that a non-space follows.
    """

    _made: dict[str, Tokens] = {}
    _run = re.compile(" (?:[" + SPACE + r"]|\Z)")
    _cut = re.compile(" (?=[^" + SPACE + "])")

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self._whole = path, None  # the library's own encoder is loaded when a text needs it
        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.words: dict[str, bytes] = {}  # a word with the space before it

    @classmethod
    def of(cls, path: str) -> Tokens:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _learn(self, words: list[str]) -> None:
        """Encode new words, laid end to end, and find where each one's ids end by the tokens' sizes in bytes."""
        ids = np.array(self.encoder.encode_ordinary(" " + " ".join(words)), "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        blob, begin = ids.tobytes(), 0
        for word, stop in zip(words, stops.tolist()):
            self.words[word] = blob[4 * begin : 4 * stop]
            begin = stop

    def _whole_text(self, text: str) -> bytes:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.words) > REMEMBERED:
            self.words = {}
        heads, parts = [], []
        for text in texts:
            first, *rest = self._cut.split(text) if self._run.search(text) else text.split(" ")
            heads.append(first)
            parts.append(rest)
        if new := set().union(*parts).difference(self.words):
            self._learn(list(new))
        word, head, out = self.words.__getitem__, self.encoder.encode_ordinary, []
        for text, first, rest in zip(texts, heads, parts):
            if SPECIAL in text:
                out.append(self._whole_text(text))
            else:
                out.append((np.array(head(first), "<u4").tobytes() if first else b"") + b"".join(map(word, rest)))
        return out
