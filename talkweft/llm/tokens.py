"""Token ids by the tokenizers library, a word at a time.

The vocabulary's pre-tokenizer drops white space and no token spans it, so a text's ids are those of its
words in turn; a worker process remembers up to WORDS of them. A run of Latin letters, with or without
punctuation after it, is one piece and one more for the pre-tokenizer too: the library's model alone encodes
these, after lower-casing. All other words go through the whole tokenizer. Where a vocabulary treats such words
otherwise (held against PROBES when it is loaded), all do.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

WORDS = 800_000
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
PROBES = ("the", "The", "HOUSE,", "façade.", "ÉTÉ", "Straße***", "ñandú's", "x&&&", "end).", "over-all", "ab<|", "it'", "unglich!?")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Encoder:
    """The ids of words as packed unsigned 32-bit integers, and what is known of them."""

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.piece = self.tokenizer.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.known: dict[str, bytes] = {}
        self.plain = True
        expected = self._whole(list(PROBES))
        self.plain = dict(zip(PROBES, expected, strict=True)) == self.learn(list(PROBES))
        self.known = {}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.known[piece] = array("I", [t.id for t in self.piece(piece.translate(self.letters))]).tobytes()
        return found

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of ``words``; those of pieces met on the way are kept."""
        out, rest = {}, []
        for w in words:
            m = PLAIN.fullmatch(w) if self.plain and len(w) <= 64 else None
            if m:
                core, tail = m.groups()
                out[w] = self._piece(core.lower()) + self._piece(tail) if tail else self._piece(core.lower())
            else:
                rest.append(w)
        if rest:
            out.update(zip(rest, self._whole(rest), strict=True))
        return out


class WordCache:
    """Ids of words. What a worker process has learnt serves all its tasks: it is kept under a module of its own."""

    def __init__(self, vocabulary: str) -> None:
        import sys
        from types import ModuleType

        kept = sys.modules.setdefault("_talkweft_words", ModuleType("_talkweft_words")).__dict__
        if vocabulary not in kept:
            kept[vocabulary] = _Encoder(vocabulary)
        self.encoder = kept[vocabulary]

    def packed(self, text: str | None) -> bytes:
        """The ids of a text, 4 bytes each; its new words are encoded together."""
        if not text:
            return b""
        words, known = text.replace("\n", " ").split(" "), self.encoder.known
        new = list(set(words).difference(known))
        if new:
            if len(known) + len(new) > WORDS:
                known.clear()
                new = list(set(words))
            learnt = self.encoder.learn(new)
            known.update(learnt)
        out = b"".join(map(known.__getitem__, words))
        for w in new:
            if len(w) > 64:
                del known[w]
        return out


def ids_of(text: str | None, cache: WordCache) -> np.ndarray:
    return np.frombuffer(cache.packed(text), np.uint32)


def count_of(text: str | None, cache: WordCache) -> int:
    return len(cache.packed(text)) // 4
