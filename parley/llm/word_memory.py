"""Ids of whole texts by a word-level BPE tokenizer, each distinct word part being encoded once."""

from __future__ import annotations

import json
import os
import re

import numpy as np

# fixed values: what the definition of a tokenizer must say for texts to be cut the way they are cut here
NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# fixed values: letters and numbers among ASCII, Latin and general punctuation signs. None of these signs
# composes with another, and each has one lower-case letter at most (so without the dotted capital I)
_KNOWN = re.compile("[\x00-\x7f¡-įı-ſ‐-‧]*")
_LETTERS, _NUMBERS = "a-zªµºÀ-ÖØ-öø-įı-ſ", "0-9²³¹¼½¾"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^ \t-\r{_LETTERS}{_NUMBERS}]+")

_WORDS = re.compile(r"[^ \t-\r]+")

#: Parts, and characters of whole words, that are remembered.
MOST, HELD = 300_000, 20_000_000


class WordMemory:
    """Encodes texts as the tokenizers library does, without truncation, padding or added special tokens.

    A text of known signs is cut, in lower case, into the parts that the tokenizer encodes apart; the distinct
    parts of a slice go to the library together, with blanks between. Other texts, and those that may hold
    a special token, are cut at blanks; their words that have only known signs are cut further, the rest
    go to the library whole. Up to ``MOST`` parts and ``HELD`` characters of whole words are remembered. A tokenizer
    that cuts in another way is not taken.
    """

    def __init__(self, definition: str):
        # a task has one core: the library must not start threads of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        given = json.loads(definition)
        cuts = (given["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        if (
            (given["normalizer"] or {}).get("normalizers") != NORMALIZERS
            or (cuts[0].get("pattern") or {}).get("Regex") != SPLIT
            or given["model"].get("end_of_word_suffix") != "</w>"
            or given["model"].get("ignore_merges")
        ):
            raise ValueError("the tokenizer does not cut words in the known way")
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        spelled = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.final = np.array([token.endswith("</w>") for token in spelled])
        self.spelled = [token.encode("utf-8") for token in spelled]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = sorted({content[:2] for content in self.specials})
        self.parts: dict[str, bytes] = {}
        self.whole: dict[str, bytes] = {}
        self.held = 0

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit numbers."""
        cut = [self._cut((text or b"").decode("utf-8")) for text in texts]
        wanted = set().union(*[parts for parts, _ in cut])
        if len(self.parts) + len(wanted) > MOST:
            self.parts.clear()
        self._learn(wanted.difference(self.parts, *[whole for _, whole in cut]))
        known, found = self.parts, []
        for parts, whole in cut:
            if whole:
                self._learn_whole(whole)
                found.append(b"".join([self.whole[p] if p in whole else known[p] for p in parts]))
            else:
                found.append(b"".join([known[p] for p in parts]))
        return found

    def decoded(self, ids: bytes) -> bytes:
        """What the library's ``decode`` gives, special tokens included: without a decoder, tokens with blanks between."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        if self.tokenizer.decoder is None:
            return b" ".join([self.spelled[i] for i in numbers])
        return self.tokenizer.decode(numbers, skip_special_tokens=False).encode("utf-8")

    def _plain(self, text: str) -> bool:
        return not any(mark in text for mark in self.marks) and _KNOWN.fullmatch(text) is not None

    def _cut(self, text: str) -> tuple[list[str], set[str]]:
        """A text's parts in order, and which of them are words that the library has to cut."""
        if self._plain(text):
            return _PARTS.findall(text.lower()), set()
        parts, whole = [], set()
        for word in _WORDS.findall(text):
            if self._plain(word):
                parts += _PARTS.findall(word.lower())
            else:
                parts.append(word)
                whole.add(word)
        return parts, whole

    def _learn(self, new: set[str]) -> None:
        parts = list(new)
        lines = [parts[at : at + 500] for at in range(0, len(parts), 500)]
        for group in range(0, len(lines), 16):
            some = lines[group : group + 16]
            for line, found in zip(some, self._encoded([" ".join(line) for line in some])):
                ends = (np.flatnonzero(self.final[found]) + 1).tolist()
                if len(ends) != len(line):
                    raise ValueError("the tokenizer does not end every word part with a final token")
                raw = found.tobytes()
                self.parts.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(line, [0, *ends], ends))

    def _learn_whole(self, words: set[str]) -> None:
        if self.held > HELD:
            self.whole.clear()
            self.held = 0
        new = list(words - self.whole.keys())
        self.held += sum(map(len, new))
        self.whole.update((w, found.tobytes()) for w, found in zip(new, self._encoded(new)))

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4") for x in found]


def shared_memory(known: dict) -> WordMemory:
    """The memory of this worker, kept in the plain dictionary that carries the definition to it."""
    if "memory" not in known:
        known["memory"] = WordMemory(known["definition"])
    return known["memory"]
