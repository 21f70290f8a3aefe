"""Ids by a tokenizer file of the tokenizers library, each distinct run of a text encoded once.

A byte-level tokenizer with the usual pattern never merges across runs (white space with the word after it), nor from a
letter to a sign after it, so a text's ids are those of such pieces, one after the other. A blank behind something
else than white space starts a piece, so texts are first split at blanks, and what is new between them into pieces. Files of
any other kind encode whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

from tablewright.llm.byte_bpe import SPACE

#: Western letters up to an ASCII sign or the end; else runs.
PIECES = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\\x00-@\\[-`{{-\\x7f]|\\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: White space, which no blank that starts a piece may follow.
WHITE = re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001))))
#: An English word with the blank before it, which the pattern takes whole and whose bytes a byte-level vocabulary writes as they are.
WORD = re.compile(" ?[A-Za-z]+")
#: Pieces, and parts between blanks, that are kept with their ids.
CACHE = 400_000


@lru_cache(2)
def shared_encoder(path: str) -> RunEncoder:
    """The encoder of a worker process, which outlives its tasks; what it keeps is bounded and holds words only."""
    return RunEncoder(path)


class RunEncoder:
    """A tokenizer file and the ids of the runs met so far; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        before = form.get("pre_tokenizer") or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.by_runs = bool(byte_level and not form.get("normalizer"))
        self.size = self.tokenizer.get_vocab_size()
        self.known: dict[str, bytes] = {}
        self.blank: dict[str, bytes] = {}  # ids of a blank and a part

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words as ``WORD`` has them: the library's model alone, which spares the search for the words."""
        cut = self.tokenizer.model.tokenize
        return [array("I", [token.id for token in cut(word.replace(" ", "\u0120"))]).tobytes() for word in words]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_runs:
            return self._library(texts)
        if len(self.blank) > CACHE:
            self.blank.clear()
        blank, double = self.blank, [white + " " for white in WHITE]
        split = [[text] if text.startswith(" ") or any(white in text for white in double) else text.split(" ") for text in texts]
        if new := list({part for parts in split for part in parts[1:] if part not in blank}):
            words = [part for part in new if part.isascii() and part.isalpha()]
            other = [part for part in new if not (part.isascii() and part.isalpha())]
            blank.update(zip(words, self._words([" " + part for part in words])))
            blank.update(zip(other, self._pieces([" " + part for part in other])))
        heads = self._pieces([parts[0] for parts in split])
        return [b"".join([head, *[blank[part] for part in parts[1:]]]) for head, parts in zip(heads, split)]

    def _pieces(self, texts: list[str]) -> list[bytes]:
        found = [PIECES.findall(text) for text in texts]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        if new := list({run for runs in found for run in runs if run not in known}):
            words = [run for run in new if WORD.fullmatch(run)]
            other = [run for run in new if not WORD.fullmatch(run)]
            known.update(zip(words, self._words(words)))
            known.update(zip(other, self._library(other)))
        return [b"".join([known[run] for run in runs]) for runs in found]

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id of a byte-level vocabulary."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        names = {i: name for name, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        out = []
        for i in range(max(names, default=-1) + 1):
            name = names.get(i, "")
            out.append(bytes(letter[c] for c in name) if all(c in letter for c in name) else name.encode())
        return out
