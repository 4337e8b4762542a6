"""Whole texts to token ids with a public tokenizer file, one distinct piece at a time.

A text is cut at its spaces and each distinct piece is encoded once per worker, then remembered;
both memories are bounded. Cutting at a space changes nothing for a tokenizer that drops white
space. A byte-level one keeps runs of white space together, so there a text in which a space
touches other white space is encoded whole.

A text that holds the string of a special token is encoded whole: the library gives that string the
token's id, as in a plain call without added tokens.

Most pieces are letters followed by marks, on one line or two. Both tokenizers encode the parts on
their own, so these go straight to the library's BPE model; every other piece takes the library's full path.
"""

from __future__ import annotations

import os
import re

import numpy as np

PIECES = 600_000
WORDS = 900_000
BATCH = 128
END_ID = 0

# letters whose case and composition need no context, then ASCII marks but the apostrophe, which
# starts pieces of its own
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
PLAIN = re.compile(f"([{LETTERS}]+)([{MARKS}]*)(?:\n([{LETTERS}]+)([{MARKS}]*))?")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: a printable byte is itself, the others follow from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


SPELLING = _byte_letters() | {10: "\n"}


class TextEncoder:
    """Encodes texts to little-endian ids, two bytes wide where the vocabulary allows it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the library finds these anywhere in a text, so a text that holds one is encoded whole
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # the same model over words that are spelt in its alphabet already, one a line
        self.by_line = Tokenizer(self.tokenizer.model)
        self.by_line.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.end = END_ID.to_bytes(self.width, "little")
        self.keeps_spaces = self._whole(" a") != self._whole("a")
        self.line_end = self._whole("\n")
        self.lowers = self._whole("A") == self._whole("a")
        if self.lowers:
            self.added = [t.lower() for t in self.added]
        self.pieces: dict[str, bytes | None] = {}
        self.words: dict[str, bytes] = {}

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _whole(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn_words(self, words: list[str]) -> None:
        """Remember the ids of runs of letters or of marks."""
        width, known = self.width, self.words
        for i in range(0, len(words), 500):
            chosen = words[i : i + 500]
            spelt = "\n".join(chosen).encode().decode("latin-1").translate(SPELLING)
            found = self.by_line.encode(spelt, add_special_tokens=False)
            ids = self._pack(found.ids)
            firsts = np.flatnonzero(np.diff(found.word_ids, prepend=-1)) * width
            ends = [*firsts[1:].tolist(), len(ids)]
            for word, low, high in zip(chosen, firsts.tolist(), ends):
                known[word] = ids[low:high]

    def _learn(self, missing: set[str]) -> None:
        """Remember the ids of pieces; None marks one that cannot stand alone."""
        space = " " if self.keeps_spaces else ""
        lowers, plain, split, single = self.lowers, PLAIN.fullmatch, [], []
        parts: set[str] = set()
        for p in missing:
            if p.isalpha() and p.isascii():
                single.append(p)
                continue
            found = plain(p)
            if found:
                own = found.groups("")
                letters, marks, below, rest = [x.lower() for x in own] if lowers else own
                split.append((p, space + letters, marks, below, rest))
                parts.update((space + letters, marks, below, rest))
            elif space and (not p or p[0].isspace() or p[-1].isspace()):
                self.pieces[p] = None
            else:
                self.pieces[p] = self._whole(space + p)
        words, pieces = self.words, self.pieces
        spelt = [p.lower() for p in single] if lowers else [space + p for p in single]
        parts.update(spelt)
        words[""] = b""
        self._learn_words([w for w in parts if w not in words])
        pieces.update(zip(single, map(words.__getitem__, spelt)))
        for p, letters, marks, below, rest in split:
            ids = words[letters] + words[marks]
            pieces[p] = ids + self.line_end + words[below] + words[rest] if below else ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: empty) and then the end id, as packed bytes."""
        out: list[bytes] = []
        for i in range(0, len(texts), BATCH):
            for memory, most in ((self.pieces, PIECES), (self.words, WORDS)):
                if len(memory) > most:
                    memory.clear()
            cut = [[] if self._holds_added(t) else (t or "").split(" ") for t in texts[i : i + BATCH]]
            used = set().union(*(parts[self.keeps_spaces :] for parts in cut))
            self._learn(used.difference(self.pieces))
            for text, parts in zip(texts[i : i + BATCH], cut):
                out.append((self._joined(text or "", parts) if parts else self._whole(text)) + self.end)
        return out

    def _holds_added(self, text: str | None) -> bool:
        if not text:
            return False
        text = text.lower() if self.lowers else text
        return any(t in text for t in self.added)

    def _joined(self, text: str, parts: list[str]) -> bytes:
        head = b""
        if self.keeps_spaces:
            # the first piece has no space before it; a leading space leaves it empty
            first = parts.pop(0)
            if first[-1:].isspace():
                return self._whole(text)
            head = self._whole(first) if first else b""
        try:
            return head + b"".join(map(self.pieces.__getitem__, parts))
        except TypeError:
            return self._whole(text)


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
