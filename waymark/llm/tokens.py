"""Token ids of texts by a public tokenizer's file."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from .common import kept

#: Blanks on which Python splits and the tokenizers' patterns do not.
ODD_BLANKS = re.compile("[\x1c-\x1f]")

#: Punctuation that ends a word; the pattern makes it a token apart from letters before it.
TAIL = ".,;:!?|"

#: The normaliser and the pre-tokenizer, as their file spells them, for which word by word is the same as whole.
#: Both treat each run of non-blanks by itself: blanks only part, case and composition don't cross them, and no piece holds one.
BY_WORD_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
BY_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
BY_WORD_PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": BY_WORD_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

#: Words that an encoder holds, about 200 bytes each, twice over at most.
HELD = 1 << 19

#: Places in which words that came once are marked.
SLOTS = 1 << 22

#: Byte-level models spell a byte as a character: printable ones stand for themselves.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPELLED = {b: chr(b) for b in PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}


def by_word(spec: str) -> bool:
    """Whether the tokenizer of this JSON text gives a text's ids word by word; else texts are encoded whole."""
    own = json.loads(spec)
    tokens = [t["content"] for t in own.get("added_tokens") or []]
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in own.get("added_tokens") or [])
    plain = plain and all(t and not re.search(r"\s", t) for t in tokens) and not own.get("post_processor") and not own.get("truncation") and not own.get("padding")
    return plain and own["model"]["type"] == "BPE" and not own["model"].get("dropout") and own.get("normalizer") == BY_WORD_NORMALISER and own.get("pre_tokenizer") == BY_WORD_PIECES


class Encoder(dict):
    """ids of whole texts, word by word: a cache from each run of non-blanks to its ids' bytes.

    Only for tokenizers that by_word() knows to allow it; by any other, and with
    words=False, texts are encoded whole. Words of letters up to U+00FF go straight to the model if it spells
    them as encode does. At most limit words that came twice are held, and those
    of one full cache before.
    """

    def __init__(self, path: str, eos: int | None, words: bool = True, limit: int = HELD) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model
        self.end = np.array([] if eos is None else [eos], "<u4").tobytes()
        self.words, self.limit, self.old = words and by_word(tokenizer.to_str()), limit, {}
        self.seen, self.marked = bytearray(SLOTS), 0
        self.letters = {i: "".join(SPELLED[b] for b in chr(i).encode()) for i in range(256) if chr(i).isalpha()}
        trial = ["the", "unlikelihood", "\u00e9t\u00e9", "stra\u00dfe", "\u00aa\u00b5\u00ba", "zzqxv\u00ff"]
        self.straight = all(self.spelled(w) == list(self.encode(w, add_special_tokens=False).ids) for w in trial)

    def spelled(self, word: str) -> list[int]:
        return [x.id for x in self.model.tokenize(word if word.isascii() else word.translate(self.letters))]

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            # up to U+00FF letters stay single letters when composed and lower-cased
            narrow = word.isascii() or max(word) < "\u0100"
            if narrow and self.straight and word.isalpha() and word.islower():
                ids = array("I", self.spelled(word)).tobytes()
            else:
                plain = word.lower() if narrow else word
                core = plain.rstrip(TAIL) if narrow else plain
                if core != plain and core.isalpha():
                    ids = self[core] + self[plain[len(core) :]]
                elif plain != word:
                    ids = self[plain]
                else:
                    ids = array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
            # most words of a long tail come once: they are held from the second time on
            slot = hash(word) & (SLOTS - 1)
            if not self.seen[slot]:
                self.seen[slot] = 1
                self.marked += 1
                if self.marked > SLOTS // 2:
                    self.seen, self.marked = bytearray(SLOTS), 0
                return ids
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids, with the end id."""
        text = text or ""
        if not self.words or ODD_BLANKS.search(text):
            return array("I", self.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        return b"".join(map(self.__getitem__, text.split())) + self.end


def documents(batches, tokenizer: str, eos: int | None, words: bool, held: int) -> Iterator[tuple[object, bytes]]:
    """(id, ids) of each row, by an encoder that holds so many words. Columns: id, text."""
    encoder = kept(("encoder", tokenizer, eos, words, held), lambda: Encoder(tokenizer, eos, words, held))
    for batch in batches:
        texts = batch.column("text")
        for i, name in enumerate(batch.column("id").to_pylist()):
            yield name, encoder.ids(texts[i].as_py())
