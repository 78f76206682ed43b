"""Ids of whole texts by a public tokenizer, with the work per word done once.

Both tokenizers split a text into pieces before their merges, and no piece
reaches over a space that stands between two other characters. So the ids of a
text are those of its words in a row, and a word's ids can be remembered. Texts
with rarer white space or with the tokenizers' special strings are encoded as
a whole instead; the ids are the same either way.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than the space and the line feed.
OTHER_SPACE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LATIN = r"^[\x00-\x{ff}]*$"
#: Marks that end words; each is a piece of its own behind a letter or digit.
TAIL = ".,!?;:%&$#*|"
#: A line feed or space that doesn't stand alone between two other characters.
LOOSE = r"[ \n][ \n]|^[ \n]|[ \n]$"


def _visible_bytes() -> list[str]:
    """Characters that byte-level vocabularies write for the 256 bytes: printable
    Latin-1 stands for itself, the rest takes the code points from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in kept]
    return [chr(x) if x in kept else chr(256 + rest.index(x)) for x in range(256)]


class WordEncoder:
    """Encodes Arrow arrays of texts.

    Words' ids are kept in two generations of at most ``limit`` words each: when the younger is
    full it becomes the older, whose words are dropped unless they are met again meanwhile.
    """

    def __init__(self, path: str, keeps_space: bool, limit: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keeps_space = keeps_space
        self.limit = limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = dict(enumerate(_visible_bytes()))
        self.loose = re.compile(r" ?\S+|\s+(?!\S)|\s+")

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def piece(self, word: str) -> bytes:
        """Ids of a word without white space inside, maybe behind one space."""
        found = self.known.get(word)
        if found is not None:
            return found
        core = word.rstrip(TAIL)
        last = core[-1:]
        if last and len(core) < len(word) and last <= "\xff" and last.isalnum():
            return self.piece(core) + self.piece(word[len(core):])
        return self.learn(word)

    def learn(self, word: str) -> bytes:
        """As ``piece`` of a word that the younger generation lacks and that isn't taken apart."""
        found = self.older.get(word)
        if found is None:
            bare = word[1:] if word[:1] == " " else word
            if bare.isalpha() and (bare.isascii() or max(bare) <= "\xff") and (self.keeps_space or bare == bare.lower()):
                if bare.isascii():
                    seen = bare if len(bare) == len(word) else self.bytes[32] + bare
                else:
                    seen = "".join(map(self.bytes.__getitem__, word.encode()))
                ids = [x.id for x in self.model.tokenize(seen)]
                found = struct.pack(f"<{len(ids)}I", *ids)
            else:
                found = self.whole(word)
        if len(self.known) >= self.limit:
            self.older, self.known = self.known, {}
        self.known[word] = found
        return found

    def chunk(self, text: str) -> bytes:
        """Ids of what stands between two spaces (the first one included)."""
        if "\n" not in text:
            return self.piece(text)
        first, *rest = text.split("\n")
        feed = self.piece("\n")
        return self.piece(first) + b"".join(feed + self.piece(x) for x in rest)

    def spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each word behind a space, or behind the line feed it begins with; known words and marks
        behind known words aren't taken apart."""
        get, found, feed = self.known.get, [], self.piece("\n")
        for word in words:
            if word[:1] == "\n":
                found.append(feed + self.piece(word[1:]))
                continue
            text = " " + word
            ids = get(text)
            if ids is None:
                core = text.rstrip(TAIL)
                if len(core) == len(text):
                    ids = self.learn(text)
                elif core[-1] <= "\xff" and core[-1].isalnum():
                    ids, marks = get(core), text[len(core):]
                    ids = (self.learn(core) if ids is None else ids) + (get(marks) or self.piece(marks))
                else:
                    ids = self.chunk(text)
            found.append(ids)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin (one more at the end)."""
        texts = texts.fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, OTHER_SPACE), pc.match_substring(texts, "<|"))
        if self.keeps_space:
            loose = pc.and_not(pc.match_substring_regex(texts, LOOSE), odd)
        else:
            loose = pc.and_not(pc.invert(pc.match_substring_regex(texts, LATIN)), odd)
        plain = np.asarray(pc.invert(pc.or_(odd, loose)))
        loose = np.asarray(loose)
        parts: list[np.ndarray | None] = [None] * len(texts)
        self._plain(texts.filter(pa.array(plain)), np.flatnonzero(plain), parts)
        for i in np.flatnonzero(~plain):
            text = texts[int(i)].as_py()
            if loose[i] and self.keeps_space:
                ids = b"".join(map(self.piece, self.loose.findall(text)))
            elif loose[i]:
                ids = b"".join(map(self.piece, text.split()))
            else:
                ids = self.whole(text)
            parts[i] = np.frombuffer(ids, dtype="<u4")
        starts = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in parts], out=starts[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), starts

    def _plain(self, texts: pa.Array, places: np.ndarray, parts: list) -> None:
        """All words of many texts at once: each different word is looked up once."""
        if not len(texts):
            return
        if self.keeps_space:
            # a line feed stands between two words here, and stays with the second
            words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        else:
            words = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        ends = np.asarray(words.offsets).astype(np.int64)
        ends = ends - ends[0]
        coded = words.flatten().dictionary_encode()
        which = np.asarray(coded.indices)
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.keeps_space:
            # the first word of a text has no space before it
            n = len(different)
            heads = ends[:-1]
            firsts, back = np.unique(which[heads], return_inverse=True)
            which = which.copy()
            which[heads] = n + back
            found = self.spaced(different) + [self.piece(different[k]) if different[k] else b"" for k in firsts]
        else:
            found = [self.piece(x) if x else b"" for x in different]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        begin = np.cumsum(sizes) - sizes
        each = sizes[which]
        upto = np.zeros(len(each) + 1, dtype=np.int64)
        np.cumsum(each, out=upto[1:])
        # places are half as wide where they can be
        width = np.int32 if max(upto[-1], len(flat)) < 1 << 31 else np.int64
        ids = flat[np.arange(upto[-1], dtype=width) + np.repeat((begin[which] - upto[:-1]).astype(width), each)]
        bounds = upto[ends]
        for k, place in enumerate(places):
            parts[place] = ids[bounds[k]:bounds[k + 1]]


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """One encoder per worker process, so that its words stay known."""
    key = (path, keeps_space)
    if key not in _encoders:
        # lower-cased words are fewer
        _encoders[key] = WordEncoder(path, keeps_space, 400_000 if keeps_space else 200_000)
    return _encoders[key]
