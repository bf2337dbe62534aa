"""Encoding texts with a public tokenizer file, through a cache of the pieces that the tokenizer would cut anyway.

The tokenizers library spends most of its time on pieces it has merged before. A byte-level BPE never merges across a
space that starts a run of white space, so a text is the concatenation of its chunks (a space and what follows up to
the next one), and each distinct chunk is encoded by the library once per worker and remembered.
"""

from __future__ import annotations

import functools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space behind other white space belongs to that run, whose pieces depend on what follows: such texts are encoded whole.
RUN = r"\s "
#: What keeps a chunk from being cut at its line ends.
SPACES = re.compile(r"[^\S\n ]|\n\n| \n")
LATIN = re.compile(r"[A-Za-zªµºÀ-ÖØ-öø-ɏ]+")
LETTERS = re.compile(rf"( ?{LATIN.pattern})([!-/:-@\[-`{{-~]*)")
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """encode(texts) gives all ids in one array and where each text's ids begin. Ids equal those of the library on whole texts."""

    def __init__(self, path: str, special_as_text: bool = True, cached: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        self.map = byte_alphabet()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [] if special_as_text else special
        self.line_end = self._whole("\n")
        self.cached, self.young, self.old, self.tails = cached, {}, {}, {}
        self.bytewise = "ByteLevel" in type(self.tokenizer.pre_tokenizer).__name__ and self.tokenizer.normalizer is None

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """One piece of the pre-tokenizer, given in its byte alphabet."""
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _made(self, chunk: str) -> bytes:
        """The ids of a chunk; it may begin with a space."""
        if m := LETTERS.fullmatch(chunk):
            letters, signs = m.groups()
            if letters[0] == " ":
                return self._spaced([letters[1:]])[0] + (self._piece(signs) if signs else b"")
            return self._piece(letters.encode().decode("latin1").translate(self.map)) + (self._piece(signs) if signs else b"")
        if "\n" in chunk and not SPACES.search(chunk):  # lone line ends are pieces of their own
            return self.line_end.join(self._made(part) if part else b"" for part in chunk.split("\n"))
        return self._whole(chunk)

    def _spaced(self, words: list[str]) -> list[bytes]:
        """The ids of each chunk that is a space and one of these strings; these are remembered."""
        young, old, tails = self.young, self.old, self.tails
        found = list(map(young.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = old.get(word)
                if ids is None:
                    # letters are a piece, the signs behind them are another
                    stem = word.rstrip(SIGNS)
                    if not stem.isalpha() or not (stem.isascii() or LATIN.fullmatch(stem)):
                        ids = self._made(f" {word}")
                    elif len(stem) == len(word):
                        ids = self._letters(word)
                    else:
                        ids = young.get(stem) or old.get(stem)
                        if ids is None:
                            ids = young[stem] = self._letters(stem)
                        signs = word[len(stem) :]
                        if signs not in tails:
                            if len(tails) > 10_000:
                                tails.clear()
                            tails[signs] = self._piece(signs)
                        ids += tails[signs]
                found[i] = young[word] = ids
        if len(self.young) > self.cached:  # what wasn't used since the last turn goes
            self.old, self.young = self.young, {}
        return found

    def _letters(self, word: str) -> bytes:
        """The ids of a space and letters."""
        return array("I", [t.id for t in self.model.tokenize("Ġ" + (word if word.isascii() else word.encode().decode("latin1").translate(self.map)))]).tobytes()

    def _cut(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all distinct chunks, their sizes, which chunks the texts consist of, and where each text's begin."""
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, RUN).to_numpy(zero_copy_only=False) | (not self.bytewise)
        odd |= np.array([not o and not t.isascii() and bool(re.search(RUN, t)) for t, o in zip(texts, odd, strict=True)], bool)
        if self.special:
            odd |= np.array([any(s in t for s in self.special) for t in texts], bool)
        lists = pc.split_pattern(pa.array(["" if o else t for t, o in zip(texts, odd, strict=True)], pa.large_string()), " ")
        starts = lists.offsets.to_numpy()
        codes = lists.values.dictionary_encode()
        index = codes.indices.to_numpy().copy()
        found = self._spaced(codes.dictionary.to_pylist())
        # a text's first chunk has no space in front; a text that isn't cut is encoded whole: both get codes of their own
        n = len(found)
        found += [self._whole(t) if o else self._made(c) if (c := t.split(" ", 1)[0]) else b"" for t, o in zip(texts, odd, strict=True)]
        index[starts[:-1]] = n + np.arange(len(texts))
        return found, np.fromiter(map(len, found), np.int32, len(found)) // np.int32(4), index, starts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, sizes, index, starts = self._cut(texts)
        flat = np.frombuffer(b"".join(found), np.uint32)
        begin = np.cumsum(sizes, dtype=np.int32) - sizes
        each = sizes[index]
        ends = np.cumsum(each, dtype=np.int32)  # a call's texts are far shorter than 2 ** 31
        at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat(begin[index] - ends + each, each)
        return flat[at], np.concatenate([[0], ends])[starts].astype(np.int64)

    def lengths(self, texts: list[str]) -> np.ndarray:
        """How many ids each text has."""
        _, sizes, index, starts = self._cut(texts)
        return np.diff(np.concatenate([[0], np.cumsum(sizes[index], dtype=np.int64)])[starts])


@functools.lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = True, cached: int = 400_000) -> PieceEncoder:
    """One for each worker process and file."""
    return PieceEncoder(path, special_as_text, cached)
