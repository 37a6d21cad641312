"""Token ids of whole texts by the tokenizers library, with a bounded memory of the pieces seen so far.

A byte-level BPE vocabulary splits a text into words: letters, digits or punctuation, each with the space before it.  Ids of a text
are the ids of its words one after another.  Texts are taken side by side: numpy finds the words by the classes of their bytes, Arrow
the distinct ones, each of these is looked up once, and numpy lays the ids of all places.  Each is encoded once for as long as the
memory holds it; one of letters goes straight to the library's BPE model, as the characters that stand for its bytes.  What stands
between two spaces and has other characters than these (apostrophes of contractions, letters from U+0250 on) goes to the library in one
piece.  Texts with white space other than single spaces and line ends, and texts that hold one of the vocabulary's added tokens, go
to the library whole.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces held; when so many new ones have come, those not met again since the last turn are let go.
REMEMBERED = 400_000
#: Pieces longer than this are not remembered.
LONGEST = 64
#: Bytes of texts taken side by side (one text at least), and words whose ids are laid at once.
SIDE_BY_SIDE, LAID = 4 << 20, 1 << 19
#: Letters below this character are letters in every version of Unicode that a splitter may know.
_LETTERS = "\u0250"
#: Pieces on which the short ways are tried against the library's whole one.
_TRIED = ("a", "word", "Capital", "naïve", "übergrößen", "ñandú", "supercalifragilistic")
_TRIED_PARTS = ("word,", "end.\nNext", "größe!!\n(2)", "x***", "10.0.0.1", "2024-01-02", "a1b22", "(see)", "k@b.c", "a_b=`c`", "|\n|")


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: themselves if visible, else those from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_SHOWN = [c for _, c in sorted(_byte_characters().items())]


_OTHER, _LETTER, _DIGIT, _MARK, _SPACE, _LINE = range(6)
_CLASSES = np.array([_LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _MARK if chr(b) != "'" else _OTHER for b in range(33, 127)], np.uint8)
_CLASSES = np.concatenate([np.zeros(33, np.uint8), _CLASSES, np.zeros(129, np.uint8)])
_CLASSES[[32, 10]] = _SPACE, _LINE


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8; both bytes of letters from U+00C0 to below _LETTERS are letters."""
    out = _CLASSES[data]
    at = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    if len(at):
        lead, then = data[at], data[np.minimum(at + 1, len(data) - 1)]
        at = at[((lead < 0xC9) | (then < 0x90)) & ~((lead == 0xC3) & ((then == 0x97) | (then == 0xB7)))]  # without the signs of multiplication and division
        out[at] = out[at + 1] = _LETTER
    return out


def _words(data: np.ndarray, opens: np.ndarray, parted: bool) -> np.ndarray:
    """Where the words of texts begin that begin at opens and fill data."""
    classes = _classes(data)
    before, after = np.zeros_like(classes), np.zeros_like(classes)
    before[1:], after[:-1] = classes[:-1], classes[1:]
    before[opens], after[opens[1:] - 1] = _OTHER, _OTHER
    begins = (classes != before) & (before != _SPACE)
    spaces = classes == _SPACE
    seen = np.array([False, True, True, True, False, False])
    other = classes == _OTHER
    other |= spaces & ~seen[after]
    other |= (classes == _LINE) & ~(seen[before] & seen[after])
    spaces[opens] = True
    if not parted:
        return np.flatnonzero(spaces)
    if other.any():
        between = np.flatnonzero(spaces)
        kept = ~np.logical_or.reduceat(other, between)
        begins &= np.repeat(kept, np.diff(between, append=len(data)))
    return np.flatnonzero(begins | spaces)


class _Whole(Exception):
    """The text has to be encoded in one piece."""


class _Words(dict):
    """Ids as bytes by word, with the space before it."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self._encode(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def all(self, words: list[str]) -> list[bytes | None]:
        """The ids of each word, None where a text with it has to be encoded whole."""
        found = list(map(self.get, words))
        for k, held in enumerate(found):
            if held is None:
                try:
                    found[k] = self[words[k]]
                except _Whole:
                    pass
        return found

    def _encode(self, word: str) -> bytes:
        own = self.encoder
        lead, shown = (" ", word[1:]) if word[0] == " " else ("", word)
        if own.direct and shown.isalpha() and len(shown) <= LONGEST and (shown.isascii() or max(shown) < _LETTERS):
            return own.word(lead, shown)
        if word == "\n":
            return own.line
        if not shown or not shown[0].isprintable():
            raise _Whole  # other white space, two spaces in a row, or one at the end
        return own.whole(word)


class Encoder:
    """width: bytes of an id, 2 where the vocabulary allows it, else 4; ids are little-endian."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.added = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.tokenize = self.model.model.tokenize
        self.type = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.line = self.whole("\n")
        self.direct = all(self.word(lead, w) == self.whole(lead + w) for lead in ("", " ") for w in _TRIED)
        self.parted, self.words = True, _Words(self)
        self.parted = all(self.encode(lead + w).tobytes() == self.whole(lead + w) for lead in ("", " ") for w in _TRIED_PARTS)
        self.words = _Words(self)

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def word(self, lead: str, letters: str) -> bytes:
        """The ids of lead and letters as one word of the splitter."""
        shown = lead and _SHOWN[32]
        shown += letters if letters.isascii() else "".join([_SHOWN[b] for b in letters.encode()])
        return array(self.type.char, [t.id for t in self.tokenize(shown)]).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; a null has none."""
        return next(self.encode_all(pa.array([text], pa.large_string())))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each whole text, in order; a null has none."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, SIDE_BY_SIDE + (ends[at - 1] if at else 0), "right")))
            yield from self._side_by_side(pc.fill_null(texts.slice(at, stop - at), ""))
            at = stop

    def _side_by_side(self, texts: pa.Array) -> Iterator[np.ndarray]:
        texts = texts.cast(pa.large_string())
        _, places, data = texts.buffers()
        bounds = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        opens = bounds[:-1][np.diff(bounds) > 0]
        begins = _words(data, opens, self.parted) if len(opens) else opens
        coded = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(data)).dictionary_encode()
        codes, first = coded.indices.to_numpy(), np.searchsorted(begins, bounds)
        found = self.words.all(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        whole = np.zeros(len(texts), bool)
        if None in found:
            at = np.flatnonzero(np.array([x is None for x in found])[codes])
            whole[np.searchsorted(first[:-1], at, "right") - 1] = True
            found = [x or b"" for x in found]
        for x in self.added:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        held = np.frombuffer(b"".join(found), self.type)
        counts = np.fromiter(map(len, found), np.int64, len(found)) // self.type.itemsize
        starts = np.cumsum(counts) - counts
        ends = np.concatenate([[0], np.cumsum(counts[codes])])
        ids = np.empty(ends[-1], self.type)
        for at in range(0, len(codes), LAID):
            some = codes[at : at + LAID]
            low, high = ends[at], ends[at + len(some)]
            ids[low:high] = held[np.repeat(starts[some] - ends[at : at + len(some)], counts[some]) + np.arange(low, high)]
        laid = ends[first]
        for k in range(len(texts)):
            yield np.frombuffer(self.whole(texts[k].as_py()), self.type) if whole[k] else ids[laid[k] : laid[k + 1]]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a Python worker and vocabulary, so that tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
