"""SentencePiece encoding and decoding with the n best segmentations of a text.

A text is normalised by the model and laid out as a lattice: an edge for every piece that occurs, with the piece's
score, and one for each character that no piece covers alone (the model's unknown score), which is written as byte
pieces.  A forward Viterbi pass gives the best score from the start to every place.  That score is the exact
heuristic of an A-star search from the end backwards, which then finds whole segmentations in order of their scores
and never follows a path that can't be among the n best: of the open paths, which stand for disjoint sets of
segmentations, only as many are kept as are still wanted.

No piece of the vocabulary crosses from a character into a space mark (checked when the model is read), so the lattice
falls apart into words, and the n best of a text come from its words' losses: only the n - 1 words that lose least by their
second best segmentation can take part.  So every distinct word gets the forward pass, which keeps the two best scores of every
place, and these few words of a text get the search.  The forward pass runs over all new words of a batch side by side, place by
place, on arrays; its results are kept in arrays by the word's number, in a memory of bounded size.  A word of more than ``_LONG``
characters goes through the same pass alone, with a score and a back pointer for every place and no stored edges.

Scores are those of the vocabulary.  In a model whose scores are merge ranks the best segmentation need not be that of
the merges; all n decode to the same text.

Defined results: a null or empty text has one segmentation without pieces, score 0; a text with fewer than n
segmentations gives all of them; equal scores come in the fixed order of the search, the same in each run; repeated rows
are encoded each for itself; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # below the smallest score of a piece
#: Words and their characters that the memory holds; what a call brings with it comes on top until the next one.
_HELD, _HELD_CHARS = 200_000, 4_000_000
#: Words whose search is remembered, if they are no longer than _LONG.
_SEARCHED = 20_000
#: Characters of a word in the side by side pass at most, and of all new words of one such pass about.
_LONG, _TOGETHER = 64, 150_000
#: Characters of the texts whose words are learnt together.
_TEXTS = 1_000_000
_OUT = 4 << 20
_DECODED = 1 << 18
#: A word: its best score, what its second segmentation loses (infinite without one), the ids of the best as bytes of 32-bit integers.
Word = tuple[float, float, bytes]
#: Segmentations, best first, as (score, ids).
Best = tuple[tuple[float, bytes], ...]
_models: dict[tuple[str, int], "Segmenter"] = {}


class Trie:
    """The beginnings of pieces as numbered states; a step from a state by a character is found in a table of hashes."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        number = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                number.setdefault(p[:k], len(number))
        self.piece = np.full(len(number), -1, np.int64)
        self.score = np.zeros(len(number))
        keys = np.empty(len(number), np.uint64)
        for p, n in number.items():
            if p in pieces:
                self.piece[n], self.score[n] = pieces[p]
            keys[n] = (number[p[:-1]] << 21 | ord(p[-1])) if p else 0
        self.bits = np.uint64(64 - max(10, (2 * len(number)).bit_length()))
        self.size = 1 << int(np.uint64(64) - self.bits)
        self.keys, self.to = np.zeros(self.size, np.uint64), np.full(self.size, -1, np.int64)
        waiting = np.arange(1, len(number))
        at = self._place(keys[waiting])
        while len(waiting):  # those that find their place taken go on to the next
            free = np.flatnonzero(self.to[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[at[won]], self.to[at[won]] = keys[waiting[won]], waiting[won]
            rest = np.ones(len(waiting), bool)
            rest[won] = False
            waiting, at = waiting[rest], (at[rest] + 1) % self.size

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def step(self, states: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where none does."""
        keys = states.astype(np.uint64) << np.uint64(21) | characters.astype(np.uint64)
        at = self._place(keys)
        out = self.to[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % self.size
            out[open_] = self.to[at[open_]]
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & (out[open_] >= 0)]
        return out


class Numbers(dict[str, int]):
    """Words numbered as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Memory:
    """What is known of words, by number: the best score, the loss of the second and the ids of the best."""

    def __init__(self) -> None:
        self.numbers = Numbers()
        self.times = np.zeros(0, np.int64)
        self.top, self.loss = np.zeros(0), np.zeros(0)
        self.size, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.characters = 0

    def add(self, lengths: np.ndarray, top: np.ndarray, loss: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Results of the words that follow in number, which have so many characters."""
        self.top, self.loss, self.size = np.append(self.top, top), np.append(self.loss, loss), np.append(self.size, size)
        self.at = np.append(self.at, len(self.ids) + np.cumsum(size) - size)
        self.ids = np.append(self.ids, ids)
        self.times = np.append(self.times, np.zeros(len(lengths), np.int64))
        self.characters += int(lengths.sum())

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of words, one after another."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.at[numbers] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def kept(self) -> Memory:
        """A memory of the words met most often, at least twice, up to half of what a memory holds."""
        out, words = Memory(), list(self.numbers)
        most = np.argsort(-self.times, kind="stable")[: _HELD // 2]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        most = most[(self.times[most] > 1) & (np.cumsum(lengths[most]) <= _HELD_CHARS // 2)]
        own = [words[k] for k in most.tolist()]
        out.numbers.update(zip(own, range(len(own)), strict=True))
        out.add(lengths[most], self.top[most], self.loss[most], self.size[most], self.joined(most))
        return out


class Segmenter:
    def __init__(self, model_file: str | None, n: int, processor=None):
        if processor is None:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if n < 1:
            raise ValueError("n must be at least 1")
        self.processor, self.n = processor, n
        size = processor.get_piece_size()
        names = [processor.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))]
        self.pieces = {names[i]: (i, processor.get_score(i)) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece crosses into a space mark")
        self.trie = Trie(self.pieces)
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p in self.pieces), default=1)
        # The state after those of the trie stands for a character that is no piece.
        # The last, which is also at -1, is that of no edge.
        self.score_of = np.concatenate([self.trie.score, [self.unknown, -np.inf]])
        self.piece_of = np.concatenate([self.trie.piece, [-1, -1]])
        self.unknown_id = processor.unk_id()
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if processor.is_byte(i)}
        self.text_of = [b"" if processor.is_control(i) else bytes([int(names[i][3:5], 16)]) if processor.is_byte(i) else names[i].encode() for i in range(size)]
        self.memory = Memory()
        self._searches: dict[str, tuple[Best, list[bool]]] = {}
        # For decoding many ids at once: every id's text with spaces for space marks, then all again without a first space.
        shown = [t.replace(SPACE.encode(), b" ") for t in self.text_of]
        self.shown = pa.array(shown + [t.removeprefix(b" ") for t in shown], pa.binary())
        self.control = np.array([processor.is_control(i) for i in range(size)])
        self.byte = np.array([processor.is_byte(i) for i in range(size)])

    def _ending(self, word: str, stop: int) -> list[tuple[int, float, int | None]]:
        """(start, score, id) of the edges that end at stop, from the smallest start on; id None for an unknown character."""
        get = self.pieces.get
        out: list[tuple[int, float, int | None]] = []
        for start in range(max(0, stop - self.longest), stop):
            found = get(word[start:stop])
            if found:
                out.append((start, found[1], found[0]))
        if not out or out[-1][0] != stop - 1:
            out.append((stop - 1, self.unknown, None))
        return out

    def _forward(self, word: str, edges: list[list[tuple[int, float, int | None]]] | None = None) -> tuple[array, float, array]:
        """The best score from the start to every place, the second best of the whole word, and for every place the start
        of the best edge that ends there.  edges: those that end at each place from 1 on, if they are at hand."""
        ahead, second, back = array("d", [0.0]), array("d", [-np.inf]), array("q", [0])
        for stop in range(1, len(word) + 1):
            one, two, at = -np.inf, -np.inf, 0
            for start, score, _ in edges[stop - 1] if edges else self._ending(word, stop):
                through = ahead[start] + score
                if through > one:
                    one, two, at = through, max(one, two), start
                else:
                    two = max(two, through)
                two = max(two, second[start] + score)
            ahead.append(one)
            second.append(two)
            back.append(at)
        return ahead, second[-1], back

    def search(self, word: str) -> Best:
        """The n best segmentations of the whole lattice of word."""
        # Paths that meet at a place go on by the same edges; those of a long word are laid out anew, so that they take no memory.
        edges = [self._ending(word, stop) for stop in range(1, len(word) + 1)] if len(word) <= _LONG else None
        ahead = self._forward(word, edges)[0]
        ways: dict[int, list[tuple]] = {}
        # Ascending: (minus the best whole score through the path, number, place, score of the path, the path as links).
        # A path's best edge leaves that score as it is, so it is followed at once and only the others are put off.
        open_paths: list[tuple] = [(-ahead[-1], 0, len(word), 0.0, None)]
        number, out, room = 0, [], self.n - 1
        while open_paths and room >= 0:
            _, _, place, behind, path = open_paths.pop(0)
            while place:
                here = ways.get(place)
                if here is None:
                    here = [(ahead[start] + score, start, score, piece) for start, score, piece in (edges[place - 1] if edges else self._ending(word, place))]
                    here.sort(key=_by_score)
                    if edges:
                        ways[place] = here
                for through, start, score, piece in here[1:] if room else ():
                    cost = -(through + behind)
                    if len(open_paths) >= room:
                        if cost >= open_paths[room - 1][0]:
                            break  # the edges that follow are no better
                        del open_paths[room - 1 :]
                    number += 1
                    insort(open_paths, (cost, number, start, score + behind, (start, place, piece, path)))
                _, start, score, piece = here[0]
                path, behind, place = (start, place, piece, path), score + behind, start
            out.append((behind, self._ids(word, path)))
            room -= 1
        return tuple(out)

    def _ids(self, word: str, path: tuple | None) -> bytes:
        ids = array("i")
        while path is not None:
            start, stop, piece, path = path
            self._put(ids, word[start:stop], piece)
        return ids.tobytes()

    def _put(self, ids: array, part: str, piece: int | None) -> None:
        if piece is not None:
            ids.append(piece)
        elif self.bytes:
            ids.extend([self.bytes[b] for b in part.encode()])
        else:
            ids.append(self.unknown_id)

    def _alone(self, word: str) -> Word:
        """By the forward pass over one word."""
        ahead, second, back = self._forward(word)
        bounds, place = array("q", [len(word)]), len(word)
        while place:
            place = back[place]
            bounds.append(place)
        ids = array("i")
        for k in range(len(bounds) - 1, 0, -1):
            part = word[bounds[k] : bounds[k - 1]]
            found = self.pieces.get(part)
            self._put(ids, part, found[0] if found else None)
        return ahead[-1], ahead[-1] - second, ids.tobytes()

    def _together(self, words: list[str]) -> list[Word]:
        """By the forward pass over many words side by side."""
        top, loss, size, ids = self._pass(words)
        data, ends = ids.tobytes(), 4 * np.cumsum(size)
        return [(t, x, data[a:b]) for t, x, a, b in zip(top.tolist(), loss.tolist(), (ends - 4 * size).tolist(), ends.tolist(), strict=True)]

    def _pass(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The forward pass over many words side by side, place by place: their best scores, losses, numbers of ids, and all ids.

        Characters lie by their place in the word, then by word, longest words first: the words that reach a place are the first so
        many, and all that concerns a place is one stretch of an array.  An edge lies at its last character, for each length apart."""
        given = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-given, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        most = int(given.max())
        reach = np.append(len(words) - np.cumsum(np.bincount(given, minlength=most + 1))[:most], 0)  # words that hold a character at a place
        at = np.concatenate([[0], np.cumsum(reach)])  # where a place's characters begin
        place = np.repeat(np.arange(most), reach[:most])
        chars = np.empty(len(place), np.uint32)
        within = np.arange(len(place)) - np.repeat(np.cumsum(given) - given, given)
        chars[at[within] + np.repeat(rank, given)] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        following = np.arange(len(place)) + reach[place]  # a character's next in its word, if there is one
        ends = np.arange(len(place)) - at[place] >= reach[place + 1]
        longest = min(self.longest, most)
        # Edges of a length begin with those that end at the first place possible.
        base = np.cumsum([0, *(len(place) - at[: longest - 1])]) - at[:longest]
        state = np.full(int(base[-1]) + len(place), -1, np.int32)
        some = np.zeros((longest, most), bool)  # whether edges of a length end at a place
        on, now = np.arange(len(place)), np.zeros(len(place), np.int64)
        for k in range(longest):
            now = self.trie.step(now, chars[on])
            going = now >= 0
            on, now = on[going], now[going]
            is_piece = self.trie.piece[now] >= 0
            state[base[k] + on[is_piece]] = now[is_piece]
            some[k, place[on[is_piece]]] = True
            more = ~ends[on]
            on, now = following[on[more]], now[more]
            if not len(on):
                break
        some[0] = True
        one_long = state[: len(place)]
        one_long[one_long < 0] = len(self.trie.piece)
        score = self.score_of[state]
        tops, seconds = np.zeros(len(words)), np.full(len(words), -np.inf)
        ahead, second, back = [tops.copy()], [seconds.copy()], np.zeros(len(place), np.int64)
        for stop in range(most):  # the last character of the edges
            n = int(reach[stop])
            top, next_top, by = np.full(n, -np.inf), np.full(n, -np.inf), back[at[stop] : at[stop + 1]]
            for k in np.flatnonzero(some[: stop + 1, stop])[::-1].tolist():  # from the smallest start on, of equals the first
                own = score[base[k] + at[stop] :][:n]
                through = ahead[stop - k][:n] + own
                by[through > top] = k
                np.maximum(next_top, np.minimum(top, through), out=next_top)
                np.maximum(next_top, second[stop - k][:n] + own, out=next_top)
                np.maximum(top, through, out=top)
            ahead.append(top)
            second.append(next_top)
            tops[reach[stop + 1] : n], seconds[reach[stop + 1] : n] = top[reach[stop + 1] :], next_top[reach[stop + 1] :]
        # The best paths, from the ends back.
        live, stop, steps = order[: reach[0]], given[order[: reach[0]]] - 1, []
        while len(live):
            last = at[stop] + rank[live]
            k = back[last]
            steps.append((live, self.piece_of[state[base[k] + last]], last))
            stop = stop - k - 1
            live, stop = live[stop >= 0], stop[stop >= 0]
        owner, piece, last = (np.concatenate([x[k] for x in steps[::-1]] or [np.zeros(0, np.int64)]) for k in range(3))
        sequence = np.argsort(owner, kind="stable")
        owner, piece, last = owner[sequence], piece[sequence], last[sequence]
        # Those below 0 stand for a character each, which is written out.
        odd, size = np.flatnonzero(piece < 0), np.ones(len(piece), np.int64)
        if len(odd):
            which, of = np.unique(chars[last[odd]], return_inverse=True)
            spelt = [self._spelt(chr(c)) for c in which.tolist()]
            size[odd] = np.array([len(x) for x in spelt])[of]
            piece, begin = np.repeat(piece, size), (np.cumsum(size) - size)[odd]
            for k in range(max(map(len, spelt))):
                open_ = size[odd] > k
                piece[begin[open_] + k] = np.array([x[k] if k < len(x) else -1 for x in spelt])[of[open_]]
        with np.errstate(invalid="ignore"):
            losses = tops - seconds
        return tops[rank], losses[rank], np.bincount(owner, size, minlength=len(words)).astype(np.int64), piece.astype(np.int32)

    def _spelt(self, character: str) -> list[int]:
        """The ids of a character that is no piece."""
        ids = array("i")
        self._put(ids, character, None)
        return ids.tolist()

    def words(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts as the model normalises them, one after another, and where each text's begin and the last's end:
        space marks, if there are any, and what follows them up to the next.  They are found by their bytes, all texts side by side."""
        normal = [self.processor.normalize(text).encode() if text else b"" for text in texts]
        at = np.zeros(len(normal) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)), out=at[1:])
        data = b"".join(normal)
        raw = np.frombuffer(data, np.uint8)
        first = np.zeros(len(raw) + 1, bool)
        one, two, three = SPACE.encode()
        marks = np.flatnonzero((raw[:-2] == one) & (raw[1:-1] == two) & (raw[2:] == three))
        first[marks[np.diff(marks, prepend=-3 - len(SPACE.encode())) != 3]] = True
        first[at[:-1]] = True  # of an empty text, where the next begins
        first[-1] = False
        start = np.flatnonzero(first)
        found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(raw))), pa.py_buffer(data))
        return found, np.searchsorted(start, at)

    def learn(self, words: pa.Array) -> np.ndarray:
        """The numbers that the memory has for the words; those that it doesn't hold get the forward pass."""
        if len(self.memory.numbers) >= _HELD or self.memory.characters >= _HELD_CHARS:
            self.memory = self.memory.kept()
        numbers, held = self.memory.numbers, len(self.memory.numbers)
        # Only the distinct ones become Python's strings.
        coded = words.dictionary_encode()
        own = np.fromiter(map(numbers.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
        out = own[coded.indices.to_numpy()]
        new = list(islice(numbers, held, None))
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        ends, long = np.cumsum(lengths), np.append(np.flatnonzero(lengths > _LONG), len(new))
        found, at = [], 0
        while at < len(new):
            if lengths[at] > _LONG:
                top, loss, ids = self._alone(new[at])
                found.append((np.array([top]), np.array([loss]), np.array([len(ids) // 4]), np.frombuffer(ids, np.int32)))
                at += 1
                continue
            stop = int(min(np.searchsorted(ends, ends[at] - lengths[at] + _TOGETHER) + 1, long[np.searchsorted(long, at)]))
            found.append(self._pass(new[at:stop]))
            at = stop
        if found:
            self.memory.add(lengths, *map(np.concatenate, zip(*found, strict=True)))
        self.memory.times += np.bincount(out, minlength=len(self.memory.times))
        return out

    def encode(self, text: str | None) -> list[tuple[float, np.ndarray]]:
        """(score, ids) of the n best segmentations, best first."""
        return next(self.encode_many([text]))

    def encode_many(self, texts: list[str | None]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """encode of each text; new words of all of them are learnt together."""
        for best in self._segmented(texts):
            yield [(score, ids) for score, ids, _ in best]

    def _segmented(self, texts: list[str | None]) -> Iterator[list[tuple[float, np.ndarray, bool]]]:
        """encode_many, and with each segmentation whether its ids are written by the same bytes as the best one's."""
        words, bounds = self.words(texts)
        numbers, memory = self.learn(words), self.memory
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield self._nbest(words[a:b], numbers[a:b], memory)

    def _nbest(self, words: pa.Array, numbers: np.ndarray, memory: Memory) -> list[tuple[float, np.ndarray, bool]]:
        top, best = float(memory.top[numbers].sum()), memory.joined(numbers)
        out = [(top, best, True)]
        if self.n > 1 and len(words):
            losses = memory.loss[numbers]
            if self.n - 1 < len(words):
                near = np.flatnonzero(losses <= np.partition(losses, self.n - 2)[self.n - 2])
            else:
                near = np.arange(len(words))
            least = [k for k in near[np.argsort(losses[near], kind="stable")[: self.n - 1]].tolist() if np.isfinite(losses[k])]
            searched = {k: self._searched(words[k].as_py()) for k in least}
            ends = np.cumsum(memory.size[numbers])
            for loss, taken in self._combine({k: found for k, (found, _) in searched.items()}):
                parts, done, alike = [], 0, True
                for k, r in sorted(taken):
                    end = int(ends[k])
                    parts += [best[done : end - memory.size[numbers[k]]], np.frombuffer(searched[k][0][r][1], np.int32)]
                    alike, done = alike and searched[k][1][r], end
                out.append((top - loss, np.concatenate([*parts, best[done:]]), alike))
        return out

    def _searched(self, word: str) -> tuple[Best, list[bool]]:
        """search, and of each segmentation whether its ids are written by the same bytes as the first one's."""
        held = self._searches.get(word)
        if held is None:
            found = self.search(word)
            shown = [b"".join(map(self.text_of.__getitem__, np.frombuffer(ids, np.int32).tolist())) for _, ids in found]
            held = found, [x == shown[0] for x in shown]
            if len(word) <= _LONG:
                if len(self._searches) >= _SEARCHED:
                    self._searches.clear()
                self._searches[word] = held
        return held

    def _combine(self, searched: dict[int, Best]) -> list[tuple[float, list[tuple[int, int]]]]:
        """The n - 1 smallest losses but none, of choices of a segmentation for some of the words: (loss, [(word, rank)])."""
        sums: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for k, own in searched.items():
            sums = heapq.nsmallest(self.n, ((loss + own[0][0] - own[r][0], taken + (((k, r),) if r else ())) for loss, taken in sums for r in range(len(own))))
        return [(loss, list(taken)) for loss, taken in sums if taken]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation: bytes joined, space marks as spaces, without the space that the model puts first."""
        data = b"".join(map(self.text_of.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def decode_many(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of many segmentations; the k-th has the ids bounds[k] to bounds[k + 1]."""
        some = np.flatnonzero(np.diff(bounds) > 0)
        shown = ids.astype(np.int64)
        shown[bounds[some]] += len(self.text_of)
        _, offsets, data = self.shown.take(pa.array(shown)).buffers()
        offsets = np.frombuffer(offsets, np.int32, len(ids) + 1)
        out = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets[bounds]), data)
        odd = self.control[ids]
        if self.byte[ids].any() and (not _valid(out) or pc.any(pc.match_substring(out, SPACE)).as_py()):
            odd = odd | self.byte[ids]
        if not odd.any():
            return out
        odd = np.diff(np.concatenate([[0], np.cumsum(odd)])[bounds]) > 0
        return pa.array([self.decode(ids[bounds[k] : bounds[k + 1]]) if odd[k] else out[k].as_py() for k in range(len(out))], pa.string())

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """decode_many of lists of ids; null lists give null texts."""
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        texts = self.decode_many(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]))
        return pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string())) if lists.null_count else texts


def _valid(texts: pa.Array) -> bool:
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        return False
    return True


def _by_score(edge: tuple) -> float:
    return -edge[0]


def segmenter(model_file: str, n: int) -> Segmenter:
    """One for each worker process."""
    if (model_file, n) not in _models:
        _models[model_file, n] = Segmenter(model_file, n)
    return _models[model_file, n]


def encode_texts(docs: DataFrame, model_file: str, n: int = 4, id_column: str = "doc_id", text_column: str = "text", decoded: str | None = None) -> DataFrame:
    """A row for each of a text's n best segmentations: the id column, rank (from 1), score, ids; and, in a column called as decoded
    says, the text that decode_ids makes of these ids, without their way through another worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(model_file, n)
        for batch in batches:
            rows, ranks, scores, ids, like, size = [], [], [], [], [], 0

            def full() -> pa.RecordBatch:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ranks, pa.int32()), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), flat)]
                if decoded:
                    # Ids that are written by the same bytes have one text.
                    of, once = np.unique(like, return_index=True)
                    columns.append(own.decode_lists(columns[-1].take(pa.array(once))).take(pa.array(np.searchsorted(of, like))))
                return pa.RecordBatch.from_arrays(columns, names=[id_column, "rank", "score", "ids", *([decoded] if decoded else [])])

            characters = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(characters, (characters[at - 1] if at else 0) + _TEXTS, "right")))
                for row, best in enumerate(own._segmented(batch.column(1).slice(at, stop - at).to_pylist()), at):
                    for rank, (score, found, alike) in enumerate(best, 1):
                        like.append(len(like) - rank + 1 if alike else len(like))
                        rows.append(row)
                        ranks.append(rank)
                        scores.append(score)
                        ids.append(found)
                        size += len(found)
                    if size > _OUT // 4:
                        yield full()
                        rows, ranks, scores, ids, like, size = [], [], [], [], [], 0
                at = stop
            if rows:
                yield full()

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, rank int, score double, ids array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode_ids(encoded: DataFrame, model_file: str, ids_column: str = "ids", text_column: str = "text") -> DataFrame:
    """encoded with the text of its ids in place of them; null ids give a null text."""
    kept = [c for c in encoded.columns if c != ids_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(model_file, 1)
        for batch in batches:
            lists = batch.column(len(kept))
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _DECODED, "right")))
                texts = own.decode_lists(lists.slice(at, stop - at))
                yield pa.RecordBatch.from_arrays([*[c.slice(at, stop - at) for c in batch.columns[:-1]], texts], names=[*kept, text_column])
                at = stop

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(ids_column)).mapInArrow(run, f"{schema}, `{text_column}` string")
