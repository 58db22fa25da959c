"""Whole-text encoding with the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from tidegraph.llm.common import KEPT
from tidegraph.llm.words import _LOWER, Words, mix, scan

#: Words whose ids a worker keeps (some 60 bytes each); beyond it the store starts anew.
KEEP_WORDS = 1_200_000
#: Unseen words that one call of the library encodes.
CALL_WORDS = 4000
#: Stops that are taken off a word one by one, and bytes of a word that are hashed eight at a time; the rest goes by sums over all bytes.
STOPS = 8
HASHED = 64


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Behind byte 0xC3: letters, all but the signs of multiplication and division.
_TRAIL = np.zeros(256, bool)
_TRAIL[0x80:0xC0] = True
_TRAIL[[0x97, 0xB7]] = False
_STOP = np.zeros(256, bool)
_STOP[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True
#: Code points of the letters that these bytes spell.
_LETTERS = [*range(65, 91), *range(97, 123), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]


#: Words of ASCII and Latin-1 letters.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _last_but_stops(w: Words, at: np.ndarray) -> np.ndarray:
    """The last byte that is not a stop of each of these words, which end with a stop; before its start where there is none."""
    last, left = w.stop[at] - 2, np.arange(len(at))
    for _ in range(STOPS):
        left = left[last[left] >= w.start[at[left]]]
        left = left[_STOP[w.data[last[left]]]]
        if not len(left):
            return last
        last[left] -= 1
    places = np.arange(len(w.data), dtype=np.int64)
    places[_STOP[w.data]] = -1
    last[left] = np.maximum.accumulate(places)[w.stop[at[left]] - 1]
    return last


def _without_stops(w: Words) -> Words:
    """The words with the stops behind a letter at their end taken off as a word of its own: pieces end there anyway."""
    at = np.flatnonzero(_STOP[w.data[w.stop - 1]])
    last = _last_but_stops(w, at)
    some = last >= w.start[at]
    at, last = at[some], last[some]
    byte = w.data[last]
    letter = _LETTER[byte] | (last > w.start[at]) & _TRAIL[byte] & (w.data[last - 1] == 0xC3)
    at, last = at[letter], last[letter]
    if not len(at):
        return w
    start = np.insert(w.start, at + 1, last + 1)
    stop = np.insert(w.stop, at, last + 1)
    return Words(w.data, w.text_start, start, stop, w.doc_start + np.searchsorted(at, w.doc_start), w.inside)


#: The lowest n of eight bytes.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _keys(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the first HASHED bytes and the length of each word."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[: len(data)] = data
    eight = padded.view("<u8")
    length = stop - start
    out = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at, left, rows = start, length, None
    for _ in range(HASHED // 8):
        place, bits = at >> 3, ((at & 7) << 3).astype(np.uint64)
        # the eight bytes from there on; shifts by 64 are taken in two steps
        x = eight[place] >> bits | eight[place + 1] << np.uint64(1) << (np.uint64(63) - bits)
        x &= _MASKS[np.minimum(left, 8)]
        if rows is None:
            out = mix(out ^ x)
        else:
            out[rows] = mix(out[rows] ^ x)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def _room(array: np.ndarray, n: int) -> np.ndarray:
    """The array, or one at least twice as long with the same beginning, so that it holds n values."""
    if n <= len(array):
        return array
    more = np.zeros(max(n, 2 * len(array)), array.dtype)
    more[: len(array)] = array
    return more


class _Places:
    """A place for each 64-bit hash: open addressing, whole arrays at once."""

    def __init__(self, bits: int = 16):
        self.keys, self.places, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for unknown ones."""
        mask = np.uint64(len(self.keys) - 1)
        at = (keys & mask).astype(np.int64)
        have = self.keys[at]
        same = have == keys
        out = np.where(same, self.places[at], -1)
        left = np.flatnonzero(~same & (have != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & int(mask)
            have, wanted = self.keys[at], keys[left]
            same = have == wanted
            out[left[same]] = self.places[at[same]]
            more = ~same & (have != 0)
            left, at = left[more], at[more]
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Add distinct keys that are not known yet."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            known = np.flatnonzero(self.keys)
            old = self.keys[known], self.places[known]
            self.__init__((2 * (self.used + len(keys)) - 1).bit_length())
            self.add(*old)
        self.used += len(keys)
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several keys for one place one stays
            own = free & (self.keys[at] == keys)
            self.places[at[own]] = places[own]
            keys, places, at = keys[~own], places[~own], (at[~own] + 1) & mask


class WordEncoder:
    """Ids of texts under a lower-casing tokenizer whose pieces never cross white space, and that drops it.

    For such a tokenizer the ids of a text are those of its words, one after another. Unseen
    words of ASCII and Latin-1 letters go straight to the library's model, spelled as its normalizer
    and pre-tokenizer spell these letters, where they make one piece of them; others go to the library together, a special token between them.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = max(self.tokenizer.get_added_tokens_decoder().items())
        self.mark_id, self.mark = special[0], special[1].content
        self.tokens_in_text = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.spelled = {c: "".join(x[0] for x in self._pieces(chr(c))) for c in _LETTERS}
        self.lowers = all(self.spelled[c] == chr(c).lower() for c in _LETTERS if c < 128)
        every = "".join(map(chr, _LETTERS))
        self.one_piece = [x[0] for x in self._pieces(every)] == [every.translate(self.spelled)]
        self.end_id = end_id
        self._clear()

    def _pieces(self, text: str) -> list:
        """The tokenizer's pieces of a text, as its model gets them."""
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else []

    def _clear(self) -> None:
        self.known = _Places()
        self.pool, self.n_pool = np.array([self.end_id], np.int32), 1
        self.first, self.length, self.n_words = np.zeros(1, np.int64), np.ones(1, np.int64), 1  # place 0: the end of a text

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words that are not of letters alone."""
        out: list[list[int]] = []
        for at in range(0, len(words), CALL_WORDS):
            some = words[at : at + CALL_WORDS]
            marked = ["<" in w and any(t in w for t in self.tokens_in_text) for w in some]
            plain = [w for w, m in zip(some, marked, strict=True) if not m]
            ids = self.tokenizer.encode_batch_fast([f" {self.mark} ".join(plain)], add_special_tokens=False)[0].ids if plain else []
            parts, own = [], []
            for i in ids:
                if i == self.mark_id:
                    parts.append(own)
                    own = []
                else:
                    own.append(i)
            parts.append(own)
            each = iter(parts)
            out += [self.tokenizer.encode(w, add_special_tokens=False).ids if m else next(each) for w, m in zip(some, marked, strict=True)]
        return out

    def _learn(self, hashes: np.ndarray, letters: list[str], others: list[str]) -> None:
        """Keep the ids of words: first those of letters alone, then the others."""
        tokenize, spelled = self.model.tokenize, self.spelled
        ids = [[t.id for t in tokenize(w.lower() if self.lowers and w.isascii() else w.translate(spelled))] for w in letters] + self._encode_words(others)
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        stop, base = self.n_pool + int(length.sum()), self.n_words
        self.pool = _room(self.pool, stop)
        self.pool[self.n_pool : stop] = np.fromiter(chain.from_iterable(ids), np.int32, stop - self.n_pool)
        self.first, self.length = _room(self.first, base + len(ids)), _room(self.length, base + len(ids))
        self.first[base : base + len(ids)], self.length[base : base + len(ids)] = self.n_pool + np.cumsum(length) - length, length
        self.n_pool, self.n_words = stop, base + len(ids)
        self.known.add(hashes, np.arange(base, self.n_words, dtype=np.int32))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (each ends with end_id), and where each text begins (one more at the end)."""
        w = _without_stops(scan(texts))
        keys = _keys(_LOWER[w.data], w.start, w.stop)
        # only words with a bar may hold a special token, which small letters would change
        bars = np.flatnonzero(w.data == ord("|"))
        if len(bars):
            marked = np.unique(np.searchsorted(w.start, bars, side="right") - 1)
            keys[marked] = _keys(w.data, w.start[marked], w.stop[marked])
        long = np.flatnonzero(w.stop - w.start > HASHED)
        if len(long):
            whole = w.hashes(lower=True)[long]
            if len(bars):
                whole = np.where(np.isin(long, marked), w.hashes()[long], whole)
            keys[long] ^= whole
        keys[keys == 0] = 1
        slots = self.known.find(keys)
        unseen = np.flatnonzero(slots < 0)
        if len(unseen):
            if self.n_words + len(unseen) > max(KEEP_WORDS, len(keys)):
                self._clear()
                unseen = np.arange(len(keys))
            new, at, inverse = np.unique(keys[unseen], return_index=True, return_inverse=True)
            at = unseen[at]
            whole = w.data.tobytes()
            base = self.n_words
            words = [whole[i:j].decode() for i, j in zip(w.start[at].tolist(), w.stop[at].tolist(), strict=True)]
            simple = np.fromiter([x.isalpha() if x.isascii() else _WORD.fullmatch(x) is not None for x in words], bool, len(words)) & self.one_piece
            order = np.argsort(~simple, kind="stable")
            n = int(simple.sum())
            words = [words[i] for i in order.tolist()]
            self._learn(new[order], words[:n], words[n:])
            place = np.empty(len(new), np.int64)
            place[order] = np.arange(base, base + len(new))
            slots[unseen] = place[inverse]
        slots = np.insert(slots, w.doc_start[1:], 0)
        length = self.length[slots]
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        shift = (self.first[slots] - (upto - length)).astype(np.int32)
        ids = self.pool[np.repeat(shift, length) + np.arange(total, dtype=np.int32)]
        ends = upto[w.doc_start[1:] + np.arange(len(texts))]
        return ids, np.concatenate([[0], ends]).astype(np.int64)


_encoders: dict[tuple[str, int], WordEncoder] = {}
KEPT.append(_encoders.clear)


def encoder(path: str, end_id: int) -> WordEncoder:
    """This worker's encoder."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]
