"""Which of many byte literals the texts of an Arrow column hold, and where: numpy over the column's UTF-8 bytes.

Every literal is entered under an anchor: its ``WORD`` bytes (a shorter literal: all its bytes) that fewest literals share.
All positions of a slice of texts are looked up at once, by one table per anchor size: a bitmap of the anchors' hashes
refuses most positions, a sorted list of the anchors names the literals, the rest of a literal is compared word by word.
The cost of a position follows the number of anchor sizes (at most ``WORD``), not the number of literals.

A literal may have a *tail*: it then counts only where a mark stands at its end. ``marked`` texts hold ``MARK`` before every
place where the tail matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = 8
MARK = "\x1f"
HASH = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as one number; zeros follow the end."""
    n = len(data) // WORD + 1
    padded = np.zeros((n + 1) * WORD, np.uint8)
    padded[:len(data)] = data
    out = np.empty(n * WORD, np.uint64)
    for k in range(WORD):
        out[k::WORD] = padded[k:k + n * WORD].view("<u8")
    return out


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
        if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 0, 3: the owners 0 0 2 2 2 and the places 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted and each once (``np.unique`` hashes, which takes several times as long here)."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate([np.ones(min(1, len(numbers)), bool), numbers[1:] != numbers[:-1]])]


class Literals:
    """``entries``: (literal, its anchor, number of its tail or -1 without). ``bits``: bitmap size, a power of two."""

    def __init__(self, entries: list[tuple[bytes, bytes, int]], bits: int, step: int):
        self.step = step
        self.length = np.array([len(x) for x, _, _ in entries], np.int64)
        self.offset = np.array([x.index(a) for x, a, _ in entries], np.int64)
        self.tail = np.array([t for _, _, t in entries], np.int64)
        self.longest = int(self.length.max(initial=0))
        # Literals of more than a word: all their words, the last one flush with the end.
        places = [[min(j, len(x) - WORD) for j in range(0, len(x), WORD)] if len(x) > WORD else [] for x, _, _ in entries]
        self.n_words = np.array([len(p) for p in places], np.int64)
        self.first_word = np.cumsum(self.n_words) - self.n_words
        self.places = np.array([i for p in places for i in p], np.int64)
        self.words = np.array([int.from_bytes(x[i:i + WORD], "little") for (x, _, _), p in zip(entries, places) for i in p], np.uint64)
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        sizes = [len(a) for _, a, _ in entries]
        # Most positions are refused by what all anchors begin with: as many bytes as the shortest has.
        self.least = _mask(min(sizes, default=1))
        self.begins = np.zeros(bits, bool)
        starts = np.array([int.from_bytes(a, "little") for _, a, _ in entries], np.uint64) & self.least
        self.begins[(starts * HASH) >> self.shift] = True
        self.tables = []
        for size in sorted(set(sizes)):
            own = np.array([i for i, (_, a, _) in enumerate(entries) if len(a) == size], np.int64)
            anchor = np.array([int.from_bytes(entries[i][1], "little") for i in own], np.uint64)
            order = np.argsort(anchor, kind="stable")
            keys, first, count = np.unique(anchor[order], return_index=True, return_counts=True)
            bitmap = np.zeros(bits, bool)
            bitmap[(keys * HASH) >> self.shift] = True
            self.tables.append((_mask(size), bitmap, keys, first, count, own[order]))

    def _found(self, data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, entry) of the literals whose anchor begins in ``[lo, hi)`` of ``data``; ends are not looked at."""
        base = max(0, lo - self.longest)
        words = _words(data[base:hi + self.longest])
        here = words[lo - base:hi - base]
        begun = np.flatnonzero(self.begins[((here & self.least) * HASH) >> self.shift])
        here, begun = here[begun], begun + lo
        for mask, bitmap, keys, first, count, members in self.tables:
            key = here & mask
            at = np.flatnonzero(bitmap[(key * HASH) >> self.shift])
            key = key[at]
            group = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[group] == key
            at, group = begun[at[same]], group[same]
            # Anchors of many literals: no more than about a step's candidates at once.
            cuts = np.searchsorted(np.cumsum(count[group]), np.arange(self.step, int(count[group].sum()), self.step), "right")
            for a, g in zip(np.split(at, cuts), np.split(group, cuts)):
                owner, place = _spread(count[g])
                entry = members[first[g][owner] + place]
                start = a[owner] - self.offset[entry]
                inside = (start >= base) & (start + self.length[entry] <= len(data))
                start, entry = start[inside], entry[inside]
                for j in range(int(self.n_words[entry].max(initial=0))):
                    more = np.flatnonzero(self.n_words[entry] > j)
                    word = self.first_word[entry[more]] + j
                    wrong = more[words[start[more] + self.places[word] - base] != self.words[word]]
                    start, entry = np.delete(start, wrong), np.delete(entry, wrong)
                yield start, entry

    def _marks(self, ends: np.ndarray, marked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Whether a mark stands at each place of the texts (of these offsets, from 0), and the texts that have no marks."""
        data, at = _buffers(marked)
        marks = np.flatnonzero(data[at[0]:at[-1]] == ord(MARK))
        at = at - at[0]
        before = np.searchsorted(marks, at)
        n = np.diff(before)
        unknown = np.diff(at) - n != np.diff(ends)
        text = np.repeat(np.arange(len(n)), n)
        place = marks - np.arange(len(marks)) + (ends[:-1] - at[:-1] + before[:-1])[text]
        # The first place of a text is the last one of the text before; no literal ends at the first.
        good = ~unknown[text] & (place > ends[:-1][text])
        out = np.zeros(int(ends[-1]) + 1, bool)
        out[place[good]] = True
        return out, unknown

    def of(self, texts: pa.Array, *marked: pa.Array) -> pa.Array:
        """The distinct entries that each text holds. Entry ``e`` comes as ``e`` plus the number of entries where the text's
        marks for its tail are not known (null): there, the literal alone was found."""
        data, offsets = _buffers(texts)
        out_counts, out_entries, i, n, e = [], [], 0, len(texts), len(self.length)
        while i < n:
            # Texts of about a step together; a longer one alone.
            k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + self.step, "right")) - 1)
            ends = offsets[i:k + 1] - offsets[i]
            known = [self._marks(ends, m.slice(i, k - i)) for m in marked]
            own = data[offsets[i]:offsets[k]]
            text_of = np.repeat(np.arange(k - i), np.diff(ends))
            pairs = [np.zeros(0, np.int64)]
            for lo in range(0, len(own), self.step):
                for start, entry in self._found(own, lo, min(len(own), lo + self.step)):
                    text, end = text_of[start], start + self.length[entry]
                    hit, untested = end <= ends[1:][text], np.zeros(len(start), bool)
                    for t, (flags, unknown) in enumerate(known):
                        mine = self.tail[entry] == t
                        untested |= mine & unknown[text]
                        hit &= ~mine | unknown[text] | flags[end]
                    pairs.append(_distinct((text * (2 * e) + entry + e * untested)[hit]))
            found = _distinct(np.concatenate(pairs))
            out_counts.append(np.bincount(found // (2 * e), minlength=k - i))
            out_entries.append((found % (2 * e)).astype(np.int32))
            i = k
        counts = np.concatenate([[0], *out_counts])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)),
                                        pa.array(np.concatenate([np.zeros(0, np.int32), *out_entries])))
