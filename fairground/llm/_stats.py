"""Statistics of whole texts, by block."""

from __future__ import annotations

import numpy as np

from fairground.llm._words import SPACED, Block, covered, inside_windows, mix, owners, repeated, spans, sums, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NOT_CONTINUATION = (np.arange(256) & 0xC0) != 0x80
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LETTERS = UPPER.copy()
LETTERS[97:123] = True
LETTERS |= np.arange(256) >= 0xC0
DIGITS = np.zeros(256, bool)
DIGITS[48:58] = True
SHOUTS = np.zeros(256, bool)
SHOUTS[list(b"!?")] = True
SALT = np.uint64(0xA24BAED4963EE407)


class Stats:
    """Lazily computed counts, one value a text of the block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._kept = data, offsets, {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._kept:
            self._kept[name] = getattr(self, f"_get_{name}")()
        return self._kept[name]

    def some(self, keep: np.ndarray) -> Stats:
        """The same for some of the texts, with all that has been counted so far."""
        lengths = np.diff(self.offsets)
        offsets = np.concatenate([[0], np.cumsum(lengths[keep])])
        out = Stats(self.data[np.repeat(keep, lengths)], offsets)
        moved = np.zeros(len(keep), np.int64)
        moved[keep] = self.offsets[:-1][keep] - offsets[:-1]
        for name, value in self._kept.items():
            if name == "words":
                starts, ends, at = value
                of = owners(at)
                w = keep[of]
                out._kept[name] = starts[w] - moved[of[w]], ends[w] - moved[of[w]], np.concatenate([[0], np.cumsum(np.diff(at)[keep])])
            elif name == "word_hashes":
                out._kept[name] = value[keep[owners(self.words[2])]]
            elif name == "lines":
                starts, ends, row = value
                x = keep[row]
                out._kept[name] = starts[x] - moved[row[x]], ends[x] - moved[row[x]], (np.cumsum(keep) - 1)[row[x]]
            elif name != "block":  # its hashes go by places in the larger block
                out._kept[name] = value[keep]
        return out

    def _count(self, kind: np.ndarray) -> np.ndarray:
        return sums(kind[self.data], self.offsets)

    def _get_block(self):
        return Block(self.data, self.offsets)

    def _get_words(self):
        return spans(SPACED[self.data], self.offsets)

    def _get_word_hashes(self):
        return self.block.hashes(*self.words[:2])

    def _get_n_words(self):
        return np.diff(self.words[2])

    def _get_word_chars(self):
        return self._count(SPACED & NOT_CONTINUATION)

    def _get_n_symbols(self):
        return self._count(SYMBOLS)

    def _get_n_upper(self):
        return self._count(UPPER)

    def _get_n_letters(self):
        return self._count(LETTERS)

    def _get_n_digits(self):
        return self._count(DIGITS)

    def _get_n_shouts(self):
        return self._count(SHOUTS)

    def _get_n_bars(self):
        return self._count(np.arange(256) == ord("|"))

    def _get_lines(self):
        """(starts, ends, text) of the lines that hold a word."""
        starts, ends, at = spans(self.data != 10, self.offsets)
        words = np.searchsorted(self.words[0], ends) - np.searchsorted(self.words[0], starts)
        keep = words > 0
        return starts[keep], ends[keep], owners(at)[keep]

    def _get_n_lines(self):
        return np.bincount(self.lines[2], minlength=len(self.offsets) - 1)

    def _get_n_dup_lines(self):
        starts, ends, row = self.lines
        later, _ = repeated(mix(self.block.hashes(starts, ends) + row.astype(np.uint64) * SALT))
        return np.bincount(row[later], minlength=len(self.offsets) - 1)

    def _get_n_repeat_words(self):
        at, size = self.words[2], 5
        row = owners(at)
        w = np.flatnonzero(inside_windows(at, size))
        keys = windows(self.word_hashes, size)[w]
        _, shared = repeated(mix(keys + row[w].astype(np.uint64) * SALT))
        return sums(covered(w[shared], size, len(row)), at)

    def _get_n_distinct(self):
        row = owners(self.words[2])
        later, _ = repeated(mix(self.word_hashes + row.astype(np.uint64) * SALT))
        return self.n_words - np.bincount(row[later], minlength=len(self.offsets) - 1)
