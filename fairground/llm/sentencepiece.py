"""SentencePiece encoding and decoding by a parallel scan over chunks.

The pieces and their scores come from a public model file.  The encoding (``Pieces``) is the segmentation of highest total
score, as the library's own processor finds it with a unigram model: a character in no piece costs ten nats more than
the rarest piece and becomes its byte pieces.  Of equal segmentations the one whose last piece is longest wins, then the
one before it, and so on.  A unigram model has log-probabilities.  A BPE model has ranks alone; nothing is trained here,
so the log-probabilities of its pieces are those of Zipf's law, ``-log(rank + ZIPF)``, in whole steps of 1/1024.  Scores are
whole numbers of 1/``SCALE``, so sums are exact.

With ``merges`` a BPE model's pieces are joined in its own order instead (``Merges``): again and again the two neighbours
that make up the piece of best rank, the leftmost of equals.

Where every piece that holds a character begins with it (the word mark), or no piece holds it, all segmentations part, as
they do between a letter and a mark of punctuation that no piece joins: between such cuts the encoding is found once for
each distinct stretch and remembered in the worker.  The new stretches of some texts are solved together, character by
character, or merge by merge, over all of them (``learn``).

A text of more than ``CHUNK`` characters is dealt out in chunks.  Under merges a chunk encodes what lies between its first
and its last cut; what it has before and behind them is put together, over as many chunks as a stretch reaches, by the last
chunk before that has a cut (``_merge_long``).  Otherwise a chunk's transfer matrix holds, for each way in (how far
the last piece of the chunk before reaches in) and each way out, the best score; matrices are combined associatively, by
(max, +), in groups of ``GROUP`` chunks and then of groups.  With the scores at its way in known, each chunk finds where each
way out came from; those short maps are followed from the end of the text, and then every chunk is traced back on its own.

A null text has null ids; an empty one has none.  Rows are told apart by a number of their own, so repeated rows and
null ids each get their result.  Results take the place of columns of the same names (``ids``, ``score``, ``decoded``), which
can be given other ones; all other columns stay, whatever they are called.  The word mark U+2581 in a text is taken as an unknown character, so decoding gives it back
(the model's own processor takes it for a space, and doesn't).
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairground.llm._shared import batch, column, cut, frugal, table, unused, wider

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 1 << 15
GROUP = 256
#: Scores are whole numbers of so many to the nat.
SCALE = 1 << 20
#: What a character that is no piece costs beyond the rarest piece, in nats; and the shift of ranks in Zipf's law.
UNKNOWN, ZIPF = 10, 2.7
NEVER = -(1 << 60)
REMEMBERED = 100_000
#: Stretches of more characters are not remembered.
SHORT = 64
#: Texts are taken until they have so many characters together.
TOGETHER = 1 << 20
MARK = "▁"


def _together(stretches: list[str], memory: dict[str, tuple[bytes, int]], find) -> tuple[bytes, int]:
    """(ids, score) of stretches in a row, remembered or found."""
    got = list(map(memory.get, stretches))
    if None in got:
        got = [g or find(p) for g, p in zip(got, stretches, strict=True)]
    if not got:
        return b"", 0
    ids, scores = zip(*got, strict=True)
    return b"".join(ids), sum(scores)


def proto_of(model: str):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    return proto


def is_bpe(model: str) -> bool:
    spec = proto_of(model).trainer_spec
    return spec.model_type == spec.BPE


def zipf(score: float) -> int:
    """The score of a piece whose score in a BPE model is its rank, below 0."""
    return -round(math.log(ZIPF - score) * 1024) * (SCALE // 1024)


class Pieces:
    """The vocabulary with its scores.  A space stands for the word mark throughout."""

    def __init__(self, vocabulary: list[tuple[str, int]], byte_ids: list[int], special: dict[int, str] | None = None):
        self.ids = {p.replace(MARK, " "): (i, s) for i, (p, s) in enumerate(vocabulary) if s is not None}
        self.texts = [p.replace(MARK, " ").encode() for p, _ in vocabulary]
        self.byte_ids = byte_ids
        for b, i in enumerate(byte_ids):
            self.texts[i] = bytes([b])
        for i in special or {}:
            self.texts[i] = b""
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min((x for _, x in self.ids.values()), default=0) - UNKNOWN * SCALE
        known = {c for p in self.ids for c in p}
        held = {c for p in self.ids for c in p[1:].lstrip(" ")} if any(p.startswith(" ") for p in self.ids) else {c for p in self.ids for c in p[1:]}
        self.marks_cut = " " not in held
        letters = "".join(map(re.escape, sorted(known - {" "})))
        # Signs: the characters that no piece has beside a letter or beside what stands with letters.
        beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1) if " " not in p[i : i + 2]}
        joined = {c for c in known if c.isalpha()}
        while more := {c for pair in beside if joined & set(pair) for c in pair} - joined:
            joined |= more
        runs = [c for c in (joined - {" "}, known - joined - {" "}) if c]
        # Stretches between cuts: a run of marks with the letters or the signs that follow it, or one unknown character.
        together = "|".join(f" *[{''.join(map(re.escape, sorted(c)))}]+" for c in runs)
        self._stretch = re.compile(f"{together}| +|[^{letters} ]" if self.marks_cut else f"[{letters} ]+|[^{letters} ]")
        self._automaton = None
        self._memory: dict[str, tuple[bytes, int]] = {}

    @classmethod
    def load(cls, model: str = MODEL, ranks: bool = False) -> Pieces:
        """The pieces of a model file; with ``ranks`` their scores are the model's own ranks."""
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=model)
        score = (lambda x: round(x)) if ranks else zipf if is_bpe(model) else (lambda x: round(x * SCALE))
        vocabulary, byte_ids, special = [], [0] * 256, {}
        for i in range(len(s)):
            odd = s.is_byte(i) or s.is_control(i) or s.is_unknown(i) or s.is_unused(i)
            vocabulary.append((s.id_to_piece(i), None if odd else score(s.get_score(i))))
            if s.is_byte(i):
                byte_ids[int(s.id_to_piece(i)[3:5], 16)] = i
            elif odd:
                special[i] = s.id_to_piece(i)
        return cls(vocabulary, byte_ids, special)

    @functools.cached_property
    def _begins(self) -> dict[str, tuple[int, int] | None]:
        """What pieces begin with: the piece of just these characters, or None.  An encoding by merges has no need of it."""
        return {p[:n]: self.ids.get(p[:n]) for p in self.ids for n in range(1, len(p) + 1)}

    def moves(self, text: str, at: int) -> list[tuple[int, int, int | None]]:
        """(length, score, piece) of each piece that begins at ``at``; an unknown character is piece None.

        Lengths are tried only as long as some piece begins so.
        """
        out, get = [], self._begins.get
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            hit = get(text[at:end], False)
            if hit is False:
                break
            if hit is not None:
                out.append((end - at, hit[1], hit[0]))
        if not out or out[0][0] != 1:
            out.append((1, self.unknown, None))
        return out

    def forward(self, text: str, entry: list[int], end: int):
        """(scores, pieces back) of each position, from the scores of the ways in; pieces begin before ``end``."""
        best = entry + [NEVER] * (len(text) + 1 - len(entry))
        back: list = [None] * (len(text) + 1)
        for at in range(end):
            now = best[at]
            if now > NEVER:
                for n, score, piece in self.moves(text, at):
                    if now + score > best[at + n]:
                        best[at + n], back[at + n] = now + score, (n, piece)
        return best, back

    def trace(self, text: str, back, at: int) -> tuple[list[int], int]:
        """(ids, way in) of the pieces that end at ``at``."""
        out = []
        while at > 0 and back[at] is not None:
            n, piece = back[at]
            out.append([piece] if piece is not None else [self.byte_ids[b] for b in text[at - n : at].encode()])
            at -= n
        return [i for ids in reversed(out) for i in ids], at

    def _best(self, text: str) -> tuple[list[int], int] | None:
        """(ids, score) of a stretch by the same rule as ``forward`` and ``trace``, in one plain loop; None if a character is no piece."""
        n, get, longest = len(text), self._begins.get, self.longest
        best, start, piece = [0] + [NEVER] * n, [0] * (n + 1), [0] * (n + 1)
        for at in range(n):
            now = best[at]
            if not get(text[at]):
                return None
            for end in range(at + 1, min(at + longest, n) + 1):
                hit = get(text[at:end], False)
                if hit:
                    score = now + hit[1]
                    if score > best[end]:
                        best[end], start[end], piece[end] = score, at, hit[0]
                elif hit is False:
                    break
        out, at = [], n
        while at:
            out.append(piece[at])
            at = start[at]
        return out[::-1], best[n]

    def stretch(self, text: str) -> tuple[bytes, int]:
        """(ids as int32 bytes, score) of a stretch between two cuts."""
        got = self._memory.get(text)
        if got is None:
            if len(text) == 1 and text not in self.ids:
                ids, score = [self.byte_ids[b] for b in text.encode()], self.unknown
            elif plain := self._best(text):
                ids, score = plain
            else:
                best, back = self.forward(text, [0], len(text))
                ids, score = self.trace(text, back, len(text))[0], best[-1]
            got = array("i", ids).tobytes(), score
            if len(text) <= SHORT:
                if len(self._memory) >= REMEMBERED:
                    self._memory.clear()
                self._memory[text] = got
        return got

    def _tables(self):
        """The trie of all pieces: (state of a first character, number of a later one, next states, ids, scores) by state; 0 is none."""
        if self._automaton is None:
            states = {p: k for k, p in enumerate(sorted(self._begins), 1)}
            later = {c: k for k, c in enumerate(sorted({p[-1] for p in states if len(p) > 1}), 1)}
            first, number = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int32)
            ids, scores = np.zeros(len(states) + 1, np.int32), np.full(len(states) + 1, NEVER, np.int64)
            follow = np.zeros((len(states) + 1, len(later) + 1), np.min_scalar_type(len(states)))
            for c, k in later.items():
                number[ord(c)] = k
            for p, k in states.items():
                if len(p) == 1:
                    first[ord(p)] = k
                else:
                    follow[states[p[:-1]], later[p[-1]]] = k
                if p in self.ids:
                    ids[k], scores[k] = self.ids[p]
            self._automaton = first, number, follow, ids, scores
        return self._automaton

    def learn(self, stretches: list[str], group: int = 8192) -> None:
        """Remembers the best segmentations of the short stretches among these that pieces can make up."""
        words = sorted((s for s in stretches if len(s) <= SHORT), key=len)
        first, number, follow, ids, scores = self._tables()
        for k in range(0, len(words), group):
            some = words[k : k + group]
            n, width = len(some), len(some[-1])
            length = np.array([len(w) for w in some])
            letter = np.frombuffer("".join([w.ljust(width, "\0") for w in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
            best = np.full((n, width + 1), NEVER, np.int64)
            start, piece = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
            best[:, 0] = 0
            for at in range(width):
                state = first[letter[:, at]]
                row = np.flatnonzero((state > 0) & (best[:, at] > NEVER) & (at < length))
                state, now = state[row], best[row, at]
                for end in range(at + 1, min(at + self.longest, width) + 1):
                    score = scores[state]
                    better = np.flatnonzero((score > NEVER) & (now + score > best[row, end]))
                    r = row[better]
                    best[r, end], start[r, end], piece[r, end] = now[better] + score[better], at, ids[state[better]]
                    if end == width:
                        break
                    state = follow[state, number[letter[row, end]]]
                    live = np.flatnonzero(state)
                    if not len(live):
                        break
                    row, state, now = row[live], state[live], now[live]
            total = best[np.arange(n), length]
            out, at, left = np.zeros((n, width), np.int32), length.copy(), np.full(n, width)
            row = np.flatnonzero(total > NEVER)
            while len(row):
                left[row] -= 1
                out[row, left[row]] = piece[row, at[row]]
                at[row] = start[row, at[row]]
                row = row[at[row] > 0]
            raw = out.tobytes()
            for i, (w, a, t) in enumerate(zip(some, left.tolist(), total.tolist(), strict=True)):
                if t > NEVER:
                    self._memory[w] = raw[4 * (i * width + a) : 4 * (i + 1) * width], t

    def many(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """``whole`` of each of some marked texts; their new stretches are solved together."""
        parts = [self._stretch.findall(t) for t in texts]
        every, memory, find = set().union(*parts), self._memory, self.stretch
        new = [p for p in every if p not in memory]
        if len(memory) + len(new) > REMEMBERED:  # what these texts have in common with earlier ones stays
            kept = {p: memory[p] for p in every if p in memory}
            memory.clear()
            memory.update(kept)
        self.learn(new)
        return [_together(ps, memory, find) for ps in parts]

    def whole(self, text: str) -> tuple[bytes, int]:
        """(ids as int32 bytes, score) of a marked text."""
        parts = self._stretch.findall(text)
        memory, find = self._memory, self.stretch
        return _together(parts, memory, find)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.texts[i] for i in ids]).decode("utf-8", "replace")[1:]

    # --- chunks of giant texts ---------------------------------------------------------------------------

    def middle(self, text: str, size: int) -> tuple[int, int]:
        """The first and last cut of a chunk that lie beyond all ways in and before its end; (size, size) if none."""
        cuts = [m.start() for m in self._stretch.finditer(text) if self.longest <= m.start() <= size]
        return (cuts[0], cuts[-1]) if cuts else (size, size)

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Transfer matrix of a chunk: ``text`` is the chunk's ``size`` characters and what follows, up to a piece less one."""
        width = self.longest
        a, b = self.middle(text, size)
        tail = self._ways_out(text, b, size)
        if a == size:  # no cut: all ways in at once
            best = np.full((len(text) + 1, width), NEVER, np.int64)
            for i in range(min(width, len(text) + 1)):
                best[i, i] = 0
            for at in range(size):
                for n, score, _ in self.moves(text, at):
                    np.maximum(best[at + n], best[at] + score, out=best[at + n])
            out = np.full((width, width), NEVER, np.int64)
            n = min(width, len(text) + 1 - size)
            out[:, :n] = best[size : size + n].T
            return np.maximum(out, NEVER)
        centre = self.many([text[a:b]])[0][1]
        head = np.array([self.forward(text[:a], [NEVER] * i + [0], a)[0][a] if i <= a else NEVER for i in range(width)], np.int64)
        return np.maximum(head[:, None] + centre + tail[None], NEVER)

    def _ways_out(self, text: str, start: int, size: int) -> np.ndarray:
        best, _ = self.forward(text[start:], [0], size - start)
        out = np.full(self.longest, NEVER, np.int64)
        got = best[size - start : size - start + self.longest]
        out[: len(got)] = got
        return out

    def ways_in(self, text: str, size: int, entry: list[int]) -> list[int]:
        """For each way out, the way in that its best segmentation comes from (-1: none)."""
        a, b = self.middle(text, size)
        if a == size:
            best, back = self.forward(text, entry, size)
            return [self.trace(text, back, size + j)[1] if size + j <= len(text) and best[size + j] > NEVER else -1 for j in range(self.longest)]
        _, back = self.forward(text[:a], entry, a)
        way = self.trace(text[:a], back, a)[1]
        return [way if x > NEVER else -1 for x in self._ways_out(text, b, size).tolist()]

    def chunk_ids(self, text: str, size: int, entry: list[int], out: int) -> bytes:
        """The ids of the pieces that begin in the chunk, on the way to one way out."""
        a, b = self.middle(text, size)
        if a == size:
            return np.array(self.trace(text, self.forward(text, entry, size)[1], size + out)[0], np.int32).tobytes()
        head, _ = self.trace(text[:a], self.forward(text[:a], entry, a)[1], a)
        tail, _ = self.trace(text[b:], self.forward(text[b:], [0], size - b)[1], size - b + out)
        return np.array(head, np.int32).tobytes() + self.many([text[a:b]])[0][0] + np.array(tail, np.int32).tobytes()


class Merges:
    """The encoding of a BPE model, by order of merges.  Cuts, byte pieces and decoding are those of its ``Pieces``."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.longest, self.decode = pieces, pieces.longest, pieces.decode
        self._memory: dict[str, tuple[bytes, int]] = {}
        symbols = {c: k for k, c in enumerate(sorted(set(pieces.ids) | {c for p in pieces.ids for c in p}), 1)}
        self._first = np.zeros(0x110000, np.int32)
        self._ids, self._scores = np.full(len(symbols) + 1, -1, np.int32), np.zeros(len(symbols) + 1, np.int64)
        for p, k in symbols.items():
            if len(p) == 1:
                self._first[ord(p)] = k
            if p in pieces.ids:
                self._ids[k], self._scores[k] = pieces.ids[p]
        # Ranks are dense, so that tables of them take half the room of scores; the last one stands for no piece.
        self._ranks = np.unique(-self._scores, return_inverse=True)[1].astype(np.int32)
        self._ranks[0] = self._last = self._ranks.max() + 1
        halves = [(symbols[p[:n]] * (len(symbols) + 1) + symbols[p[n:]], k) for p, k in symbols.items() if p in pieces.ids for n in range(1, len(p)) if p[:n] in symbols and p[n:] in symbols]
        halves.sort()
        self._pairs, self._merged = np.array([h[0] for h in halves] + [1 << 62], np.int64), np.array([h[1] for h in halves] + [0], np.int32)

    def _merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, rank) of each pair of neighbours; symbol 0 and the last rank where they make up no piece."""
        pair = left.astype(np.int64) * len(self._ids) + right
        at = np.searchsorted(self._pairs, pair)
        symbol = np.where(self._pairs[at] == pair, self._merged[at], 0)
        return symbol, self._ranks[symbol]

    def _result(self, symbols: list[str]) -> tuple[bytes, int]:
        ids, score, get = [], 0, self.pieces.ids.get
        for p in symbols:
            if hit := get(p):
                ids.append(hit[0])
                score += hit[1]
            else:  # only a character can be no piece
                ids += [self.pieces.byte_ids[b] for b in p.encode()]
                score += self.pieces.unknown
        return array("i", ids).tobytes(), score

    def plain(self, text: str) -> tuple[bytes, int]:
        """(ids as int32 bytes, score) of a marked text of any kind, with a queue of neighbours."""
        symbols, get = list(text), self.pieces.ids.get
        before, after = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        queue = [(-hit[1], k, 2) for k in range(len(text) - 1) if (hit := get(text[k : k + 2]))]
        heapq.heapify(queue)
        while queue:
            _, a, size = heapq.heappop(queue)
            b = after[a]
            # A pair is stale once either side has gone or grown.
            if not symbols[a] or b >= len(symbols) or len(symbols[a]) + len(symbols[b]) != size:
                continue
            symbols[a] += symbols[b]
            symbols[b] = ""
            after[a] = after[b]
            if after[a] < len(symbols):
                before[after[a]] = a
            for x, y in ((before[a], a), (a, after[a])):
                if x >= 0 and y < len(symbols) and (hit := get(symbols[x] + symbols[y])):
                    heapq.heappush(queue, (-hit[1], x, len(symbols[x]) + len(symbols[y])))
        return self._result([p for p in symbols if p])

    def learn(self, stretches: list[str], group: int = 8192) -> None:
        """Remembers the encodings of the short stretches among these whose characters are all pieces."""
        words = sorted((s for s in stretches if len(s) <= SHORT), key=len)
        for k in range(0, len(words), group):
            some = words[k : k + group]
            n, width = len(some), len(some[-1])
            letter = np.frombuffer("".join([w.ljust(width, "\0") for w in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
            length = np.array([len(w) for w in some])
            inside = np.arange(width) < length[:, None]
            # A last column of no symbol stands for what follows.
            symbol = np.hstack([np.where(inside, self._first[letter], 0), np.zeros((n, 1), np.int32)])
            whole = np.flatnonzero(((self._ids[symbol[:, :-1]] >= 0) | ~inside).all(axis=1))
            symbol, length, columns = symbol[whole], length[whole], np.arange(width + 1)
            merged, rank = self._merge(symbol[:, :-1], symbol[:, 1:])
            live = np.arange(len(whole))
            while len(live):
                at = rank[live].argmin(axis=1)
                go = rank[live, at] < self._last
                live, at = live[go], at[go]
                if not len(live):
                    break
                symbol[live, at] = merged[live, at]
                # What lies behind the merged pair moves up by one.
                moved = np.minimum(columns + (columns > at[:, None]), width)
                symbol[live] = np.take_along_axis(symbol[live], moved, axis=1)
                length[live] -= 1
                for table in (merged, rank):
                    table[live] = np.take_along_axis(table[live], np.minimum(moved[:, :-1], width - 1), axis=1)
                for left in (at - 1, at):
                    here = np.flatnonzero(left >= 0)
                    r, c = live[here], left[here]
                    merged[r, c], rank[r, c] = self._merge(symbol[r, c], symbol[r, c + 1])
            raw, scores = self._ids[symbol].tobytes(), self._scores[symbol].sum(axis=1)
            for i, (w, m, t) in enumerate(zip(whole.tolist(), length.tolist(), scores.tolist(), strict=True)):
                self._memory[some[w]] = raw[4 * i * (width + 1) : 4 * (i * (width + 1) + m)], t

    def stretch(self, text: str) -> tuple[bytes, int]:
        """(ids as int32 bytes, score) of a stretch between two cuts."""
        got = self._memory.get(text)
        if got is None:
            got = self.plain(text)
            if len(text) <= SHORT:
                if len(self._memory) >= REMEMBERED:
                    self._memory.clear()
                self._memory[text] = got
        return got

    def many(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """(ids as int32 bytes, score) of each of some marked texts; their new stretches are solved together."""
        parts = [self.pieces._stretch.findall(t) for t in texts]
        every, memory, find = set().union(*parts), self._memory, self.stretch
        new = [p for p in every if p not in memory]
        if len(memory) + len(new) > REMEMBERED:  # what these texts have in common with earlier ones stays
            kept = {p: memory[p] for p in every if p in memory}
            memory.clear()
            memory.update(kept)
        self.learn(new)
        return [_together(ps, memory, find) for ps in parts]

    def parts(self, before: str, text: str) -> tuple[str | None, str, str]:
        """(before the first cut, between the first and the last, behind the last) of a chunk, given the character before it; None, the text and nothing if it has no cut."""
        cuts = [m.start() - len(before) for m in self.pieces._stretch.finditer(before + text) if m.start() >= len(before)]
        return (text[: cuts[0]], text[cuts[0] : cuts[-1]], text[cuts[-1] :]) if cuts else (None, text, "")


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return np.maximum((a[:, :, None] + b[None]).max(axis=1), NEVER)


_loaded: dict[str, Pieces] = {}


def pieces_of(model: str) -> Pieces:
    """The vocabulary of a model file, loaded once in each worker."""
    if model not in _loaded:
        _loaded[model] = Pieces.load(model)
    return _loaded[model]


_merges: dict[str, Merges] = {}


def encoder_of(model: str, merges: bool = False) -> Pieces | Merges:
    """What encodes the texts, loaded once in each worker."""
    if not merges:
        return pieces_of(model)
    if model not in _merges:
        if not is_bpe(model):
            raise ValueError(f"{model} is not a BPE model: its pieces have no order of merges")
        _merges[model] = Merges(Pieces.load(model, ranks=True))
    return _merges[model]


def marked(text: str) -> str:
    """With the word mark before the first word; a space stands for it."""
    return " " + text if text else ""


def _short_batches(batches, model: str, keep: list[str], text: str, names: list[str], merges: bool = False):
    """The kept columns of batches of shorter texts, with ids and score."""
    pieces = encoder_of(model, merges)
    for rows in batches:
        so_far = np.cumsum(pc.fill_null(pc.utf8_length(column(rows, text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TOGETHER
        edges = [0, *(np.flatnonzero(np.diff(so_far)) + 1).tolist(), rows.num_rows]
        for at, end in itertools.pairwise(edges):
            some = rows.slice(at, end - at)
            texts = column(some, text).to_pylist()
            solved = iter(pieces.many([marked(t) for t in texts if t is not None]))
            found = [next(solved) if t is not None else None for t in texts]
            ends = np.cumsum([0, *(len(f[0]) // 4 if f else 0 for f in found)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(f[0] for f in found if f))])
            missing = pa.array([f is None for f in found], pa.bool_())
            ids = pa.ListArray.from_arrays(pa.array(ends), values, mask=missing)
            yield pa.RecordBatch.from_arrays([*(column(some, c) for c in keep), ids, pa.array([f[1] if f else None for f in found], pa.int64())], names=[*keep, *names])


def _decoded_batches(batches, model: str, ids: str, to: str):
    pieces = pieces_of(model)
    for rows in batches:
        texts = [pieces.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in column(rows, ids)]
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*rows.schema.names, to])


def _scan_long(chunks: DataFrame, model: str) -> DataFrame:
    """(row, ids, score) from (row, k, part, size): the chunks of giant texts with what follows each."""
    width = pieces_of(model).longest

    def matrices(frames):
        pieces = pieces_of(model)
        for f in frames:
            yield pd.DataFrame({"row": f["row"], "k": f["k"], "m": [pieces.matrix(t, n).tobytes() for t, n in zip(f["part"], f["size"], strict=True)]})

    def load(m) -> np.ndarray:
        return np.frombuffer(m, np.int64).reshape(width, width)

    def product(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        out = load(group["m"].iloc[0])
        for m in group["m"].iloc[1:]:
            out = plus(out, load(m))
        return pd.DataFrame({"row": [group["row"].iloc[0]], "g": [group["g"].iloc[0]], "m": [out.tobytes()]})

    def entries(group: pd.DataFrame, by: str, start: np.ndarray) -> pd.DataFrame:
        group = group.sort_values(by)
        vectors, v = [], start
        for m in group["m"]:
            vectors.append(v.tobytes())
            v = np.maximum((v[:, None] + load(m)).max(axis=0), NEVER)
        out = group[["row", by]].assign(entry=vectors)
        out["score"] = int(v[0])
        return out

    first = np.full(width, NEVER, np.int64)
    first[0] = 0

    def group_entries(group: pd.DataFrame) -> pd.DataFrame:
        return entries(group, "g", first)

    def chunk_entries(group: pd.DataFrame) -> pd.DataFrame:
        return entries(group, "k", np.frombuffer(group["start"].iloc[0], np.int64))[["row", "k", "entry"]]

    leaf = cut(chunks.select("row", "k", "part", "size").mapInPandas(frugal(matrices), "row long, k int, m binary").withColumn("g", F.expr(f"k div {GROUP}").cast("int")))
    grouped = leaf.groupBy("row", "g").applyInPandas(product, "row long, g int, m binary")
    starts = cut(grouped.groupBy("row").applyInPandas(group_entries, "row long, g int, entry binary, score long"))
    scores = starts.select("row", "score").distinct()
    entered = leaf.join(starts.select("row", "g", F.col("entry").alias("start")), ["row", "g"]).groupBy("row", "g").applyInPandas(chunk_entries, "row long, k int, entry binary")
    known = cut(chunks.join(entered, ["row", "k"]))

    def maps(frames):
        pieces = pieces_of(model)
        for f in frames:
            ways = [pieces.ways_in(t, n, np.frombuffer(e, np.int64).tolist()) for t, n, e in zip(f["part"], f["size"], f["entry"], strict=True)]
            yield pd.DataFrame({"row": f["row"], "k": f["k"], "ways": ways})

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k", ascending=False)
        outs, at = [], int(group["out"].iloc[0]) if "out" in group else 0
        for ways in group["ways"]:
            outs.append(at)
            at = int(ways[at])
        return group[["row", "k"]].assign(out=outs)

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        ways = None
        for w in group.sort_values("k", ascending=False)["ways"]:
            ways = list(w) if ways is None else [int(w[x]) if x >= 0 else -1 for x in ways]
        return pd.DataFrame({"row": [group["row"].iloc[0]], "k": [group["g"].iloc[0]], "ways": [ways]})

    mapped = cut(known.select("row", "k", "part", "size", "entry").mapInPandas(frugal(maps), "row long, k int, ways array<int>").withColumn("g", F.expr(f"k div {GROUP}").cast("int")))
    over_groups = mapped.groupBy("row", "g").applyInPandas(compose, "row long, k int, ways array<int>").groupBy("row").applyInPandas(follow, "row long, k int, out int").withColumnRenamed("k", "g")
    ways_out = mapped.join(over_groups, ["row", "g"]).groupBy("row", "g").applyInPandas(follow, "row long, k int, out int")

    def ids(frames):
        pieces = pieces_of(model)
        for f in (f[at : at + 64] for f in frames for at in range(0, len(f), 64)):
            found = [np.frombuffer(pieces.chunk_ids(t, n, np.frombuffer(e, np.int64).tolist(), o), np.int32) for t, n, e, o in zip(f["part"], f["size"], f["entry"], f["out"], strict=True)]
            yield pd.DataFrame({"row": f["row"], "k": f["k"], "ids": found})

    traced = known.join(ways_out, ["row", "k"]).select("row", "k", "part", "size", "entry", "out").mapInPandas(frugal(ids), "row long, k int, ids array<int>")
    # One row holds a text's ids as one row held the text.
    whole = traced.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.join(scores, "row")


def _merge_long(chunks: DataFrame, model: str) -> DataFrame:
    """(row, ids, score) from (row, k, before, part): the chunks of giant texts with the character before each."""

    def solve(frames):
        merges = encoder_of(model, True)
        for f in (f[at : at + 64] for f in frames for at in range(0, len(f), 64)):
            parts = [merges.parts(b, t) for b, t in zip(f["before"], f["part"], strict=True)]
            found = merges.many([p[1] if p[0] is not None else "" for p in parts])
            head = [p[1] if p[0] is None else p[0] for p in parts]
            yield pd.DataFrame({"row": f["row"], "k": f["k"], "cut": [p[0] is not None for p in parts], "head": head, "tail": [p[2] for p in parts], "ids": [np.frombuffer(x[0], np.int32) for x in found], "score": [x[1] for x in found]})

    def stretches(frames):
        merges = encoder_of(model, True)
        for f in frames:
            found = merges.many(f["stretch"].tolist())
            yield pd.DataFrame({"row": f["row"], "k": f["k"], "half": 1, "ids": [np.frombuffer(x[0], np.int32) for x in found], "score": [x[1] for x in found]})

    solved = cut(chunks.mapInPandas(frugal(solve), "row long, k int, cut boolean, head string, tail string, ids array<int>, score long"))
    # A head belongs to the last chunk before it that has a cut; the first chunk has one at its beginning.
    owner = F.last(F.when(F.col("cut"), F.col("k")), ignorenulls=True).over(Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    heads = solved.select("row", owner.alias("owner"), "k", F.col("head").alias("text")).where("owner is not null")
    tails = solved.where("cut").select("row", F.col("k").alias("owner"), "k", F.col("tail").alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "")
    open_ones = heads.union(tails).groupBy("row", F.col("owner").alias("k")).agg(joined.alias("stretch"))
    ends = open_ones.mapInPandas(frugal(stretches), "row long, k int, half int, ids array<int>, score long")
    every = solved.select("row", "k", F.lit(0).alias("half"), "ids", "score").union(ends)
    # One row holds a text's ids as one row held the text.
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "half", "ids"))), lambda x: x["ids"]))
    return every.groupBy("row").agg(ids.alias("ids"), F.sum("score").alias("score"))


def _chunks(giants: DataFrame, row: str, text: str, chunk: int, more: int) -> DataFrame:
    """(row, k, before, part, size): the chunks of marked texts, each cut off once; ``part`` goes on for ``more`` characters."""
    schema = pa.schema([("row", pa.int64()), ("k", pa.int32()), ("before", pa.string()), ("part", pa.string()), ("size", pa.int32())])

    def split(batches):
        for rows in batches:
            for number, t in zip(column(rows, row).to_pylist(), column(rows, text), strict=True):
                t = marked(t.as_py())
                for at in range(0, len(t), 64 * chunk):
                    ks = range(at, min(len(t), at + 64 * chunk), chunk)
                    yield batch(schema, [number] * len(ks), [k // chunk for k in ks], [t[max(0, k - 1) : k] for k in ks], [t[k : k + chunk + more] for k in ks], [min(chunk, len(t) - k) for k in ks])

    return giants.select(row, text).mapInArrow(frugal(split), "row long, k int, before string, part string, size int")


def _encode(docs: DataFrame, model: str, text: str, chunk: int, names: list[str], then, kind, merges: bool = False) -> DataFrame:
    """What ``then``, from batches to batches of the type ``kind``, makes of the encoded rows in the worker that encodes them."""
    keep = docs.columns
    width = pieces_of(model).longest
    longer = F.length(text) >= chunk
    short = docs.where(F.coalesce(~longer, F.lit(True))).mapInArrow(frugal(lambda batches: then(_short_batches(batches, model, keep, text, names, merges))), kind)
    row, found = unused(docs, "row", "found")
    giants = cut(docs.where(longer).withColumn(row, F.monotonically_increasing_id()))
    if giants.isEmpty():
        return short
    parts = cut(_chunks(giants, row, text, chunk, 0 if merges else width - 1).repartition("row", "k"))
    traced = _merge_long(parts.select("row", "k", "before", "part"), model) if merges else _scan_long(parts.select("row", "k", "part", "size"), model)
    traced = traced.select(F.col("row").alias(row), F.struct("ids", "score").alias(found))
    encoded = giants.join(traced, row).select(*keep, *(F.col(f"{found}.{c}").alias(n) for c, n in zip(("ids", "score"), names, strict=True)))
    return short.unionByName(encoded.mapInArrow(frugal(then), kind))


def _without(docs: DataFrame, text: str, names: list[str]) -> DataFrame:
    return docs.select(*(c for c in docs.columns if c == text or c.lower() not in {n.lower() for n in names}))


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", chunk: int = CHUNK, ids: str = "ids", score: str = "score", merges: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``score`` (long)."""
    docs = _without(docs, text, [ids, score])
    return _encode(docs, model, text, chunk, [ids, score], lambda batches: batches, wider(docs, **{ids: "array<int>", score: "long"}), merges)


def decode(encoded: DataFrame, model: str = MODEL, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the ids stand for; null ids give null."""
    encoded = _without(encoded, ids, [to])
    return encoded.mapInArrow(lambda batches: _decoded_batches(batches, model, ids, to), wider(encoded, **{to: "string"}))


def encode_and_decode(docs: DataFrame, model: str = MODEL, text: str = "text", chunk: int = CHUNK, ids: str = "ids", score: str = "score", to: str = "decoded") -> DataFrame:
    """``decode`` of ``encode``, in one pass."""
    docs = _without(docs, text, [ids, score, to])
    return _encode(docs, model, text, chunk, [ids, score], lambda batches: _decoded_batches(batches, model, ids, to), wider(docs, **{ids: "array<int>", score: "long", to: "string"}))


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, score, ids_crc32, round_trip) for every row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("score", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def scan(batches):
        pieces = pieces_of(model)
        for rows in batches:
            n, crc, same = [], [], []
            for ids, text in zip(column(rows, "ids"), column(rows, "text"), strict=True):
                x = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                n.append(len(x))
                crc.append(zlib.crc32(x.astype("<i4").tobytes()))
                same.append(pieces.decode(x.tolist()) == text.as_py() if ids.is_valid else None)
            yield batch(schema, column(rows, "doc_id"), n, column(rows, "score"), crc, same)

    return _encode(docs.select("doc_id", "text"), model, "text", CHUNK, ["ids", "score"], scan, "doc_id long, n_pieces long, score long, ids_crc32 long, round_trip boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
