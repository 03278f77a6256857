"""Segmentation of marked words into pieces by dynamic programming over a trie of distinct words.

A marked word is a run of the space mark followed by other characters; no piece holds a mark after
another character, so words are segmented by themselves. Distinct words are sorted, which walks
their trie depth-first: what was computed for a prefix stays on a stack and is used again by all
words that share it, and each terminal keeps its result.

Both kinds of models run Viterbi over the same trie, keeping the forward score of each prefix and the
last piece of its best path; they differ in the edges of the lattice:

* unigram models: every piece is an edge;
* BPE models: a piece is an edge only if its pair with the last piece of the path before merges back
  into just these two. Greedy merging of a prefix is merging of a shorter prefix plus one such piece,
  and exactly one ends at each prefix (tested), so the search for edges ends with the first. Without
  this rule the paths of highest score over the merge ranks are not what such a model's encoder
  gives; with it they are.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Callable, Iterable
from typing import TypeVar

import numpy as np
import pyarrow as pa

from loomspark.llm.common import Memo, byte_sizes, not_single_spaced, ragged, words

T = TypeVar("T")
MARK = "▁"
#: Words that a worker's memo may hold; it starts anew beyond.
MEMO = 1_000_000
#: Pairs of pieces that a worker remembers.
PAIRS = 150_000
#: Words of more characters keep no values of their prefixes.
LONG = 64
UNIGRAM, BPE = 1, 2
_WORD = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")


def _fields(raw: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    out, i = [], 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while i < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            out.append((key >> 3, varint()))
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            out.append((key >> 3, raw[i : i + n]))
            i += n
    return out


class Pieces:
    """A piece table: scores and ids by piece, and how unknown characters are spelt."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], kind: int, bytes_at: list[int] | None = None, unk: int = 0):
        self.scores, self.ids, self.kind, self.bytes_at, self.unk = scores, ids, kind, bytes_at, unk
        self.longest = max(map(len, scores), default=1)
        self.worst = min(scores.values(), default=0.0) - 10.0
        self.pairs: dict[tuple[str, str], bool] = {}
        self._suffixes: dict[str, bool] | None = None

    def spell(self, piece: str) -> list[int]:
        """Ids of a piece; of a character outside the table, its bytes' ids or the unknown id."""
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes_at[b] for b in piece.encode()] if self.bytes_at else [self.unk]

    def merge(self, word: str) -> list[str]:
        """Greedy merging from single characters: the best-scored adjacent pair first, the leftmost of equals."""
        n, scores = len(word), self.scores
        part: list[str | None] = list(word)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def push(i: int) -> None:
            j = right[i]
            if j < n:
                s = scores.get(part[i] + part[j])
                if s is not None:
                    heapq.heappush(heap, (-s, i, part[i] + part[j]))

        for i in range(n):
            push(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if part[i] is None or right[i] >= n or part[i] + part[right[i]] != both:
                continue
            j = right[i]
            part[i], part[j] = both, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            push(i)
            if left[i] >= 0:
                push(left[i])
        return [p for p in part if p is not None]

    def suffixes(self) -> dict[str, bool]:
        """Every suffix of a piece: whether it is itself a piece that merging its characters gives."""
        if self._suffixes is None:
            out: dict[str, bool] = {}
            for p in self.scores:
                for i in range(len(p)):
                    out.setdefault(p[i:], False)
                out[p] = self.merge(p) == [p]
            self._suffixes = out
        return self._suffixes

    def segment(self, words: Iterable[str], code: Callable[[str], T], zero: T) -> dict[str, T]:
        """For each distinct word the sum of code(piece) over its pieces, from zero on: code may give ids as bytes, lists or counts."""
        if self.kind == BPE:
            forward = self._forward_bpe
            self.suffixes()
        else:
            forward = self._forward_unigram
        codes = _Codes(code)
        out, before = {}, ""
        last, best, value = [""], [0.0], [zero]  # by length of the prefix: its last piece, score and value
        for w in sorted(words):
            if self.kind == BPE and w.count(MARK) > 1:  # runs of marks have pieces of equal score
                out[w] = _sum([codes[p] for p in self.merge(w)], zero)
                continue
            if len(w) > LONG:  # values of all its prefixes would grow with the square of its length
                ends = [""]
                forward(w, ends, [0.0], [0], _Codes(lambda p: 0))
                parts, i = [], len(w)
                while i:
                    parts.append(codes[ends[i]])
                    i -= len(ends[i])
                out[w] = _sum(parts[::-1], zero)
                continue
            k, n = 0, min(len(w), len(before))
            if before[:6] == w[:6]:
                k = min(6, n)
            while k < n and w[k] == before[k]:
                k += 1
            del last[k + 1 :], value[k + 1 :], best[k + 1 :]
            forward(w, last, best, value, codes)
            before = w
            out[w] = value[-1]
        return out

    def _forward_bpe(self, w: str, last: list[str], best: list[float], value: list, codes: dict) -> None:
        """The only edge that ends at each prefix, its forward score and value."""
        suffixes, pairs, scores = self._suffixes, self.pairs, self.scores
        for i in range(len(last), len(w) + 1):
            j = at = i - 1
            found = w[j]
            while j > 0:
                j -= 1
                t = w[j:i]
                ends = suffixes.get(t)
                if ends is None:
                    break
                if ends:
                    if j:
                        pair = last[j], t
                        fits = pairs.get(pair)
                        if fits is None:
                            if len(pairs) > PAIRS:
                                pairs.clear()
                            fits = pairs[pair] = self.merge(last[j] + t) == [last[j], t]
                        if not fits:
                            continue
                    found, at = t, j
                    break
            last.append(found)
            best.append(best[at] + scores.get(found, self.worst))
            value.append(value[at] + codes[found])

    def _forward_unigram(self, w: str, last: list[str], best: list[float], value: list, codes: dict) -> None:
        """An unknown character costs more than any piece; of equal scores the longest last piece wins."""
        scores, longest = self.scores, self.longest
        for i in range(len(last), len(w) + 1):
            at, top = i - 1, best[i - 1] + scores.get(w[i - 1], self.worst)
            for j in range(i - 2, max(-1, i - longest - 1), -1):
                s = scores.get(w[j:i])
                if s is not None and best[j] + s >= top:
                    at, top = j, best[j] + s
            last.append(w[at:i])
            best.append(top)
            value.append(value[at] + codes[w[at:i]])


def _sum(values: list, zero: T) -> T:
    if isinstance(zero, bytes):
        return b"".join(values)
    for v in values:
        zero = zero + v
    return zero


class _Codes(dict):
    """Codes of pieces, made when first needed."""

    def __init__(self, code: Callable):
        self.code = code

    def __missing__(self, piece: str):
        x = self[piece] = self.code(piece)
        return x


class Encoder:
    """Ids of whole texts under a sentencepiece model file, and texts of ids."""

    _loaded: dict[str, "Encoder"] = {}

    @classmethod
    def load(cls, path: str) -> "Encoder":
        """One encoder per worker and file, so that its memos outlive a task."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=os.fspath(path))
        model = _fields(sp.serialized_model_proto())
        trainer = dict(_fields(next((v for k, v in model if k == 2), b"")))
        rules = dict(_fields(next((v for k, v in model if k == 3), b"")))
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError("only models without a character map that keep all white space are supported")
        self.prefix = MARK if rules.get(3, 1) else ""
        every = range(sp.vocab_size())
        plain = [i for i in every if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {sp.id_to_piece(i): i for i in plain}
        spelt = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        self.pieces = Pieces({sp.id_to_piece(i): sp.get_score(i) for i in plain}, ids, trainer.get(3, UNIGRAM), [spelt[b] for b in range(256)] if len(spelt) == 256 else None, max(0, sp.unk_id()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in ids):
            raise ValueError("a piece reaches across words")
        self.dtype = np.dtype("<u2" if len(every) <= 1 << 16 else "<u4")
        back = {i: bytes([b]) for b, i in spelt.items()} | {i: p.replace(MARK, " ").encode() for p, i in ids.items()}
        self.back = [back.get(i, b" \xe2\x81\x87 " if sp.is_unknown(i) else b"") for i in every]
        self.memos: dict[str, Memo] = {}

    def code(self, piece: str) -> bytes:
        return np.array(self.pieces.spell(piece), self.dtype).tobytes()

    def marked(self, text: str) -> list[str]:
        """The text's marked words."""
        if not text:
            return []
        if self.prefix and MARK not in text and "  " not in text and text[0] != " ":
            return [MARK + w for w in text.split(" ")]
        return _WORD.findall(self.prefix + text.replace(" ", MARK))

    def _parts(self, texts: list[str | None] | pa.Array, kind: str) -> tuple[list[str | None], np.ndarray, Memo, np.ndarray, np.ndarray]:
        """The texts, which of them are to be taken one by one, and for the words of the others a memo that holds them, their places in it and their texts."""
        a = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        w = words(a, b" ")
        odd = not_single_spaced(w, byte_sizes(a))
        mark = np.flatnonzero((w.buf[:-2] == 0xE2) & (w.buf[1:-1] == 0x96) & (w.buf[2:] == 0x81))
        doc = w.doc_of()
        if not self.prefix:
            odd[:] = True
        elif len(mark):
            odd[doc[np.searchsorted(w.start, mark, "right") - 1]] = True
        use = np.flatnonzero(~odd[doc])
        memo = self.memos.get(kind)
        if memo is None or len(memo.hashes) > MEMO:
            memo = self.memos[kind] = Memo(self.dtype)
        distinct, at, back = np.unique(w.hashes[use], return_index=True, return_inverse=True)
        new = np.flatnonzero(memo.find(distinct) < 0)
        if len(new):
            raw = w.buf.tobytes()
            said = [MARK + raw[i:j].decode() for i, j in zip(w.start[use[at[new]]].tolist(), w.end[use[at[new]]].tolist())]
            if kind == "ids":
                got = self.pieces.segment(set(said), self.code, b"")
                runs = [got[x] for x in said]
                memo.add(distinct[new], np.frombuffer(b"".join(runs), self.dtype), np.array([len(x) // self.dtype.itemsize for x in runs], np.int32))
            else:
                got = self.pieces.segment(set(said), lambda p: len(self.pieces.spell(p)), 0)
                memo.add(distinct[new], np.zeros(0, self.dtype), np.array([got[x] for x in said], np.int32))
        return a, odd, memo, memo.find(distinct)[back], doc[use]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        a, odd, memo, place, doc = self._parts(texts, "ids")
        n = memo.n[place].astype(np.int64)
        total = np.bincount(doc, n, len(a)).astype(np.int64)
        out = np.split(memo.ids[ragged(memo.at[place], n)], np.cumsum(total)[:-1]) if len(a) else []
        for i in np.flatnonzero(odd).tolist():
            said = self.marked(a[i].as_py() or "")
            got = self.pieces.segment(set(said), self.code, b"")
            out[i] = np.frombuffer(b"".join(got[x] for x in said), self.dtype)
        return out

    def count(self, texts: list[str | None] | pa.Array) -> list[tuple[int, int]]:
        """Ids and marked words of each text, from the counts kept at the trie's terminals."""
        a, odd, memo, place, doc = self._parts(texts, "counts")
        total, n = np.bincount(doc, memo.n[place], len(a)).astype(np.int64), np.bincount(doc, minlength=len(a))
        for i in np.flatnonzero(odd).tolist():
            said = self.marked(a[i].as_py() or "")
            got = self.pieces.segment(set(said), lambda p: len(self.pieces.spell(p)), 0)
            total[i], n[i] = sum(got[x] for x in said), len(said)
        return list(zip(total.tolist(), n.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        text = b"".join([self.back[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text
