"""Byte-level BPE as a deterministic automaton built by successive merge gadgets.

The automaton reads tokens.  It starts with one state and an arc for each byte.
The merges are compiled in order; the gadget of merge (a, b) -> ab at time r

* adds an arc ab from every state that has an arc a whose target has an arc b,
* and splits the target of a: its new copy has no arc b.

So all arcs labelled t lead to one state, state(t).  state(ab) starts as state(b)
was at time r; state(a) from then on lacks b.  An arc u leaves a state unless one
of the tokens that u is built from, reading along its left edge, was cut there
while it stood at the front.  What remains accepts exactly the token sequences
that BPE produces, and of all ways to spell a byte string exactly one is accepted.

Encoding runs over positions: `spell` is a deterministic matcher over bytes
(longest token ending here, by failure links), `shorter` its chain of shorter
tokens, `arc` the transition test; at each position the only token whose arc
leaves the state of the prefix before it is kept.  All are tables; the transition
table is filled as pairs occur.  Prefix counts come with it.  Many words are taken
through the same tables together, position by position, as NumPy arrays.
"""

from __future__ import annotations

import gc
import json
import os
import re
from functools import lru_cache
from itertools import accumulate, compress
from operator import not_

import numpy as np
import regex

from netsift.llm.common import reside

#: The pre-tokenizer's pattern and its printable stand-ins for bytes, as the vocabulary file's format has them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r 0-9A-Za-z]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")  # PATTERN over ASCII
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
FOREVER = 1 << 60
#: Words whose encodings a worker keeps, pairs of tokens whose transitions it keeps, and steps by failure links.
WORDS_KEPT, ARCS_KEPT, STEPS_KEPT = 250_000, 500_000, 250_000
#: Words that are worth taking together, bytes of the longest of them, code points of texts whose words are, and places for transitions.
TOGETHER, LONGEST, AT_ONCE, PLACES = 64, 32, 1 << 20, 1 << 20


def _stand_ins() -> dict[str, int]:
    """Printable character -> byte."""
    shown = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Kept(dict):
    """At most some values by key, in two generations: what is asked for again outlives what is not."""

    __slots__ = ("most", "old")

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def again(self, key):
        """The value of a key of the older generation, which is kept anew; else None."""
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = value


class Automaton:
    """tokens: bytes of each id; merges: (left id, right id, new id) in order."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]):
        self.tokens = tokens
        n = len(tokens)
        born = [0] * n  # the time of the gadget that made a token; 0: a byte
        left, right = [-1] * n, [-1] * n
        cut: dict[int, int] = {}  # a << 20 | b -> time from which state(a) lacks b
        self.born, self.left, self.right, self.cut = born, left, right, cut
        for time, (a, b, ab) in enumerate(merges, 1):
            if not all(len(tokens[x]) == 1 or left[x] >= 0 for x in (a, b)) or not self._arc(a, b):
                continue  # no state has this pair of arcs: an earlier merge always takes one of them
            if left[ab] >= 0:
                raise ValueError(f"token {ab} has two merges")
            born[ab], left[ab], right[ab] = time, a, b
            cut[a << 20 | b] = time
        self.made = [i for i in range(n) if tokens[i] and (len(tokens[i]) == 1 or left[i] >= 0)]
        self._spelling()
        self.arcs: list[dict[int, bool]] = [{} for _ in range(n)]  # by token: does an arc of another leave its state
        self.room = ARCS_KEPT
        self.lengths = [len(t) for t in tokens]
        self.words: Kept = Kept(WORDS_KEPT)  # word -> ids, as bytes of int32
        self.prefixes: Kept = Kept(WORDS_KEPT)  # word -> counts

    def _spelling(self) -> None:
        """Failure-link matcher: step (state * 256 + byte -> state), longest token of a state, next shorter token."""
        step: dict[int, int] = {}
        token, depth = [-1], 1
        for t in self.made:
            s = 0
            for byte in self.tokens[t]:
                k = s << 8 | byte
                nxt = step.get(k)
                if nxt is None:
                    nxt = step[k] = depth
                    token.append(-1)
                    depth += 1
                s = nxt
            token[s] = t
        kids: dict[int, list[tuple[int, int]]] = {}
        for k, s in step.items():
            kids.setdefault(k >> 8, []).append((k & 255, s))
        fail, longest = [0] * depth, token[:]
        shorter = [-1] * len(self.tokens)
        queue = [s for _, s in kids.get(0, ())]
        for s in queue:
            for byte, nxt in kids.get(s, ()):
                f = fail[s]
                while f and (f << 8 | byte) not in step:
                    f = fail[f]
                fail[nxt] = step.get(f << 8 | byte, 0)
                queue.append(nxt)
            if token[s] >= 0:
                shorter[token[s]] = longest[fail[s]]
            else:
                longest[s] = longest[fail[s]]
        self.fail, self.longest, self.shorter = fail, longest, shorter
        keys = sorted(step)  # the same as arrays, for many words at a time
        self.keys = np.array([*keys, -1], np.int64)
        self.targets = np.array([step[k] for k in keys], np.int32)
        self.arrays = [np.array(x, np.int32) for x in (fail, longest, shorter, list(map(len, self.tokens)))]
        self.places = np.full(PLACES, -1, np.int64)  # by a hash of two tokens: both, and whether the arc is there
        self.step: list[dict[int, int]] = [{} for _ in range(depth)]  # by state: byte -> state
        for k, nxt in step.items():
            self.step[k >> 8][k & 255] = nxt
        self.detours = STEPS_KEPT

    def arc(self, t: int, u: int) -> bool:
        """Does an arc u leave state(t)?  Put into the table, which is emptied when it is full."""
        if not self.room:
            for row in self.arcs:
                row.clear()
            self.room = ARCS_KEPT
        self.room -= 1
        found = self.arcs[t][u] = self._arc(t, u)
        return found

    def _detour(self, state: int, byte: int) -> int:
        """The state after a byte that a state has no step for: by failure links, then put into the table while it has room."""
        s = state
        while (nxt := self.step[s].get(byte)) is None:
            s = self.fail[s]
        if self.detours:
            self.detours -= 1
            self.step[state][byte] = nxt
        return nxt

    def _arc(self, t: int, u: int) -> bool:
        front, until = [], FOREVER
        while u >= 0:  # tokens along u's left edge, each with the time at which it is merged away
            front.append((u, until))
            until, u = self.born[u], self.left[u]
        until = FOREVER
        while t >= 0:  # state(t) has the cuts of each token on its right edge while that was the last
            for y, gone in front:
                at = self.cut.get(t << 20 | y)
                # at the same time the left one of overlapping pairs is merged, so u's own merge comes too late
                if at is not None and at < until and at <= gone and at > self.born[t] and at > self.born[y]:
                    return False
            until, t = self.born[t], self.right[t]
        return True

    def run(self, word: bytes) -> tuple[list[int], list[int]]:
        """(last, count): the last token of the encoding of each prefix, and its number of tokens."""
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        step, longest, shorter, lengths, arcs = self.step, self.longest, self.shorter, self.lengths, self.arcs
        s = 0
        for end in range(1, n + 1):
            byte = word[end - 1]
            nxt = step[s].get(byte)
            s = self._detour(s, byte) if nxt is None else nxt
            t = longest[s]
            while True:
                begin = end - lengths[t]
                if begin == 0:
                    break
                ok = arcs[last[begin]].get(t)
                if ok is None:
                    ok = self.arc(last[begin], t)
                if ok:
                    break
                t = shorter[t]
            last[end], count[end] = t, count[begin] + 1
        return last, count

    def _lasts(self, word: bytes) -> list[int]:
        """The first half of run(word), for encoding alone."""
        last = [-1] * (len(word) + 1)
        step, longest, shorter, lengths, arcs = self.step, self.longest, self.shorter, self.lengths, self.arcs
        s = 0
        for end, byte in enumerate(word, 1):
            nxt = step[s].get(byte)
            s = self._detour(s, byte) if nxt is None else nxt
            t = longest[s]
            begin = end - lengths[t]
            while begin:
                ok = arcs[last[begin]].get(t)
                if ok is None:
                    ok = self.arc(last[begin], t)
                if ok:
                    break
                t = shorter[t]
                begin = end - lengths[t]
            last[end] = t
        return last

    def _steps(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The states after one byte each, by failure links where a state has no step."""
        out, todo = np.empty_like(state), np.arange(len(state))
        while len(todo):
            key = state.astype(np.int64) << 8 | byte
            at = np.searchsorted(self.keys[:-1], key)
            hit = self.keys[at] == key
            out[todo[hit]] = self.targets[at[hit]]
            todo, state, byte = todo[~hit], self.arrays[0][state[~hit]], byte[~hit]
        return out

    def _arcs(self, t: np.ndarray, u: np.ndarray) -> np.ndarray:
        """_arc of many pairs; a place that another pair has is computed and taken over."""
        pair = t.astype(np.int64) << 20 | u
        place = (pair * 0x9E3779B1 >> 16) & (PLACES - 1)
        found = self.places[place]
        lost = np.flatnonzero(found >> 1 != pair)
        if len(lost):
            new, back = np.unique(pair[lost], return_inverse=True)
            new = np.array([p << 1 | self._arc(p >> 20, p & 0xFFFFF) for p in new.tolist()], np.int64)[back]
            found[lost] = self.places[place[lost]] = new
        return (found & 1).astype(bool)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """encode_word of different words, none kept; few or long ones go one by one."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        short = np.flatnonzero(size <= LONGEST) if len(raw) >= TOGETHER else np.empty(0, np.int64)
        out = [b""] * len(raw)
        for k in np.setdiff1d(np.arange(len(raw)), short).tolist():
            out[k] = self._ids(raw[k])
        if not len(short):
            return out
        short = short[np.argsort(-size[short], kind="stable")]
        size, names = size[short], short.tolist()
        text, start = np.frombuffer(b"".join(map(raw.__getitem__, names)), np.uint8), np.cumsum(size) - size
        _, longest, shorter, lengths = self.arrays
        last = np.full((size[0] + 1, len(short)), -1, np.int32)
        state = np.zeros(len(short), np.int32)
        for end in range(1, size[0] + 1):
            n = int(np.searchsorted(-size, -end, side="right"))  # words with so many bytes
            state = self._steps(state[:n], text[start[:n] + end - 1])
            token = longest[state]
            begin = end - lengths[token]
            todo = np.flatnonzero(begin)
            while len(todo):
                todo = todo[~self._arcs(last[begin[todo], todo], token[todo])]
                token[todo] = shorter[token[todo]]
                begin[todo] = end - lengths[token[todo]]
                todo = todo[begin[todo] > 0]
            last[end, :n] = token
        found, at, end = [], np.arange(len(short)), size.copy()
        while len(at):
            token = last[end[at], at]
            found.append((at, token))
            end[at] -= lengths[token]
            at = at[end[at] > 0]
        at, token = (np.concatenate(x[::-1]) for x in zip(*found, strict=True))
        flat, stops = token[np.argsort(at, kind="stable")].tobytes(), (4 * np.cumsum(np.bincount(at))).tolist()
        lo = 0
        for k, hi in zip(names, stops, strict=True):
            out[k] = flat[lo:hi]
            lo = hi
        return out

    def _ids(self, raw: bytes) -> bytes:
        last, lengths = self._lasts(raw), self.lengths
        ids, end = [], len(raw)
        while end:
            ids.append(last[end])
            end -= lengths[last[end]]
        return np.array(ids[::-1], np.int32).tobytes()

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word; kept for the next time."""
        found = self.words.get(word) or self.words.again(word)
        if found is None:
            found = self._ids(word.encode())
            if len(word) <= 64:
                self.words.keep(word, found)
        return np.frombuffer(found, np.int32).tolist()

    def prefix_word(self, word: str) -> bytes | list[int]:
        """Tokens of each prefix of one pre-split word, by code points from none on; kept for the next time."""
        found = self.prefixes.get(word) or self.prefixes.again(word)
        if found is None:
            raw = word.encode()
            counts = self.run(raw)[1]
            if len(raw) != len(word):
                counts = [counts[end] for end in accumulate(map(_width, word), initial=0)]
            found = bytes(counts) if counts[-1] < 256 else counts
            if len(word) <= 64:
                self.prefixes.keep(word, found)
        return found


def _width(char: str) -> int:
    """Bytes of a code point in UTF-8."""
    return 1 + (char > "\x7f") + (char > "\u07ff") + (char > "\uffff")


class ByteBPE:
    """A byte-level vocabulary file: automaton, splitting pattern and special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        byte_of = _stand_ins()
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for text, i in vocab.items():
            if text not in special:
                tokens[i] = bytes(byte_of[c] for c in text)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.automaton = Automaton(tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.labels = tokens[:]
        for text, i in special.items():
            self.labels[i] = text.encode()
        self.special = special
        self.special_ids = {text: np.array([i], np.int32).tobytes() for text, i in special.items()}
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def pieces(self, text: str):
        """Alternately ordinary text and special strings."""
        return self.cut.split(text) if self.cut and any(x in text for x in self.special) else (text,)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self._packed([text])[0], np.int32).tolist()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of int32.  Words that are not kept are encoded together, over bounded parts of texts."""
        out: list[bytes] = []
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= AT_ONCE:
                out += self._packed(part)
                part, size = [], 0
        return out + self._packed(part)

    def _packed(self, texts: list[str]) -> list[bytes]:
        kept = self.automaton.words
        found: list[tuple[list[str], list[bytes | None]]] = []  # of each text: words, and the ids of those that are kept
        lost: dict[str, bytes] = {}
        for text in texts:
            words: list[str] = []
            parts: list[bytes | None] = []
            for k, piece in enumerate(self.pieces(text)):
                if k % 2:
                    words.append(piece)
                    parts.append(self.special_ids[piece])
                else:
                    some = (PLAIN if piece.isascii() else self.split).findall(piece)
                    words += some
                    parts += map(kept.get, some)
            if None in parts:
                lost.update(dict.fromkeys(compress(words, map(not_, parts)), b""))
            found.append((words, parts))
        new = []
        for word in lost:
            ids = kept.again(word)
            if ids is None:
                new.append(word)
            else:
                lost[word] = ids
        for word, ids in zip(new, self.automaton.encode_words(new), strict=True):
            lost[word] = ids
            if len(word) <= 64:
                kept.keep(word, ids)
        return [b"".join([p or lost[w] for w, p in zip(words, parts, strict=True)] if None in parts else parts) for words, parts in found]

    def decode(self, ids: list[int]) -> str:
        """Arc labels one after another; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


def load(path: str) -> ByteBPE:
    """One automaton a process and file, until another operator works there."""
    reside("bpe", _loaded.cache_clear)
    before = _loaded.cache_info().misses
    found = _loaded(path)
    if _loaded.cache_info().misses > before:
        gc.collect()
        gc.freeze()  # the collector need not look through the tables again and again
    return found


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
