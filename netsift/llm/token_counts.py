"""Token counts by prefix dynamic programming.

The automaton's pass over a word yields the exact token count of each of its
prefixes.  These counts are stored for every word of a text, with the sum of the
words before it, so the count at any prefix, and with it truncation and budget
questions, is looked up: nothing is encoded again.  Where a cut changes how words
are split (within a special string, a contraction or between white space), the
counts of that other split are stored beside them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.bpe import ByteBPE, default_path, load
from netsift.llm.common import release, table, texts_of

BATCH = 1024


#: Contractions of three characters: cut after two, they are an apostrophe and a letter.
SPLIT_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))


class PrefixCounts:
    """Exact token counts of the prefixes of one text, by code points."""

    def __init__(self, codec: ByteBPE, text: str):
        self.codec, self.text = codec, text
        self.words: list[str] = []
        self.counts: list[bytes | list[int]] = []  # of each word's prefixes
        #: Word -> counts after the first characters of it, where a cut there splits the words before it otherwise.
        self.others: dict[int, list[int]] = {}
        count, known = codec.automaton.prefix_word, codec.automaton.prefixes.get
        for k, piece in enumerate(codec.pieces(text)):
            if k % 2:
                self._special(piece)
            else:
                found = codec.split.findall(piece)
                counts = list(map(known, found))
                if None in counts:
                    counts = [count(w) if n is None else n for w, n in zip(found, counts, strict=True)]
                self.words += found
                self.counts += counts
        self.tokens = list(accumulate([n[-1] for n in self.counts], initial=0))  # before each word, and of all
        self._starts: list[int] | None = None
        self._spaced = False

    def _special(self, piece: str) -> None:
        """A special string is one token; cut within, it is ordinary text that the word before it may run into."""
        lead = self.words[-1] if self.words and self.words[-1] not in self.codec.special else ""
        if len(piece) > 1:
            part = PrefixCounts(self.codec, lead + piece[:-1])
            base = self.counts[-1][-1] if lead else 0
            self.others[len(self.words)] = [part.at(len(lead) + j) - base for j in range(1, len(piece))]
        self.words.append(piece)
        self.counts.append([0] * len(piece) + [1])

    @property
    def total(self) -> int:
        return self.tokens[-1]

    @property
    def starts(self) -> list[int]:
        if self._starts is None:
            self._starts = list(accumulate(map(len, self.words), initial=0))
        return self._starts

    def _between_spaces(self) -> None:
        """Stores what a cut right after the first character of white space behind white space counts: both are one word then."""
        special = self.codec.special
        for w in range(1, len(self.words)):
            before, word = self.words[w - 1], self.words[w]
            if word[0].isspace() and before.isspace() and word not in special and before not in special:
                self.others[w] = [self.codec.automaton.prefix_word(before + word[0])[-1] - self.counts[w - 1][-1]]
        self._spaced = True

    def at(self, chars: int) -> int:
        """Tokens of text[:chars], as it would be encoded on its own."""
        if not self._spaced:
            self._between_spaces()
        chars = max(0, min(chars, len(self.text)))
        w = bisect_left(self.starts, chars) - 1  # the word that holds the last of them
        if w < 0:
            return 0
        word, within = self.words[w], chars - self.starts[w]
        other = self.others.get(w)
        if other is not None and within <= len(other):
            return self.tokens[w] + other[within - 1]
        if within == 2 and word in SPLIT_CONTRACTIONS:
            return self.tokens[w] + 2
        return self.tokens[w] + self.counts[w][within]

    def fit(self, budget: int) -> int:
        """Code points of the longest prefix of at most budget tokens that ends where one of the text's tokens does."""
        if self.total <= budget:
            return len(self.text)
        w = bisect_right(self.tokens, budget) - 1
        word, left = self.words[w], budget - self.tokens[w]
        if word in self.codec.special or not left:
            return self.starts[w]
        end, size = 0, 0
        for token in self.codec.automaton.encode_word(word)[:left]:
            size += len(self.codec.automaton.tokens[token])
        end = len(word.encode()[:size].decode("utf-8", "ignore"))
        return self.starts[w] + end


def count_tokens(docs: DataFrame, budget: int = 512, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every row of docs.

    fit_chars: code points of the longest prefix that ends between tokens and has
    at most budget of them.  A null text counts as empty: 0 bytes, 0 tokens.
    Special strings within a text are one token each, as the library has it.
    Rows stay as they are, repeated ones too; empty input, no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                found = [(0, 0) if not t else ((p := PrefixCounts(codec, t)).total, p.fit(budget)) for t in part.column(1).to_pylist()]
                total = pa.array([x for x, _ in found], pa.int64())
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, total, pc.greater(total, budget), pa.array([x for _, x in found], pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])
        release()

    rows = texts_of(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars) of every document, of 512 tokens; nulls are empty."""
    return count_tokens(table(spark, sf_dir, "documents"))
