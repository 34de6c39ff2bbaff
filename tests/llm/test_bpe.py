import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netsift.llm.bpe import Automaton, ByteBPE, default_path, load
from netsift.llm.codec import decoded, digests, encode_decode
from netsift.llm.token_counts import PrefixCounts, count_tokens
from tests.llm.fixtures import docs

PIECES = ["a", "aa", "aaa", " ", "  ", "\n", "e", "the", "\x1c", "\x85", "\xa0", "é", "日本", "👍", "<|endoftext|>", "<|endof", "'s", "'re", "12", "...", "\t", "\r\n", "　", "A", "\x00", "​", "İ", "ß", "﻿", "believ", "able"]


@pytest.fixture(scope="module")
def both():
    return load(default_path()), Tokenizer.from_file(default_path())


def same(both, text):
    mine, library = both
    ids = mine.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert mine.decode(ids) == library.decode(want, skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_pieces(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(both, text):
    same(both, text)


def test_long_words(both):
    rng = random.Random(3)
    for n in (100, 1000, 20000):
        same(both, "".join(rng.choice("abcdeilnorst") for _ in range(n)))
        same(both, "a" * n)
        same(both, "ab" * n)


def test_automaton_is_bpe_on_random_merges():
    """Against applying the merges one by one, over small alphabets where rules overlap."""
    rng = random.Random(11)
    for _ in range(150):
        tokens = [b"a", b"b", b"c"]
        merges = []
        for _ in range(12):
            a, b = rng.randrange(len(tokens)), rng.randrange(len(tokens))
            if tokens[a] + tokens[b] not in tokens and len(tokens[a] + tokens[b]) < 12:
                tokens.append(tokens[a] + tokens[b])
                merges.append((a, b, len(tokens) - 1))
        auto = Automaton(tokens, merges)
        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            last, count = auto.run(word)
            for end in range(1, len(word) + 1):
                want = [tokens.index(bytes([c])) for c in word[:end]]
                for a, b, ab in merges:
                    k = 0
                    while k < len(want) - 1:
                        if want[k] == a and want[k + 1] == b:
                            want[k : k + 2] = [ab]
                        k += 1
                assert (last[end], count[end]) == (want[-1], len(want))


def test_prefix_counts(both):
    mine, library = both
    rng = random.Random(4)
    cuts = [*PIECES, "<", "!", "'", "'ll", "'ve", "<|", "|>", " \n"]
    texts = ["".join(rng.choice(cuts) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    for text in ["foo<<|endoftext|>", "a <|endoftext|>", "a'<|endoftext|><|endoftext|> \n \n b", "<" * 300 + "<|endoftext|>", " " * 200 + "x" + "\n" * 100, *texts]:
        p, ids = PrefixCounts(mine, text), library.encode(text, add_special_tokens=False).ids
        assert p.total == len(ids)
        for k in range(len(text) + 1):
            assert p.at(k) == len(library.encode(text[:k], add_special_tokens=False).ids)
        for k in range(len(ids) + 1):
            assert text[: p.fit(k)] == mine.decode(ids[:k]).rstrip("�")


def test_counts_at_prefixes_encode_nothing(both, monkeypatch):
    mine, library = both
    text = "It's <<|endoftext|>   a \n\n longer text, they'll count; été 日本 " * 40
    p = PrefixCounts(mine, text)
    assert p.at(0) == 0 and p.fit(10) > 0
    want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(0, len(text), 7)]
    p.at(1)
    monkeypatch.setattr(Automaton, "run", None)
    assert [p.at(k) for k in range(0, len(text), 7)] == want


ROWS = [(1, "Hello  world's <|endoftext|>\n", "s"), (2, None, "s"), (3, "", None), (3, "", None), (None, "x" * 3000, "s"), (4, "été 日本 " * 400, "s")]


def test_codec_frames(spark, both):
    _, library = both
    got = sorted(map(tuple, encode_decode(docs(spark, ROWS)).withColumns(digests()).drop("ids").collect()), key=repr)
    want = []
    for i, t, _ in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, t or "", len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert encode_decode(docs(spark, [])).collect() == []


def test_count_frames(spark, both):
    _, library = both
    got = sorted((tuple(r)[:4] for r in count_tokens(docs(spark, ROWS)).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in ROWS]
    assert got == sorted(want, key=repr)
    assert count_tokens(docs(spark, [])).collect() == []


def test_many_words_are_encoded_together(both, monkeypatch):
    """Against the library, over more words than are kept; short ones take no pass each of their own."""
    _, library = both
    mine = ByteBPE(default_path())
    mine.automaton.words.most = 300
    rng = random.Random(8)
    made = ["".join(rng.choice("aeinorstlhdé日\x85") for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    texts = ["", *("".join(rng.choice([" ", " ", " ", "\n ", "  ", "", "'s ", ".", "<|endoftext|>"]) + rng.choice(made) for _ in range(rng.randint(0, 200))) for _ in range(60))]
    with monkeypatch.context() as m:
        m.setattr(Automaton, "_lasts", None)
        got = [np.frombuffer(x, np.int32).tolist() for x in mine.encode_all([t for t in texts if not any(len(w.encode()) > 32 for w in mine.split.findall(t))])]
        assert len(got) > 20
    texts += ["x" * 40 + " " + "日" * 70, "é" * 16]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert all(ids in want for ids in got)
    assert [np.frombuffer(x, np.int32).tolist() for x in mine.encode_all(texts)] == want


def test_decoded_lists(both):
    mine, library = both
    ids = [mine.encode("été <|endoftext|> 日本"), [], mine.encode("日")[:1], mine.encode(" a")]
    got = decoded(mine, pa.array(mine.labels, pa.large_binary()), pa.array(ids, pa.list_(pa.int32()))).to_pylist()
    assert got == [library.decode(x, skip_special_tokens=False) for x in ids]
    assert decoded(mine, pa.array(mine.labels, pa.large_binary()), pa.array([[], []], pa.list_(pa.int32()))).to_pylist() == ["", ""]
