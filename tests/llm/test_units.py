"""The parts of the operators by themselves."""

import io
import random

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegraph.llm.decontaminate import WindowIndex, _without
from tidegraph.llm.elias_fano import EliasFano
from tidegraph.llm.packing import Packer
from tidegraph.llm.simhash import _forest, _links, block_masks, fingerprint
from tidegraph.llm.token_files import TokenFile, file_bytes
from tidegraph.llm.tokens import encoder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano_gives_back_every_number(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    made = EliasFano.encode(values)
    again = EliasFano.from_parts(made.n, made.low_bits, *made.parts())
    assert again.all().tolist() == values.tolist()
    assert [again.select(k) for k in range(len(values))] == values.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=1500), st.data())
def test_elias_fano_decodes_any_stretch(steps, data):
    values = np.cumsum(np.array(steps, np.int64))
    made = EliasFano.encode(values)
    first = data.draw(st.integers(0, len(values)))
    last = data.draw(st.integers(first, len(values)))
    assert made.between(first, last).tolist() == values[first:last].tolist()
    value = data.draw(st.integers(-1, int(values[-1]) + 1))
    assert made.place_after(value, first) == max(first, int(np.searchsorted(values, value, side="right")))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 1000, 100_000))
    bits = 8 * sum(map(len, EliasFano.encode(values).parts()))
    assert bits / len(values) < 2 + np.log2(values[-1] / len(values)) + 0.6


def test_token_file_reads_one_document():
    ids = [np.arange(k, dtype="<u2").tobytes() for k in (0, 3, 700, 0, 1)]
    opened = TokenFile(io.BytesIO(b"".join(file_bytes(ids, [None, None, 5, 6, 9], 2))))
    assert [opened.ids(k).tolist() for k in range(5)] == [list(range(k)) for k in (0, 3, 700, 0, 1)]
    assert [opened.doc_id(k) for k in range(5)] == [None, None, 5, 6, 9]
    assert opened.start(3) == 703


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.text("aZé.,' \n\t\x1c\x85ß÷Σσ1İǅ́|<>endoftx", max_size=200))
def test_words_encode_like_the_whole_text(text):
    made = encoder(WORD_BPE)
    whole = made.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(made.encode(text), "<u2").tolist() == whole


def test_the_memory_of_words_is_bounded():
    made = encoder(WORD_BPE)
    made.known.clear()
    made.encode("x" * 100)
    assert not made.known
    limit, made.limit = made.limit, 3
    for k in range(20):
        made.encode(f"a{k}b c{k}d")
    assert len(made.known) <= 6
    made.limit = limit


@pytest.mark.parametrize("max_loss,max_segments", [(64, 100), (20, 100), (64, 3), (10, 2)])
def test_packer_keeps_all_limits(max_loss, max_segments):
    rng = random.Random(3)
    packer = Packer(1, 64, max_segments, max_loss, pool=16)
    examples = {k: (np.arange(n := rng.randint(1, 200), dtype="<u4") + 1000 * k, rng.randint(0, n)) for k in range(300)}
    for k, (ids, prompt) in examples.items():
        packer.add(k, ids, prompt)
    packer.finish()
    sequences, covered = {}, {k: [] for k in examples}
    for doc, start, length, ids, loss, total, sequence, offset in packer.rows:
        tokens, prompt = examples[doc]
        assert ids == tokens[start : start + length].tobytes() and total == len(tokens)
        assert loss == sum(p >= prompt for p in range(start, start + length))
        covered[doc] += range(start, start + length)
        sequences.setdefault(sequence, []).append((offset, length, loss))
    assert all(sorted(c) == list(range(len(examples[k][0]))) for k, c in covered.items())
    for pieces in sequences.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64 and len(pieces) <= max_segments and sum(x for *_, x in pieces) <= max_loss
    if (max_loss, max_segments) == (64, 100):
        assert all(sum(n for _, n, _ in p) & (sum(n for _, n, _ in p) - 1) == 0 for p in sequences.values())


def test_close_fingerprints_share_a_block():
    masks = block_masks(4, 7)
    assert len(masks) == 35
    rng = random.Random(1)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_links_of_long_and_short_runs_connect_alike():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (120, 3)).astype(np.uint64)
    prints = np.unique(base[rng.integers(0, 3, 120)] ^ flips[:, 0] ^ flips[:, 1])
    nodes = prints.view(np.int64)
    keys = np.zeros(len(nodes), np.int64)
    pairs = _links(keys, nodes, prints.reshape(-1, 1), 4, short=1000)
    tree = _links(keys, nodes, prints.reshape(-1, 1), 4, short=2)
    assert len(tree) < len(nodes) < len(pairs)
    joined = [brute.roots(nodes.tolist(), lambda a, b, s={tuple(x) for x in found.tolist()}: (a, b) in s or (b, a) in s) for found in (pairs, tree)]
    groups = [{frozenset(n for n in r if r[n] == root) for root in set(r.values())} for r in joined]
    assert groups[0] == groups[1]
    assert _forest(nodes[:1], prints[:1].reshape(-1, 1), 4) == []


def test_fingerprints_of_long_texts():
    text = " ".join(f"w{k % 97}" for k in range(3000))
    assert int(fingerprint(text.encode())[0]) == brute.fingerprint(text)
    assert fingerprint(None).tolist() == [0] and fingerprint(b" \n", 5, 4).tolist() == [0] * 4


def test_window_index_and_cutting():
    index = WindowIndex([("1", b"a b c d"), ("2", b"b c d e"), ("3", b"x")], 3)
    ids = np.array([index.words.get(w, 0) for w in b"z a b c d e z x".split()])
    hits = {(a, b, tuple(index.items[k] for k in own)) for a, b, own in index.scan(ids)}
    assert hits == {(1, 4, ("1",)), (2, 5, ("1", "2")), (3, 6, ("2",)), (7, 8, ("3",))}
    assert _without("Z, a b! c é d", [{"begin": 1, "end": 4}]) == "Z,   é d"


PLAIN = Tokenizer.from_file(WORD_BPE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "foo", "Bar.", ",", " ", "\n", "\x1c", "é", "Σ", "\u0301"]), max_size=12))
def test_markers_encode_like_the_library_does(pieces):
    text = "".join(pieces)
    assert np.frombuffer(encoder(WORD_BPE).encode(text), "<u2").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_a_marker_has_one_id():
    ids = np.frombuffer(encoder(WORD_BPE).encode("foo <|endoftext|> bar"), "<u2").tolist()
    assert ids == [23435, 49407, 2411]
