"""The registered queries against plain versions, over documents with every edge case."""

from collections import defaultdict

import brute
import public_tokenizers
import pytest
from brute import same
from tokenizers import Tokenizer

from tidegraph.llm.queries import QUERIES


@pytest.fixture(scope="module")
def encoded(doc_rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t, _, _ in doc_rows]


def test_op1(spark, tables, encoded):
    found = QUERIES["op1_token_files"](spark, tables).collect()
    ordered = sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id, r.start))
    start = 0
    for row in sorted(ordered, key=lambda r: r.start):
        assert row.start == start
        start += row.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in found], [(d, len(i) + 1, brute.crc([*i, 2])) for d, i in encoded])


def test_op2(spark, tables, encoded):
    found = QUERIES["op2_vector_packing"](spark, tables).collect()
    check_packing(found, [(d, [*i, 1]) for d, i in encoded], 2048)


def check_packing(found, documents, size):
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == size or at & (at - 1) == 0
    # Pieces of rows with equal ids cannot be told apart by row, so count them.
    by_id = defaultdict(list)
    for d, ids in documents:
        by_id[d].append(ids)
    pieces = defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
    assert set(by_id) == set(pieces)
    for d, texts in by_id.items():
        for r in pieces[d]:
            assert any(
                len(ids) == r.doc_tokens and brute.crc(ids[r.start : r.start + r.length]) == r.ids_crc32 for ids in texts
            )
        assert sum(r.length for r in pieces[d]) == sum(map(len, texts))
        covered = sorted(k for r in pieces[d] for k in range(r.start, r.start + r.length))
        assert covered == sorted(k for ids in texts for k in range(len(ids)))


def test_op3(spark, tables, doc_rows):
    found = QUERIES["op3_simhash"](spark, tables).select("doc_id", "fingerprint", "component_id").collect()
    expected = brute.simhash([(d, t) for d, t, _, _ in doc_rows])
    same(found, expected)
    assert len({c for _, _, c in expected}) < len(expected) - 30


def test_op4(spark, tables, doc_rows):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_words", "kept"]
    found = QUERIES["op4_line_frequency"](spark, tables).select(columns).collect()
    expected = brute.quality_rules([(d, t, s) for d, t, _, s in doc_rows])
    same(found, expected)
    assert any(n for *_, n, _ in expected)


def test_op5(spark, tables, doc_rows, items):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = QUERIES["op5_decontamination"](spark, tables).select(columns).collect()
    expected = brute.contaminated([(d, t) for d, t, _, _ in doc_rows], [tuple(r) for r in items.collect()])
    same(found, expected)
    assert 5 < sum(x[-1] for x in expected) < len(expected) / 2


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, no_tables, name):
    found = QUERIES[name](spark, no_tables).collect()
    # The conversation that op11 adds is there without any other.
    assert [r.conv_id for r in found] == [-1] if name == "op11_reply_trees" else found == []


def test_op7(spark, tables, doc_rows):
    found = QUERIES["op7_brown_scores"](spark, tables).collect()
    expected = brute.base_score([(d, t) for d, t, _, _ in doc_rows])
    assert len(found) == len(doc_rows)
    texts = defaultdict(list)
    for d, t, _, _ in doc_rows:
        texts[d].append(t)
    for r in found:
        held, n_tokens, n_known, train_tokens, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n_tokens, n_known, train_tokens)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in found if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op10(spark, tables, doc_rows):
    found = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, tables).collect()}
    langs = {d: lang for d, _, lang, _ in doc_rows}
    held = [d for d, r in found.items() if r.held_out and d is not None and d < 10_000]
    assert all(r.held_out == (brute.zlib.crc32(str(d).encode()) % 4 == 2) for d, r in found.items() if d is not None)
    assert sum(found[d].lang_pred == langs[d] for d in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {found[d].lang_pred for d in (10_000, 10_001, 10_002)} == {"und"}
    assert found[10_003].lang_pred != "und"
