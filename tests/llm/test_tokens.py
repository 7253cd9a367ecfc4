import random as rnd

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from loam.llm.arrays import utf8
from loam.llm.bpe import PATTERN, Merges, Pieces, held_pieces, load_ranks
from loam.llm.common import TOKENIZERS, WORD_VOCABULARY
from loam.llm.duck_bpe import DuckBpe, decode_bpe, encode_bpe, encode_and_decode
from loam.llm.huffman import Code, code_lengths, decode_bits, decode_blocks, encode_bits, huffman_blocks
from loam.llm.queries import QUERIES
from loam.llm.token_counts import count_tokens

ODD = ["", " ", "a", "  a  b ", "a\n b", "　x", "é" * 5, "don't we're", " \n\n x", "<|endoftext|>", "x" * 700, "ab" * 200, "漢字🎉", "a\x00b", "tab\t\ttab", "\r\n", "1234567 8", "ﬁ ﬂ", "x ", " x"]
ODD += ["'s", " 's", "a's't'tore''s \n's 'll'rev", "a'", "'r", "'re", "x\x1cy \x1f z", "a×b÷c ×", "“q” a “b", "\u2028 \u00a0 x", "a 漢 b 'tis I'd've", "abc" * 3000, "qzxw" * 400]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(WORD_VOCABULARY), special_tokens={}).encode_ordinary


def split(flat, counts):
    ends = np.cumsum(counts)
    return [flat[e - n : e].tolist() for e, n in zip(ends, counts)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_pieces_and_duckdb_equal_the_reference_encoder(name, texts):
    path = f"{TOKENIZERS}/{name}"
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary
    r = rnd.Random(3)
    odd = ["".join(r.choice("aabcdeestrn  ''\n\t.,!1234é×ñß漢“” \x1c🎉STD") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    some = ODD + odd + ["".join(r.choice("abcdefgs.=-") for _ in range(6000))] + list(texts.values())[:60]
    want = [encode(t) for t in some]
    columns = utf8(pa.array(some))
    assert split(*held_pieces(path).ids(*columns)) == want
    assert held_pieces(path).counts(*columns).tolist() == [len(w) for w in want]
    duck = DuckBpe(path, words_at_once=500)
    ids, n = duck.encode(*columns)
    assert split(ids, n) == want
    assert duck.decode(ids, n) == [t.encode() for t in some]


def test_duckdb_contracts_random_words_like_a_plain_loop():
    duck, random = DuckBpe(WORD_VOCABULARY), np.random.default_rng(1)
    words = [bytes(random.choice(list(b"aetnorsih ,"), int(random.integers(1, 30)))) for _ in range(300)]
    columns = np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)))
    flat, start = duck.merge(*columns)
    merges = Merges(load_ranks(WORD_VOCABULARY))
    pairs = merges.pairs
    assert all((x == y).all() for x, y in zip(merges.symbols(*columns), (flat, start)))
    assert all(merges.by_ranks(np.frombuffer(w, np.uint8)).tolist() == flat[a:b].tolist() for w, a, b in zip(words, start, start[1:]))
    for i, w in enumerate(words):
        ids = [merges.of_byte[b] for b in w]
        while True:
            ranks = [pairs.get(int(a) << 32 | int(b), 1 << 40) for a, b in zip(ids, ids[1:])]
            if not ranks or min(ranks) == 1 << 40:
                break
            at = ranks.index(min(ranks))
            ids[at : at + 2] = [min(ranks)]
        assert flat[start[i] : start[i + 1]].tolist() == ids


def test_forgetting_pieces_changes_nothing(texts, reference):
    merges = Merges(load_ranks(WORD_VOCABULARY))
    pairs = merges.pairs
    some = list(texts.values())[:40]
    for most in (10, 300):
        held = Pieces(merges.ranks, merges.symbols, most)
        assert [c for i in range(0, 40, 5) for c in held.counts(*utf8(pa.array(some[i : i + 5]))).tolist()] == [len(reference(t)) for t in some]


def test_a_vocabulary_whose_merges_make_lower_pairs():
    """Against a plain loop that merges one pair at a time."""
    r = rnd.Random(5)
    for _ in range(30):
        tokens = {bytes([b]): b for b in range(256)}
        more = list({"".join(r.choice("ab") for _ in range(r.randint(2, 5))).encode() for _ in range(14)})
        tokens.update({t: 256 + i for i, t in enumerate(more)})
        merges = Merges(tokens)
        pairs = merges.pairs
        words = ["".join(r.choice("aab") for _ in range(r.randint(1, 40))).encode() for _ in range(60)]
        flat, start = merges.symbols(np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words))))
        for w, a, b in zip(words, start, start[1:]):
            ids = [merges.of_byte[x] for x in w]
            while len(ids) > 1:
                ranks = [pairs.get(int(x) << 32 | int(y), 1 << 40) for x, y in zip(ids, ids[1:])]
                if min(ranks) == 1 << 40:
                    break
                at = ranks.index(min(ranks))
                ids[at : at + 2] = [min(ranks)]
            assert flat[a:b].tolist() == ids == merges.by_ranks(np.frombuffer(w, np.uint8)).tolist()


def test_count_query(spark, sf, texts, reference):
    got = {r.doc_id: r.n_tokens for r in QUERIES["op10_token_counts"](spark, sf).collect()}
    assert got == {i: len(reference(t)) for i, t in texts.items()}


def test_bpe_query(spark, sf, texts, reference):
    rows = QUERIES["op7_bpe"](spark, sf).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == {i: reference(t) for i, t in texts.items()}
    assert all(r.round_trip for r in rows)


def test_huffman_query(spark, sf, texts, reference):
    blocks = QUERIES["op8_huffman"](spark, sf).cache()
    got = {r.doc_id: list(r.ids) for r in decode_blocks(blocks).collect()}
    assert got == {i: reference(t) for i, t in texts.items()}
    assert all(r.round_trip for r in blocks.select("round_trip").collect())


def test_blocks_of_text_ids(spark, reference):
    df = spark.createDataFrame([("a", "one two"), (None, None), ("a", ""), ("b", "x" * 400)], "name string, body string")
    got = decode_blocks(huffman_blocks(df, block_ids=3, every=2, id_col="name", text_col="body")).collect()
    assert sorted(((r.doc_id, r.ids) for r in got), key=repr) == sorted([("a", reference("one two")), (None, None), ("a", []), ("b", reference("x" * 400))], key=repr)


def test_edges(spark, edge, empty, reference):
    order = lambda rows: sorted(((repr(i), x) for i, x in rows), key=repr)
    want = order((r.doc_id, None if r.text is None else reference(r.text)) for r in edge.collect())
    assert order((r.doc_id, r.n_tokens) for r in count_tokens(edge).collect()) == order((eval(i), None if x is None else len(x)) for i, x in want)
    encoded = encode_bpe(edge)
    assert order((r.doc_id, r.ids) for r in encoded.collect()) == want
    back = decode_bpe(encoded)
    assert order((r.doc_id, r.text) for r in back.collect()) == order((r.doc_id, r.text) for r in edge.collect())
    assert {r.round_trip for r in encode_and_decode(edge).collect()} == {True, None}
    blocks = huffman_blocks(edge, block_ids=50, every=7)
    assert order((r.doc_id, r.ids) for r in decode_blocks(blocks).collect()) == want
    for f in (count_tokens, encode_bpe, encode_and_decode):
        assert f(empty).count() == 0
    assert [r.block_id for r in huffman_blocks(empty).collect()] == [-1]
    assert decode_blocks(huffman_blocks(empty)).count() == 0
    assert decode_bpe(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0


def test_unknown_ids_are_errors():
    duck = DuckBpe(WORD_VOCABULARY)
    with pytest.raises(ValueError):
        duck.decode(np.array([10**6], np.int32), np.array([1]))
    code = Code(np.array([2, 2, 2], np.uint8))
    with pytest.raises(ValueError):
        decode_bits(b"\xff", 2, np.array([0]), 4, code)


def test_code_lengths_are_best_under_the_limit():
    import heapq

    random = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 30):
        counts = random.integers(1, 1000, n)
        lengths = code_lengths(counts, 16)
        heap = [(int(c), i, 0) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        cost = 0 if n > 1 else int(counts[0])
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), 0))
        assert int((lengths * counts).sum()) == cost
    skewed = 2 ** np.arange(20)
    for limit in (5, 6, 8):
        lengths = code_lengths(skewed, limit)
        assert lengths.max() <= limit and (0.5 ** lengths.astype(float)).sum() <= 1 + 1e-12
    assert code_lengths(np.array([0, 5, 0]), 16).tolist() == [0, 1, 0]
    assert code_lengths(np.zeros(0, int)).tolist() == []
    with pytest.raises(ValueError):
        code_lengths(np.ones(5, int), 2)
    # against all length-limited codes of four symbols
    from itertools import product

    counts = np.array([1, 2, 10, 40])
    best = min(sum(c * x for c, x in zip(counts, ls)) for ls in product(range(1, 3), repeat=4) if sum(0.5**x for x in ls) <= 1)
    assert int((code_lengths(counts, 2) * counts).sum()) == best


@pytest.mark.parametrize("every", [1, 3, 64])
def test_bits_come_back(every):
    random = np.random.default_rng(every)
    for n, symbols in ((0, 5), (1, 1), (1000, 3), (5000, 3000)):
        ids = np.minimum(random.geometric(0.01, n) - 1, symbols - 1)
        code = Code(code_lengths(np.bincount(ids, minlength=symbols), 16))
        payload, marks = encode_bits(ids, code.codes(), code.lengths, every)
        assert (decode_bits(payload, n, marks, every, code) == ids).all()
        k = len(marks) // 2  # a checkpoint is enough to start from
        if n and k:
            assert (decode_bits(payload, n - k * every, marks[k:], every, code) == ids[k * every :]).all()


def test_blocks_hold_whole_documents(spark, docs):
    blocks = huffman_blocks(docs, block_ids=3000).where(F.col("block_id") >= 0).collect()
    assert sum(len(b.doc_ids) for b in blocks) == docs.count() and len(blocks) > 3
    assert all(sum(b.doc_counts) == b.n_ids and b.n_ids - b.doc_counts[-1] < 3000 for b in blocks)
