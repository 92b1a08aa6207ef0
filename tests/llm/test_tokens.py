"""Packing, byte-level BPE and token files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from murmura.llm import best_fit, byte_bpe, huffman
from murmura.llm.word_tokens import ChunkTokenizer

ODD = "aBéÉΣİ'sſ 1²٣́\x1c\x85　\t.!<|endoftext|>日本\U0001f600ß‍H̱क़"


@pytest.fixture(scope="module")
def word(vocab):
    return Tokenizer.from_file(vocab.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def chunked(vocab):
    return ChunkTokenizer(vocab.path("word_bpe_49k.json"), limit=500)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ODD, max_size=20))
def test_chunks_are_the_whole(word, chunked, text):
    assert chunked.encode([text])[0].tolist() == word.encode(text, add_special_tokens=False).ids


MARKS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|end", "oftext|>", " ", "\n", "x", "É", "don't", "日本" * 50, "a" * 200, "."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(MARKS), max_size=8).map("".join))
def test_marks_in_texts_are_the_librarys(word, chunked, text):
    assert chunked.encode([text, "x" + text])[0].tolist() == word.encode(text, add_special_tokens=False).ids


def test_caches_are_bounded_in_bytes(word, chunked, bpe):
    """Long text without white space is encoded as the library does and not kept."""
    rng, theirs = random.Random(5), bpe[0]
    for _ in range(30):
        text = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(rng.choice([3, 40, 1000]))) for _ in range(10))
        assert chunked.encode([text])[0].tolist() == word.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe[1].encode(text), "<u4").tolist() == theirs.encode_ordinary(text)
    for cache in (chunked.cache, chunked.old, bpe[1].cache, bpe[1].old):
        assert max(map(len, cache), default=0) <= 64 and sum(map(len, cache)) <= 16 * 500 + 10_000


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aÉΣ日ßx\u0331²’”'.,;$ \n1", max_size=16), max_size=5), st.sampled_from([b"", b"\2\0"]))
def test_columns_are_the_librarys(word, chunked, texts, end):
    """What looks like letters before punctuation and isn't, in many texts at once."""
    texts = [*texts, "“word”, “word”. ΑΣ, x̱. " + "a" + "." * 30, "<|endoftext|>,"]
    plain = [np.array(word.encode(t, add_special_tokens=False).ids, "<u2").tobytes() + end for t in texts]
    assert chunked.encode_column(texts, end).to_pylist() == plain


def test_a_part_is_worked_on_once(vocab, monkeypatch):
    """Words with and without punctuation, however often: each word and each tail is learned once, alone."""
    tok, learned = ChunkTokenizer(vocab.path("word_bpe_49k.json")), []
    learn = tok.learn
    monkeypatch.setattr(tok, "learn", lambda chunks: (learned.extend(chunks), learn(chunks)))
    tok.encode_raw(["Rivers, lakes; rivers. École! École, lakes$$$ " * 500, "rivers... lakes\n" * 500])
    assert sorted(learned) == sorted(["rivers", "lakes", "École", "Rivers", ",", ";", ".", "!", "$$$", "..."])


@pytest.fixture(scope="module")
def bpe(vocab):
    ranks = byte_bpe.read_ranks(vocab.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Encoder(ranks, vocab.PATTERN, cache=200)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ODD + "theationing", max_size=40))
def test_bpe_is_tiktokens(bpe, text):
    theirs, ours = bpe
    assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode_ordinary(text)


def test_bpe_pieces(bpe):
    theirs, ours = bpe
    rng = random.Random(1)
    for _ in range(500):
        piece = bytes(rng.choice(b"abcdetinghsro -\xc3\xa9\xff") for _ in range(rng.randint(1, 40)))
        assert ours.machine.encode(piece) == theirs._encode_single_piece(piece)
    for long in (b"a" * 20_000, b"abcab" * 3_000, b" " * 9_000):
        assert ours.machine.encode(long) == theirs._encode_single_piece(long)
        assert max(map(len, ours.machine.stream(long, hold=256))) <= 256
    ours.machine.limit = 50  # the machine starts anew all the time
    mixed = bytes(rng.choice(b"abcdetinghsro\xc3\xa9") for _ in range(9_000))
    assert ours.machine.encode(mixed) == theirs._encode_single_piece(mixed) and len(ours.machine.content) < 9_000
    assert ours.machine.encode(b"reconsiderations") == theirs._encode_single_piece(b"reconsiderations")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=40), st.integers(1, 7))
def test_stream_gives_whole_characters(bpe, ids, step):
    vocab = bpe[1].machine.vocab
    stream = byte_bpe.Utf8Stream(vocab)
    parts = [stream.feed(ids[i : i + step]) for i in range(0, len(ids), step)] + [stream.close()]
    data = b"".join(vocab[i] for i in ids)
    assert b"".join(parts) == data
    assert "".join(p.decode("utf-8", "replace") for p in parts) == data.decode("utf-8", "replace")


def test_bpe_round_trip(spark, edge_docs, no_docs, vocab):
    ranks = vocab.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.recode(edge_docs, ranks, vocab.PATTERN).collect()
    assert len(rows) == edge_docs.count()
    texts = sorted((r["text"] or "").encode() for r in edge_docs.collect())
    assert sorted(bytes(r["data"]) for r in rows) == texts
    two = byte_bpe.decode(byte_bpe.encode(edge_docs, ranks, vocab.PATTERN), ranks, vocab.PATTERN)
    assert sorted(bytes(r["data"]) for r in two.collect()) == texts
    assert byte_bpe.recode(no_docs, ranks, vocab.PATTERN).count() == 0


def test_bpe_query(spark, data, docs, vocab, bpe):
    from murmura.llm.queries import op7_byte_bpe

    got = {r["doc_id"]: r for r in op7_byte_bpe(spark, data).collect()}
    for r in docs.collect():
        ids = np.array(bpe[0].encode_ordinary(r["text"]), "<u4")
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())


def pieces_are_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return by


def test_packing_query(spark, data, docs, word):
    from murmura.llm.queries import op6_best_fit

    rows = op6_best_fit(spark, data).collect()
    by = pieces_are_packed(rows, 4096)
    assert len(by) <= 1.1 * sum(r["length"] for r in rows) / 4096 + 1
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    expected = {}
    for r in docs.collect():
        ids = np.array(word.encode(r["text"], add_special_tokens=False).ids + [1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            expected[r["doc_id"], k] = (at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    assert got == expected


def test_packing_edges(spark, edge_docs, no_docs, vocab):
    path = vocab.path("word_bpe_49k.json")
    rows = best_fit.pack(edge_docs, path, capacity=64, end_id=1, open_bins=2, with_ids=True).collect()
    pieces_are_packed(rows, 64)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert sum(r["piece"] == 0 for r in rows) == edge_docs.count()
    assert best_fit.pack(no_docs, path).count() == 0


def test_packing_hardly_depends_on_the_tasks(spark, docs, vocab):
    path = vocab.path("word_bpe_49k.json")
    found = []
    for tasks in (1, 40):
        rows = best_fit.pack(docs.repartition(tasks, "doc_id"), path).collect()
        found.append(len(pieces_are_packed(rows, 4096)))
        least = -(-sum(r["length"] for r in rows) // 4096)
    assert least <= found[0] and found[1] <= max(1.06 * found[0], found[0] + 1)


def test_best_fit_against_scan():
    rng = random.Random(3)
    bins = best_fit.BestFit(100, 4)
    open_, fill, next_ = [], {}, 0
    for _ in range(2000):
        n = rng.randint(1, 100)
        fits = [(100 - fill[s], s) for s in open_ if 100 - fill[s] >= n]
        sequence, offset = bins.add(n)
        if fits:
            assert 100 - fill[sequence] == min(fits)[0]
        else:
            assert sequence == next_
            next_ += 1
            if n < 100:
                if len(open_) == 4:
                    fullest = max(fill[s] for s in open_)
                    gone = [s for s in open_ if fill[s] == fullest]
                    open_.remove(gone[-1] if len(gone) == 1 else next(s for s in gone if s not in [x for v in bins.held.values() for x in v]))
                open_.append(sequence)
            fill[sequence] = 0
        assert offset == fill[sequence]
        fill[sequence] += n
        if fill[sequence] == 100 and sequence in open_:
            open_.remove(sequence)
        assert sorted(x for v in bins.held.values() for x in v) == sorted(open_)


@pytest.mark.parametrize("n, limit", [(1, 20), (2, 20), (300, 9), (5000, 13), (5000, 20)])
def test_code(n, limit):
    rng = np.random.default_rng(n)
    counts = np.zeros(6000, np.int64)
    counts[rng.choice(6000, n, replace=False)] = (rng.pareto(0.5, n) + 1).clip(1, 1e8).astype(np.int64)
    lengths = huffman.code_lengths(counts, limit)
    used = lengths[counts > 0].astype(float)
    assert (lengths[counts == 0] == 0).all() and used.max() <= limit and (2.0**-used).sum() <= 1
    code, symbols = huffman.Code(lengths), np.flatnonzero(counts)
    for size in (1, 63, 64, 65, 1000):
        ids = rng.choice(symbols, size)
        words, marks = code.encode(ids)
        assert (code.decode(words, marks, size) == ids).all()
    raw = huffman.write_block(code, [5, 6], [ids[:1], ids[1:]])
    docs, sizes, back = huffman.read_block(code, raw)
    assert docs == [5, 6] and sizes.tolist() == [1, 999] and (back == ids).all()
    assert huffman.read_block(code, huffman.write_block(code, [None, 7], [ids[:1], ids[1:]]))[0] == [None, 7]
    with pytest.raises(ValueError):
        huffman.read_block(code, raw[:50] + bytes([raw[50] ^ 1]) + raw[51:])


def test_codes_are_made_in_small_pieces():
    """No array but the words has an element for each symbol, and pieces join without a gap."""
    import tracemalloc

    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5000, 1 << 18).astype(np.uint16)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=5000), 20))
    tracemalloc.start()
    words, marks = code.encode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * len(ids)
    assert (code.decode(words, marks, len(ids)) == ids).all()


def test_optimal_lengths():
    """Without a tight limit the code is as short as Huffman's."""
    import heapq

    counts = np.array([50, 1, 1, 7, 9, 200, 3])
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (huffman.code_lengths(counts, 20).astype(int) * counts).sum() == cost


def test_token_files(spark, data, docs, edge_docs, no_docs, word, vocab):
    from murmura.llm.queries import op10_huffman

    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op10_huffman(spark, data).collect()}
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = np.array(word.encode(r["text"], add_special_tokens=False).ids + [2], "<u4")
        assert got[r["doc_id"]] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = vocab.path("word_bpe_49k.json")
    hot = edge_docs.unionByName(spark.range(3000).selectExpr("if(id % 2 = 0, 7L, null) AS doc_id", "concat('again ', id) AS text"), allowMissingColumns=True)
    for table in (edge_docs, hot):  # ids that are null or repeat
        rows = huffman.read_ids(spark, huffman.write_ids(table, path, tokens_per_file=2000)).orderBy("start").collect()
        order = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
        assert order == sorted(order)
        at = 0
        for r in rows:
            assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            at += r["n_tokens"]
        plain = lambda doc, ids: (doc is None, doc, bytes(ids))
        asked = [plain(r["doc_id"], np.array(word.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for r in table.collect()]
        assert sorted(map(repr, asked)) == sorted(repr(plain(r["doc_id"], r["ids"])) for r in rows)
    assert huffman.read_ids(spark, huffman.write_ids(no_docs, path)).count() == 0
