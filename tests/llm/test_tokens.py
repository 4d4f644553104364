"""Streaming BPE and token counts against the libraries."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from arborspark.llm import bpe_stream, token_counts

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["e", "st", "th", "ing", " ", "  ", "\n", "'s", "'", "É", "ß", "İ", "Σ", "\x1c", "\x85", "​", "　", "日本", "😀", "½", "३", "<|endoftext|>", "<s>", "▁", "!!", "%", "12", "\0", "é"]


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_encode_and_decode_as_the_library():
    lib, own = Tokenizer.from_file(WORD), bpe_stream.WordBPE(WORD)
    for t in texts(1500):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode_tokens(ids) == lib.decode(ids, skip_special_tokens=False)


def test_long_words_are_streamed(monkeypatch):
    lib, own = Tokenizer.from_file(WORD), bpe_stream.WordBPE(WORD)
    r = random.Random(2)
    for n in (100, 6_000, 20_000):
        word = "".join(r.choice("etaoinshr") for _ in range(n))
        assert [*own.word_ids(word)] == lib.encode(word, add_special_tokens=False).ids
    for lookahead in (own.merger.lookahead,):
        assert 1 < lookahead < 20_000


def test_sufficient_lookahead_of_small_lists():
    assert bpe_stream.sufficient_lookahead([]) == 1
    assert bpe_stream.sufficient_lookahead([("a", "b")]) >= 2
    assert bpe_stream.sufficient_lookahead([("a", "b"), ("b", "c"), ("c", "d")]) >= bpe_stream.sufficient_lookahead([("a", "b")])


def test_decoding_gives_characters_when_complete():
    own = bpe_stream.WordBPE(WORD)
    ids = own.encode("naïve 日本 😀")
    pieces = [*own.decode_text(iter(ids))]
    assert "".join(pieces).split() == ["naïve", "日本", "😀"]
    assert "�" not in "".join(pieces)


def test_encode_table(spark, docs, none):
    lib = Tokenizer.from_file(WORD)
    got = bpe_stream.encode_digests(docs, WORD).collect()
    want = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    assert len(got) == len(want)
    made = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    exact = []
    for i, t in want:
        ids = lib.encode(t, add_special_tokens=False).ids
        exact.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    assert made == sorted(exact)
    assert bpe_stream.encode_digests(none, WORD).count() == 0
    back = bpe_stream.decode_documents(bpe_stream.encode_documents(docs.where("doc_id = 1"), WORD), WORD).first()
    assert back["text"].split()[:2] == ["hello", "there"]


def test_token_counts_as_the_library(spark, docs, none):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert token_counts.boundaries_hold(PIECE)
    extra = spark.createDataFrame(enumerate(texts(300, 5), 100), "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(both, PIECE).collect())
    want = []
    for r in both.collect():
        t = r["text"] or ""
        n = len(lib.encode(t))
        want.append((r["doc_id"] or -1, len(t.encode()), n, n > 4096))
    assert got == sorted(want)
    assert token_counts.count_tokens(none, PIECE).count() == 0


def test_token_counts_with_a_small_hot_table(spark, docs, monkeypatch):
    whole = sorted(map(tuple, token_counts.count_tokens(docs, PIECE).collect()), key=repr)
    monkeypatch.setattr(token_counts, "HOT_ENTRIES", 2)
    assert sorted(map(tuple, token_counts.count_tokens(docs, PIECE).collect()), key=repr) == whole


def test_small_windows_cut_no_word(monkeypatch):
    lib, own = Tokenizer.from_file(WORD), bpe_stream.WordBPE(WORD)
    more = ["it's", "''s'", "-'re", "x-", "a1b2", "don't!'ll", "..", "<|endoftext|>x", "ab" * 40]
    r = random.Random(7)
    for window in (1, 3, 17):
        monkeypatch.setattr(bpe_stream, "WINDOW_CHARS", window)
        for _ in range(400):
            t = "".join(r.choice(PARTS + more) for _ in range(r.randint(0, 25)))
            ids = lib.encode(t, add_special_tokens=False).ids
            assert own.encode(t) == ids
            assert bpe_stream.digest(own, t)[0] == len(ids)
            assert "".join(own.decode_chunks(own.encode_chunks(t))) == lib.decode(ids, skip_special_tokens=False)


def test_the_machine_keeps_bytes_of_unfinished_characters():
    own = bpe_stream.WordBPE(WORD)
    for t in ("日本 语", "a😀b é", "<|endoftext|>😀"):
        ids = [i for c in t.encode() for i in [own.vocab[own.bytes[c]]]] if "<" not in t else own.encode(t)
        out = [*own.decode_text(iter(ids))]
        assert "�" not in "".join(out)


def test_clashing_hashes_are_counted_exactly(spark, docs, monkeypatch):
    whole = sorted(map(tuple, token_counts.count_tokens(docs, PIECE).collect()), key=repr)
    real = token_counts.key_of
    monkeypatch.setattr(token_counts, "key_of", lambda p: real(p) % 3 if len(p) < 6 else real(p))
    monkeypatch.setattr(token_counts, "HOT_ENTRIES", 2)
    assert sorted(map(tuple, token_counts.count_tokens(docs, PIECE).collect()), key=repr) == whole


def test_hot_pretokens_come_from_a_cut_off(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{k}", k, k, 1) for k in range(1, 2000)] + [("x" * 60, 7, 10**9, 1)], "pre_token string, key long, n long, n_pieces long")
    monkeypatch.setattr(token_counts, "HOT_ENTRIES", 300)
    got = {r["pre_token"] for r in token_counts.hot_rows(counts).collect()}
    clash = {f"w{7}", "x" * 60}
    assert clash <= got and len(got - clash) <= 300 and "w1999" in got
    least = min(int(w[1:]) for w in got - clash)
    assert {f"w{k}" for k in range(least, 2000)} <= got
