"""Token counts and byte-level BPE against the libraries."""

import base64
import hashlib

import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm.byte_bpe import ByteBpe, decode_ids, digests, encode_texts
from quern.llm.token_counts import PieceTable, count_tokens
from tests.llm.edge import empty, odd

PIECE, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")
TABLE, SP = PieceTable.load(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
BPE = ByteBpe.load(RANKS, P.PATTERN)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
ODD = ["", " ", "  ", "▁", "▁ ▁x", "\n\n a\n", "a" * 3000, "-=" * 400, " " * 100 + "x", " " * 33, "<s></s><unk><0x41>", "<|endoftext|>", "é漢😀", "\x00\x1c\x85\u00a0\u2003 x", "it's I'LL we'd", "12345 6", "\t\t\tif x:\n        y"]
TEXTS = st.text(alphabet=st.sampled_from(" \n\t▁abethnioxyzÉé漢字😀0129-=_.,'<s>\x00\x85\u00a0\u2003"), max_size=120) | st.text(max_size=60)


def docs():
    return pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column(0).to_pylist()


def test_counts_of_odd_texts_and_documents():
    texts = ODD + docs()
    assert TABLE.count_texts([t.encode() for t in texts]) == [len(x) for x in SP.encode(texts)]


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_of_any_text(t):
    t = t.encode("utf-8", "ignore").decode()
    assert TABLE.count_texts([t.encode()]) == [len(SP.encode(t))]


def test_ids_of_odd_texts_and_documents():
    for t in ODD + docs():
        ids = BPE.encode(t.encode()).tolist()
        assert ids == TIK.encode_ordinary(t) and BPE.decode(ids) == t.encode()


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_of_any_text(t):
    t = t.encode("utf-8", "ignore").decode()
    ids = BPE.encode(t.encode()).tolist()
    assert ids == TIK.encode_ordinary(t) and BPE.decode(ids) == t.encode()


def test_perfect_hash_is_minimal_and_rejects():
    keys = list(BPE.tokens.values())
    assert sorted(BPE.whole.slots) == list(range(len(keys)))
    assert all(BPE.ids[BPE.whole.get(t)] == r for r, t in BPE.tokens.items())
    assert BPE.whole.get(b"no such token at all") == -1


def test_frames(spark):
    rows = {r.doc_id: r for r in count_tokens(odd(spark), PIECE, 4096).collect()}
    assert len(count_tokens(odd(spark), PIECE).collect()) == 19 and rows[3].n_tokens == 0 == rows[4].n_tokens and rows[8].over_limit and not rows[1].over_limit
    assert rows[7].n_tokens == len(SP.encode("é ñ 漢字 😀 \x00 \x1c ​"))
    got = {r.doc_id: r for r in digests(odd(spark), RANKS, P.PATTERN).collect()}
    assert got[3].ids_sha256 == hashlib.sha256(b"").hexdigest() and got[16].n_tokens == len(TIK.encode_ordinary("<|endoftext|> <s> </s>"))
    assert digests(empty(spark), RANKS, P.PATTERN).count() == 0 == count_tokens(empty(spark), PIECE).count()
    back = decode_ids(encode_texts(odd(spark), RANKS, P.PATTERN), RANKS, P.PATTERN)
    want = {r.doc_id: (r.text or "").encode() for r in odd(spark).where("doc_id is not null").collect()}
    assert {r.doc_id: bytes(r.data) for r in back.where("doc_id is not null").collect()} == want


@pytest.mark.parametrize("name", ["op1_token_counts", "op2_byte_bpe"])
def test_queries_match_the_libraries(spark, name):
    from quern.llm.registry import queries

    rows = queries()[name](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        if name.startswith("op1"):
            assert (r.n_bytes, r.n_tokens) == (len(texts[r.doc_id].encode()), len(SP.encode(texts[r.doc_id])))
        else:
            ids = TIK.encode_ordinary(texts[r.doc_id])
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def unbroken(seed=1):
    """Long texts without blanks: random letters, base64, repeated and mixed characters."""
    import base64
    import random

    r = random.Random(seed)
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(r.choices(of, k=n))
    return [letters(n) for n in (1023, 1025, 1500, 60_000)] + [base64.b64encode(r.randbytes(45_000)).decode(), "a" * 50_000, "ab" * 4000, "-=" * 3000, letters(9000, "日本語中文é😀ñab"), letters(3000, "aab") + " " + letters(3000, "the"), "\n" * 3000, "1234567890" * 900]


def test_long_texts_without_blanks():
    import time

    import public_tokenizers as P
    import sentencepiece
    import tiktoken

    from quern.llm.byte_bpe import ByteBpe
    from quern.llm.token_counts import PieceTable

    table, library = PieceTable.load(P.path("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = unbroken()
    assert table.count_texts([t.encode() for t in texts]) == [len(library.encode(t)) for t in texts]
    bpe = ByteBpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    reference = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in bpe.tokens.items()}, special_tokens={})
    for t in texts:
        assert bpe.encode(t.encode()).tolist() == reference.encode_ordinary(t)
    assert all(len(k) <= 256 for cache in (table.cache, bpe.cache) for k in cache)
    began = time.time()
    table.count_texts([t.encode() for t in unbroken(2)])
    assert time.time() - began < 20  # a second for 170 kB here; by rounds over the whole it was minutes


def test_caches_stay_within_their_bytes(monkeypatch):
    import random

    import public_tokenizers as P

    from quern.llm import byte_bpe, token_counts

    r = random.Random(3)
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 100_000)
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 100_000)
    table, bpe = token_counts.PieceTable.load(P.path("piece_bpe_32k.model")), byte_bpe.ByteBpe.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for _ in range(30):
        text = " ".join("".join(r.choices("abcdefgh", k=9)) for _ in range(400)).encode()
        table.count_texts([text])
        bpe.encode(text)
        assert max(table.held, bpe.held) < 300_000 and max(len(table.cache), len(bpe.cache)) < 2000
