import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from martlens.llm import bpe, records

RANKS, TOKENIZER = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
PIECES = ["a", "B", "'s", "'", "\n", " ", "  ", "\t", "\xa0", "é", "9", "12", ".", "!?", "　", "\x1c", "中", "。",
          "<|endoftext|>", "\r\n", "don't"]


def _random_texts(n, longest):
    r = random.Random(5)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_cut_texts_give_the_ids_of_whole_texts():
    enc = bpe.encoding(RANKS, P.PATTERN)
    for t in _random_texts(1500, 40):
        assert bpe.encode_text(enc, t, 3).tolist() == enc.encode_ordinary(t)


def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.mark.parametrize("limit", [5, 50, 10_000])
def test_gathered_pieces_give_the_ids_of_whole_texts(limit):
    tok, enc = plain_tokenizer(), records.PieceEncoder(records.tokenizer(TOKENIZER), 2, limit=limit)
    texts = [*_random_texts(1500, 40), "a <|endoftext|> b", "x<|endoftext|>", " \n a", "a \n ", "<|endoftext", "x " * 300_000, None]
    want = [np.array(tok.encode(t or "", add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    for k in (1, 7, 400):
        for i in range(0, len(texts), k):
            assert enc.encode(pa.array(texts[i:i + k], pa.string())) == want[i:i + k]


def test_special_strings_are_special_tokens():
    enc = records.PieceEncoder(records.tokenizer(TOKENIZER), 2)
    got, = enc.encode(pa.array(["a <|endoftext|> b"]))
    assert len(got) == 2 * 4 and np.frombuffer(got, dtype="<u2").tolist().count(50256) == 1


def test_encode_round_trip_and_cases(case_docs, cases):
    enc = bpe.encoding(RANKS, P.PATTERN)
    out = bpe.encode(case_docs, RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "text", "score", "n_tokens", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(cases)
    for r in rows:
        want = enc.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()
    again = bpe.decode(out.drop("decoded"), RANKS, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again)


def test_encode_empty_table(no_docs):
    assert bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0


def test_records_read_back_in_any_order(case_docs, cases):
    index = records.write_records(case_docs, TOKENIZER, 2)
    tok = plain_tokenizer()
    got = records.read_records(index.orderBy(F.rand(3))).collect()
    assert len(got) == len(cases)
    start = 0
    ordered = sorted(cases, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    for r, (i, t) in zip(sorted(got, key=lambda r: r.start), ordered, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_records_of_an_empty_table(no_docs):
    assert records.read_records(records.write_records(no_docs, TOKENIZER, 2)).count() == 0


def test_damaged_records_are_refused():
    good = records.frame(b"abcd")
    assert records.unframe(good) == b"abcd"
    for at in range(len(good)):
        with pytest.raises(ValueError):
            records.unframe(good[:at] + bytes([good[at] ^ 1]) + good[at + 1:])


def test_queries_on_the_tables(spark):
    from martlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = bpe.encoding(RANKS, P.PATTERN)
    for r in QUERIES["op1_byte_bpe"](spark, sf).collect():
        ids = np.array(enc.encode_ordinary(docs[r.doc_id]), dtype="<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    rows = sorted(QUERIES["op2_token_records"](spark, sf).collect())
    assert [r.doc_id for r in rows] == sorted(docs)
    assert [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])
