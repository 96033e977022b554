import tempfile
import uuid
import zlib

import numpy as np
import pytest

from riskfold.llm import token_pack as T
from riskfold.llm.words import documents
from conftest import SF_SMALL


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip_and_random_access(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64)
        data = T.pack(ids, width)
        assert len(data) == -(-n // 64) * 8 * width
        assert (T.unpack(data, width, 0, n) == ids).all()
        for a in {0, n // 3, max(0, n - 2)}:
            assert (T.unpack(data, width, a, n - a) == ids[a:]).all()


def test_width():
    assert [T.width_of(v) for v in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def direct(rows):
    from tokenizers import Tokenizer
    path, _ = T.default_tokenizer()
    tok = Tokenizer.from_file(path)
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[1])


ODD = ["", "a", " a", "a ", "  a  b", "a\n b\n\n  c\t d", "it's we'll x   y", "\x1c x\x1fy", "　日本 語。​ x",
       "<|endoftext|> a <|endoftext|>", "tab\tand  two\r\nline \n", "\n", " ", "   \n  ", "é à  ü", "1 22 333,4", "\U0001f600 x",
       "﻿bom x", "don't  'S", "end.\nStart", "x " * 30000]


def test_edge_texts_equal_direct_encoding(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (None, "last")]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, n_tokens string")
    assert got(T.tokenize(df, *T.default_tokenizer())) == direct(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "one two"), (1, "one two"), (0, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(T.tokenize(df, *T.default_tokenizer())) == direct(rows)
    assert T.tokenize(df.limit(0), *T.default_tokenizer()).count() == 0


def test_query_equals_direct_encoding(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF_SMALL).select("doc_id", "text").collect()]
    # the table repeats a doc_id with another text: both stand, ordered by doc_id
    found = got(T.op6_token_pack(spark, SF_SMALL))
    assert sorted((r[0], r[2], r[3]) for r in found) == sorted((r[0], r[2], r[3]) for r in direct(rows))
    ends = np.cumsum([r[2] for r in found])
    assert [r[1] for r in found] == [0, *ends[:-1]]
    assert [r[0] for r in found] == sorted(r[0] for r in found)


def test_random_access_to_a_written_block(spark):
    path = f"{tempfile.gettempdir()}/blocks-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(i, f"word{i} and more") for i in range(50)], "doc_id long, text string")
    tok, size = T.default_tokenizer()
    T.write_blocks(df, path, tok, size, block_tokens=40)
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(tok)
    for b in spark.read.parquet(path).collect():
        ends = np.cumsum(b.n_tokens)
        for i, n, e in zip(b.doc_ids, b.n_tokens, ends):
            ids = T.unpack(bytes(b.payload), b.width, int(e - n), n)
            assert ids.tolist() == plain.encode(f"word{i} and more").ids + [0]
