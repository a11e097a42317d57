import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from noticelake.llm import flatfile, warc


def test_warc_round_trip(spark):
    long = "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n" + "é" * 300_000
    rows = [(1, "http://a/1", long), (5, "http://a/5", long), (3, "u\r\nv", long), (4, None, None), (6, "", ""), (7, "", "short"), (8, "", "short"), (9, "", "y" * 100), (2, "", "y" * 100), (2, "", "y" * 100), (None, "", "y" * 100), (None, None, "z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS digest", "7 AS size").repartition(3)
    chunks = warc.round_trip(pages).cache()
    got = sorted(((r.id, r.payload_bytes, r.running_digest, r.record_type, r.refers_to) for r in chunks.where("last").collect()), key=str)
    want = []
    for ident, _, html in rows:
        raw = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        first = min(same) if len(raw) >= 100 and len([1 for _, _, h in rows if (h or "") == (html or "")]) > 1 and same else None
        revisit = first is not None and ident != first
        want.append((ident, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert chunks.where("id = 1").count() > 2 and chunks.agg({"chunk_bytes": "max"}).first()[0] <= warc.CHUNK
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = ["b a\nc  d", None, "", " lead", "tail ", "a\n\nb 12 don't", "x\x1c! y", "　é​<|endoftext|> z", "a <|endoftext|> b", "a  b   c\u00a0 d\r\n", "word " * 5000, "w" * 50_000]
    rows = [(len(texts) - k, t) for k, t in enumerate(texts)] + [(None, "last"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS id")
    got = [tuple(r) for r in flatfile.round_trip(docs, path).orderBy("start").collect()]
    want, at = [], 0
    hashed = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    for ident, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]])):
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((ident, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert flatfile.round_trip(docs.limit(0), path).count() == 0


def test_other_tokenizer_is_encoded_whole(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert not flatfile.cuts_at_spaces(path)
    docs = spark.createDataFrame([(1, "One two  Three")], "doc_id long, text string")
    assert flatfile.round_trip(docs, path).first().n_tokens == len(Tokenizer.from_file(path).encode("One two  Three", add_special_tokens=False).ids) + 1


def test_pieces_are_those_of_a_plain_call():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model, rng = Tokenizer.from_file(path), random.Random(5)
    signs = [" ", " ", " ", "\n", "\t", "\r\n", "a", "B", "it's", "I'll", "é", "ß", "×", "÷", "“", "”", "—", "\u00a0", "\u2003", "\u3000", "\u0085", "\u180e", "\x1c", "\u0301", "1", "23", "²", ",", ".", "-", "'", "'s", "<|endoftext|>", "漢", "Ж", "😀", "_", "\x00", "  ", "   ", "\n\n"]
    for window in (8, 64, 4 << 20):
        flatfile.WINDOW, was = window, flatfile.WINDOW
        try:
            for plain in (False, True):
                model.encode_special_tokens = plain
                encode = flatfile.encoder.__wrapped__(path, 2, plain)
                for _ in range(200):
                    texts = ["".join(rng.choices(signs, k=rng.choice([0, 1, 2, 5, 30]))) for _ in range(rng.choice([1, 2, 20]))]
                    ids, sizes = encode(pa.array(texts))
                    assert ids.tolist() == [x for t in texts for x in model.encode(t, add_special_tokens=False).ids]
                    assert sizes.tolist() == [len(model.encode(t, add_special_tokens=False).ids) for t in texts]
        finally:
            flatfile.WINDOW = was


def test_bases_are_prefix_sums(spark):
    rows = [(k, f"f{k}", 1, 10 + k, "<u2") for k in range(20)]
    found = flatfile.bases(spark.createDataFrame(rows, "part long, file string, docs long, tokens long, kind string"), block=3)
    assert [r.base for r in found.orderBy("part").collect()] == [sum(10 + j for j in range(k)) for k in range(20)]
