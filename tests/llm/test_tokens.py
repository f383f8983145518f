import io
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import token_files, tokens

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "a", "Hello  world\n\n x", "it's we'll I'D '' 's", "ÉCOLE straße ñ Ñ ÿ ªº²³¼ × ÷ ¿", "tab\t\tx \r\n", "<|endoftext|> a <|startoftext|>", "\x0b\x0c\x1c\x85\xa0 x", "é İ Σας 漢字 🎉", "12345 6a7", "a" * 300, "!!!??? ###\n", "don't'S  'st", "İ x"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_library(name):
    path = tokens.default_path(name)
    library = Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n'sStTdDmMlLrRvVeEéÉñß123²!#<|>"), st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"])), max_size=60))
    def same(text):
        ids = np.frombuffer(tokens.Encoder.encode(e, [text])[0], "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids

    e = tokens.Encoder(path, cache_words=500)
    for t in ODD:
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert e.words is not None
    same()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 2**32 - 1)), max_size=400), max_size=5), st.sampled_from([1, 7, 128]), st.sampled_from([0, 50, 90, 100]))
def test_round_trip(docs, block, percentile):
    f = io.BytesIO()
    w = token_files.Writer(f, block, percentile)
    for i, d in enumerate(docs):
        w.add(i if i else None, np.array(d, "<u4").tobytes())
    w.close()
    r = token_files.Reader(f, len(f.getvalue()))
    flat = [x for d in docs for x in d]
    assert r.ids(0, r.n_ids).tolist() == flat
    assert r.doc_ids == [i if i else None for i in range(len(docs))]
    for _ in range(5):
        a = random.randint(0, len(flat))
        b = random.randint(a, len(flat))
        assert r.ids(a, b).tolist() == flat[a:b]


def test_query(spark):
    library = Tokenizer.from_file(tokens.default_path(NAMES[0]))
    rows = [(7 * (i % 13), t, "x", 5) for i, t in enumerate([*ODD, None, "word " * 20000, "dup", "dup"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, start int")
    got = token_files.token_output(docs).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    at, want = 0, {}
    for r in got:
        assert r.start == at
        at += r.n_tokens
    for d, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(d, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    for d, w in want.items():
        assert sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == d) == sorted(w)
    assert token_files.token_output(docs.limit(0)).count() == 0
