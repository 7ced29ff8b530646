from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import bpe

VOCAB = Path(bpe.VOCABULARY)
pytestmark = pytest.mark.skipif(not VOCAB.exists(), reason="no vocabulary files")
SCHEMA = "doc_id bigint, text string, ids array<int>, key string"


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(VOCAB.with_name("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    return t


def encoded(texts):
    import numpy as np

    parts = [t.encode() for t in texts]
    ids, begins, where = bpe.encoder(str(VOCAB)).encode_batch(b"".join(parts), np.cumsum([0, *map(len, parts)]))
    return [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="a 'sdtrevlmS\t\n é日1²½.,<|>😀́", max_size=60)), max_size=20))
def test_ids_are_the_reference_encoders_and_decode_to_the_text(reference, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = encoded(texts)
    assert got == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [bpe.encoder(str(VOCAB)).decode(i) for i in got] == texts


def test_contractions_special_strings_and_long_texts(reference):
    texts = ["don't we'll THEY'RE 's 's's ''s '", "<|endoftext|>", "x" * 20_000, "word " * 20_000, " \n \n", "a\u0085b", ""]
    assert encoded(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_rows_nulls_repeats_and_clashing_columns(spark):
    data = [(1, "Hello world", [0], "x"), (2, None, None, None), (3, "", [1], "y"), (3, "", [1], "y"), (None, "a", None, None)]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["ids"]) for r in bpe.encode(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == [(False, 1, [15496, 995]), (False, 2, []), (False, 3, []), (False, 3, []), (True, None, [64])]
    assert bpe.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_offsets_lead_back_to_the_text(spark):
    data = [(1, "Zoë's café", None, None), (2, "", None, None), (3, "日本 x", None, None)]
    enc = bpe.encoder(str(VOCAB))
    for r in bpe.encode(spark.createDataFrame(data, SCHEMA), with_offsets=True).collect():
        raw = dict((a, b) for a, b, *_ in data)[r["doc_id"]].encode()
        assert all(raw[o:].startswith(enc.pieces[i]) for i, o in zip(r["ids"], r["offsets"]))
