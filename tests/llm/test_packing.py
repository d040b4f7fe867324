import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factlake.llm.packing import WordTokens, described, pack, sequences

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE, WORDS = Tokenizer.from_file(PATH), WordTokens(PATH)
ODD = [None, "", " \n\t", "a b", "don't STOP  it's", "Straße İ Σας x", "é ́x", "<|endoftext|> y<|endoftext|>z", "<|ENDOFTEXT|> a,<|endoftext|>, B<|End", "12ab!?\x1c\x85q", "日本 語", "aİ, İ. plain, words. Ça ǅ ª x́y's, ok"]


@pytest.mark.parametrize("text", ODD)
def test_words_give_the_ids_of_the_whole_text(text):
    assert next(iter(WORDS.encode([text]))).tolist() == WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAé'sÍ ß1!| \n\t\x0b\x1cΣ日", max_size=40), max_size=5))
def test_batches_give_the_ids_of_each_text(texts):
    assert [x.tolist() for x in WORDS.encode(texts)] == [WHOLE.encode(x, add_special_tokens=False).ids for x in texts]


def test_long_text_is_cut_at_spaces():
    text = "word " * 300_000
    assert len(next(iter(WORDS.encode([text])))) == 300_000


def test_pieces_cover_every_id_once(spark):
    rows = [(i, "the quick brown fox " * (i % 40) + (t or "")) for i, t in enumerate(ODD * 20)] + [(None, None), (7, "again"), (7, "again"), (999, "x " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("offset", F.lit("clash")).repartition(5)
    pieces = pack(docs, PATH)
    got = pieces.toPandas()
    want = sorted((d if d is not None else -1, [*WHOLE.encode(t or "", add_special_tokens=False).ids, 2]) for d, t in rows)
    whole = got.sort_values(["sequence_id", "offset"])
    at = (whole["sequence_id"] * 4096 + whole["offset"]).to_numpy()
    assert (at == np.r_[0, np.cumsum(whole["length"])[:-1]]).all()
    assert whole["length"].max() <= 4096 and (whole["offset"] + whole["length"]).max() <= 4096
    found, held = [], []
    for row in whole.itertuples():
        held += np.frombuffer(row.ids, "<u4").tolist()
        assert row.first == (row.start == 0)
        if row.last:
            assert len(held) == row.doc_tokens
            found.append((-1 if row.doc_id != row.doc_id else int(row.doc_id), held))
            held = []
    assert sorted(found) == want
    crc = {(r.sequence_id, r.offset): r.ids_crc32 for r in described(pieces).collect()}
    assert all(crc[r.sequence_id, r.offset] == zlib.crc32(r.ids) for r in whole.itertuples())
    full = sequences(pieces).orderBy("sequence_id").collect()
    assert all(r.n_tokens == 4096 for r in full[:-1]) and all(len(r.ids) == 4 * r.n_tokens for r in full)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
