import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import language_model as L


def noisy(hidden=4, words=20, buckets=5, size=8, dtype=np.float64):
    r = np.random.default_rng(0)
    model = L.Model.initial(np.arange(words, 0, -1.0), np.full(buckets, 3.0), hidden=hidden, size=size)
    for k in model.names:
        setattr(model, k, (getattr(model, k) + (r.normal(0, 0.3, getattr(model, k).shape) if k != "word_b" else 0)).astype(dtype))
    return model, r


def test_gradients_agree_with_differences():
    model, r = noisy()
    tokens = r.integers(0, 25, (7, 3))
    before = np.r_[np.full((1, 3), -1), tokens[:-1]]
    before[3, 1] = -1
    live = np.ones((7, 3), bool)
    live[6, 2] = False
    state = np.zeros((3, 4))
    grads, _, _ = model.gradients(tokens, before, state, live)
    for k in model.names:
        a = getattr(model, k)
        for _ in range(5):
            at = tuple(r.integers(0, s) for s in a.shape)
            a[at] += 1e-4
            up = model.gradients(tokens, before, state, live)[2]
            a[at] -= 2e-4
            down = model.gradients(tokens, before, state, live)[2]
            a[at] += 1e-4
            assert grads[k][at] == pytest.approx((up - down) / 2e-4, abs=2e-3)


def test_probabilities_sum_to_one():
    model, r = noisy()
    h = np.repeat(r.normal(0, 1, (1, 4)), 25, axis=0)
    assert np.exp(model.log_likelihood(h, np.arange(25))).sum() == pytest.approx(1, abs=1e-6)


def test_scores_in_step_equal_scores_one_by_one():
    """State is carried over windows, and texts of other lengths beside it change nothing."""
    model, r = noisy(dtype=np.float32)
    texts = [r.integers(0, 25, n) for n in (1, 2, 3 * L.WINDOW, 2 * L.WINDOW, 2 * L.WINDOW + 1, 7, 150, 1)] * 80
    got = model.score(texts)
    for i in range(8):
        h, table, total = np.zeros((1, 4), np.float32), model.table(), 0.0
        for t, token in enumerate(texts[i]):
            if t:
                h = model.step(h, table[texts[i][t - 1 : t]])[0]
            total += model.log_likelihood(h, texts[i][t : t + 1])[0]
        assert got[i] == pytest.approx(total, rel=1e-4)
        assert got[i + 8] == pytest.approx(total, rel=1e-4)


def base_scores(rows):
    """The base, by plain counting."""
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in L.split_words(t))
    n, v = sum(c.values()), len(c)
    return n, [(i, out(i), len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, t in rows for w in [L.split_words(t)]]


def test_table(spark, monkeypatch):
    monkeypatch.setattr(L, "LIMIT", 500)  # counts are written out many times
    monkeypatch.setattr(L, "KNOWN", 3000)  # and many words are looked up in the join
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in L.score_documents(docs).collect()}
    n, want = base_scores([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == len(want)
    for i, held, tokens, known, base in want:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r.held_out]
    gain = (sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held)
    assert gain > 0.1  # of a power of ten a token


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (3, "a"), (3, "a"), (9, "A b\x0bc" * 4000), (12, " \n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in L.score_documents(docs).collect())
    _, want = base_scores(rows)
    assert got == sorted((i if i is not None else -1, n, k, round(b, 6)) for i, _, n, k, b in want)
    assert L.score_documents(docs.limit(0)).count() == 0
    only_held_out = spark.createDataFrame([(i, "x y") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id bigint, text string")
    assert {(r.train_tokens, r.base_score, r.n_known) for r in L.score_documents(only_held_out).collect()} == {(0, 0.0, 0)}


def test_all_training_documents_are_trained_on(spark, monkeypatch):
    """Whatever the bounds of tasks, blocks and averages, every token is used once an epoch; one
    doc_id for all rows and a long text change nothing."""
    for name, value in (("SHARE", 1000), ("BLOCK", 300), ("FAN", 2), ("EPOCHS", 1)):
        monkeypatch.setattr(L, name, value)
    r = np.random.default_rng(1)
    texts = [r.integers(0, 25, size).astype("<u2") for size in (*r.integers(1, 60, 200), 2500)]
    rows = spark.createDataFrame([("1", i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "doc string, row bigint, tokens binary").repartition(7)
    n = sum(map(len, texts))
    model, _ = noisy(dtype=np.float32)
    before = model.score(texts).sum()
    after, used = L.trained(model, rows, n)
    assert used == n
    assert after.score(texts).sum() > before

    blocks = list(L._blocks([L.pd.DataFrame({"tokens": [t.tobytes() for t in texts]})], 300))
    assert all(sum(map(len, b)) == 300 for b in blocks[:-1])
    assert np.array_equal(np.concatenate([x for b in blocks for x in b]), np.concatenate(texts))


def test_tokens_used_follow_the_table(spark, monkeypatch):
    """A table that is larger than what a task holds is trained on as a whole."""
    for name, value in (("BLOCK", 500), ("SHARE", 1000), ("EPOCHS", 1)):
        monkeypatch.setattr(L, name, value)
    seen = []
    whole = L.trained
    monkeypatch.setattr(L, "trained", lambda *a: seen.append(whole(*a)) or seen[-1])
    docs = spark.createDataFrame([(i % 3, f"word{i % 7} and more " * 20) for i in range(300)], "doc_id bigint, text string")
    n = {r.train_tokens for r in L.score_documents(docs).collect()}
    assert n == {seen[0][1]} and seen[0][1] > 10_000


def test_partitions_and_order_change_nothing(spark, monkeypatch):
    """The same rows in one partition, in sixteen, and in another order get the same scores."""
    for name, value in (("LIMIT", 300), ("KNOWN", 400), ("VOCABULARY", 128), ("SHARE", 20_000), ("BLOCK", 4000), ("FAN", 2), ("LANES", 8)):
        monkeypatch.setattr(L, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id < 40")).union(docs.where("doc_id < 40"))  # with rows that repeat
    scores = []
    for frame in (docs.coalesce(1), docs.repartition(16), docs.orderBy(F.desc("text")).coalesce(3)):
        scores.append(sorted((r.doc_id, r.n_tokens, r.base_score, r.score) for r in L.score_documents(frame).collect()))
    for other in scores[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in scores[0]]
        for (_, n, base, score), (_, _, base2, score2) in zip(other, scores[0], strict=True):
            assert base == pytest.approx(base2, rel=1e-9)
            assert abs(score - score2) / n < 1e-4
    assert scores[0][0][3] != scores[0][0][2]


def test_long_texts_do_not_cost_a_softmax_a_window(monkeypatch):
    """Softmax is worked out for many states at once, also where few texts are still open."""
    model, r = noisy(dtype=np.float32)
    calls = []
    whole = L.Model.log_likelihood
    monkeypatch.setattr(L.Model, "log_likelihood", lambda self, h, *a: calls.append(len(h)) or whole(self, h, *a))
    texts = [r.integers(0, 25, n) for n in (40 * L.WINDOW, 5, 39 * L.WINDOW)]
    assert np.isfinite(model.score(texts)).all()
    assert calls == [sum(map(len, texts))]


def test_large_weights_change_nothing_but_rounding():
    """Where exp() might overflow, the largest logit is taken away first; elsewhere both ways agree."""
    model, r = noisy(dtype=np.float32)
    h, token = r.uniform(-1, 1, (200, 4)).astype(np.float32), r.integers(0, 25, 200)
    *weights, calm = model.output()
    assert calm
    assert model.log_likelihood(h, token, (*weights, True)) == pytest.approx(model.log_likelihood(h, token, (*weights, False)), rel=1e-4)
    model.class_w = model.class_w * np.float32(1000)
    assert not model.output()[2]
    assert np.isfinite(model.log_likelihood(h, token)).all()
    grads, _, loss = model.gradients(token.reshape(20, 10), np.r_[np.full((1, 10), -1), token.reshape(20, 10)[:-1]], np.zeros((10, 4), np.float32), np.ones((20, 10), bool))
    assert math.isfinite(loss) and all(np.isfinite(g).all() for g in grads.values())


def test_words_by_arrow_are_those_of_plain_splitting():
    texts = [None, "", " ", "\n", " a  B\x0b\x0c\r\n", "".join(map(chr, range(1, 700))), "x\x00y \x1cz\x1d \x85\xa0\u2028 q", "\u0130\u212a \xc4 A", "a b " * 1000]
    words, every, size = L.coded_words(L.pa.array(texts, L.pa.string()))
    plain = [L.split_words(t) for t in texts]
    assert np.array(words.to_pylist(), object)[every].tolist() == [w for own in plain for w in own]
    assert size.tolist() == list(map(len, plain))
    assert L.buckets(words).tolist() == [zlib.crc32(w[-3:]) % L.BUCKETS for w in words.to_pylist()]
    assert L.hashes(words).tolist() == [L.xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in words.to_pylist()]
    part = L.coded_words(L.pa.array(texts, L.pa.string())[4:7])
    assert part[2].tolist() == size[4:7].tolist()


def test_batches_are_put_together_by_their_tokens():
    batches = [L.pd.DataFrame({"tokens": [b"ab" * n], "row": [n]}) for n in (3, 4, 5, 20, 1)] + [L.pd.DataFrame({"tokens": [], "row": []})]
    assert [b["row"].tolist() for b in L._gathered(iter(batches), 7)] == [[3, 4], [5, 20], [1]]
