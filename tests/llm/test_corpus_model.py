"""The language model against a plain run word by word, and its memory on one very long text."""

import tracemalloc
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tractloom.llm import language_model as lm


def random_model(seed=3):
    rng = np.random.default_rng(seed)
    model = lm.new_model(rng.integers(1, 1000, lm.TYPES))
    return {k: (v + rng.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in model.items()}


def plain_score(model, types):
    """log of the probability of a text, one word after the other, in double precision."""
    m = {k: v.astype(np.float64) for k, v in model.items()}
    h, members = lm.HIDDEN, lm.TYPES // lm.CLASSES
    state, last, total = np.zeros(h), lm.END, 0.0
    for target in types:
        x, s = m["wx"][last], state @ m["u"]
        z, r = (1 / (1 + np.exp(-(x[i * h : (i + 1) * h] + s[i * h : (i + 1) * h]))) for i in (0, 1))
        n = np.tanh(x[2 * h :] + r * (s[2 * h :] + m["bn"]))
        state = (1 - z) * n + z * state
        c, w = divmod(int(target), members)
        for logits, at in ((state @ m["wc"] + m["bc"], c), (state @ m["ww"][c] + m["bw"][c], w)):
            total += logits[at] - np.log(np.exp(logits).sum())
        last = target
    return total


def test_scores_are_those_of_a_plain_run_whatever_the_window(monkeypatch):
    model, rng = random_model(), np.random.default_rng(1)
    texts = [np.append(rng.integers(1, lm.TYPES, n), lm.END).astype(np.int16) for n in (0, 1, 5, 63, 64, 65, 300)]
    wanted = [plain_score(model, t) for t in texts]
    for steps in (1, 16, 64, 1000):
        monkeypatch.setattr(lm, "SCORING_STEPS", steps)
        for width in (1, 3, 512):
            assert np.allclose(lm._run(model, lm.Lanes(texts, width), None), wanted, rtol=1e-4)


def test_slopes_are_those_of_small_changes():
    model, rng = random_model(), np.random.default_rng(4)
    texts = [np.append(rng.integers(1, lm.TYPES, n), lm.END).astype(np.int16) for n in (3, 0, 5, 3)]
    for width in (1, 2, 4):
        windows = []
        lm._run(model, lm.Lanes(texts, width), lambda slopes, n, most: windows.append((slopes, n)))
        ((slopes, n),) = windows
        assert n == sum(map(len, texts))
        for name, weights in model.items():
            steep = np.argsort(-np.abs(slopes[name]), axis=None)[:4]
            for i in [*steep, rng.integers(weights.size)]:
                at = np.unravel_index(i, weights.shape)
                both = []
                for change in (1e-4, -1e-4):
                    other = {k: v.astype(np.float64) for k, v in model.items()}
                    other[name][at] += change
                    both.append(sum(plain_score(other, t) for t in texts))
                assert np.isclose(slopes[name][at], (both[1] - both[0]) / 2e-4, rtol=1e-3, atol=1e-4), (name, at)


def test_a_step_works_on_gates_in_one_piece_of_memory():
    model, rng = random_model(), np.random.default_rng(5)
    inputs, fresh = rng.integers(0, lm.TYPES, (16, 64)).astype(np.int16), rng.random((16, 64)) < 0.1
    _, kept = lm._recur(model, inputs, fresh, np.zeros((64, lm.HIDDEN), np.float32), True)
    steps = [x for part in (kept["before"], kept["n"], kept["inner"], *kept["gates"]) for x in part]
    assert len(steps) == 5 * 16 and all(x.flags.c_contiguous and x.dtype == np.float32 for x in steps)


def test_one_very_long_text_takes_no_more_than_its_tokens():
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(1, lm.TYPES, 20), lm.END).astype(np.int16) for _ in range(5000)]
    texts.append(np.append(rng.integers(1, lm.TYPES, 500_000), lm.END).astype(np.int16))
    tracemalloc.start()
    lanes = lm.Lanes(texts)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    seen = np.zeros(len(lanes.targets), int)
    for places, real in lanes.windows(lm.SCORING_STEPS):
        seen[places[real]] += 1
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert (seen == 1).all() and lanes.loads.max() >= 500_001 and lanes.width > 32


def test_counts_and_base_scores_by_definition(spark):
    rows = [(i, " ".join(f"w{(i * j) % 40}" for j in range(i % 30)) + (" Rare" if i % 7 == 0 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in lm.language_model_scores(docs, carried=["doc_id"]).collect()}
    held = {r.doc_id for r in docs.filter(lm.held_out("doc_id")).collect()}
    counts, ends = Counter(), 0
    for i, text in rows:
        if i not in held:
            counts.update(text.lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for i, text in rows:
        words = text.lower().split()
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        base += np.log10((ends + 0.1) / (n + 0.1 * (v + 1)))
        assert np.isclose(found[i].base_score, base)
        assert (found[i].held_out, found[i].n_tokens, found[i].train_tokens) == (i in held, len(words) + 1, n)
        assert found[i].score < 0


def test_longest_words_are_joined_and_not_copied(spark):
    long_ = "z" * 100
    docs = spark.createDataFrame([(i, f"{long_} a b") for i in range(30)], "doc_id long, text string")
    counts = lm.word_counts(docs.select(F.col("text").cast("binary").alias("body")))
    words, times = lm.frequent_words(counts)
    assert words.split() == [b"a", b"b"] and times.tolist() == [30, 30]
    found = lm.language_model_scores(docs, carried=["doc_id"]).first()
    assert found.n_known == found.n_tokens == 4
