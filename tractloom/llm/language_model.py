"""Scoring texts with a small gated recurrent language model, and with smoothed word frequencies.

Model. A GRU reads one word at a time; its output softmax is factored into classes of words and words of a class. It
knows the most frequent words and the end of a text; every other word is one unknown type, whose probability is
divided among them by their smoothed frequencies, so that the model gives a probability to every possible text.

Training. Truncated backpropagation through time in numpy: texts run in parallel lanes, windows of steps follow each
other, and a lane's state is carried from window to window until its text ends. Every training document is read once,
in a few rounds. In a round each partition starts from the same model and trains on its documents; the models are
averaged, weighted by tokens, in two shuffles. Only one model, of a fixed size, passes through the driver.

Scoring. States are carried over a whole text, whatever its length. Frequent words' counts are copied to the tasks,
up to a fixed number; all other words are joined with the counts, so no word is left out.

Nulls and odd input: null texts are empty and consist of their end; a null id counts as an empty text and so is held
out; repeated rows are scored alike; without training documents all counts are 0; empty tables stay empty.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractloom.llm.common import col, settle, unpacked, whole

ALPHA = 0.1
#: Types of the model: end, unknown and the most frequent words, in CLASSES equal classes by frequency.
TYPES = 1024
CLASSES = 32
HIDDEN = 16
STEPS = 16
LANES = 512
RATE = 0.01
CLIP = 1.0
SEED = 11
#: Steps of a window where nothing is learnt: they change no score.
SCORING_STEPS = 64
#: Words whose counts are copied to the tasks, and the bytes of the longest of them; all others are joined.
FREQUENT = 500_000
FREQUENT_BYTES = 64
#: Eighths of the training documents in each round.
ROUNDS = (1, 3, 4)
PIECES = 16

END, UNKNOWN = 0, 1
_NAMES = ("wx", "u", "bn", "wc", "bc", "ww", "bw")


def tokens(text: bytes | None) -> list[bytes]:
    """Words in ASCII lower case; bytes split at the six white space bytes only."""
    return text.lower().split() if text else []


def held_out(doc_id: str):  # noqa: ANN201
    """Whether a document is kept from training: the CRC-32 of its id as text is divisible by 10."""
    return F.crc32(F.coalesce(col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


# --- the model -------------------------------------------------------------------------------------------------


def new_model(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; output biases that give the types' frequencies."""
    random = np.random.default_rng(SEED)
    h, members = HIDDEN, TYPES // CLASSES
    share = (counts + 0.5).reshape(CLASSES, members)
    draw = lambda *shape: random.normal(0, 0.1, shape).astype(np.float32)
    return {
        "wx": draw(TYPES, 3 * h),
        "u": draw(h, 3 * h) * np.float32(2),
        "bn": np.zeros(h, np.float32),
        "wc": draw(h, CLASSES),
        "bc": np.log(share.sum(axis=1) / share.sum()).astype(np.float32),
        "ww": draw(CLASSES, h, members),
        "bw": np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def _gates(weights: np.ndarray) -> np.ndarray:
    """Columns of the three gates one behind the other, so that each gate lies in one piece of memory."""
    return np.ascontiguousarray(weights.reshape(-1, 3, HIDDEN).transpose(1, 0, 2))


def _recur(
    m: dict, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, learn: bool
) -> tuple[np.ndarray, dict]:
    """States after each step (steps, lanes, h); if learning, what the way back needs. fresh: where a text begins."""
    steps = len(inputs)
    out = np.empty((*inputs.shape, HIDDEN), np.float32)
    u, bn = _gates(m["u"]), m["bn"]
    from_words = np.take(_gates(m["wx"]), inputs.astype(np.intp), axis=1)
    begins = [np.flatnonzero(f) for f in fresh]
    kept = {}
    if learn:
        kept = {k: np.empty_like(out) for k in ("before", "n", "inner")} | {"gates": from_words[:2], "begins": begins}
    for t in range(steps):
        if learn or len(begins[t]):
            before = kept["before"][t] if learn else np.empty_like(state)
            np.copyto(before, state)
            before[begins[t]] = 0
        else:
            before = state
        zr, n = from_words[:2, t], from_words[2, t]
        zr += before @ u[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr
        inner = np.matmul(before, u[2], out=kept["inner"][t] if learn else None)
        inner += bn
        n += r * inner
        n = np.tanh(n, out=kept["n"][t] if learn else n)
        state = out[t]
        np.subtract(before, n, out=state)
        state *= z
        state += n
    return out, kept


def _outputs(m: dict, states: np.ndarray, targets: np.ndarray, learn: bool) -> tuple[np.ndarray, dict, np.ndarray]:
    """Log probabilities of the targets; if learning, slopes of the output weights and of the states."""
    members = TYPES // CLASSES
    order = np.argsort(targets, kind="stable")  # by class, and by word within it
    states, sorted_ = np.take(states, order, axis=0), np.take(targets, order)
    rows = np.arange(len(targets))
    classes = sorted_ // members
    own_class, own_word = rows * CLASSES + classes, rows * members + sorted_ % members
    # States lie between -1 and 1, so logits stay far from overflow without taking off their maximum.
    logits = states @ m["wc"]
    logits += m["bc"]
    found = np.take(logits, own_class)
    p = np.exp(logits, out=logits)
    total = p @ np.ones(CLASSES, p.dtype)
    bounds = np.searchsorted(classes, np.arange(CLASSES + 1)).tolist()
    used = [(c, slice(bounds[c], bounds[c + 1])) for c in range(CLASSES) if bounds[c] < bounds[c + 1]]
    found -= np.log(total)
    inside, sums = np.empty((len(targets), members), states.dtype), np.empty_like(total)
    ones = np.ones(members, states.dtype)
    for c, at in used:
        own = np.matmul(states[at], m["ww"][c], out=inside[at])
        own += m["bw"][c]
    at_word = np.take(inside, own_word)
    q = np.exp(inside, out=inside)
    for _, at in used:
        np.matmul(q[at], ones, out=sums[at])
    found += at_word - np.log(sums)
    slopes: dict[str, np.ndarray] = {}
    back = np.empty(0)
    if learn:
        for x, by, own in ((p, total, own_class), (q, sums, own_word)):
            x /= by[:, None]
            x.ravel()[own] -= 1
        ones = np.ones(len(p), p.dtype)
        slopes["wc"], slopes["bc"] = states.T @ p, ones @ p
        slopes["ww"], slopes["bw"] = np.zeros_like(m["ww"]), np.zeros_like(m["bw"])
        sorted_back = p @ m["wc"].T
        for c, at in used:
            np.matmul(states[at].T, q[at], out=slopes["ww"][c])
            np.matmul(ones[at], q[at], out=slopes["bw"][c])
            sorted_back[at] += q[at] @ m["ww"][c].T
        back = np.empty_like(sorted_back)
        back[order] = sorted_back
    unsorted = np.empty_like(found)
    unsorted[order] = found
    return unsorted, slopes, back


def _backward(m: dict, inputs: np.ndarray, kept: dict, outer: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the recurrent weights over one window; nothing flows further back."""
    h = HIDDEN
    u_back = m["u"].T
    z, r = kept["gates"]
    before, n, inner, begins = kept["before"], kept["n"], kept["inner"], kept["begins"]
    # What needs no slopes, for all steps at once.
    not_z, not_r, change, bend = 1 - z, 1 - r, before - n, n * n
    np.subtract(1, bend, out=bend)
    by_word = np.empty((*inputs.shape, 3 * h), np.float32)
    from_state = np.empty_like(by_word[0])
    slopes = {"u": np.zeros_like(m["u"]), "bn": np.zeros_like(m["bn"])}
    ones = np.ones(inputs.shape[1], np.float32)
    carried = np.zeros_like(outer[0])
    for t in reversed(range(len(inputs))):
        ds = np.add(outer[t], carried, out=carried)
        dn = ds * not_z[t]
        dn *= bend[t]
        dz = ds * change[t]
        dz *= z[t]
        dz *= not_z[t]
        dr = dn * inner[t]
        dr *= r[t]
        dr *= not_r[t]
        d_inner = dn * r[t]
        np.concatenate((dz, dr, dn), axis=1, out=by_word[t])
        np.concatenate((dz, dr, d_inner), axis=1, out=from_state)
        slopes["u"] += before[t].T @ from_state
        slopes["bn"] += ones @ d_inner
        carried = from_state @ u_back
        ds *= z[t]
        carried += ds
        carried[begins[t]] = 0
    ids = inputs.reshape(-1)
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    slopes["wx"] = np.zeros_like(m["wx"])
    slopes["wx"][ids[firsts]] = np.add.reduceat(np.take(by_word.reshape(-1, 3 * h), order, axis=0), firsts, axis=0)
    return slopes


class Lanes:
    """Texts laid end to end in lanes of about the same length; windows of steps over all of them.

    Texts go to the shortest lane, the longest first, and are then shuffled within their lane, so that long texts
    don't all come at once. Lanes lie one behind the other without padding, and a window is cut out of them when it is
    due, so one very long text takes no more than its own tokens.
    """

    def __init__(self, texts: list[np.ndarray], most: int = LANES) -> None:
        sizes = np.array([len(t) for t in texts])
        self.width = int(max(1, min(most, len(texts), max(32, sizes.sum() // 2048))))
        heap = [(0, lane) for lane in range(self.width)]
        lanes: list[list[int]] = [[] for _ in range(self.width)]
        for i in np.argsort(-sizes, kind="stable"):
            load, lane = heapq.heappop(heap)
            lanes[lane].append(int(i))
            heapq.heappush(heap, (load + int(sizes[i]), lane))
        lanes.sort(key=lambda own: -sizes[own].sum())
        shuffle = np.random.default_rng(SEED)
        for own in lanes:
            shuffle.shuffle(own)
        self.loads = np.array([sizes[own].sum() for own in lanes])
        self.begins = np.concatenate([[0], np.cumsum(self.loads)[:-1]])
        order = [i for own in lanes for i in own]
        self.targets = np.concatenate([texts[i] for i in order]).astype(np.int16)
        self.text = np.repeat(np.array(order, np.int32), sizes[order])
        firsts = np.concatenate([[0], np.cumsum(sizes[order])[:-1]])
        self.fresh = np.zeros(len(self.targets), bool)
        self.fresh[firsts] = True
        self.inputs = np.concatenate([[END], self.targets[:-1]]).astype(np.int16)
        self.inputs[firsts] = END

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the tokens (steps, active lanes), and which of them are within their lane."""
        for at in range(0, int(self.loads[0]), steps):
            active = int((self.loads > at).sum())
            rows = at + np.arange(min(steps, int(self.loads[0]) - at))[:, None]
            real = rows < self.loads[:active]
            yield np.where(real, self.begins[:active] + rows, 0), real


def _run(m: dict, lanes: Lanes, learn) -> np.ndarray:  # noqa: ANN001
    """Log probability of every text; `learn`, if given, takes each window's slopes."""
    sums = np.zeros(int(lanes.text.max()) + 1 if lanes.text.size else 0)
    state = np.zeros((lanes.width, HIDDEN), np.float32)
    for places, real in lanes.windows(STEPS if learn else SCORING_STEPS):
        inputs, fresh = np.take(lanes.inputs, places), np.take(lanes.fresh, places)
        states, kept = _recur(m, inputs, fresh, state[: places.shape[1]], learn is not None)
        state = states[-1]
        # Only at the lanes' ends a window has places that are none of theirs.
        full = bool(real.all())
        own = places.ravel() if full else places[real]
        at = states.reshape(-1, HIDDEN) if full else states[real]
        found, slopes, back = _outputs(m, at, np.take(lanes.targets, own), learn is not None)
        sums += np.bincount(np.take(lanes.text, own), found, len(sums))
        if learn:
            outer = back.reshape(states.shape) if full else np.zeros_like(states)
            if not full:
                outer[real] = back
            slopes |= _backward(m, inputs, kept, outer)
            learn(slopes, len(own), lanes.width * STEPS)
    return sums


class Adam:
    def __init__(self, model: dict[str, np.ndarray]) -> None:
        self.model, self.time = model, 0
        self.first = {k: np.zeros_like(v) for k, v in model.items()}
        self.second = {k: np.zeros_like(v) for k, v in model.items()}

    def __call__(self, slopes: dict[str, np.ndarray], n: int, most: int) -> None:
        """A step from the slopes of n tokens; windows with few of the tokens that lanes can hold count for less."""
        self.time += 1
        size = np.sqrt(sum(float(np.vdot(s, s)) for s in slopes.values())) / n
        scale = np.float32(min(1.0, CLIP / max(size, 1e-12)) / n)
        rate = np.float32(n / most * RATE * np.sqrt(1 - 0.99**self.time) / (1 - 0.9**self.time))
        for k, s in slopes.items():
            s *= scale
            self.first[k] += np.float32(0.1) * (s - self.first[k])
            self.second[k] += np.float32(0.01) * (s * s - self.second[k])
            self.model[k] -= rate * self.first[k] / (np.sqrt(self.second[k]) + np.float32(1e-6))


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([model[k].ravel() for k in _NAMES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    model, at = new_model(np.zeros(TYPES)), 0
    for k in _NAMES:
        size = model[k].size
        model[k] = values[at : at + size].reshape(model[k].shape).astype(np.float32)
        at += size
    return model


# --- the corpus ------------------------------------------------------------------------------------------------


def word_counts(bodies: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs in `body`; counted in the tasks before anything moves."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["body"]:
                seen.update(tokens(text))
            if len(seen) > 500_000:
                yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})
                seen = Counter()
        if seen:
            yield pd.DataFrame({"word": list(seen), "c": list(seen.values())})

    return bodies.mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int | None = None) -> tuple[bytes, np.ndarray]:
    """Words, blanks between them, and their counts, most frequent first, equally frequent ones by their bytes.

    At most FREQUENT of FREQUENT_BYTES: all such words from some count on, found from how many words have each count.
    """
    most = FREQUENT if most is None else most
    short = counts.filter(F.length("word") <= FREQUENT_BYTES)
    by_count = short.groupBy("c").agg(F.count(F.lit(1)).alias("words"))
    upto = F.sum("words").over(W.orderBy(F.desc("c")).rowsBetween(W.unboundedPreceding, W.currentRow))
    least = by_count.withColumn("upto", upto).filter(F.col("upto") <= most).agg(F.min("c")).first()[0]
    if least is None:
        return b"", np.empty(0, np.int64)
    top = short.filter(F.col("c") >= least).toArrow()
    words, times = top["word"].to_pylist(), top["c"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-times[i], words[i]))
    return b" ".join([words[i] for i in order]), times[order]


class Vocabulary:
    """Frequent words, most frequent first; the first TYPES - 2 are types of their own from 2 on."""

    def __init__(self, words: bytes) -> None:
        self.place = {w: i for i, w in enumerate(words.split())}

    def places(self, words: list[bytes]) -> np.ndarray:
        """A word's place, or -1."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    @staticmethod
    def types(places: np.ndarray) -> np.ndarray:
        """Types of words and, at last, of the end."""
        known = (places >= 0) & (places < TYPES - 2)
        return np.append(np.where(known, places + 2, UNKNOWN), END).astype(np.int16)


def _pieces(model: np.ndarray, n: int) -> pd.DataFrame:
    parts = np.array_split(model.astype(np.float32), PIECES)
    return pd.DataFrame({"piece": range(PIECES), "n": n, "sums": [(p * np.float64(n)).tobytes() for p in parts]})


def trained_round(bodies: DataFrame, words: bytes, model: np.ndarray) -> np.ndarray:
    """The model after one round: what each partition makes of it, averaged by tokens."""

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Vocabulary(words)
        own = shaped(model)
        adam = Adam(own)
        n = 0
        for batch in batches:
            texts = [known.types(known.places(tokens(t))) for t in batch["body"]]
            if texts:
                n += sum(map(len, texts))
                _run(own, Lanes(texts), adam)
        if n:
            yield _pieces(flat(own), n)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, n, values in zip(batch["piece"], batch["n"], batch["sums"], strict=True):
                have = sums.setdefault(piece, [0, 0.0])
                have[0] += n
                have[1] = have[1] + np.frombuffer(values, np.float64)
        if sums:
            yield pd.DataFrame([(k, n, v.tobytes()) for k, (n, v) in sums.items()], columns=["piece", "n", "sums"])

    kind = "piece int, n long, sums binary"
    rows = bodies.mapInPandas(train, kind)
    # Two levels of sums, each over about the square root of the number of models.
    salts = max(2, math.isqrt(bodies.rdd.getNumPartitions()))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    partial = salted.repartition(salts, "piece", "salt").select("piece", "n", "sums").mapInPandas(add, kind)
    got = partial.repartition(PIECES, "piece").mapInPandas(add, kind).orderBy("piece").collect()
    if not got:
        return model
    return np.concatenate([np.frombuffer(r["sums"], np.float64) / r["n"] for r in got]).astype(np.float32)


def scored_texts(docs: DataFrame, text: str, doc_id: str, carried: list[str]) -> DataFrame:
    """The carried columns, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    base = docs.select(
        whole(docs.select(*map(col, carried))).alias("d") if carried else F.struct(F.lit(0).alias("none")).alias("d"),
        F.coalesce(col(text), F.lit("")).cast("binary").alias("body"),
        held_out(doc_id).alias("held_out"),
        F.pmod(F.xxhash64(col(doc_id)), F.lit(sum(ROUNDS))).alias("eighth"),
    )
    training = base.filter("NOT held_out")
    counts = settle(word_counts(training.select("body")), "words")
    ends = training.count()
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (total["n"] or 0) + ends, total["v"] + (1 if ends else 0)

    frequent, frequent_counts = frequent_words(counts)
    own = frequent_counts[: TYPES - 2]
    types = np.zeros(TYPES)
    types[END], types[UNKNOWN], types[2 : 2 + len(own)] = ends, n - ends - own.sum(), own
    own_words = b" ".join(frequent.split()[: TYPES - 2])
    model = flat(new_model(types))
    first = 0
    for share in ROUNDS:
        slice_ = training.filter(F.col("eighth").between(first, first + share - 1)).select("body")
        model = trained_round(slice_, own_words, model)
        first += share

    # Unknown words share the unknown type's probability by smoothed frequency; one more stands for all unseen words.
    rest = n - ends - int(own.sum()) + ALPHA * (v - (1 if ends else 0) - len(own) + 1)
    fullmass = n + ALPHA * (v + 1)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, frequent_counts))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words_, counts_ = shared.value
        known = Vocabulary(words_)
        fitted = shaped(model)
        log_base = np.log10((counts_ + ALPHA) / fullmass)
        log_rest = np.log10((counts_ + ALPHA) / rest)
        end_base = np.log10((ends + ALPHA) / fullmass)
        for batch in batches:
            texts, found = [], []
            for text in batch:
                words = tokens(text)
                places = known.places(words)
                texts.append(known.types(places))
                seen = places[places >= 0]
                rare = Counter(words[i] for i in np.flatnonzero(places < 0))
                found.append(
                    (len(words) + 1, len(seen) + (1 if ends else 0), log_base[seen].sum() + end_base,
                     log_rest[seen[seen >= TYPES - 2]].sum(), list(rare), list(rare.values()))
                )
            out = pd.DataFrame(found, columns=["n_tokens", "known_here", "base_here", "rest_here", "rare", "times"])
            out["model"] = _run(fitted, Lanes(texts), None) / np.log(10) if texts else []
            yield out

    kind = (
        "n_tokens long, known_here long, base_here double, rest_here double, rare array<binary>, "
        "times array<long>, model double"
    )
    scores = F.pandas_udf(score, kind)("body").alias("s")
    row = F.monotonically_increasing_id().alias("row")
    scored = settle(base.select("d", "held_out", row, scores).select("d", "held_out", "row", "s.*"), "lm-scores")

    each = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.times").alias("times")
    )
    met = each.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("times") * F.log10((F.col("c") + ALPHA) / fullmass)).alias("base_rare"),
        F.sum(F.col("times") * F.log10((F.col("c") + ALPHA) / rest)).alias("rest_rare"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    summed = scored.join(rare, "row", "left").select(
        "d",
        "held_out",
        "n_tokens",
        (F.col("known_here") + zero(F.col("known_rare"))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_here") + zero(F.col("base_rare"))).alias("base_score"),
        (F.col("model") + F.col("rest_here") + zero(F.col("rest_rare"))).alias("score"),
    )
    return unpacked(summed, "d", carried, added)


def language_model_scores(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carried: list[str] | None = None
) -> DataFrame:
    """The carried columns (all, unless named) and the scores; these replace input columns of the same name."""
    return scored_texts(docs, text, doc_id, docs.columns if carried is None else carried)
