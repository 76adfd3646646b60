"""Toxicity by a support vector machine on a gap-weighted subsequence string kernel, with Nystroem landmarks.

Words are what stands between white space, lower-cased, with all but letters taken out, so signs within a word don't
hide it; single letters in a row are one word.  The kernel of order ORDER counts the subsequences that two strings share, each
with DECAY to the power of the length it spans in both: letters put in between weaken a match, they don't
end it.  Its POWER is taken between a word, with a mark at its beginning, and a landmark; words that have too few of the landmark's letters for a common
subsequence, whose kernel is 0, are passed over.  A sentence has, for each landmark, the sum of its words' kernel values; the landmarks' own kernel matrix to
the power -1/2 maps these to a vector.  A linear SVM scores each sentence.  A logistic curve turns a text's
largest margin and the sum of its margins above that of a sentence without matches, whole and for its number
of words, into its score: nothing but margins goes into it.

Landmarks are stems, beginnings of words, that cover the words that tell toxic from other training texts.  The SVM is trained on
sentences: of toxic texts the one with the largest margin so far, of others all.  Training takes a bounded
sample, about SAMPLE texts of each label chosen by the hash of their ids.

Null and empty texts have the score of a text without any landmark's letters.  Without training rows of both labels each
score is 0.  A document with several labels counts as toxic if one says so.  Repeated rows give one row each.  Only
the named columns are looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches as B
from .common import keep, sampled, table

ORDER = 4
DECAY = 0.7
#: The kernel that is used is this power of the subsequence kernel, a kernel as well: what many words share with a landmark by chance hardly adds up.
POWER = 4
SAMPLE = 4000
LANDMARKS = 48
STEM = range(4, 11)
#: A telling word is in so many sampled toxic texts, and so many times as large a share of toxic ones as of others.
LEAST_TEXTS, TIMES = 5, 20
RIDGE = 0.1
START = b"\x01"
#: Letters of a word that are looked at together; longer words are cut into overlapping parts.
WORD = 32
#: Words whose kernel values a worker holds, LANDMARKS numbers each: most words of a text have been in another.
HELD = 1 << 18
THRESHOLD = 0.7
_SPACE = ~B.byte_table(bytes([*range(9, 14), *range(28, 33)]))
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_BIT = np.zeros(256, np.uint32)
_BIT[97:123] = np.uint32(1) << np.arange(26, dtype=np.uint32)
_BIT[128:] = np.uint32(1) << (26 + np.arange(128, dtype=np.uint32) % 6)
_STOP = np.isin(np.arange(256), list(b".!?"))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, where each word begins in them with the end last, text of each word, sentence of each word)."""
    starts, ends, _ = B.word_spans(data, offsets, ~_SPACE)
    letter = _LETTER[data]
    before = np.concatenate([[0], np.cumsum(letter)])
    first, last = before[starts], before[ends]
    has = np.flatnonzero(last > first)
    starts, ends, first, last = starts[has], ends[has], first[has], last[has]
    text = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return data[letter], np.zeros(1, np.int64), text, text
    other = np.concatenate([[True], text[1:] != text[:-1]])
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    stopped = np.concatenate([[True], _STOP[data[ends[:-1] - 1]]]) | np.concatenate([[True], lines[starts[1:]] != lines[starts[:-1]]])
    single = last - first == 1
    goes_on = np.concatenate([[False], single[1:] & single[:-1]]) & ~other
    sentence = np.cumsum(other | stopped)
    keep_ = ~goes_on
    return data[letter], np.concatenate([first[keep_], last[-1:]]), text[keep_], sentence[keep_]


def kernel(strings: np.ndarray, landmark: bytes) -> np.ndarray:
    """Of each row of letters, zeros after its end, the subsequence kernel with the landmark."""
    n, m = len(strings), len(landmark)
    order = min(ORDER, m)
    marks = np.frombuffer(landmark, np.uint8)[:, None]
    apart = np.arange(m)[:, None] - np.arange(m) - 1
    fade = np.where(apart >= 0, DECAY ** np.maximum(apart, 0), 0).astype(np.float32)  # of a match from one place of the landmark to those after it
    k1 = np.zeros((order, m, n), np.float32)  # K' of each order for what comes before each place of the landmark
    k1[0] = 1
    total = np.zeros(n, np.float32)
    for at in range(strings.shape[1]):
        met = k1 * ((strings[:, at] == marks) * np.float32(DECAY**2))
        total += met[-1].sum(axis=0)
        k1[1:] *= np.float32(DECAY)
        k1[1:] += fade @ met[:-1]
    return total


def one(word: bytes, landmark: bytes) -> float:
    return float(kernel(np.frombuffer(word, np.uint8)[None], landmark)[0])


def may_share(strings: np.ndarray, landmark: bytes) -> np.ndarray:
    """Whether each row of letters has a subsequence of the kernel's order in common with the landmark: the kernel of others is 0.

    The longest common subsequence by bit vectors: a bit for each place of the landmark, 0 where the length grows."""
    m = len(landmark)
    if m > 31:
        return np.ones(len(strings), bool)
    kind = np.uint16 if m < 16 else np.uint32
    bits = np.zeros(256, kind)
    for i, c in enumerate(landmark):
        bits[c] |= kind(1 << i)
    left = np.full(len(strings), (1 << m) - 1, kind)
    for column in np.ascontiguousarray(strings.T):
        met = left & bits[column]
        left = (left + met) | (left - met)
    return m - np.bitwise_count(left & kind((1 << m) - 1)).astype(np.int64) >= min(ORDER, m)


def _least_letters(landmark: bytes) -> int:
    """How many different letters' bits a word has at least of the landmark's if their kernel isn't 0; the mark may be one match."""
    bits = _BIT[np.frombuffer(landmark.removeprefix(START), np.uint8)]
    most = np.cumsum(np.sort(np.unique(bits, return_counts=True)[1])[::-1])
    return int(np.searchsorted(most, min(ORDER, len(landmark)) - landmark.startswith(START))) + 1


class Landmarks:
    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        own = np.array([[one(a, b) for b in strings] for a in strings])
        self.unit = 1 / np.diag(own)
        own = own**POWER
        self.scale = 1 / np.sqrt(np.diag(own))
        values, vectors = np.linalg.eigh(own * self.scale[:, None] * self.scale[None, :])
        good = values > 1e-4 * values.max()
        self.root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
        self.masks = np.array([np.bitwise_or.reduce(_BIT[np.frombuffer(s, np.uint8)]) for s in strings], np.uint32)
        self.least = np.array([_least_letters(s) for s in strings])
        self.known, self.place, self.held, self.rows = np.empty(0, B.U), np.empty(0, np.int64), np.empty((0, len(strings)), np.float32), 0

    def _remember(self, hashes: np.ndarray, values: np.ndarray) -> None:
        """Holds the values of up to HELD words, those met first, for the texts to come."""
        new = min(len(hashes), HELD - self.rows)
        if new <= 0:
            return
        if self.rows + new > len(self.held):
            self.held = np.concatenate([self.held[: self.rows], np.empty((min(HELD, 2 * (self.rows + new)) - self.rows, self.held.shape[1]), np.float32)])
        self.held[self.rows : self.rows + new] = values[:new]
        known, place = np.concatenate([self.known, hashes[:new]]), np.concatenate([self.place, self.rows + np.arange(new)])
        order = np.argsort(known, kind="stable")
        self.known, self.place, self.rows = known[order], place[order], self.rows + new

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, kernel values with each landmark, by its own length) of the sentences that have any."""
        letters, at, text, sentence = words(data, offsets)
        none = np.empty(0, np.int64), np.empty((0, len(self.strings)), np.float32)
        if len(at) < 2:
            return none
        begin, size = at[:-1], np.diff(at)
        long = size > WORD
        whole = np.full(len(size), START[0], np.uint8)
        if long.any():  # parts that overlap by half
            parts = np.where(long, -(-(size - WORD) // (WORD // 2)) + 1, 1)
            source = np.repeat(np.arange(len(size)), parts)
            turn = np.arange(len(source)) - np.repeat(np.cumsum(parts) - parts, parts)
            begin = begin[source] + turn * (WORD // 2)
            size = np.minimum(WORD, at[:-1][source] + np.diff(at)[source] - begin)
            text, sentence, whole = text[source], sentence[source], np.where(turn == 0, whole[source], 0).astype(np.uint8)
        bits = np.append(_BIT[letters], np.uint32(0))  # the places after it are ends of words
        mask = np.bitwise_or.reduceat(bits, np.stack([begin, begin + size], 1).ravel())[::2]
        hashes = B.word_hashes(letters, begin, begin + size) ^ whole.astype(B.U)
        distinct, one_of, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        seen = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        values = np.empty((len(one_of), len(self.strings)), np.float32)
        values[seen] = self.held[self.place[at[seen]]]
        new = one_of[~seen]
        values[~seen] = own = self._kernels(letters, mask[new], begin[new], size[new], whole[new])
        self._remember(distinct[~seen], own)
        first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        out = np.add.reduceat(values[back.ravel()], first, axis=0)
        has = out.any(axis=1)
        return (text[first[has]], out[has]) if has.any() else none

    def _kernels(self, letters: np.ndarray, mask: np.ndarray, begin: np.ndarray, size: np.ndarray, whole: np.ndarray) -> np.ndarray:
        values = np.zeros((len(begin), len(self.strings)), np.float32)
        for least, most in ((0, 6), (6, 10), (10, 16), (16, WORD)):
            some = np.flatnonzero((size > least) & (size <= most))
            if not len(some):
                continue
            place = begin[some, None] + np.arange(most)
            strings = np.where(np.arange(most) < size[some, None], letters[np.minimum(place, len(letters) - 1)], 0)
            strings = np.concatenate([whole[some, None], strings], 1)
            for k, m in enumerate(self.masks):
                hit = np.flatnonzero(np.bitwise_count(mask[some] & m) >= self.least[k])
                hit = hit[may_share(strings[hit], self.strings[k])]
                if len(hit):
                    values[some[hit], k] = (kernel(strings[hit], self.strings[k]) * np.float32(self.unit[k])) ** POWER
        return values

    def map(self, values: np.ndarray) -> np.ndarray:
        return (values / self.scale) @ self.root if len(values) else np.zeros((0, len(self.strings)))


def _lowered(batch: pa.RecordBatch, text: str):
    column = pc.utf8_lower(batch.column(text).cast(pa.large_string()).fill_null(""))
    numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(column))), column], ["row", "text"])
    for part, data, offsets in B.chunks(numbered, "text"):
        yield part.column("row").to_numpy(), data, offsets


def stems(telling: dict[str, int], other: dict[str, int], odds: float, most: int = LANDMARKS) -> list[bytes]:
    """Beginnings that cover the telling words, weighted by their texts.  odds: toxic sampled texts by others."""
    parts = lambda w: {w[:n] for n in STEM if n <= len(w)} | {w}
    weight: dict[str, int] = {}
    for w, k in telling.items():
        for s in parts(w):
            weight[s] = weight.get(s, 0) + k
    against = dict.fromkeys(weight, 0)
    for w, k in other.items():
        for s in parts(w):
            if s in against:
                against[s] += k
    good = [s for s in weight if weight[s] >= TIMES * odds * against[s]]
    left, out = dict(telling), []
    while len(out) < most and left:
        gain = dict.fromkeys(good, 0)
        for w, k in left.items():
            for s in parts(w):
                if s in gain:
                    gain[s] += k
        best = max(good, key=lambda s: (gain[s], -against[s], len(s), s), default=None)
        if best is None or gain[best] < LEAST_TEXTS:
            break
        out.append(best)
        left = {w: k for w, k in left.items() if not w.startswith(best)}
    return [START + s.encode() for s in out]


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps; the last feature is the constant."""
    w = np.zeros(x.shape[1] + 1)
    blocks = [slice(i, i + 20_000) for i in range(0, len(x), 20_000)]
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        square, slope = ridge.copy(), ridge @ w
        for at in blocks:
            z = np.concatenate([x[at], np.ones((len(x[at]), 1))], 1)
            slack = 1 - y[at] * (z @ w)
            on = slack > 0
            zi, ci = z[on], c * weight[at][on]
            square += (zi * ci[:, None]).T @ zi
            slope -= (zi * (ci * y[at][on] * slack[on])[:, None]).sum(axis=0)
        step = np.linalg.solve(square, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the features, the last a constant, by Newton steps on smoothed targets."""
    target = np.where(y > 0, (sum(y > 0) + 1) / (sum(y > 0) + 2), 1 / (sum(y <= 0) + 2))
    z, w = np.concatenate([x, np.ones((len(x), 1))], 1), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + RIDGE * np.eye(len(w)), z.T @ (p - target) + RIDGE * w)
        w = w - np.clip(step, -2, 2)
    return w


class Model:
    def __init__(self, landmarks: Landmarks, w: np.ndarray, b: float) -> None:
        self.landmarks, self.w, self.b, self.curve = landmarks, w, b, None

    def features(self, n: int, owner: np.ndarray, values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        most, total = np.zeros(n), np.zeros(n)
        margin = values @ (self.landmarks.root @ self.w / self.landmarks.scale).astype(np.float32)
        np.maximum.at(most, owner, margin)
        np.add.at(total, owner, np.maximum(margin, 0))
        return np.stack([most + self.b, np.log1p(total), np.log1p(200 * total / np.maximum(n_words, 1))], 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        x = self.features(n, *self.landmarks.sentences(data, offsets), count_words(data, offsets))
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -500, 500)))


def count_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return B.word_spans(data, offsets, ~_SPACE)[2]


def _words_of(batches):
    for batch in batches:
        for rows, data, offsets in _lowered(batch, "text"):
            letters, at, text, _ = words(data, offsets)
            raw = letters.tobytes()
            own = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            cuts = np.searchsorted(text, np.arange(len(rows) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("toxic").take(pa.array(rows)), pa.array([list({w for w in own[a:b] if 3 <= len(w) <= WORD}) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.list_(pa.string()))], ["toxic", "words"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """From labels, rows of key and a label of 0 or 1, and the texts of those that are sampled; these
    rows, about `sample` of each label, are broadcast, so the documents aren't shuffled."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    few = keep(marked.where(sampled(F.col("key"), F.col("toxic"), sizes, sample)), "sampled")
    chosen = keep(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(few), "key"), "labelled")
    used = chosen.mapInArrow(B.giving_back(_words_of), "toxic int, words array<string>").select("toxic", F.explode("words").alias("w"))
    counts = keep(used.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t + c > 1"), "words")
    odds = min(1.0, sample / sizes[1]) * sizes[1] / (min(1.0, sample / sizes[0]) * sizes[0])
    # of the sample's words, whose texts are bounded
    table_of = lambda df: dict(zip(*[c.to_pylist() for c in df.toArrow().columns], strict=True))
    telling = table_of(counts.where(f"t >= {LEAST_TEXTS} AND t >= {TIMES * odds:.9f} * c").select("w", "t"))
    starts = F.array([F.lit(w[: STEM.start]) for w in sorted({w[: STEM.start] for w in telling})]) if telling else F.array().cast("array<string>")
    other = table_of(counts.where((F.col("c") > 0) & F.array_contains(starts, F.left("w", F.lit(STEM.start)))).select("w", "c"))
    chosen_stems = stems(telling, other, odds)
    if not chosen_stems:
        return None
    landmarks = Landmarks(chosen_stems)
    shared = docs.sparkSession.sparkContext.broadcast(landmarks)

    def features(batches):
        for batch in batches:
            for rows, data, offsets in _lowered(batch, "text"):
                owner, values = shared.value.sentences(data, offsets)
                per = [values[owner == i].astype("<f4") for i in range(len(rows))]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").take(pa.array(rows)), pa.array([v.tobytes() for v in per]), pa.array(count_words(data, offsets))], ["toxic", "values", "n"])

    got = chosen.mapInArrow(B.giving_back(features), "toxic int, values binary, n bigint").toArrow().to_pylist()  # the sample's sentences with a landmark
    y = np.array([1 if r["toxic"] else -1 for r in got])
    raw = [np.frombuffer(r["values"], "<f4").reshape(-1, len(chosen_stems)) for r in got]
    per = [landmarks.map(x).astype(np.float32) for x in raw]
    per = [x if len(x) else np.zeros((1, len(chosen_stems)), np.float32) for x in per]
    # of toxic texts the sentence nearest to a landmark to begin with, then the one with the largest margin
    pick = [int(np.argmax((x**2).sum(axis=1))) for x in per]
    negatives = np.concatenate([x for x, v in zip(per, y, strict=True) if v < 0])
    for _ in range(6):
        positives = np.stack([x[i] for x, i, v in zip(per, pick, y, strict=True) if v > 0])
        x = np.concatenate([positives, negatives])
        t = np.concatenate([np.ones(len(positives)), -np.ones(len(negatives))])
        weight = np.where(t > 0, 1 / len(positives), 1 / len(negatives)) * len(t) / 2 / 10
        w, b = svm(x, t, weight)
        new = [int(np.argmax(x @ w)) for x in per]
        if new == pick:
            break
        pick = new
    del per, negatives, positives, x
    model = Model(landmarks, w, b)
    owner = np.repeat(np.arange(len(raw)), [len(v) for v in raw])
    model.curve = logistic(model.features(len(raw), owner, np.concatenate(raw), np.array([r["n"] for r in got])), y)
    # the sample may hold more toxic texts than there are: shift to the labels' own odds
    model.curve[-1] += np.log(sizes[1] / sizes[0]) - np.log(odds)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text; a column of that name is replaced.  Equal texts have equal scores."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS strings and weights

    def run(batches):
        model = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for rows, data, offsets in _lowered(batch, text) if model else ():
                scores[rows] = model.scores(data, offsets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(B.giving_back(run), f"{schema}, {out} double")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
