"""Toxicity with a gapped subsequence kernel, Nystroem landmarks and a support vector machine.

The machine is trained on labelled sentences: each is as toxic as its most insulting word. Words are compared by
the subsequence kernel over three letters spanning at most five, each skipped letter costing DECAY, with marks for
the word's ends: "id-iot", "idioot" and "i d i o t" stay close to "idiot".

Labels belong to documents, so the sentences to blame are found by multiple-instance learning: sentences of toxic
documents with words and stems that speak against either half of the documents alike are the first positives. The
machine is fitted; then toxic documents point to their best sentences again, and every clean sentence that comes
near the margin is a negative, by its most insulting word and with the weight of the sentences that it stands for, up to HEAVY.
A document's score follows from its three most insulting words. As the kernel is an inner product of explicit
features, landmarks and weights fold into one table by which all words are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundra.llm.common import bounded_batches, broadcast_if, pieces, text_bytes, text_of

#: Learned from at most about so many labelled rows of each kind, of at most LONGEST characters.
TOXIC_ROWS, CLEAN_ROWS, LONGEST = 1500, 3000, 50_000
DECAY, LANDMARKS, ROUNDS, COST = 0.6, 320, 4, 4.0
#: Clean sentences that one word can weigh as, in training.
HEAVY = 30
#: The value of a word that isn't there.
NOTHING = -2.0
#: Weights of the three highest word values and a constant before documents are seen, and how firmly they are held.
START, RIDGE = np.array([2.0, 0.7, 0.2, 0.3]), 0.02
#: Remembered values of tokens in a task, and letters of a word that are looked at at once.
MEMORY, WIDTH = 200_000, 24
#: Offsets of three letters within five, by letters skipped.
_PATTERNS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)]
_SIZE = 64
_ODD = re.compile(r"[\W\d_]+")
_SENTENCES = re.compile(r"[.!?\n]+")


def _letters() -> np.ndarray:
    """1-26 for a-z, 27-61 shared by all other letters; 0 is nothing, 62 and 63 are the word's ends."""
    table = 27 + np.arange(0x110000, dtype=np.int64) % 35
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table.astype(np.uint8)


_LETTERS = _letters()


def words_of(text: str) -> list[str]:
    """Lower-cased words without other signs; three or more single letters in a row are one word."""
    out, single = [], []
    for token in text.lower().split():
        word = token if token.isalpha() else _ODD.sub("", token)
        if len(word) == 1:
            single.append(word)
            continue
        if single:
            out.append("".join(single) if len(single) > 2 else single[-1])
            single = []
        if word:
            out.append(word)
    if single:
        out.append("".join(single) if len(single) > 2 else single[-1])
    return out


def sentences_of(text: str) -> list[list[str]]:
    """The distinct words of each sentence, and those that are spelled letter by letter across sentences."""
    sentences = [sorted(set(words_of(x))) for x in _SENTENCES.split(text)]
    return [*sentences, sorted(set(words_of(text)).difference(*sentences))]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, feature numbers and weights of all subsequences of all words; long words in parts of WIDTH letters."""
    pieces, owner = [], []
    for k, w in enumerate(words):
        for a in range(0, max(1, len(w) - 4), WIDTH - 6):
            pieces.append(("\x01" if a == 0 else "") + w[a : a + WIDTH - 2] + ("\x02" if a + WIDTH - 2 >= len(w) else ""))
            owner.append(k)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    grid = np.zeros((len(pieces), WIDTH + 4), np.int64)
    row = np.repeat(np.arange(len(pieces)), size)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    letters = _LETTERS[codes].astype(np.int64)
    letters[codes == 1], letters[codes == 2] = 62, 63
    grid[row, at] = letters
    rows, numbers, weights = [], [], []
    owner = np.array(owner, np.int64)
    for a, b, c in _PATTERNS:
        x, y, z = grid[:, :WIDTH], grid[:, b : WIDTH + b], grid[:, c : WIDTH + c]
        r, p = np.nonzero(z)
        rows.append(owner[r])
        numbers.append((x[r, p] * _SIZE + y[r, p]) * _SIZE + z[r, p])
        weights.append(np.full(len(r), DECAY ** (c - 2)))
    return np.concatenate(rows), np.concatenate(numbers), np.concatenate(weights)


def _norms(rows: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(np.maximum(np.bincount(rows, weights * weights, n), 1e-9))


class InsultModel:
    """Word scores as one table over the features; document scores by a fitted logistic curve."""

    def __init__(self):
        self.table, self.bias = np.zeros(_SIZE**3, np.float32), -1.0
        self.slopes, self.shift = START[:3], float(START[3])

    def raw(self, words: list[str]) -> np.ndarray:
        """Decision values of words."""
        out = np.empty(len(words))
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            rows, numbers, weights = features(part)
            out[a : a + len(part)] = np.bincount(rows, weights * self.table[numbers], len(part)) / _norms(rows, weights, len(part)) + self.bias
        return out

    def fit(self, positive: list[str], weight: np.ndarray, negative: list[str], against: np.ndarray, landmarks: int = LANDMARKS) -> None:
        """Nystroem map from landmarks of both kinds, then a linear machine with squared hinge loss."""
        half = landmarks // 2
        marks = [positive[k] for k in np.argsort(-weight, kind="stable")[:half]] + negative[:half]
        words = positive + negative
        rows, numbers, weights = features(marks)
        used, column = np.unique(numbers, return_inverse=True)  # only features of landmarks count
        place = np.full(_SIZE**3, len(used), np.int32)
        place[used] = np.arange(len(used))
        dense = np.zeros((len(marks), len(used) + 1))
        np.add.at(dense, (rows, column), weights)
        dense /= _norms(rows, weights, len(marks))[:, None]
        values, vectors = np.linalg.eigh(dense @ dense.T)
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        kernel = np.zeros((len(words), len(marks)))
        for a in range(0, len(words), 1000):
            part = words[a : a + 1000]
            rows, numbers, weights = features(part)
            sparse = np.zeros((len(part), len(used) + 1))
            np.add.at(sparse, (rows, place[numbers]), weights)
            kernel[a : a + len(part)] = (sparse @ dense.T) / _norms(rows, weights, len(part))[:, None]
        x = np.concatenate([kernel @ root, np.ones((len(words), 1))], 1)
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        share = np.concatenate([weight / weight.sum(), against / max(1.0, against.sum())]) * len(words) / 2
        w = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps on the points inside the margin
            on = y * (x @ w) < 1
            if not on.any():
                break
            xs = x[on] * (COST * share[on])[:, None]
            new = np.linalg.solve(xs.T @ x[on] + np.eye(x.shape[1]), xs.T @ y[on])
            if np.allclose(new, w, atol=1e-6):
                break
            w = new
        self.table = np.zeros(_SIZE**3, np.float32)
        self.table[used] = ((root @ w[:-1]) @ dense)[:-1]
        self.bias = float(w[-1])

    def calibrate(self, values: np.ndarray, labels: np.ndarray) -> None:
        """A logistic curve through the documents' evidence, both kinds weighing the same; few documents leave it near START."""
        share = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
        x = np.concatenate([values, np.ones((len(values), 1))], 1)
        w = START
        for _ in range(80):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (share * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(4)
            w = w + np.clip(np.linalg.solve(h, x.T @ (share * (labels - p)) - RIDGE * (w - START)), -2, 2)
        self.slopes, self.shift = np.maximum(w[:3], [1e-3, 0.0, 0.0]), float(w[3])

    def probability(self, values: np.ndarray) -> np.ndarray:
        """Scores of documents by their evidence."""
        return 1 / (1 + np.exp(-np.clip(values @ self.slopes + self.shift, -30, 30)))


class _Sentences:
    """The sentences of documents as word numbers: where each begins, and its document."""

    def __init__(self, documents: list[list[list[str]]], number: dict[str, int]):
        some = [(d, words) for d, sentences in enumerate(documents) for words in sentences if words]
        self.document = np.array([d for d, _ in some], np.int64)
        self.starts = np.cumsum([0, *(len(w) for _, w in some)])[:-1]
        self.flat = np.fromiter((number[w] for _, words in some for w in words), np.int64)

    def worst(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value and number of the most insulting word of each sentence, the first of equals."""
        if not len(self.flat):
            return np.zeros(0), self.flat
        each = values[self.flat]
        top = np.maximum.reduceat(each, self.starts)
        owner = np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, len(each))))
        at = np.flatnonzero(each == top[owner])
        first = at[np.unique(owner[at], return_index=True)[1]]
        return top, self.flat[first]


def learn(texts: list[str], labels: list[int]) -> InsultModel:
    """Fit from the sentences of documents with labels 1 and 0."""
    model = InsultModel()
    kept = [(t, y) for t, y in zip(texts, labels) if words_of(t)]
    toxic, clean = ([sentences_of(t) for t, y in kept if y == label] for label in (1, 0))
    if not toxic or not clean:
        return model
    words = sorted({w for doc in toxic + clean for s in doc for w in s})
    number = {w: k for k, w in enumerate(words)}
    halves = [[Counter(), Counter()], [Counter(), Counter()]]  # by label, of every other document
    for label, group in ((1, toxic), (0, clean)):
        for k, doc in enumerate(group):
            halves[label][k % 2].update({p for s in doc for w in s for p in _parts(w)})
    bad, good = (a + b for a, b in (halves[1], halves[0]))
    base = len(toxic) / (len(toxic) + len(clean))
    bar = 2 * np.log(max(100, len(bad)))  # as so many parts are tried

    def blame(part: str) -> float:
        """Likelihood ratio of a part that is more frequent in toxic documents; 0 for others."""
        k, n = bad[part], bad[part] + good[part]
        if k <= base * n:
            return 0.0
        return 2 * (k * np.log(k / (base * n)) + ((n - k) * np.log((n - k) / ((1 - base) * n)) if n > k else 0.0))

    def rare_in_clean(part: str) -> bool:
        return good[part] / len(clean) <= 0.1 * bad[part] / len(toxic)

    def holds(part: str) -> bool:
        """Whether a part is rare in clean documents and speaks against either half of the documents alike."""
        return rare_in_clean(part) and all(bad_half[part] > base * (bad_half[part] + good_half[part]) for bad_half, good_half in zip(halves[1], halves[0]))

    blamed = {p: x for p in bad if (x := blame(p)) > bar and holds(p)}
    # the first positives: sentences of toxic documents with the parts blamed most
    blame_of = np.array([max(blamed.get(p, 0.0) for p in _parts(w)) for w in words])
    of_toxic, of_clean = _Sentences(toxic, number), _Sentences(clean, number)

    def witnesses(values: np.ndarray, least: np.ndarray) -> Counter:
        """The most insulting words of up to three sentences of each toxic document that pass its ``least`` value."""
        top, word = of_toxic.worst(values)
        order = np.lexsort((word, -top, of_toxic.document))
        document = of_toxic.document[order]
        place = np.arange(len(order)) - np.searchsorted(document, document)
        on = order[(place < 3) & (top[order] > least[document])]
        return Counter(words[k] for k in word[on])

    most = np.zeros(len(toxic))
    np.maximum.at(most, of_toxic.document, of_toxic.worst(blame_of)[0])
    witness = witnesses(blame_of, 0.3 * most)
    if not witness:
        return model
    ordinary = np.unique(of_clean.flat)
    ordinary = ordinary[np.random.default_rng(7).permutation(len(ordinary))[:4000]].tolist()
    # what may be blamed later: a third of the evidence is enough for words close to those found
    may = np.array([rare_in_clean(w) and max(map(blame, _parts(w))) > bar / 3 for w in words])
    hard: dict[int, int] = {}  # most insulting words of clean sentences, with how many sentences they stand for
    for turn in range(ROUNDS):
        positive = sorted(witness, key=lambda w: (-witness[w], w))
        negative = [k for k in dict.fromkeys([*hard, *ordinary]) if words[k] not in witness]
        model.fit(positive, np.array([witness[w] for w in positive], float), [words[k] for k in negative], np.array([min(hard.get(k, 1), HEAVY) for k in negative], float))
        if turn + 1 < ROUNDS:
            values = model.raw(words)
            top, word = of_clean.worst(values)
            stands = Counter(word[top > -0.9].tolist())
            hard = dict([*((k, stands[k]) for k in sorted(stands, key=lambda k: (-values[k], k))[:1500]), *((k, n) for k, n in hard.items() if k not in stands)][:5000])
            witness = witnesses(np.where(may, values, -1.0), np.zeros(len(toxic))) or witness
    values = model.raw(words)
    model.calibrate(np.array([evidence({w: values[number[w]] for s in doc for w in s}) for doc in toxic + clean]), np.array([1] * len(toxic) + [0] * len(clean), float))
    return model


def evidence(values: dict[str, float]) -> list[float]:
    """The three highest values of different words of a document, NOTHING where there are fewer."""
    return (sorted(values.values(), reverse=True)[:3] + [NOTHING] * 3)[:3]


def _parts(word: str) -> tuple[str, ...]:
    """A word, and its first four letters as a stem."""
    return (word, word[:4] + "-") if len(word) > 4 else (word,)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> InsultModel:
    """Fit on about TOXIC_ROWS and CLEAN_ROWS labelled documents (all of them if there are fewer).

    Null labels, labels without a document, and texts that are null or over LONGEST characters aren't learned from;
    of several texts with one id, the first by order is.
    """
    marked = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").distinct()
    counts = {r.y: r.n for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("y") == 1, F.lit(min(1.0, TOXIC_ROWS / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, CLEAN_ROWS / max(1, counts.get(0, 0)))))
    sample = broadcast_if(marked.filter(draw < share), 10 * (TOXIC_ROWS + CLEAN_ROWS))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= LONGEST))
    # one text of an id, however many rows have it
    rows = sorted((str(r.id), r.text, r.y) for r in texts.join(sample, "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect())
    return learn([t for _, t, _ in rows], [y for _, _, y in rows])


class _Scorer:
    """Scores parts of batches; remembers the values of tokens, up to MEMORY of them."""

    def __init__(self, model: InsultModel):
        self.model = model
        self.tokens, self.words, self.values, self.single = pa.array([], pa.string()), pa.array([], pa.string()), np.zeros(0), np.zeros(0, bool)

    def places(self, tokens: pa.Array) -> np.ndarray:
        """Where the tokens stand in what is remembered."""
        place = pc.index_in(tokens, value_set=self.tokens)
        fresh = tokens.filter(pc.is_null(place))
        if not len(fresh):
            return place.to_numpy()
        if len(self.tokens) + len(fresh) > MEMORY:
            self.__init__(self.model)
            fresh = tokens
        words = [t if t.isalpha() else _ODD.sub("", t) for t in fresh.to_pylist()]
        values = self.model.raw(words)
        values[[not w for w in words]] = NOTHING
        self.tokens, self.words = pa.concat_arrays([self.tokens, fresh]), pa.concat_arrays([self.words, pa.array(words, pa.string())])
        self.values, self.single = np.concatenate([self.values, values]), np.concatenate([self.single, [len(w) == 1 for w in words]])
        return pc.index_in(tokens, value_set=self.tokens).to_numpy()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
        """Evidence of each text, and its worst word."""
        split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.string()))
        coded = split.flatten().dictionary_encode()
        place = self.places(coded.dictionary)
        document = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
        # words that tokens come down to, each once a document
        named = self.words.take(pa.array(place)).dictionary_encode()
        word = named.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64)
        value_of = np.zeros(len(named.dictionary))
        value_of[named.indices.to_numpy()] = self.values[place]
        pairs = np.unique(document * max(1, len(value_of)) + word)
        owner, word = pairs // max(1, len(value_of)), pairs % max(1, len(value_of))
        order = np.lexsort((word, -value_of[word], owner))
        rank = np.arange(len(order)) - np.searchsorted(owner, owner)
        found = np.full((len(texts), 3), NOTHING)
        worst: list[str | None] = [None] * len(texts)
        top = rank < 3
        at, of = rank[top], owner[order][top]
        found[of, at] = value_of[word[order][top]]
        first = top & (rank == 0)
        for d, name in zip(owner[order][first].tolist(), named.dictionary.take(pa.array(word[order][first])).to_pylist()):
            worst[d] = name or None
        # words spelled letter by letter
        alone = self.single[place][coded.indices.to_numpy()]
        run = alone[:-2] & alone[1:-1] & alone[2:] & (document[:-2] == document[2:])
        for d in np.unique(document[:-2][run]).tolist():
            own = sorted({_ODD.sub("", t) for t in split[d].as_py()}.union(words_of(texts[d])) - {""})
            values = dict(zip(own, self.model.raw(own).tolist()))
            found[d], worst[d] = evidence(values), max(values, key=lambda w: (values[w], w))
        return found, worst


def score_toxicity(docs: DataFrame, model: InsultModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 if score >= 0.5), worst (the word to blame).

    Null texts and texts without a word score as the model's floor and blame nothing; of words that are as bad, one
    is blamed. Texts of any length are scored whole, in time and memory in proportion to it; bytes that are no UTF-8
    count as U+FFFD. Repeated rows stay, an empty table gives no rows, further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # one table of fixed size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in pieces(batches, 1):
            found, worst = scorer([text_of(x.as_py()) for x in batch.column(1)])
            values = shared.value.probability(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64()), pa.array((values >= 0.5).astype(np.int32)), pa.array(worst, pa.string())], names=["doc_id", "score", "predicted", "worst"])

    return docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("body")).mapInArrow(score, f"doc_id {kind}, score double, predicted int, worst string")
