"""Language identification with a blended-spectrum string kernel.

The kernel of two texts counts the character n-grams (n = 1 to 3) present in both, over the square root
of the product of their own counts. Landmark texts give a Nystroem map; one-versus-rest ridge regression
in that space gives one weight per landmark and language. As the kernel is linear in the n-grams of the
landmarks, landmarks and weights fold into one matrix, and a batch of texts is scored by one product.
All characters are told apart: n-grams of landmarks are looked up by exact numbers, and one with a character
that no landmark has is in no landmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boundra.llm.common import bounded_batches, pieces

#: Learned from at most about SAMPLE texts of a language and TEXTS of all, of at most LONGEST characters; landmarks of a language.
SAMPLE, TEXTS, LONGEST, LANDMARKS = 500, 20_000, 50_000, 60
RIDGE, SHARPNESS = 1e-3, 6.0
#: Numbers of a matrix at most. With many languages, fewer landmarks of each are taken until those of the landmarks and of the weights fit.
DENSE = 1 << 27
#: Characters of texts that are scored at once.
AT_ONCE = 300_000
_LETTER = regex.compile(r"\p{L}").search


def fold(id_column: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


class SpectrumModel:
    def __init__(self, texts: list[str], langs: list[str], landmarks: int = LANDMARKS):
        self.langs = sorted(set(langs))
        by_lang: dict[str, list[int]] = {}
        for k, lang in enumerate(langs):
            by_lang.setdefault(lang, []).append(k)
        while True:
            chosen = [k for lang in self.langs for k in by_lang[lang][:landmarks]]
            alphabet = sorted(set().union(*(texts[k].lower() for k in chosen)))
            self.letter = np.zeros(0x110000, np.int32)  # 0: in no landmark
            for k, c in enumerate(alphabet):
                self.letter[ord(c)] = k + 1
            self.letters = len(alphabet) + 1
            grams = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(self.grams(texts[k])) for k in chosen)]))
            if landmarks == 1 or len(grams) * max(len(chosen), len(self.langs)) <= DENSE:
                break
            landmarks = max(1, landmarks // 2)
        self.landmarks = len(chosen)
        self.features = len(grams)
        # numbers of n-grams in a table of open addresses, a quarter full at most
        self.slots = 1 << max(10, (4 * len(grams)).bit_length())
        self.held, self.feature = np.full(self.slots, -1, np.int64), np.full(self.slots, len(grams), np.int32)
        todo = np.arange(len(grams))
        at = self.slot(grams)
        while len(todo):
            free = np.flatnonzero(self.held[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]  # one comer for each place
            self.held[at[first]], self.feature[at[first]] = grams[todo[first]], todo[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, at = todo[rest], (at[rest] + 1) % self.slots
        marks = self.presence([texts[k] for k in chosen])
        marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
        step = max(1, min(100, DENSE // 4 // max(1, len(grams))))
        gram = np.concatenate([self.kernel(texts[k : k + step], marks) for k in range(0, len(texts), step)])
        values, vectors = np.linalg.eigh(sum((marks[:, k : k + 65536].astype(float) @ marks[:, k : k + 65536].T for k in range(0, max(1, marks.shape[1]), 65536)), np.zeros((len(marks), len(marks)))))
        good = values > 1e-8 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        mapped = gram @ root
        mapped = np.concatenate([mapped, np.ones((len(texts), 1))], 1)
        target = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        # each language weighs the same
        weight = (1 / np.array([langs.count(x) for x in langs]))[:, None]
        left = mapped.T @ (weight * mapped) + RIDGE * np.eye(mapped.shape[1])
        solved = np.linalg.solve(left, mapped.T @ (weight * target))
        into = root @ solved[:-1]
        self.weights = np.concatenate([(marks[:, k : k + 65536].T @ into).astype(np.float32) for k in range(0, max(1, marks.shape[1]), 65536)])
        self.bias = solved[-1]

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * 0x9E3779B1) >> 7) & (self.slots - 1)

    def grams(self, text: str) -> np.ndarray:
        """Numbers of the text's n-grams of characters that landmarks have; those of each length have their own range."""
        c = self.letter[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        a, known = self.letters, c > 0
        two, both = c[:-1] * a + c[1:], known[:-1] & known[1:]
        three, all_three = two[:-1] * a + c[2:], both[:-1] & known[2:]
        return np.concatenate([c[known], two[both] + a, three[all_three] + a + a * a])

    def presence(self, texts: list[str]) -> np.ndarray:
        """Which of the landmarks' n-grams each text has."""
        out = np.zeros((len(texts), self.features + 1), np.float32)
        found = [self.grams(t) for t in texts]
        row, grams = np.repeat(np.arange(len(texts)), [len(x) for x in found]), np.concatenate([np.zeros(0, np.int64), *found])
        at = self.slot(grams)
        while len(grams):
            held = self.held[at]
            hit = held == grams
            out[row[hit], self.feature[at[hit]]] = 1
            on = np.flatnonzero(~hit & (held >= 0))
            row, grams, at = row[on], grams[on], (at[on] + 1) & (self.slots - 1)
        return out[:, :-1]

    def kernel(self, texts: list[str], marks: np.ndarray) -> np.ndarray:
        p = self.presence(texts)
        return (p @ marks.T) / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place of the language and a score from 0 to 1 for each text."""
        p = self.presence(texts)
        f = (p @ self.weights) / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1)) + self.bias
        e = np.exp(SHARPNESS * (f - f.max(1, keepdims=True)))
        return f.argmax(1), e.max(1) / e.sum(1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> SpectrumModel | None:
    """Fit on about ``sample`` texts of each language of ``docs`` (all of them if it has fewer), fewer if they were TEXTS in all.

    Texts that are null or of more than LONGEST characters aren't learned from. None without any.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(f"lang IS NOT NULL AND text IS NOT NULL AND length(text) <= {LONGEST}")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    sample = min(sample, max(1, TEXTS // len(counts)))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1_000_000)) / 1e6
    taken = sorted((r.id or "", r.text, r.lang) for r in rows.filter(draw < share[F.col("lang")]).collect())
    return SpectrumModel([t for _, t, _ in taken], [lang for _, _, lang in taken]) if taken else None


def identify_language(docs: DataFrame, model: SpectrumModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score.

    ``und`` with score 0 for a null text, a text without a letter (Unicode's category L), or without a model. Of
    languages that score alike, the first by name. Texts of any length are scored whole. Repeated rows stay, an empty
    table gives no rows, further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # bounded by the landmarks, not by the corpus

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        most = max(1, min(128, DENSE // 8 // max(1, m.features))) if m is not None else 128
        for batch in pieces(batches, 1):
            langs, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(1).to_pylist()
            on = [k for k, t in enumerate(texts) if m is not None and t and _LETTER(t)]
            while on:
                part, chars = [], 0
                while on and len(part) < most and (not part or chars + len(texts[on[-1]]) <= AT_ONCE):
                    chars += len(texts[on[-1]])
                    part.append(on.pop())
                place, value = m.predict([texts[k] for k in part])
                scores[part] = value
                for k, p in zip(part, place.tolist()):
                    langs[k] = m.langs[p]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, lang_pred string, score double")
