"""Token counts with the whole-token shortcut.

For the word vocabulary (a ``tokenizers`` JSON file: BPE with word ends after NFC, white space folding,
lower-casing and a word split) most pre-tokens of a text are vocabulary strings that encode alone as
one token. Which ones do is proved once, offline, by merging each vocabulary string. A pre-token in
that set counts one; only the rest is merged, each distinct one once per task.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundra.llm.common import bounded_batches, pieces, text_bytes, text_of

#: Remembered counts of merged pre-tokens per worker.
MEMORY = 300_000
#: A pre-token of more bytes is merged from a heap; one of more characters isn't remembered.
LONG = 64


def byte_letters() -> dict[int, str]:
    """The usual printable letter for each byte of byte-level BPE."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in kept)}


class WordCounter:
    """Counts the tokens of texts as the vocabulary's library gives them, special strings included."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text("utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("byte_fallback"):
            raise ValueError("a BPE vocabulary with word ends is asked for")
        self.suffix = model["end_of_word_suffix"]
        self.rank = {tuple(pair if isinstance(pair, list) else pair.split(" ")): k for k, pair in enumerate(model["merges"])}
        self.letters = byte_letters()
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]))
        self.counts = self.whole_tokens(model["vocab"])
        self.first = len(self.counts)

    def whole_tokens(self, vocabulary: dict[str, int]) -> dict[str, int]:
        """Pre-tokens that are proved to encode alone as one token."""
        back = {letter: byte for byte, letter in self.letters.items()}
        found = {}
        for piece in vocabulary:
            if piece.endswith(self.suffix) and len(piece) > len(self.suffix):
                body = piece[: -len(self.suffix)]
                try:
                    word = bytes(back[x] for x in body).decode()
                except (KeyError, UnicodeDecodeError):
                    continue  # part of a character: no pre-token
                if self.merged(word) == 1:
                    found[word] = 1
        return found

    def merged(self, word: str) -> int:
        """Tokens of one pre-token: neighbours are merged, best rank first and leftmost of equals."""
        parts = [self.letters[x] for x in word.encode()]
        parts[-1] += self.suffix
        if len(parts) > LONG:
            return self.merged_long(parts)
        rank, none = self.rank, len(self.rank)
        while len(parts) > 1:
            ranks = [rank.get(pair, none) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts)

    def merged_long(self, parts: list[str]) -> int:
        """The same order of merges from a heap of (rank, place), in time n log n; merged places become empty."""
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get((a, b))) is not None]
        heapify(heap)
        left = n
        while heap:
            _, k, a, b = heappop(heap)
            other = after[k]
            if parts[k] != a or other >= n or parts[other] != b:
                continue  # one of the two has been merged since
            parts[k], parts[other] = a + b, ""
            left -= 1
            after[k] = after[other]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                    heappush(heap, (r, x, parts[x], parts[y]))
        return left

    def of_word(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= LONG:
            if len(self.counts) > self.first + MEMORY:
                self.counts = dict(list(self.counts.items())[: self.first])
            self.counts[word] = n
        return n

    def __call__(self, text: str) -> int:
        total, segments = 0, [text]
        if "<|" in text:
            segments = self.special.split(text)
            total = len(segments) - 1
        for segment in segments:
            if segment:
                # lower-casing goes letter by letter: no final sigma
                plain = unicodedata.normalize("NFC", segment).replace("Σ", "σ").lower()
                known = self.counts.get
                for word in self.find(plain):
                    total += known(word) or self.of_word(word)
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is the path of the JSON file on every executor. Null text counts as empty: 0 bytes,
    0 tokens; bytes that are no UTF-8 count as U+FFFD. Special strings inside a text are one token each, as the
    library has it; none are added. Very long texts and words take time in proportion to their length, nearly.
    Repeated rows stay, an empty table gives no rows, further columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in pieces(batches, 1):
            n_bytes, n_tokens = [], []
            for body in batch.column(1):
                raw = body.as_py()
                n_bytes.append(len(raw))
                n_tokens.append(counter(text_of(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("body"))
    return source.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
