"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are concatenated and indexed by a suffix array, sorted by as many letters as
the longest piece has. Every piece is binary-searched for its range of occurrences; the occurrences are the
edges. Edges are sorted by where they end and relaxed from left to right, all words at once; the few words of
more than LONG letters one after another, which takes time in proportion to their length.

The model is a BPE model, so an edge may follow another only if merging their joint text gives just
these two pieces; of the edges that end at a place, exactly one follows what has been chosen before
its start, and the chain of chosen edges is the encoding. Words are parted at the space mark, which
stands only at the start of pieces (or makes up whole pieces); runs of marks are merged apart.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundra.llm.common import bounded_batches, give_back, pieces, strings, text_bytes

MARK = "▁"
#: Characters of distinct words indexed at once; remembered words per task, and places for pairs per worker.
BATCH_CHARS, WORDS, PAIRS = 100_000, 250_000, 1 << 20
#: Longer words are relaxed one by one and not remembered.
LONG = 256
#: Runs of marks but the last; words with their mark; single marks.
_PARTS = re.compile(f"{MARK}+(?={MARK})|{MARK}[^{MARK}]+|{MARK}").findall


class Codec:
    """Encodes and decodes with a BPE piece model with byte fallback and a leading space mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)  # only read: its pieces and scores
        size = model.get_piece_size()
        names = [model.id_to_piece(k) for k in range(size)]
        kept = [k for k in range(size) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.unknown = model.unk_id()
        self.bytes = {int(names[k][3:5], 16): k for k in range(size) if model.is_byte(k)}
        self.score = {names[k]: model.get_score(k) for k in kept}
        self.number = {names[k]: k for k in kept}
        if any(MARK in x.lstrip(MARK) or x.startswith(MARK * 2) and x.strip(MARK) for x in self.number) or any(len(x) > 1 and not set(x) <= self.number.keys() for x in self.number):
            raise ValueError("pieces with inner space marks or unknown characters are not supported")
        self.size = size
        self.raw = [b""] * size
        for name, k in self.number.items():
            self.raw[k] = name.replace(MARK, " ").encode()
        for byte, k in self.bytes.items():
            self.raw[k] = bytes([byte])
        self.name = names
        # pieces that merging their own text gives; runs of marks are merged apart
        whole = [x for x in self.number if not x.startswith(MARK * 2) and (len(x) == 1 or self.merge(x) == [x])]
        self.ids = np.array([self.number[x] for x in whole], np.int32)
        self.length = np.array([len(x) for x in whole], np.int32)
        self.depth = int(self.length.max())
        self.longest = max((len(x) for x in self.number if not x.strip(MARK)), default=1)
        self.longest_first = self.merge(MARK * self.longest) == [MARK * self.longest]
        alphabet = sorted(x for x in whole if len(x) == 1)
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        for k, x in enumerate(alphabet):
            self.letter[ord(x)] = k + 1
        self.single = np.zeros(len(alphabet) + 1, np.int32)
        for k, x in enumerate(alphabet):
            self.single[k + 1] = self.number[x]
        # the letters of each piece, packed step by step: with nothing and with anything after its end
        bits = len(alphabet).bit_length()
        self.step = max(1, min(self.depth, 62 // bits))
        self.bits = bits
        rounds = -(-self.depth // self.step)
        self.least, self.most = np.zeros((rounds, len(whole)), np.int64), np.zeros((rounds, len(whole)), np.int64)
        padded = np.full((len(whole), rounds * self.step), -1, np.int64)
        for k, x in enumerate(whole):
            padded[k, : len(x)] = self.letter[[ord(c) for c in x]]
        for k in range(rounds * self.step):
            self.least[k // self.step] = (self.least[k // self.step] << bits) | np.maximum(padded[:, k], 0)
            self.most[k // self.step] = (self.most[k // self.step] << bits) | np.where(padded[:, k] < 0, (1 << bits) - 1, padded[:, k])
        self.raw_pieces = pa.array([*self.raw, b""], pa.binary())
        self.pair_keys, self.pair_good, self.pairs = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool), 0
        self.forget()

    def forget(self) -> None:
        """Drop the remembered words; pairs stay, in a table of fixed size."""
        self.words = pa.array([], pa.string())  # without their mark
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def merge(self, text: str) -> list[str]:
        """Merge neighbours, best score first and leftmost of equals; for checks of pieces and pairs."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            joined = [score(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(joined)
            if best == -np.inf:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def run(self, n: int) -> list[int]:
        """Ids of a run of n marks; the longest piece of marks joins with nothing more."""
        if n >= self.longest and self.longest_first:
            times, n = divmod(n, self.longest)
            return [self.number[MARK * self.longest]] * times + (self.run(n) if n else [])
        return [self.number[x] for x in self.merge(MARK * n)]

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of every occurrence of every piece in ``text`` (letters, 0 between words)."""
        n, depth, step = len(text), self.depth, self.step
        padded = np.concatenate([text, np.zeros(depth + step, np.int64)])
        packed = padded[: n + depth].copy()  # the next letters of each place in one number
        for k in range(1, step):
            packed = (packed << self.bits) | padded[k : k + n + depth]
        key, reach = packed[:n], step
        order = np.argsort(key, kind="stable")
        while reach < depth:  # sorted by twice as many letters by their ranks
            rank = np.empty(n, np.int64)
            ordered = key[order]
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            after = np.zeros(n, np.int64)
            after[: max(0, n - reach)] = rank[reach:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            reach *= 2
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), n, np.int64)
        for k in range(len(self.least)):
            on = np.flatnonzero((self.length > k * step) & (low < high))
            if not len(on):
                break
            low[on], high[on] = self.bound(packed, order, low[on], high[on], self.least[k, on], k * step), self.bound(packed, order, low[on], high[on], self.most[k, on] + 1, k * step)
        count = np.where(low < high, high - low, 0)
        total = int(count.sum())
        places = np.repeat(low - (np.cumsum(count) - count), count)
        places += np.arange(total)
        return order[places].astype(np.int32), np.repeat(np.arange(len(self.ids), dtype=np.int32), count)

    @staticmethod
    def bound(packed, order, low, high, target, k):
        """First places in [low, high) of the suffix array whose letters from the k-th on are at least target."""
        low, high = low.copy(), high.copy()
        while True:
            on = np.flatnonzero(low < high)
            if not len(on):
                return low
            middle = (low[on] + high[on]) // 2
            less = packed[order[middle] + k] < target[on]
            low[on[less]] = middle[less] + 1
            high[on[~less]] = middle[~less]

    def follows(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether merging the joint text of two pieces leaves them as they are."""
        keys = before.astype(np.int64) * self.size + after
        good, missing = self._known(keys)
        if len(missing):
            new = np.unique(keys[missing]).tolist()
            self._room(len(new))
            for key in new:
                self._learn_pair(key)
            good[missing] = self._known(keys[missing])[0]
        return good

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is remembered of pairs, and which pairs aren't."""
        good, missing = np.zeros(len(keys), bool), []
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            held = self.pair_keys[at]
            hit, empty = held == keys[todo], held < 0
            good[todo[hit]] = self.pair_good[at[hit]]
            missing.append(todo[empty])
            on = ~(hit | empty)
            todo, at = todo[on], (at[on] + 1) % PAIRS
        return good, np.concatenate(missing) if missing else todo

    @staticmethod
    def _slot(keys):
        return ((keys * 0x9E3779B1) >> 9) % PAIRS

    def _room(self, new: int) -> None:
        """Forget all pairs if so many new ones would fill more than half of the table."""
        if self.pairs + new > PAIRS // 2:
            self.pair_keys[:], self.pairs = -1, 0

    def _learn_pair(self, key: int) -> bool:
        a, b = self.name[key // self.size], self.name[key % self.size]
        good = self.merge(a + b) == [a, b]
        at = self._slot(key)
        while self.pair_keys[at] >= 0:
            at = (at + 1) % PAIRS
        self.pair_keys[at], self.pair_good[at] = key, good
        self.pairs += 1
        return good

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each word (and the mark before it) one after another, and where each word's begin."""
        codes = np.frombuffer((MARK + f"\n{MARK}".join(words.to_pylist())).encode("utf-32-le"), np.uint32)
        text = self.letter[codes].astype(np.int64)
        size = pc.utf8_length(words).to_numpy().astype(np.int64) + 1
        first = np.cumsum(size + 1) - size - 1
        text[(first + size)[:-1]] = 0  # between words
        owner_start = np.repeat(first, size + 1)[: len(text)]
        start, piece = self.edges(text)
        # characters in no piece are edges of their own, given out as bytes
        odd = np.flatnonzero(text == 0)
        ends = first + size
        odd = odd[ends[np.searchsorted(ends, odd)] != odd]
        length = np.concatenate([self.length[piece], np.ones(len(odd), np.int32)])
        ids = np.concatenate([self.ids[piece], np.full(len(odd), -1, np.int32)])
        start = np.concatenate([start, odd.astype(np.int32)])
        last = np.full(len(text) + 1, -2, np.int32)  # the chosen piece that ends before each place
        back = np.zeros(len(text) + 1, np.int32)
        if (size > LONG).any():
            far = np.repeat(size > LONG, size + 1)[: len(text)][start]
            self.relax_long(start[far], length[far], ids[far], owner_start, last, back)
            start, length, ids = start[~far], length[~far], ids[~far]
        level = (start - owner_start[start] + length).astype(np.uint16)  # where an edge ends in its word
        order = np.argsort(level, kind="stable")
        start, length, ids, level = start[order], length[order], ids[order], level[order]
        at_first = level == length
        end = start + length
        cuts = np.flatnonzero(np.diff(level)) + 1
        begins = np.concatenate([[0], cuts]) if len(level) else cuts
        for a, b in zip(begins.tolist(), np.concatenate([cuts, [len(level)]]).tolist()):
            s, t = start[a:b], ids[a:b]
            before, good = last[s], at_first[a:b]
            if len(odd):
                good |= (t == -1) & (before != -2) | (before == -1)
            ask = np.flatnonzero(~good & (before >= 0) & (t >= 0))
            good[ask] = self.follows(before[ask], t[ask])
            to = end[a:b][good]
            last[to], back[to] = t[good], s[good]
        # walk back from the ends of all words
        took_word, took_id, took_at = [], [], []
        for k in np.flatnonzero(size > LONG).tolist():
            at, chain = int(ends[k]), []
            while at > first[k]:
                chain.append(at)
                at = int(back[at])
            took_word.append(np.full(len(chain), k))
            took_id.append(last[chain])
            took_at.append(back[chain])
        word = np.flatnonzero(size <= LONG)
        at = ends[word]
        while True:
            on = at > first[word]
            at, word = at[on], word[on]
            if not len(at):
                break
            took_word.append(word)
            took_id.append(last[at])
            took_at.append(back[at])
            at = back[at].astype(np.int64)
        if not took_word:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        word, ids, at = (np.concatenate(x) for x in (took_word, took_id, took_at))
        order = np.argsort(at, kind="stable")  # places grow from word to word
        word, ids, at = word[order], ids[order], at[order]
        if (ids == -1).any():  # bytes of characters in no piece
            out = [[self.bytes.get(x, self.unknown) for x in chr(codes[p]).encode()] if t == -1 else [t] for t, p in zip(ids.tolist(), at.tolist())]
            many = np.fromiter(map(len, out), np.int64, len(out))
            word, ids = np.repeat(word, many), np.array([x for y in out for x in y], np.int32)
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(word, minlength=len(words)), out=starts[1:])
        return ids, starts

    def relax_long(self, start, length, ids, owner_start, last, back) -> None:
        """As the other words, edge by edge in the order of their ends."""
        end = start + length
        order = np.argsort(end, kind="stable")
        first, known, size = owner_start[start[order]], {}, self.size
        chosen: dict[int, int] = {}
        for s, e, t, f in zip(start[order].tolist(), end[order].tolist(), ids[order].tolist(), first.tolist()):
            if s != f:
                before = chosen.get(s, -2)
                if before == -2:
                    continue
                if t != -1 and before != -1:
                    key = before * size + t
                    good = known.get(key)
                    if good is None:
                        good, missing = self._known(np.array([key]))
                        if len(missing):
                            self._room(1)
                        known[key] = good = self._learn_pair(key) if len(missing) else bool(good[0])
                    if not good:
                        continue
            chosen[e] = t
            last[e], back[e] = t, s

    def learn(self, words: pa.Array) -> None:
        """Encode words not met before, in batches of bounded size, and remember them."""
        ends = np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64) + 2)
        flats, starts, at = [self.flat], [self.starts], 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS, "right")))
            ids, begin = self.encode_words(words.slice(at, to - at))
            flats.append(ids)
            starts.append(begin[1:] + starts[-1][-1])
            at = to
        self.flat, self.starts = np.concatenate(flats), np.concatenate(starts)
        self.words = pa.concat_arrays([self.words, words])

    def pieces_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the remembered words at ``at`` one after another, and how many each has."""
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        return self.flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and offsets by text."""
        texts = pa.array(texts, pa.string())
        # texts with runs of marks, or with none
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK)), pc.or_(pc.starts_with(texts, " "), pc.equal(pc.binary_length(texts), 0)))
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        parts = [_PARTS(MARK + t.replace(" ", MARK)) if t else [] for t in texts.filter(odd).to_pylist()]
        others = pa.array([w[1:] for part in parts for w in part if w[1:].strip(MARK)], pa.string())
        coded = pa.concat_arrays([split.flatten(), others]).dictionary_encode()
        used = coded.dictionary
        place = pc.index_in(used, value_set=self.words)
        fresh = used.filter(pc.is_null(place))
        if len(self.words) + len(fresh) > WORDS:
            self.forget()
            fresh = used
        if len(fresh):
            self.learn(fresh)
            place = pc.index_in(used, value_set=self.words)
        ids, size = self.pieces_of(place.to_numpy()[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(size)])
        words = np.cumsum(np.concatenate([[0], pc.list_value_length(split).to_numpy()]))
        counts = np.zeros(len(texts), np.int64)
        odd = odd.to_numpy(zero_copy_only=False)
        counts[~odd] = np.diff(ends[words])
        if parts:
            own = (ids[a:b].tolist() for a, b in zip(ends[words[-1] : -1].tolist(), ends[words[-1] + 1 :].tolist()))
            runs = iter([self.with_runs(part, own) for part in parts])
            plain = iter(np.split(ids[: ends[words[-1]]], ends[words[1:-1]]))
            rows = [next(runs) if x else next(plain) for x in odd]
            counts[:] = [len(x) for x in rows]
            ids = np.concatenate(rows)
        if len(used) and pc.max(pc.utf8_length(used)).as_py() >= LONG:
            self.forget()
        return ids, np.concatenate([[0], np.cumsum(counts)])

    def with_runs(self, part: list[str], own: Iterator[list[int]]) -> np.ndarray:
        """Ids of a text with runs of marks: what a word's own ids leave of its mark joins the run."""
        out: list[int] = []
        mark, marks = self.number[MARK], 0
        for w in part:
            if not w.strip(MARK):
                marks += len(w)
                continue
            ids = next(own)
            if marks and ids[0] == mark:
                marks += 1
                ids = ids[1:]
            if marks:
                out += self.run(marks)
                marks = 0
            out += ids
        if marks:
            out += self.run(marks)
        return np.array(out, np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids: pieces and bytes joined, without the leading space."""
        flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        raw = self.raw_pieces.take(pa.array(np.where((flat >= 0) & (flat < self.size), flat, self.size)))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        joined = strings(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), raw), b""))
        return pc.if_else(pc.starts_with(joined, " "), pc.utf8_slice_codeunits(joined, 1), joined)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    """Ids of rows and their token ids, part by part."""
    c = codec(model)
    try:
        for batch in pieces(batches, 1):
            ids, offsets = c.encode(strings(batch.column(1)))
            yield batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
    finally:
        c.forget()  # workers live on
        give_back()


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, token_ids (array<int>).

    ``model`` is the path of the model file on every executor. Null and empty texts have no tokens; bytes that
    are no UTF-8 count as U+FFFD. Very long texts and words take time and memory in proportion to their length.
    Repeated rows stay, an empty table gives no rows, further columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lists in _encoded(batches, model):
            yield pa.RecordBatch.from_arrays([ids, lists], names=["doc_id", "token_ids"])

    return docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("body")).mapInArrow(run, f"doc_id {kind}, token_ids array<int>")


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row per input row: doc_id, token_ids, text. Null ids give the empty text, ids out of range nothing."""
    bounded_batches(tokens.sparkSession)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), c.decode_all(batch.column(1))], names=["doc_id", "token_ids", "text"])

    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("token_ids")).mapInArrow(run, f"doc_id {kind}, token_ids array<int>, text string")


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode it again, in one pass: doc_id, n_tokens, token_ids, decoded_sha256.

    Rows as encode() and decode() give them.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lists in _encoded(batches, model):
            decoded = codec(model).decode_all(lists).cast(pa.binary())  # only its digest leaves the task
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in decoded], pa.string())], names=["doc_id", "token_ids", "decoded_sha256"])

    both = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("body")).mapInArrow(run, f"doc_id {kind}, token_ids array<int>, decoded_sha256 string")
    return both.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", "decoded_sha256")
