"""License scans: normalised text against licence notices and full licence texts by Dice over word bigrams.

A text is lower-cased and cut into words; where bigrams of a template stand, windows of the text of the
template's size are compared with it, across line ends. Two texts with Dice t have sizes within t / (2 - t)
of each other, so a line or a document is compared whole only with templates of such a size. The windows of
a template slide by one word, its common bigrams being counted on, and only where enough of them lie close.
"""

from __future__ import annotations

import math
import pkgutil
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boundra.llm.common import bounded_batches, pieces, text_bytes
from boundra.llm.decontaminate import words_of

LEAST_DICE = 0.75
#: Short public notices by SPDX identifier.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Released under CC0 1.0 Universal public domain dedication",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


#: Full licence texts by SPDX identifier, each a file in licenses/, without titles and names where these change.
TEXTS = "0BSD Apache-2.0 Artistic-1.0-Perl BSD-2-Clause BSD-3-Clause CC0-1.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 MIT MPL-1.1 MPL-2.0 Unlicense".split()


def full_texts() -> dict[str, str]:
    return {name: pkgutil.get_data("boundra.llm", f"licenses/{name}.txt").decode() for name in TEXTS}


class Notices:
    """Templates: short notices, and full texts, which go before the notices they hold."""

    def __init__(self, notices: dict[str, str], least: float, texts: dict[str, str] | None = None):
        self.least = least
        self.templates = []
        self.by_pair: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
        for full, (name, text) in [(False, x) for x in sorted(notices.items())] + [(True, x) for x in sorted((texts or {}).items())]:
            words = words_of(text.encode())
            if len(words) < 2:
                raise ValueError(f"the notice {name} has fewer than two words")
            pairs = Counter(zip(words, words[1:]))
            # so many common bigrams a text of any size needs
            need = max(1, math.ceil(least / (2 - least) * (len(words) - 1) - 1e-9))
            self.templates.append((name, len(words), pairs, need, full))
            for p in pairs:
                self.by_pair[p].append(len(self.templates) - 1)
        self.by_pair = dict(self.by_pair)

    def scan(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """Best template of each stretch of a text: name, Dice, first word, word after the last."""
        words = words_of(text)
        pairs = list(zip(words, words[1:]))
        places: dict[int, list[int]] = defaultdict(list)
        known = self.by_pair
        for k, p in enumerate(pairs):
            if p in known:
                for number in known[p]:
                    places[number].append(k)
        places = {number: at for number, at in places.items() if len(at) >= self.templates[number][3]}
        if not places:
            return []
        lines, first = [(0, len(words))], 0
        for line in text.split(b"\n"):
            if size := len(words_of(line)):
                lines.append((first, first + size))
                first += size
        found = []
        for number, at in places.items():
            name, _, _, _, full = self.templates[number]
            for (start, end), value in {**self.slide(pairs, at, number), **self.parts(pairs, at, number, lines)}.items():
                found.append((not full, -value, start, name, end))
        taken: list[tuple[str, float, int, int]] = []
        for _, value, start, name, end in sorted(found):
            if all(end <= a or start >= b for _, _, a, b in taken):
                taken.append((name, -value, start, end))
        return sorted(taken, key=lambda x: x[2])

    def slide(self, pairs: list, at: list[int], number: int) -> dict[tuple[int, int], float]:
        """The windows of a template's size with its least Dice; ``at``: where its bigrams stand."""
        _, size, template, need, _ = self.templates[number]
        total, out = size - 1, {}
        ranges: list[list[int]] = []  # starts whose windows hold enough bigrams of the template
        for a, b in zip(at, at[need - 1 :]):
            if b - a < total:
                low = max(0, b - total + 1)
                if ranges and low <= ranges[-1][1] + 1:
                    ranges[-1][1] = a
                else:
                    ranges.append([low, a])
        for low, high in ranges:
            counts, common = Counter(), 0
            first = last = bisect_left(at, low)
            for start in range(low, high + 1):
                while first < last and at[first] < start:
                    p = pairs[at[first]]
                    counts[p] -= 1
                    common -= counts[p] < template[p]
                    first += 1
                while last < len(at) and at[last] < start + total:
                    p = pairs[at[last]]
                    common += counts[p] < template[p]
                    counts[p] += 1
                    last += 1
                have = min(total, len(pairs) - start)
                if (value := 2 * common / (have + total)) >= self.least:
                    out[start, start + have + 1] = value
        return out

    def parts(self, pairs: list, at: list[int], number: int, lines: list[tuple[int, int]]) -> dict[tuple[int, int], float]:
        """The document and lines of a size near the template's, and what a line's end cuts from its windows."""
        _, size, template, need, _ = self.templates[number]
        low, high = self.least / (2 - self.least) * (size - 1), (2 - self.least) / self.least * (size - 1)
        out = {}
        for begin, end in lines:
            if end - begin - 1 < low:
                continue
            a, b = bisect_left(at, begin), bisect_left(at, end - 1)
            if b - a < need:
                continue
            starts = [k for k in at[max(a, bisect_left(at, end - size)) : b - need + 1]]
            for start in [begin, *starts] if end - begin - 1 <= high else starts:
                held = Counter(pairs[k] for k in at[bisect_left(at, start) : b])
                value = 2 * sum(min(n, template[p]) for p, n in held.items()) / (end - start - 1 + size - 1)
                if value >= self.least:
                    out[start, end] = value
        return out


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, least: float = LEAST_DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, license (best match, ties by place), dice, n_matches, matches.

    Without ``notices``, the fixed ones and the full licence texts are sought. Without a match, and for null or empty texts, license is null, dice 0 and matches empty. Repeated
    rows stay, an empty table gives no rows, further columns are ignored. Texts of any length are scanned whole, as
    bytes; of overlapping matches the better one is given, of equal ones the first.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    known = Notices(NOTICES, least, full_texts()) if notices is None else Notices(notices, least)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in pieces(batches, 1):
            rows = [[{"license": n, "dice": v, "start": a, "end": b} for n, v, a, b in known.scan(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "matches"])

    found = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("body")).mapInArrow(scan, f"doc_id {kind}, matches array<struct<license:string,dice:double,start:bigint,end:bigint>>")
    best = F.aggregate("matches", F.lit(None).cast("struct<license:string,dice:double,start:bigint,end:bigint>"), lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]), x).otherwise(a))
    return found.withColumn("best", best).select("doc_id", F.col("best.license").alias("license"), F.coalesce("best.dice", F.lit(0.0)).alias("dice"), F.size("matches").cast("bigint").alias("n_matches"), "matches")
