"""Archives with ids and pages of any kind; licence scans against brute-force Dice over all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from boundra.llm.decontaminate import words_of
from boundra.llm.license_scan import LEAST_DICE, Notices
from boundra.llm.warc import archive_round_trip


def test_ids_and_payloads_of_any_kind(spark):
    long = "<p>é</p>" * 400_000  # 3.6 MB
    trap = "x" * 1200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [("a\nb", "u1", long), ("c>d\r\n", "http://x/\r\nWARC-Type: evil", long), ("ü %41 +", None, trap), ("z", "u4", trap), ("", "u5", None), (None, "u6", "short"), ("plain", "h" * 100_000, "short")]
    out = {r.payload_digest: [] for r in []}
    for r in archive_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).collect():
        out.setdefault(r.payload_digest, []).append(r)
    digest = lambda text: hashlib.sha1(text.encode()).hexdigest()
    assert sum(map(len, out.values())) == len(rows)
    kept = {text: max(i for i, _, t in rows if t == text) for text in (long, trap)}
    for text, keep in kept.items():
        for r in out[digest(text)]:
            assert r.payload_bytes == len(text.encode())
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == keep else ("revisit", keep))
        assert {r.page_id for r in out[digest(text)]} == {i for i, _, t in rows if t == text}
    assert {r.page_id for r in out[digest("short")]} == {None, "plain"} and {r.page_id or "" for r in out[digest("")]} == {""}


def _dice(words: list[bytes], template: list[bytes]) -> float:
    a, b = Counter(zip(words, words[1:])), Counter(zip(template, template[1:]))
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def test_windows_equal_brute_force():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)]
    texts = {f"T{k}": " ".join(rng.choice(vocabulary) for _ in range(n)) for k, n in enumerate((4, 7, 12, 40))}
    known = Notices(texts, LEAST_DICE)
    hits = 0
    for trial in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for name, text in texts.items():
            if rng.random() < 0.5:
                noisy = [w if rng.random() > 0.06 else rng.choice(vocabulary) for w in text.split()]
                at = rng.randint(0, len(words))
                words[at:at] = noisy
        body = [w.encode() for w in words]
        text = "".join(w + (" " if rng.random() < 0.8 else "\n") for w in words).encode()
        want: dict[int, dict[tuple[int, int], float]] = {}
        for number, (name, size, *_rest) in enumerate(known.templates):
            template = words_of(texts[name].encode())
            for start in range(max(0, len(body) - 1)):
                window = body[start : start + size]
                if len(window) > 1 and (value := _dice(window, template)) >= LEAST_DICE - 1e-12:
                    want.setdefault(number, {})[start, start + len(window)] = value
        pairs = list(zip(body, body[1:]))
        for number, windows in want.items():
            at = [k for k, p in enumerate(pairs) if p in known.templates[number][2]]
            found = known.slide(pairs, at, number)
            assert {k: round(v, 9) for k, v in windows.items()} == {k: round(v, 9) for k, v in found.items()}
        # what is given out is the best of what overlaps, and nothing that stands alone is lost
        taken = known.scan(text)
        hits += len(taken)
        for windows in want.values():
            for start, end in windows:
                assert any(a < end and start < b for _, _, a, b in taken)
        for (_, value, a, b), (_, _, c, _d) in zip(taken, taken[1:]):
            assert b <= c and value >= LEAST_DICE
    assert hits > 100
