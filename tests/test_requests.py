"""Paging, structured search, nearest targets and as-of joins for many requests, against brute force and by what their joins give."""

import random

from pyspark.sql import functions as F

from boundra.operators.quality import encode_cursor, pages_after
from boundra.operators.search import match_structured, structured_matches
from boundra.operators.snapshots import as_of_join, as_of_summary, filter_areas
from boundra.operators.spatial import nearest_per_request


def test_pages_of_many_cursors(spark):
    """Keys that repeat, cursors between rows and behind all, a page for each; places are counted."""
    r = random.Random(1)
    keys = sorted((r.randint(0, 40), k) for k in range(500))
    df = spark.createDataFrame([(a, b, f"v{b}") for a, b in keys], "a int, b int, v string").repartition(5)
    asked = [(i, a, b) for i, (a, b) in enumerate([(r.randint(-1, 41), r.randint(-5, 505)) for _ in range(1500)])]
    before = {i: sum(k <= (a, b) for k in keys) for i, a, b in asked}
    rows = spark.createDataFrame([(i, a, b, before[i] + (i % 10 == 0)) for i, a, b in asked], "request_id int, a int, b int, said bigint")
    cursors = rows.select("request_id", encode_cursor(F.lit("v"), F.col("said"), [F.col("a"), F.col("b")]).alias("cursor"))
    found = {}
    for x in pages_after(df, ["a", "b"], cursors, 4, "v", verify=True).collect():
        found.setdefault(x.request_id, []).append((x.place, x.a, x.b, x.status, x.next_cursor is not None) if x.status == "OK" else x.status)
    for i, _, _ in asked:
        if i % 10 == 0:
            assert found[i] == ["CURSOR_STALE"]
        else:
            page = keys[before[i] : before[i] + 4]
            assert sorted(found.get(i, [])) == [(before[i] + n, *k, "OK", n == 4) for n, k in enumerate(page, 1)]
    # the last row's cursor leads to the next page, to the end
    cursor, seen = None, []
    for _ in range(4):
        page = sorted(pages_after(df, ["a", "b"], spark.createDataFrame([(1, cursor)], "request_id int, cursor string"), 170, "v", verify=True).collect(), key=lambda x: x.place)
        seen += [(x.a, x.b) for x in page]
        cursor = page[-1].next_cursor if page else None
        if cursor is None:
            break
    assert seen == keys


def test_structured_requests_join_nothing_but_matches(spark):
    r = random.Random(2)
    some = lambda *values: r.choice([None, None, *values])
    held = [(r.randint(1, 3), f"a{i}", r.choice(["Łódź", "Gdańsk", "Polna Wola"]), r.choice([None, "ul. Długa", "Krótka"]), str(r.randint(1, 4)), some("00-001"), some("s1", "s2"), some("m1")) for i in range(300)]
    addresses = spark.createDataFrame(held, "shard int, object_id string, locality_name string, street_name string, building_number string, postal_code string, street_id string, municipality_code string")
    asked = [(i, some("łódź", "GDAŃSK"), some("ulica Długa", "krotka", ""), some("1", "2"), some("s1", "s2"), some("m1"), some([1], [1, 3], [])) for i in range(120)]
    requests = spark.createDataFrame(asked, "request_id int, locality string, street string, number string, street_id string, municipality_code string, shards array<int>")
    plain = {"łódź": "Łódź", "GDAŃSK": "Gdańsk", "ulica Długa": "ul. Długa", "krotka": "Krótka", "": None}
    wanted = set()
    for i, locality, street, number, sid, mc, shards in asked:
        if all(v is None for v in (locality, street, number, sid, mc)):
            continue
        for h in held:
            if (locality is None or h[2] == plain[locality]) and (street is None or h[3] == plain[street]) and (number is None or h[4] == number) and (sid is None or h[6] == sid) and (mc is None or h[7] == mc) and (shards is None or h[0] in shards):
                wanted.add((i, h[1]))
    assert {(x.request_id, x.object_id) for x in match_structured(requests, addresses, 1000).collect()} == wanted
    a, b = structured_matches(requests, addresses)
    assert a.join(b, ["mask", "key"]).count() == len(wanted)  # no row of the join is thrown away


def test_nearest_with_own_radii(spark):
    r = random.Random(3)
    held = [(r.choice("ąaćczżź") + str(i), float(r.randint(-40, 40) * 50), float(r.randint(-40, 40) * 50)) for i in range(600)]
    asked = [(i, r.uniform(-2500, 2500), r.uniform(-2500, 2500), r.choice([None, 1.0, 70.0, 500.0, 3000.0, 10_000.0]), r.choice([None, 1, 100]), r.choice([None, 5, 5000])) for i in range(200)]
    requests = spark.createDataFrame([*asked, (999, float("nan"), 0.0, None, None, None)], "point_id int, x double, y double, radius double, limit int, max_candidates int")
    found = {}
    for x in nearest_per_request(requests, spark.createDataFrame(held, "object_id string, tx double, ty double")).collect():
        found.setdefault(x.point_id, []).append((x.rank, x.object_id, x.status))
    order = {c: k for k, c in enumerate("aącćzźż")}
    for i, x, y, radius, limit, ceiling in asked:
        near = sorted(((x - b) ** 2 + (y - c) ** 2, order[o[0]], o[1:], o) for o, b, c in held if (x - b) ** 2 + (y - c) ** 2 <= (radius or 500.0) ** 2)
        if len(near) > (ceiling or 500):
            assert found[i] == [(None, None, "CANDIDATE_LIMIT_EXCEEDED")]
        else:
            assert sorted(found.get(i, [])) == [(k, n[3], "OK") for k, n in enumerate(near[: limit or 10], 1)]
    assert found[999] == [(None, None, "INVALID_INPUT")]


def test_as_of_join_by_brute_force(spark):
    r = random.Random(4)
    day = lambda: f"{r.choice([1700, 1800, 1999, 2000, 2001, 2600])}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    versions = [(r.choice(["hot", "hot", "k"]), i, r.choice([None, day()]), r.choice([None, day()])) for i in range(250)]
    requests = [(r.choice(["hot", "k", "none"]), i, day()) for i in range(150)] + [("hot", 900, None), ("hot", 901, "no day")]
    found = as_of_join(spark.createDataFrame(requests, "key string, q int, date string"), spark.createDataFrame(versions, "key string, v int, valid_from string, valid_to string"), ["key"])
    rows = [(x.q, x.v) for x in found.collect()]
    wanted = {(q, v) for a, q, d in requests if d and d != "no day" for b, v, f, t in versions if a == b and (f is None or f <= d) and (t is None or d <= t)}
    assert len(rows) == len(set(rows)) and set(rows) == wanted


def test_as_of_summary_equals_its_pairs(spark):
    """Open ends, days beyond the bins, keys without versions; and no more rows are joined than bins hold."""
    r = random.Random(5)
    day = lambda: r.choice([f"20{r.randint(10, 12)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"] * 8 + ["1750-01-01", "1799-12-31", "1800-01-01", "2600-05-05", "2023-02-30"])
    requests = spark.createDataFrame([(r.choice("abc"), q, day()) for q in range(400)], "key string, q int, date string")
    versions = spark.createDataFrame([(r.choice("ab"), r.choice([None, day()]), r.choice([None, day(), day()])) for _ in range(200)], "key string, valid_from string, valid_to string")
    pairs = as_of_join(requests, versions, ["key"]).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("valid_from").alias("a"), F.max("valid_from").alias("b")).collect()
    found = as_of_summary(requests, versions, ["key"]).select("q", "versions", "oldest", "newest").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, map(tuple, pairs))) and pairs
    plan = as_of_summary(requests, versions, ["key"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hint") == 0 and "Aggregate" in plan


def test_filters_that_ask_the_same_are_answered_once(spark):
    areas = spark.createDataFrame([("L01", str(k), f"N{k % 3}", f"{k % 4:02d}") for k in range(30)] + [("L02", "x", None, None)], "layer_id string, object_id string, name string, code string")
    asked = [(i, [None, "01", "02", "none"][i % 4], [None, "L01", "L02"][i % 3]) for i in range(60)]
    found = {}
    for x in filter_areas(areas, spark.createDataFrame(asked, "request_id int, code string, layer_id string"), limit=3).collect():
        found.setdefault(x.request_id, []).append((x.rank, x.object_id))
    rows = [(a.layer_id, (a.name or "").lower(), a.object_id, a.code) for a in areas.collect()]
    for i, code, layer in asked:
        best = sorted(a for a in rows if (code or layer) and (code is None or code == a[3]) and (layer is None or layer == a[0]))[:3]
        assert sorted(found.get(i, [])) == [(n, a[2]) for n, a in enumerate(best, 1)]
    ranked = filter_areas(areas, spark.createDataFrame(asked, "request_id int, code string, layer_id string"), limit=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in ranked and "request_id" not in next(x for x in ranked.splitlines() if "Window [" in x)


def test_a_cursor_is_decoded_once(spark):
    from boundra.functions.ids import once

    df = once(spark.range(3).withColumn("k", F.col("id").cast("string")), "d", F.upper("k"))
    plan = df.filter("d = 'x' OR d = 'y' OR d = 'z'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1


def test_equal_searches_are_answered_once_by_their_rarest_word(spark, monkeypatch):
    """one search for requests of one form; the same results where nothing is sent to all tasks."""
    from boundra.operators import search

    addresses = spark.createDataFrame([(k % 2, f"a{k}", "Gdynia", "Polna", str(k), None) for k in range(1, 31)], "shard int, object_id string, locality_name string, street_name string, building_number string, postal_code string")
    requests = spark.createDataFrame([(i, ["Polna 7", "polna  7", "POLNA 7", "Gdynia polna 9", "nic 7"][i % 5]) for i in range(20)], "request_id int, query string")
    seen, plain = [], search.text_search
    monkeypatch.setattr(search, "text_search", lambda queries, *more: (seen.append(queries.count()), plain(queries, *more))[1])
    found = sorted((x.request_id, x.object_id, x.rank) for x in search.search_addresses(requests, addresses).collect())
    assert seen == [3]
    assert found == sorted((i, "a9" if i % 5 == 3 else "a7", 1) for i in range(20) if i % 5 < 4)
    monkeypatch.setattr(search, "SENT", 0)
    assert found == sorted((x.request_id, x.object_id, x.rank) for x in search.search_addresses(requests, addresses).collect())
