import random
from collections import defaultdict

import numpy as np

from lettermill.llm import packing

CAPACITIES = [(1, 100), (2, 37)]


def check(items, rows, slack):
    """Every item whole or cut only if it must be, no container overfull, and few containers."""
    for pack, capacity in CAPACITIES:
        mine = [r for r in rows if r.pack_id == pack]
        fill, parts = defaultdict(int), defaultdict(list)
        for r in mine:
            fill[r.container_id] += r.tokens
            parts[r.doc_id].append((r.piece, r.token_start, r.tokens))
        assert max(fill.values(), default=0) <= capacity
        assert set(parts) == {d for d, _, n in items if n > 0}
        for d, _, n in items:
            if n > 0:
                got = sorted(parts[d])
                assert [p[0] for p in got] == list(range(1, len(got) + 1)) and len(got) == max(1, -(-n // capacity))
                assert [p[1] for p in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))] and sum(p[2] for p in got) == n
        assert len(fill) <= slack * -(-sum(n for _, _, n in items) // capacity) + 3


def test_windows_and_shares(spark):
    rng = random.Random(3)
    items = [(k, "hot" if k % 3 == 0 else rng.choice(["a", "b", None]), rng.choice([0, 1, 5, 20, 36, 37, 38, 99, 100, 101, 450])) for k in range(1500)]
    df = spark.createDataFrame(items, "doc_id bigint, source string, tokens bigint")
    check(items, packing.pack_sized(df, CAPACITIES).collect(), 1.06)
    check(items, packing.pack_sized(df, CAPACITIES, window_tokens=15_000).collect(), 1.12)


def test_deficits_keep_the_mixture():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 30, 4000)
    sources = (rng.random(4000) < 0.25).astype(np.int64)
    share = np.bincount(sources, sizes) / sizes.sum()
    out = packing.pack_window(sizes, sources, 100, np.zeros(2), share)
    seen, worst = np.zeros(2), 0.0
    for _, item, _, _, n in out[: len(out) * 3 // 4]:
        seen[sources[item]] += n
        worst = max(worst, abs(seen[0] - share[0] * seen.sum()))
    assert worst < 200  # two containers, however long the queue


def test_edges(spark):
    schema = "doc_id bigint, source string, tokens bigint"
    assert packing.pack_sized(spark.createDataFrame([], schema), CAPACITIES).count() == 0
    assert packing.pack_sized(spark.createDataFrame([(1, "a", 0), (2, None, None)], schema), CAPACITIES).count() == 0
    # a repeated row is an item of its own
    twice = packing.pack_sized(spark.createDataFrame([(1, "a", 10), (1, "a", 10)], schema), [(9, 10)])
    assert twice.select("container_id").distinct().count() == 2
    docs = spark.createDataFrame([(1, None, "some text", 7), (2, "s", "", 7), (3, "s", None, 7)], "doc_id bigint, source string, text string, pack_id int")
    assert [(r.doc_id, r.tokens) for r in packing.pack_documents(docs, [(1, 512)]).collect()] == [(1, 2)]
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, weight double")
    assert packing.pack_sized(spark.createDataFrame([(1, "a", 5), (2, "b", 5), (3, "c", 5)], schema), [(1, 10)], weights=weights).count() == 3


def test_prefix_sums_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 4)
    data = [(w, s, w * 7 + len(s)) for w in range(21) for s in ("a", "bb") if (w + len(s)) % 5]
    got = {(r.window, r.source): r.before for r in packing.totals_before(spark.createDataFrame(data, "window bigint, source string, held bigint"), ["source"], "held").collect()}
    assert got == {(w, s): sum(v for x, t, v in data if t == s and x < w) for w, s, _ in data}
