import random
import re

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lettermill.operators import redelivery
from lettermill.operators.quotient import QuotientTable, permute


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3), st.integers(-5, 100)), max_size=300), st.integers(0, 8))
def test_table_is_a_dict_of_minima(entries, skip):
    table, model = QuotientTable(2, skip), {}
    for k in range(0, len(entries), 50):
        part = entries[k : k + 50]
        hi, lo = np.array([e[0] for e in part], np.uint64), np.array([e[1] for e in part], np.uint64)
        table.insert(hi, lo, np.array([e[2] for e in part], np.int64))
        for a, b, v in part:
            model[a, b] = min(v, model.get((a, b), v))
    hi, lo, value = table.items()
    assert {(int(a), int(b)): int(v) for a, b, v in zip(hi, lo, value, strict=True)} == model
    assert table.count == len(model)


def test_permutation_is_one_to_one():
    hi, lo = np.meshgrid(np.arange(64, dtype=np.uint64), np.arange(64, dtype=np.uint64))
    a, b = permute(hi.ravel(), lo.ravel())
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == 4096


def brute(rows):
    parent = {s: s for s, _, _ in rows if s is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    seen = {}
    for s, p, m in rows:
        if s is None:
            continue
        keys = [("p", p)] if (p or "").strip() else []
        clean = re.sub(r"[\s<>]+", "", m or "").lower()
        keys += [("m", clean)] if "@" in clean else []
        for k in keys:
            a, b = find(seen.setdefault(k, s)), find(s)
            parent[max(a, b)] = min(a, b)
    return sorted(s for s in parent if find(s) != s)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "seq bigint, eml_path string, message_id string, src string, low int")
    return sorted(r.seq for r in redelivery.repeated_rows(df).collect())


keys = st.sampled_from([None, "", "  ", "a@x", " <A@X>\r", "b@x", "c@x", "noat", "d@x"])


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from([None, "", " ", "p1", "p2", "p3", "p4"]), keys), max_size=25))
def test_against_union_find(spark, pairs):
    rows = [(k, p, m) for k, (p, m) in enumerate(pairs)]
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_long_chain_and_hot_keys(spark):
    n = 40
    chain = [(n - k, f"p{k // 2}", f"m{(k + 1) // 2}@x") for k in range(n)]
    hot = [(1000 + k, "hot", None) for k in range(600)] + [(5000 + k, f"q{k}", "<HOT@x>") for k in range(600)] + [(9000, "hot", "hot@X")]
    rows = chain + hot + [(None, "hot", "hot@x"), (7, "p0", None)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None), (2, "", "noat"), (3, None, "noat")]) == []
    assert run(spark, [(4, "same", None), (4, "same", None), (5, "same", None)]) == [5]
    long = "z" * 100_000
    assert run(spark, [(1, long, None), (2, long, None), (3, long + "y", None)]) == [2]
    df = spark.createDataFrame([(1, "p", "m@x"), (2, "p", None)], "seq bigint, eml_path string, message_id string")
    assert [r.seq for r in redelivery.kept_rows(df).collect()] == [1]
