"""Names with common parts: their distances are worked out together, and each pair is reported once."""

import itertools
import random

import numpy as np
import pytest

from entiform.functions import closeness
from entiform.operators import similarity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("size", [1, 2, 7, 63, 64])
def test_distances_of_many_names(monkeypatch, size):
    monkeypatch.setattr(closeness, "_AT_ONCE", 50)
    r = random.Random(size)
    a = sorted({"".join(r.choices("abcé😀", k=size)) for _ in range(30)})
    b = sorted({"".join(r.choices("abcdé", k=r.randint(1, size + 3))) for _ in range(40)})
    allowed = np.array([r.randint(0, 3) + size // 2 for _ in b])
    got = [(a[i], b[k], int(d)) for found in closeness.close_pairs(a, b, allowed) for i, k, d in zip(*found)]
    assert sorted(got) == sorted((x, y, distance(x, y)) for x in a for k, y in enumerate(b) if distance(x, y) <= allowed[k])


@pytest.mark.parametrize("seed, threshold, heavy", [(1, 0.82, 2), (2, 0.6, 2), (3, 0.75, 40), (4, 0.7, 10**9)])
def test_common_parts_equal_brute_force(spark, monkeypatch, seed, threshold, heavy):
    for name, value in (("HEAVY_PAIRS", heavy), ("ROWS_HELD", 7), ("_ROWS_ASKED", 5), ("ROWS_PER_SALT", 3)):
        monkeypatch.setattr(similarity, name, value)
    r = random.Random(seed)
    bases = ["falaisebonapriso", "falaiseakwa", "aaaaaaaa", "lafalaisemontfebe", "ab", "falaisebonaprisodoualacentre"]
    names = [r.choice(bases) + str(r.randint(0, 300)) * r.randint(0, 2) for _ in range(220)] + ["", None]
    df = spark.createDataFrame([(k, n, r.choice(["Douala", "Yaoundé", None])) for k, n in enumerate(names)], "task_ord bigint, input_name string, city string")
    out = similarity.fuzzy_name_pairs(df, threshold)
    assert ("MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()) == (heavy < 10**9)
    got = [((x.city_key, *sorted([x.form_a, x.form_b])), round(x.similarity, 9)) for x in out.collect() if x.form_a != x.form_b]
    want = {}
    for city in ("Douala", "Yaoundé"):
        forms = {x.input_name for x in df.collect() if x.city == city and x.input_name}
        for a, b in itertools.combinations(sorted(forms), 2):
            s = 1.0 if a in b or b in a else 1 - distance(a, b) / max(len(a), len(b))
            if s >= threshold - 1e-9:
                want[(city.lower().replace("é", "e"), a, b)] = round(s, 9)
    assert len(got) == len(dict(got)) and dict(got) == want
