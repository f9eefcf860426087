"""Near duplicates by MinHash against all pairs; star steps against a union of sets."""

import random

import numpy as np
import pytest

from calorix.llm.minhash_dedup import (
    MinHashRules,
    coefficients,
    minima,
    near_duplicates,
    similar_tree,
    star_components,
)
from tests.llm.data import documents, edited, empty, texts, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=4):
    w = (text or "").translate(FOLD).encode().split()
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [j for g, (j, _) in zip(group, rows, strict=True) if g == group[k] and j is not None]
        least = min(ids) if ids else None
        out.append((i, len(sets[k]), least, i == least))
    return sorted(out, key=repr)


def found(df, **more):
    return sorted((tuple(r) for r in near_duplicates(df, **more).collect()), key=repr)


def test_edge_texts(spark):
    assert found(documents(spark)) == brute(texts())


def test_large_pivots_in_small_parts(spark):
    base = words(7, 60)
    rows = [(k, edited(" ".join(base), 40, k)) for k in range(40)]
    rows += [(100 + k, " ".join([*words("common", 50), *words(k, 12)])) for k in range(40)]
    rows += [(200 + k, " ".join(words("copy", 30))) for k in range(60)]
    draw = random.Random(5)
    chain = words("chain", 80)
    for k in range(40):  # each is close to the one before, the ends are far apart
        chain[draw.randrange(80)] = f"c{k}"
        rows.append((300 + k, " ".join(chain)))
    assert found(documents(spark, rows), rules=MinHashRules(block=4)) == brute(rows)
    assert found(documents(spark, rows)) == brute(rows)


def test_no_documents(spark):
    assert near_duplicates(empty(spark)).count() == 0
    assert found(documents(spark, [(5, "only one")])) == [(5, 1, 5, True)]


def test_text_ids_keep_their_type(spark):
    rows = [("b", "one two three four five"), ("a", "ONE two three four five"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert found(df) == [("a", 2, "a", True), ("b", 2, "a", False), ("c", 0, "c", True)]


def test_minima_agree_as_often_as_sets_are_similar():
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 2**63, 1300).astype(np.uint64)
    both = np.concatenate([np.sort(pool[:1000]), np.sort(pool[200:1200])])  # 800 of 1200
    m = minima(both, np.array([1000, 1000, 0]), 2000)
    assert abs((m[0] == m[1]).mean() - 800 / 1200) < 0.05
    assert not m[2].any()
    assert (coefficients(50)[0] & np.uint64(1)).all()


def test_tree_joins_all_that_is_similar():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k * 4 : k * 4 + 200], base[:1]])) for k in range(50)]
    marks = minima(np.concatenate(sets), np.array([len(s) for s in sets]), 128)
    links = similar_tree(np.arange(50), np.arange(50), marks, sets, MinHashRules())
    assert len(links) == 49  # a chain of overlapping sets is one component
    label = np.repeat([0, 50], 25)  # only links between the two known halves are needed
    across = similar_tree(np.arange(50), label, marks, sets, MinHashRules())
    assert across and all((a < 25) != (b < 25) for a, b in across)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_star_steps_find_components(spark, shape):
    draw = random.Random(4)
    pairs = {
        "chain": [(k, k + 1) for k in range(60)],
        "star": [(500, k) for k in range(400)] + [(7, 600), (601, 602)],
        "random": [(draw.randrange(300), draw.randrange(300)) for _ in range(200)],
        "none": [],
    }[shape]
    group = {x: x for p in pairs for x in p}
    for a, b in pairs * 70 if shape == "chain" else pairs * 12:
        group[a] = group[b] = min(group[a], group[b])
    for _ in range(400):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    roots = star_components(spark.createDataFrame(pairs, "a long, b long"))
    expected = {x: g for x, g in group.items() if x != g}
    assert {r["node"]: r["root"] for r in roots.collect()} == expected
