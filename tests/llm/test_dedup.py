"""Joins and removals of repeated text against brute force."""

import collections
import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from calorix.llm import jaccard_join, phrase_dedup, substring_dedup
from calorix.llm.base import table
from calorix.llm.jaccard_join import JoinRules, components, signatures, similar_documents
from calorix.llm.phrase_dedup import PhraseRules, remove_phrases
from calorix.llm.substring_dedup import StringRules, recurring_columns, remove_strings
from tests.llm.data import PASSAGE, documents, empty, texts, words

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def covered(items, size):
    """Mask of each sequence's places that lie in a window found elsewhere."""
    seen = collections.Counter(
        tuple(x[k : k + size]) for x in items for k in range(len(x) - size + 1)
    )
    out = []
    for x in items:
        mask = np.zeros(len(x), bool)
        for k in range(len(x) - size + 1):
            if seen[tuple(x[k : k + size])] > 1:
                mask[k : k + size] = True
        out.append(mask)
    return out


def brute_phrases(rows, size):
    split = [(t or "").encode().split() for _, t in rows]
    out = []
    for (i, _), w, m in zip(rows, split, covered(split, size), strict=True):
        kept = b" ".join(x for x, gone in zip(w, m, strict=True) if not gone)
        out.append((i, len(w), int(m.sum()), kept.decode()))
    return out


def brute_strings(rows, size):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(
        hash(x[k : k + size]) for x in raw for k in range(len(x) - size + 1)
    )
    out = []
    for (i, _), x in zip(rows, raw, strict=True):
        mask = np.zeros(len(x) + 1, bool)
        for k in range(len(x) - size + 1):
            if seen[hash(x[k : k + size])] > 1:
                mask[k : k + size] = True
        mask[-1] = False
        spans = int(np.count_nonzero(mask[:-1] & ~np.concatenate([[False], mask[:-2]]))) if x else 0
        kept = bytes(b for b, gone in zip(x, mask, strict=False) if not gone)
        out.append((i, len(x), int(mask.sum()), spans, kept))
    return out


def shingles(text, size=5):
    w = (text or "").translate(FOLD).encode().split()
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if not sets[a] or not 3 * len(sets[b]) <= 4 * len(sets[a]) <= 16 / 3 * len(sets[b]):
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if sets[k] and ids else i))
    return out


def same(found, expected):
    key = lambda r: tuple((x is None, x) for x in r)
    found = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found]
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_similar_documents(spark):
    found = similar_documents(documents(spark))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    same(found.collect(), brute_components(texts()))
    assert similar_documents(empty(spark)).count() == 0


def test_similar_documents_on_the_table(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    same(jaccard_join.op3_jaccard_join(spark, folder).collect(), brute_components(rows))


def test_links_that_no_pivot_sees(spark):
    """A chain of texts, each similar to the next only, and texts that share half of their words."""
    base = words("chain", 400, 10**6)
    rows = []
    for k in range(30):
        # each text has the last 360 words of the one before it
        rows.append((k, " ".join((base + words(f"n{k}", 0))[0:0] + base)))
        base = base[40:] + words(f"more{k}", 40, 10**6)
    half = words("half", 200, 10**6)
    rows += [(100 + k, " ".join(half + words(f"own{k}", 150, 10**6))) for k in range(40)]
    same(similar_documents(documents(spark, rows)).collect(), brute_components(rows))


def test_tiny_sets_are_compared_with_no_other(spark):
    """Sets of one or two elements are similar to their equals only; larger ones still meet."""
    sets = []
    for size in (1, 2, 3):
        for k in range(300):
            elements = np.arange(size, dtype=np.uint64) + np.uint64(1000 * size + 3 * k)
            sets.append((len(sets) + 1, size, bytearray(elements.tobytes())))
    held = np.arange(4, dtype=np.uint64) + np.uint64(3000)  # holds the first set of three
    sets.append((len(sets) + 1, 4, bytearray(held.tobytes())))
    df = spark.createDataFrame(sets, "sid long, n int, elements binary")
    tied = jaccard_join.tied_sets(df, JoinRules()).collect()
    assert all(r["pivot"] > 600 and r["sid"] > 600 for r in tied)
    assert (601, 901) in {(r["pivot"], r["sid"]) for r in tied}


def test_similar_texts_of_few_shingles(spark):
    """All texts of five to nine words over three words, so that small sets meet in every way."""
    draw = np.random.default_rng(5)
    rows = [(i, " ".join(draw.choice(["a", "b", "c"], draw.integers(1, 10)))) for i in range(400)]
    same(similar_documents(documents(spark, rows)).collect(), brute_components(rows))


def test_similar_sets_share_a_signature():
    rules = JoinRules()
    draw = np.random.default_rng(3)
    for size in (1, 2, 3, 4, 5, 8, 13, 20, 47, 100, 333, 1200):
        for _ in range(12):
            a = np.unique(draw.integers(0, 2**63, size).astype(np.uint64))
            n = len(a)
            # as different as the threshold allows: elements dropped, then others added
            gone = draw.integers(0, n // 4 + 1)
            added = max(0, int(4 * (n - gone) / 3) - n)
            added = draw.integers(0, added + 1) if added else 0
            b = np.unique(
                np.concatenate([a[draw.permutation(n)[gone:]], draw.integers(0, 2**63, added).astype(np.uint64)])
            )
            common = len(np.intersect1d(a, b))
            if common * 100 < 75 * (n + len(b) - common) or not common:
                continue
            counts = np.array([n, len(b)])
            sig, of = signatures(np.concatenate([a, b]), counts, counts, rules)
            assert set(sig[of == 0]) & set(sig[of == 1]), (n, len(b), common)


def test_components(spark):
    draw = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in draw.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 440)]
    root = {n: n for p in pairs for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    found = components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == {n: r for n, r in root.items() if n != r}


def test_remove_phrases(spark):
    found = remove_phrases(documents(spark))
    same(found.collect(), brute_phrases(texts(), 35))
    assert any(r.n_removed == 90 for r in found.collect())
    assert remove_phrases(empty(spark)).count() == 0


def test_phrases_on_the_table(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    expected = [
        (i, n, gone, hashlib.sha256(kept.encode()).hexdigest())
        for i, n, gone, kept in brute_phrases(rows, 35)
    ]
    same(phrase_dedup.op9_substring_dedup(spark, folder).collect(), expected)


def test_small_windows_and_shards(spark):
    """Windows across many shards and runs of texts."""
    rows = [(k, " ".join(words(k % 37, 40, 30))) for k in range(150)]
    rules = PhraseRules(size=6, phrase=3, shard_bytes=2_000)
    same(remove_phrases(documents(spark, rows), rules=rules).collect(), brute_phrases(rows, 6))
    strings = StringRules(size=30, gram=8, shard_bytes=2_000, batch=50)
    found = remove_strings(documents(spark, rows), rules=strings)
    same(found.collect(), brute_strings(rows, 30))


def test_remove_strings(spark):
    docs = documents(spark)
    found = remove_strings(docs, carry=["doc_id", "row", "uid"])
    assert found.select("row.uid").distinct().collect()[0][0] == "clash"
    same(found.drop("row").collect(), brute_strings(texts(), 400))
    assert remove_strings(empty(spark)).count() == 0


def test_a_cut_inside_a_character(spark):
    """The byte that é and è have in common is repeated with the passage before it."""
    rows = [(1, "x" + PASSAGE + "é one"), (2, "yy" + PASSAGE + "è two \ufffd"), (3, "z")]
    same(remove_strings(documents(spark, rows)).collect(), brute_strings(rows, 400))
    found = remove_strings(documents(spark, rows), as_text=True).collect()
    assert {r.doc_id: r.kept for r in found} == {1: "x one", 2: "yy two \ufffd", 3: "z"}


def test_strings_on_the_table(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    expected = [
        (*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute_strings(rows, 400)
    ]
    same(substring_dedup.op5_suffix_array_dedup(spark, folder).collect(), expected)


@pytest.mark.parametrize("seed", range(4))
def test_recurring_columns(seed):
    draw = np.random.default_rng(seed)
    n, width, size = 40, 24, 6
    symbols = draw.integers(0, 2, (n, width)).astype(np.int16)
    group = np.sort(draw.integers(0, 5, n))
    found = recurring_columns(symbols, group, size, width - size)
    for i in range(n):
        for c in range(width - size + 1):
            others = [
                j for j in range(n)
                if j != i and group[j] == group[i] and (symbols[i, c : c + size] == symbols[j, c : c + size]).all()
            ]
            assert found[i, c] == bool(others), (i, c)


def test_passage_has_no_repeats():
    assert len(set(PASSAGE.split())) > 80


def test_gathered_shingles_are_counted_without_copies_of_all():
    """What a task of the shingle join holds beside its entries: no sorted copies of all of them."""
    draw = np.random.default_rng(3)
    sizes = np.full(1_500, 400)
    elements = draw.integers(0, 1 << 63, 600_000, dtype=np.uint64) * np.uint64(2)
    # each set shares its last hundred with the next one
    grid = elements.reshape(1_500, 400)
    grid[1:, :100] = grid[:-1, 300:]
    grid.sort(axis=1)
    elements, sids = grid.ravel(), np.arange(1, 1_501, dtype=np.uint64)

    def halves(buckets):
        return [
            jaccard_join._blocks(sids[i::2], sizes[i::2], grid[i::2].ravel(), buckets) for i in (0, 1)
        ]

    def peak(work):
        tracemalloc.start()
        out = work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most / len(elements)

    one, held = peak(lambda: jaccard_join._blocks(sids, sizes, elements, 7))
    assert held < 60  # bytes an entry; 65 with sorted copies
    found = pa.Table.from_batches(halves(1))
    (known, n, owner, e), held = peak(lambda: jaccard_join._shared_entries(found))
    assert held < 45  # 66 with sorted copies
    kept = {(int(known[o]), int(x)) for o, x in zip(owner, e, strict=True)}
    wide = grid & ~np.uint64(0xFFFF)
    value, times = np.unique(wide, return_counts=True)
    several = set(value[times > 1].tolist())
    assert kept == {(s, x) for s, row in zip(sids.tolist(), wide.tolist(), strict=True) for x in row if x in several}
    assert set(n.tolist()) == {400} and one.num_rows > 7


def crowded(n=60):
    """A passage in many different texts, a line repeated in many, and copies."""
    passage, line = " ".join(words("crowd", 30)), "Is onhe. " * 12
    rows = []
    for k in range(n):
        own = [" ".join(words(f"{side}{k}", 8)) for side in ("left", "right")]
        rows += [(k, f"{own[0]} {passage} {own[1]}"), (100 + k, f"{own[1]}! {line}{own[0]}.")]
        rows.append((200 + k, passage[: 40 + 2 * k] if k % 2 else "copied " * 9))
    return rows


@pytest.mark.parametrize("widths", [(6, 1), (5, 2, 1), (1,), ()])
def test_large_groups_of_fragments_are_split(spark, widths):
    rows = crowded() + texts()[2:8] + [(300 + k, t) for k, t in enumerate(["b" * 90, "ab" * 50, "", None])]
    rules = StringRules(size=30, gram=8, shard_bytes=3_000, batch=50, many=5, widths=widths)
    same(remove_strings(documents(spark, rows), rules=rules).collect(), brute_strings(rows, 30))


def test_no_task_gets_a_large_group_of_fragments(spark):
    """What is left under a key is few fragments, or one window for each shard."""
    rules = StringRules(size=30, gram=8, many=8, widths=(6, 1))
    shards = 3
    dealt = substring_dedup.sharded(documents(spark, crowded()), "doc_id", "text", shards)
    keys = substring_dedup.recurring_keys(dealt, rules, rules.many).collect()
    assert {r["level"] for r in keys if r["split"]} == {0, 1} and any(r["level"] == 2 for r in keys)
    known = substring_dedup.levels(pa.Table.from_pylist([r.asDict() for r in keys if r["shard"] == 0]), 3)
    raw = [(t or "").encode() for _, t in crowded()]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    kept, rest = substring_dedup.located(data, offsets, known, rules)
    for level, runs in enumerate(kept):
        found = collections.Counter()
        for key, _, _ in {(k, p - a, data[a : b + 30].tobytes()) for p, k, a, b in zip(*runs, strict=True)}:
            found[key] += 1
        assert max(found.values()) <= (rules.many if level < 2 else 1)


def test_fragments_are_lined_up_in_little_memory():
    """3,000 fragments of one anchor: numbers of all their places would take 18 MB three times."""
    rng, rules, n = np.random.default_rng(5), StringRules(), 3_000
    size = rules.reach + rules.size
    table = pa.table(
        {
            "key": pa.array([7] * n, pa.int64()),
            "shard": pa.array([0] * n, pa.int32()),
            "left": pa.array([rules.reach] * n, pa.int32()),
            "bytes": pa.array([rng.bytes(size) for _ in range(n)], pa.binary()),
            "uids": pa.array([[k] for k in range(n)], pa.list_(pa.int64())),
            "starts": pa.array([[0]] * n, pa.list_(pa.int64())),
        }
    )
    tracemalloc.start()
    try:
        assert substring_dedup._spans(table, rules).num_rows == 0
        assert tracemalloc.get_traced_memory()[1] < 11 * n * size
    finally:
        tracemalloc.stop()
