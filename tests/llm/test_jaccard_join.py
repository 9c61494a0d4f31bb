import itertools
import random
import re

import numpy as np
import pytest

from tallymill.llm import jaccard_join
from tallymill.llm.graph import components
from tests.llm.conftest import SCHEMA, odd_rows, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Per row: least key of its group, linked texts, linked documents."""
    sets = [shingles(text) for _, text in rows]
    near = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            near[i].add(j)
            near[j].add(i)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        texts = {frozenset(sets[j]) for j in near[i]} - {frozenset(sets[i])}
        keys = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((key, min(keys, default=None), len(texts), len(near[i])))
    return out


def varied(seed, words, changes):
    chance = random.Random(seed)
    words = words.split()
    for _ in range(changes):
        words[chance.randrange(len(words))] = f"new{chance.randrange(1000)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    out, key = [], 0
    for group in range(12):
        base = prose(group, 60 + 25 * group)
        for copy in range(1 + group % 5 * 3):
            out.append((key := key + 3, varied(copy, base, copy % 6)))
        out.append((key := key + 3, base))
        out.append((key := key + 3, base))
    return out + [(key + i, prose(100 + i, 80)) for i in range(1, 30)] + [(1, "a b"), (2, "a b"), (4, " ")]


def found_in(spark, rows):
    docs = spark.createDataFrame([(key, text, "en", "s", 1) for key, text in rows], SCHEMA)
    found = jaccard_join.near_duplicates(docs).collect()
    return sorted((r.key, r.class_id, r.n_texts, r.n_links) for r in found)


def test_links_equal_brute_force(spark, rows):
    want = sorted(brute(rows))
    assert sum(n for *_, n in want) > 200
    assert found_in(spark, rows) == want


def test_small_blocks_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    assert found_in(spark, rows) == sorted(brute(rows))


def test_one_document_of_each_group_stays(spark, rows):
    docs = spark.createDataFrame([(key, text, "en", "s", 1) for key, text in rows], SCHEMA)
    left = jaccard_join.one_of_each(docs.unionByName(docs))
    assert left.columns == docs.columns
    want = {least for _, least, _, _ in brute(rows)}
    found = sorted(row.doc_id for row in left.collect())
    # The blank document has no group: both of its rows stay.
    assert found == sorted([*want, 4])


def test_intersections_are_exact(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    chance = np.random.default_rng(3)
    sets = [np.unique(chance.integers(0, 60, n)).astype(np.uint64) for n in (5, 30, 40, 1, 55)]
    found = jaccard_join.overlaps(sets[:2], sets[2:])
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]
    assert found.tolist() == want


def test_pruning_keeps_what_may_reach_the_threshold():
    needed = jaccard_join.least_matches()
    assert list(needed) == list(jaccard_join.CHECKS)
    chance = np.random.default_rng(4)
    left = chance.integers(0, 256, (20_000, jaccard_join.HASHES)).astype(np.uint8)

    def kept(similarity):
        other = chance.integers(0, 256, left.shape).astype(np.uint8)
        same = chance.random(left.shape) < similarity
        return len(jaccard_join.survivors(left, np.where(same, left, other), needed))

    assert kept(0.8) >= 19_995
    assert kept(0.3) <= 5


def test_minhash_estimates_the_similarity():
    words = prose(1, 400, 10**6).split()
    hashes = jaccard_join.WordHashes()
    a = jaccard_join.shingles(" ".join(words).encode(), hashes)
    b = jaccard_join.shingles(" ".join([*words[:360], *prose(2, 40, 10**6).split()]).encode(), hashes)
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    agree = (jaccard_join.minhashes(a) == jaccard_join.minhashes(b)).mean()
    assert agree == pytest.approx(exact, abs=0.12)


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_brute_force(spark, seed):
    chance = random.Random(seed)
    edges = [(chance.randrange(60), chance.randrange(60)) for _ in range(45)]
    edges += [(100 + i, 101 + i) for i in range(30)] + [(200, i) for i in range(201, 240)]
    least = {}
    for _ in range(80):
        for a, b in edges:
            least[a] = least[b] = min(least.get(a, a), least.get(b, b))
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    want = {node: root for node, root in least.items() if any(a != b and node in (a, b) for a, b in edges)}
    assert {row.node: row.component for row in found} == want
    assert len(found) == len(want)


def test_odd_documents(odd, nothing):
    found = jaccard_join.near_duplicates(odd).collect()
    got = sorted((str(r.key), str(r.class_id), r.n_texts, r.n_links) for r in found)
    want = brute([row[:2] for row in odd_rows()])
    # Without shingles a document is its own class.
    assert got == sorted((str(k), str(c), t, n) for k, c, t, n in want)
    assert jaccard_join.near_duplicates(nothing).count() == 0
    assert jaccard_join.one_of_each(odd).columns == odd.columns
    # Five groups with shingles, and the five rows without any.
    assert jaccard_join.one_of_each(odd).count() == 10
