import math
import random
import re

import numpy as np

from loanweave.llm import near_dedup as nd
from tests.llm import cases

RANDOM = random.Random(5)


def shingles(text):
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", text.lower())
    if not words:
        return {}
    sets = {}
    for i in range(max(1, len(words) - 4)):
        key = tuple(words[i : i + 5])
        sets[key] = sets.get(key, 0) + 1
    return sets


def brute_classes(rows, least=nd.SIMILARITY):
    """Classes by comparing all texts, with exact document frequencies."""
    sets = [shingles(r[1] or "") for r in rows]
    n = sum(bool(s) for s in sets)
    df = {}
    for s in sets:
        for k in s:
            df[k] = df.get(k, 0) + 1
    idf = {k: 1 + nd.SPAN * math.log((1 + n) / (1 + v)) / math.log(1 + n) for k, v in df.items()}
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if not same and a and b:
                common = sum(min(a[k], b[k]) * idf[k] for k in a.keys() & b.keys())
                total = sum(v * idf[k] for k, v in a.items()) + sum(v * idf[k] for k, v in b.items()) - common
                same = common / total >= least
            if same:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(rows))]


def edited(text, changes):
    words = text.split()
    for _ in range(changes):
        words[RANDOM.randrange(len(words))] = f"new{RANDOM.randrange(10**6)}"
    return " ".join(words)


def grouped(ids):
    groups = {}
    for doc, label in ids:
        groups.setdefault(label, set()).add(doc)
    return sorted(map(sorted, groups.values()))


def test_equals_brute_force_on_groups_chains_and_strangers(spark):
    rows, number = [], 0
    for base in range(12):
        text = cases.prose(base, 200)
        for copy in range(RANDOM.randint(1, 9)):
            rows.append((number, edited(text, copy % 4), "en", "a", None))
            number += 1
    chain = cases.prose(99, 300)
    for _ in range(8):  # neighbours alike, ends not
        rows.append((number, chain, "en", "b", None))
        chain, number = edited(chain, 4), number + 1
    found = nd.near_duplicates(cases.documents(spark, rows)).collect()
    truth = brute_classes(rows)
    assert grouped((r.doc_id, r.class_id) for r in found) == grouped((r[0], t) for r, t in zip(rows, truth))
    assert sorted(r.doc_id for r in found if r.keep) == sorted({r.class_id for r in found})


def test_large_bucket_is_settled_in_blocks(spark, monkeypatch):
    """Blocks of few members give the classes of brute force, and rows stay few."""
    monkeypatch.setattr(nd, "MEMBERS", 7)
    base = cases.prose(3, 250)
    rows = [(i, edited(base, RANDOM.randint(0, 14)), "en", "a", None) for i in range(70)]
    found = nd.near_duplicates(cases.documents(spark, rows)).collect()
    truth = brute_classes(rows)
    got = grouped((r.doc_id, r.class_id) for r in found)
    assert got == grouped((r[0], t) for r, t in zip(rows, truth))
    assert max(map(len, got)) > 20 and sum(r.keep for r in found) == len(got)


def test_links_join_components_and_no_more(spark):
    base = cases.prose(3, 250)
    texts = [edited(base, 1) for _ in range(30)] + [cases.prose(50, 80)]
    weights = nd.Weights(np.ones((2, nd.WIDTH)), 100)
    assert len(nd.linked(weights, texts, list(range(31)), 0.8)) == 29
    assert nd.linked(weights, texts, [0] * 31, 0.8) == []


def test_samples_agree_as_often_as_weighted_sets_are_alike():
    draw = np.random.default_rng(1)
    hashes = np.sort(draw.integers(1, 2**63, 400, dtype=np.uint64))
    weights = draw.uniform(0.5, 4.0, 400)
    for shift in (0.1, 0.5):
        other = np.where(draw.random(400) < shift, weights * draw.uniform(0.2, 3.0, 400), weights)
        truth = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
        a, b = (nd.sample(hashes, w, 2000) for w in (weights, other))
        assert abs((a == b).mean() - truth) < 0.04


def test_frequencies_are_counted_over_all_texts(spark):
    rows = [(i, cases.prose(i, 30) + " one two three four five", "en", "a", None) for i in range(200)]
    weights = nd.document_frequencies(cases.documents(spark, rows))
    common = nd.shingles_of(["one two three four five"])[0]
    rare = nd.shingles_of([cases.prose(7, 30)])[0]
    assert abs(weights.of(common, np.array([1]))[0] - 1.0) < 0.02
    expected = 1 + nd.SPAN * math.log(201 / 2) / math.log(201)
    assert np.median(np.abs(weights.of(rare, np.ones(len(rare))) - expected)) < 0.02


def test_odd_rows(spark):
    frame = cases.with_clashes(cases.documents(spark))
    found = nd.near_duplicates(frame).collect()
    assert len(found) == len(cases.ROWS)
    classes = {}
    for r in found:
        classes.setdefault(r.doc_id, set()).add(r.class_id)
    assert classes[1] == classes[5] == {1} and classes[2] == {2} and classes[3] == {3} and classes[None] == {None}
    kept = nd.deduplicated(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 6, 7, 8, 9, 10]
    nothing = cases.empty(spark)
    assert nd.near_duplicates(nothing).collect() == [] and nd.deduplicated(nothing).collect() == []


def test_repeated_rows_of_a_kept_text_leave_one(spark):
    rows = [(4, "same text here", "en", "a", None)] * 3 + [(9, "same text here", "en", "a", None)]
    kept = nd.deduplicated(cases.documents(spark, rows)).collect()
    assert [r.doc_id for r in kept] == [4]


def test_idf_lies_between_one_and_two():
    """Of 9,999,999 texts: 1 + ln(1e7 / 1e4) / ln(1e7) in 9,999 of them, 2 - ln(2) / ln(1e7) in one."""
    counts = np.zeros((2, nd.WIDTH))
    counts[:, 5] = 9999
    idf = nd.Weights(counts, 9_999_999).idf
    assert np.allclose(idf[:, 5], 1.428571, atol=1e-5) and np.allclose(idf[:, 6], 1.956995, atol=1e-5)


def test_a_frequent_passage_makes_no_classes_and_a_large_group_of_copies_one(spark):
    """100 clean documents share 230 words and have 20 of their own. Of 460 texts a passage in 100
    weighs 1.248, an own shingle 1.887: similarity 226 * 1.248 / (226 * 1.248 + 48 * 1.887) = 0.757
    (plain 0.825). The 60 copies differ in one word each: above 0.92."""
    passage, base = cases.prose(1000, 230), cases.prose(2000, 250)
    rows = [(i, passage + " " + " ".join(f"own{i}x{j}" for j in range(20)), "en", "a", None) for i in range(100)]
    for i in range(60):
        words = base.split()
        words[20 + 3 * i] = f"changed{i}"
        rows.append((100 + i, " ".join(words), "en", "a", None))
    rows += [(160 + i, " ".join(f"far{i}x{j}" for j in range(30)), "en", "b", None) for i in range(300)]
    found = {r.doc_id: r.class_id for r in nd.near_duplicates(cases.documents(spark, rows)).collect()}
    assert all(found[i] == i for i in [*range(100), *range(160, 460)])
    assert {found[i] for i in range(100, 160)} == {100}
