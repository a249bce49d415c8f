import hashlib
import math
import zlib

from loanweave.llm import hash_tree
from tests.llm import cases


def brute(key, tree):
    """Descend by the definition."""
    def draw(label, weight):
        u = (int(hashlib.md5(f"{key}:{label}".encode()).hexdigest()[:13], 16) + 1) / 2.0**52
        return -math.log(u) / weight

    def pick(nodes):
        return min(nodes, key=lambda n: draw(*n)) if len(nodes) > 1 else nodes[0]

    weight = lambda leaves: sum(x.weight for x in leaves)
    regions = {}
    for leaf in tree:
        regions.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)
    region = int(pick([(f"g{r}", weight([x for rack in inside.values() for x in rack]))
                       for r, inside in sorted(regions.items())])[0][1:])
    rack = pick([(f"r{region}/{k}", weight(leaves)) for k, leaves in sorted(regions[region].items())])[0]
    leaves = regions[region][int(rack.split("/")[1])]
    return int(pick([(f"s{x.shard}", x.weight) for x in leaves])[0][1:])


def test_equals_brute_force_and_moves_only_into_the_new_shard(spark):
    rows = [(i, cases.prose(i, 3), "en", "a", None) for i in range(400)]
    tree = hash_tree.layout()
    found = hash_tree.assign(cases.documents(spark, rows)).collect()
    assert len(found) == 400
    for r in found:
        text = rows[r.doc_id][1].encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 1, zlib.crc32(text), "key")
        assert r.shard == brute(r.doc_id, tree) and r.grown_shard == brute(r.doc_id, hash_tree.grown(tree))
        assert r.grown_shard in (r.shard, 16)
    for shard in range(16):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_weights_shape_the_shards_and_zero_takes_nothing(spark):
    tree = [hash_tree.Leaf(0, 0, 0, 3.0), hash_tree.Leaf(0, 1, 1, 1.0), hash_tree.Leaf(1, 0, 2, 4.0),
            hash_tree.Leaf(1, 1, 3, 0.0)]
    rows = [(i, "x", "en", "a", None) for i in range(2000)]
    found = hash_tree.assign(cases.documents(spark, rows), tree).collect()
    share = [sum(r.shard == s for r in found) / 2000 for s in range(4)]
    assert abs(share[0] - 0.375) < 0.05 and abs(share[2] - 0.5) < 0.05 and share[3] == 0


def test_weight_change_stays_in_its_subtree(spark):
    before = [hash_tree.Leaf(0, 0, 0, 1.0), hash_tree.Leaf(0, 0, 1, 1.0), hash_tree.Leaf(1, 0, 2, 2.0)]
    after = [hash_tree.Leaf(0, 0, 0, 1.5), hash_tree.Leaf(0, 0, 1, 0.5), hash_tree.Leaf(1, 0, 2, 2.0)]
    for key in range(300):
        a, b = brute(key, before), brute(key, after)
        assert (a == 2) == (b == 2)


def test_odd_rows(spark):
    found = hash_tree.assign(cases.with_clashes(cases.documents(spark))).collect()
    assert len(found) == len(cases.ROWS)
    assert {(r.size, r.text_crc32) for r in found if r.doc_id in (2, 3)} == {(1, 0)}
    assert hash_tree.assign(cases.empty(spark)).collect() == []
