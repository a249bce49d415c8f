import hashlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loanweave.llm import token_alignment as ta
from loanweave.llm.tokens import vocabulary_path
from tests.llm import cases

TOOLS = ta.Sides(vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "a", "the ", "word, ", "é", "日本", "😀", "<|endoftext|>", "</s>", "<0x41>", "▁", "\x00", "ﬁ"]


def tokens(text):
    """Brute force: (id, start, end) of both sides by the libraries, or none."""
    if not text:
        return [], []
    a = TOOLS.a.library.encode(" " + text, add_special_tokens=False).ids
    b = TOOLS.b.encode(text)
    out = []
    for ids, names in ((a, TOOLS.a_bytes), (b, TOOLS.b_bytes)):
        if b"".join(names[i] for i in ids) != (" " + text).encode():
            return [], []
        side, at = [], 0
        for i in ids:
            side.append((i, at, at + len(names[i])))
            at += len(names[i])
        out.append(side)
    return tuple(out)


def groups(a, b):
    if not a:
        return ""
    ends = sorted({e for *_, e in a} & {e for *_, e in b})
    out, low = [], 0
    for end in ends:
        out.append("|".join(",".join(str(i) for i, s, e in side if low < e <= end) for side in (a, b)))
        low = end
    return hashlib.sha256(";".join(out).encode()).hexdigest()


def expected(texts):
    sides = [tokens(t) for t in texts]
    links = [[(i, j) for i, _, e in a for j, _, f in b if e == f] for a, b in sides]
    count = Counter(pair for found in links for pair in found)
    top = {}
    for (_, j), n in count.items():
        top[j] = max(top.get(j, 0), n)
    return [
        (len(a), len(b), len({e for *_, e in a} & {e for *_, e in b}), len(found),
         sum(count[p] == top[p[1]] for p in found), sum(count[p] for p in found), groups(a, b))
        for (a, b), found in zip(sides, links)
    ]


def result(frame):
    return sorted((tuple(r) for r in ta.alignment(frame).collect()), key=str)


def want(rows):
    return sorted(((i, *found) for (i, *_), found in zip(rows, expected([r[1] for r in rows]))), key=str)


SHORT = [r for r in cases.ROWS if len(r[1] or "") < 6000]
MORE = [(20, "<|endoftext|> x </s>", "", "", None), (21, " lead", "", "", None), (22, "a▁b", "", "", None),
        (23, "日本語 😀\x00", "", "", None), (24, "\n", "", "", None), (25, " ", "", "", None)]


def test_equals_brute_force(spark):
    rows = SHORT + MORE + [(100 + i, cases.prose(i), "en", "a", None) for i in range(30)]
    assert result(cases.with_clashes(cases.documents(spark, rows))) == want(rows)


def test_small_dictionaries_slices_and_pieces_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ta, "CHUNK", 64)
    monkeypatch.setattr(ta, "SLICE", 50)
    monkeypatch.setattr(ta, "BATCH_CHARS", 700)
    monkeypatch.setattr(ta, "PIECE", 120)
    rows = SHORT + MORE + [(100 + i, cases.prose(i % 7, 200), "en", "a", None) for i in range(20)]
    frame = cases.documents(spark, rows).coalesce(2)
    assert result(frame) == want(rows)
    # Batches and pieces in this process, as their sizes do not reach the workers.
    batch = frame.select("doc_id", "text").toPandas()
    found = list(ta._documents(TOOLS, list(zip(batch["doc_id"], batch["text"]))))
    brute = expected([r[1] for r in rows])
    assert [(d.n_a, d.n_b, d.digest.hexdigest()) if d else (0, 0, "") for _, d in found] == [
        (f[0], f[1], f[6]) for f in brute
    ]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=8).map("".join))
def test_any_text_groups_and_overlaps(text):
    [(_, found)] = list(ta._documents(TOOLS, [(1, text)]))
    a, b = tokens(text)
    assert (found.digest.hexdigest() if found else "") == groups(a, b)
    if found:
        *_, pairs = ta.overlaps(TOOLS, [TOOLS.encode([text])[0]])
        brute = {(i, j) for i, (_, s, e) in enumerate(a) for j, (_, t, f) in enumerate(b) if s < f and t < e}
        assert set(map(tuple, pairs.to_numpy().tolist())) == brute and len(pairs) == len(brute)


def test_overlap_rows(spark):
    rows = ta.overlap_rows(cases.documents(spark, SHORT[:4] + MORE)).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in SHORT[:4] + MORE if tokens(r[1])[0]}
    assert all(r.shared_bytes > 0 for r in rows)


def test_empty_table(spark):
    assert result(cases.empty(spark)) == []
    assert result(cases.documents(spark, [(1, None, None, None, None)])) == [(1, 0, 0, 0, 0, 0, 0, "")]
