import random
import re

from docfields.llm import graph
from docfields.llm import jaccard as op


def brute(rows):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {c: min((r[0] for r, k in zip(rows, comp, strict=True) if k == c and r[0] is not None), default=None) for c in comp}
    return [(r[0], len(s), least[c] if s else r[0]) for r, s, c in zip(rows, sets, comp, strict=True)]


def corpus():
    rng = random.Random(2)
    text = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(n)]
    out = []
    for n in (12, 40, 90, 300):
        base = text(n)
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                w[rng.randrange(len(w))] = "zz" + str(rng.randint(0, 9))
            out.append(" ".join(w[: rng.randint(int(n * 0.8), n)]))
    common = " ".join(text(60))
    out += [common + " " + " ".join(text(k)) for k in (3, 5, 8, 12, 16, 18, 25, 200)]
    out += [out[0], out[0].upper(), "one two", "One  TWO", "one", "", " \n", "a b c d e", "a b c d e f", " ".join(["x"] * 50), " ".join(["x"] * 70)]
    return out


def test_against_brute_force(documents):
    rows = list(enumerate(corpus())) + [(900, None), (5, "same id"), (5, "same id"), (None, "one two"), (None, "alone without an id here")]
    got = [tuple(r) for r in op.join(documents(rows)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_many_ranges(documents, monkeypatch):
    """More ranges of tokens than shuffle partitions, several of them in one task, give the same components."""
    asked, matrix = [], op._matrix
    monkeypatch.setattr(op, "_matrix", lambda sets, order, ranges: asked.append(ranges) or matrix(sets, order, ranges))
    monkeypatch.setattr(op, "RANGE", 40)
    rows = list(enumerate(corpus()))
    assert sorted(tuple(r) for r in op.join(documents(rows)).collect()) == sorted(brute(rows))
    assert asked[0] > 16


def test_one_each(documents):
    rows = list(enumerate(corpus())) + [(900, None), (5, "same id"), (5, "same id")]
    want = brute(rows)
    kept = op.one_each(documents(rows))
    got = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    expected, done = [], set()
    for row, (doc, n, comp) in zip(rows, want, strict=True):
        if not n or doc == comp and comp not in done:
            expected.append(row)
            if n:
                done.add(comp)
    assert len(got) == len(expected) and {g[0] for g in got} == {e[0] for e in expected}
    assert kept.columns == documents(["a"]).columns
    assert op.one_each(documents(["a"]).where("false")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    comp = {}
    for a, b in links:
        x, y = comp.get(a, {a}), comp.get(b, {b})
        for v in x | y:
            comp[v] = x | y
    want = {v: min(c) for v, c in comp.items() if len(c) > 1}
    got = graph.components(spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long"))
    assert {r["node"]: r["comp"] for r in got.collect()} == want and got.count() == len(want)


def test_hot_groups_are_opened_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 4)
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(40)]
    rows = []
    for i in range(60):  # a chain whose neighbours are near and whose ends are not
        base[rng.randrange(40)] = f"n{i}"
        rows.append((i, " ".join(base)))
    assert sorted(map(tuple, op.join(documents(rows)).collect())) == sorted(brute(rows))
