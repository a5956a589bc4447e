import hashlib
import random

from docfields.llm import suffix_dedup as op


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, t in enumerate(raw):
        for a in range(len(t) - op.LENGTH + 1):
            seen.setdefault(t[a : a + op.LENGTH], []).append((i, a))
    hit = [bytearray(len(t)) for t in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, a in places:
                hit[i][a : a + op.LENGTH] = b"\1" * op.LENGTH
    out = []
    for t, h in zip(raw, hit, strict=True):
        runs = sum(1 for i, x in enumerate(h) if x and (not i or not h[i - 1]))
        out.append((len(t), sum(h), runs, hashlib.sha256(bytes(c for c, x in zip(t, h, strict=True) if not x)).hexdigest()))
    return out


def check(documents, texts, ids=None):
    rows = list(zip(ids, texts, strict=True)) if ids else texts
    got = op.dedup(documents(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = [(i, *b) for i, b in zip(ids or range(len(texts)), brute(texts), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_against_brute_force(documents):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, exact, short = text(90), text(60), text(30)
    cut = shared.encode()[:200].decode("utf-8", "ignore")
    texts = [text(40) + shared + text(30), text(5) + shared, exact, exact, exact, short, short, "", None, None, "a" * 450, "b" * 199, "b" * 200, "ab" * 150 + text(20) + "ab" * 130]
    texts += [text(30) + cut + text(3), text(1) + cut, shared[10:] + text(4), text(20) + text(1) * 1, (short + "\n") * 9, text(300)]
    near = text(150)
    texts += [near[:k] + "#" + near[k:] for k in (0, 100, 300, 303, 700)]
    check(documents, texts)


def test_repeated_ids_and_empty_tables(documents, spark):
    long = "xyz " * 70
    check(documents, [long, long, "q" * 250 + long], [7, 7, None])
    assert op.dedup(documents([]) if False else documents(["a"]).where("false")).count() == 0
