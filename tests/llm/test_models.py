import itertools
import random
import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from docfields.llm import ann, base, entry, fingerprints, mixing, quality, unigram

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load("piece_bpe_32k.model")


def test_viterbi_against_all_segmentations():
    pieces = ["<unk>", "<s>", "▁", "a", "b", "ab", "▁a", "aba", "ba", "▁ab", "é", *[f"<0x{i:02X}>" for i in range(256)]]
    kinds = ["unknown", "control", *["normal"] * 9, *["byte"] * 256]
    scores = [0, 0, -3.0, -2.0, -2.5, -3.2, -4.0, -4.1, -3.9, -5.5, -6.0, *[0.0] * 256]
    v = unigram.Vocabulary(pieces, scores, kinds)
    known = {p: s for p, s, k in zip(pieces, scores, kinds, strict=True) if k == "normal"}
    for n in range(1, 6):
        for text in map("".join, itertools.product("abé x", repeat=n)):
            marked = "▁" + text.replace(" ", "▁")
            best = [0.0] + [-1e9] * len(marked)
            for j in range(1, len(marked) + 1):
                for i in range(max(0, j - 3), j):
                    s = known.get(marked[i:j], -16.0 if j - i == 1 else -1e9)
                    best[j] = max(best[j], best[i] + s)
            ids = v.encode(text)
            runs = len(text.encode().replace(b"x", b"")), text.count("x")
            total = sum(v.scores[i] for i in ids if v.kinds[i] == "normal") - 16.0 * runs[1]
            assert abs(total - best[-1]) < 1e-6, (text, ids)
            assert v.decode(ids) == text


def test_round_trips_and_bytes(vocabulary):
    for text in ("", " ", "a", "  two  blanks ", "línea\nnueva\t\r\n", "日本語 😀 \x00", "ünï" * 50, "x" * 3000, "|a|b|"):
        assert vocabulary.decode(vocabulary.encode(text)) == text
    assert vocabulary.encode("") == []
    broken = [vocabulary.byte_ids[b] for b in b"\xff\xe6\x97"]
    assert vocabulary.decode(broken) == "�" * 3


def test_cutting_changes_no_path(vocabulary):
    whole = unigram.load("piece_bpe_32k.model")
    whole.marks[:], whole.crosses = 0, True
    score = lambda v, ids: sum(v.cost[i] if v.kinds[i] == "normal" else 0 for i in ids)
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice("the and,. \n|éa1'ing ") for _ in range(60))
        assert score(vocabulary, vocabulary.encode(text)) == score(whole, whole.encode(text))


def test_against_the_library(vocabulary):
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(6)
    for _ in range(50):
        ids = [rng.randrange(3, len(vocabulary.pieces)) for _ in range(20)]
        assert vocabulary.decode(ids) == own.decode(ids)


def test_encoded_documents(documents):
    rows = {r["doc_id"]: r for r in unigram.encode(documents(["a b", "", None, "é" * 20000])).collect()}
    assert all(r["round_trip"] for r in rows.values()) and rows[1]["n_ids"] == rows[2]["n_ids"] == 0 and rows[2]["ids"] == []
    assert unigram.encode(documents(["a"]).where("false")).count() == 0


def test_scores_of_ranks_are_fitted(documents):
    """EM against sums over all segmentations; a model of merge ranks is never used as if its ranks were log scores."""
    ranked = unigram.load("piece_bpe_32k.model")
    assert not ranked.unigram
    texts = ["The government of the international community", "the government", "international  law\n", "", None, "é\x00日"] * 3
    fitted = unigram.fit(documents(texts), ranked)
    assert fitted.unigram and fitted.pieces == ranked.pieces and abs(sum(np.exp(s) for s, k in zip(fitted.scores, fitted.kinds, strict=True) if k == "normal") - 1) < 1e-6
    rows = {r["doc_id"]: r for r in unigram.encode(documents(texts)).collect()}
    assert [ranked.pieces[i] for i in rows[0]["ids"]] == ["▁The", "▁government", "▁of", "▁the", "▁international", "▁community"]
    assert all(rows[i]["ids"] == fitted.encode(t or "") and rows[i]["round_trip"] for i, t in enumerate(texts))


def test_expected_counts_against_all_segmentations():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "aba", "ba", "é"]
    v = unigram.Vocabulary(pieces, [0, -3.0, -2.0, -2.5, -3.2, -4.0, -4.1, -3.9, -6.0], ["unknown", *["normal"] * 8])
    texts = ["▁" + "".join(x) for n in range(1, 5) for x in itertools.product("abéx", repeat=n)] + ["▁" + "abx" * 400]

    def expected(texts, times):
        raw = [t.replace("▁", " ").encode() for t in texts]
        sizes = np.array([len(t) for t in raw])
        lattice = unigram.Lattice(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes, v.trie)
        return lattice.expected(np.array(times), np.array(v.cost), unknown, len(pieces)) / unigram.PARTS

    unknown = v.least - unigram.PENALTY

    def paths(t):
        if not t:
            yield 0.0, []
        for i, p in enumerate(pieces):
            if v.kinds[i] == "normal" and t.startswith(p):
                yield from ((s + v.cost[i], [i, *x]) for s, x in paths(t[len(p) :]))
        if t and t[0] not in pieces:
            yield from ((s + unknown, x) for s, x in paths(t[1:]))

    want = np.zeros(len(pieces))
    for t in texts[:-1]:
        found = list(paths(t))
        whole = sum(np.exp(s) for s, _ in found)
        for s, x in found:
            np.add.at(want, x, 2 * np.exp(s) / whole)
    got = expected(texts[:-1], [2] * (len(texts) - 1))
    assert np.abs(got - want).max() < 0.05
    # A text too long for plain products is summed in logarithms.
    long = expected(texts[-1:], [1])
    assert abs(long @ [len(p) for p in pieces] - 801) < 0.1


@pytest.fixture(scope="module")
def weighed(vocabulary):
    """The vocabulary with log scores in sixteenths, whose sums are exact in 32-bit floats, as the library adds them."""
    rng = random.Random(2)
    return vocabulary.rescored([-round(16 * (3 + 8 * rng.random() / len(p))) / 16 if k == "normal" else 0.0 for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)])


def test_encoding_against_the_library(spark, weighed, tmp_path):
    import sentencepiece

    data = weighed.proto()
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["", " ", "a", "  two  blanks ", "línea\nnueva\t\r\n", "日本語 😀 \x01", "▁x ▁ y▁", "ü" * 700, "x" * 3000 + ",b", "|a|b|", " ,. a", "a\u3000b"]
    rng = random.Random(8)
    texts += ["".join(rng.choice("the and,. \n|éa1'ing日") for _ in range(rng.randrange(90))) for _ in range(300)]
    texts += [r["text"][:4000] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").limit(150).collect()]
    ids, n, backs = weighed.encode_all([t.encode() for t in texts])
    got = np.split(ids, np.cumsum(n)[:-1])
    for text, own, back in zip(texts, got, backs, strict=True):
        assert own.tolist() == library.encode(text) == weighed.exact(text.encode()), text
        assert back == library.decode(own.tolist()) == text.replace("▁", " "), text
    # The same model from a file, which says that its scores are log scores, is not fitted again.
    (tmp_path / "own.model").write_bytes(data)
    read = unigram.load(str(tmp_path / "own.model"))
    assert read.unigram and read.scores == weighed.scores and read.pieces == weighed.pieces
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in unigram.encode(frame, str(tmp_path / "own.model")).collect()}
    assert all(rows[i]["ids"] == library.encode(t) and rows[i]["n_ids"] == len(rows[i]["ids"]) for i, t in enumerate(texts))


def test_units_of_one_hash_are_told_apart(weighed, monkeypatch):
    own = unigram.load("piece_bpe_32k.model").rescored(weighed.scores)
    real = unigram.Vocabulary.units
    monkeypatch.setattr(unigram.Vocabulary, "units", lambda self, parts: (*real(self, parts)[:3], real(self, parts)[3] % np.uint64(3)))
    texts = ["the cat sat on the mat", "a dog", "the cat", "", "mat mat mat"]
    assert [own.encode(t) for t in texts] == [weighed.exact(t.encode()) for t in texts]


def test_long_texts_in_parts(weighed, monkeypatch):
    text = ("the  cat, " * 40 + "\n" + "x" * 90) * 20 + " "
    whole = weighed.exact(text.encode())
    monkeypatch.setattr(unigram, "CHUNK", 64)
    small = unigram.load("piece_bpe_32k.model").rescored(weighed.scores)
    assert len(small.parts(text.encode())) > 50 and b"".join(small.parts(text.encode())) == b" " + text.encode()
    assert small.encode(text) == whole and small.decode(whole) == text


def test_changing_normalisers_are_refused(weighed):
    field = lambda number, n: bytes([number << 3, n])
    for changed in (field(4, 1), b"\x12\x01x"):
        spec = b"\x0a\x08identity" + field(3, 1) + (b"" if changed[0] == 32 else field(4, 0)) + changed
        with pytest.raises(ValueError, match="normaliser"):
            unigram.parsed(b"\x0a\x05\x0a\x03abc" + bytes([26, len(spec)]) + spec)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 24)) * rng.uniform(0.5, 2, (600, 1)) + 0.3
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    odd = [(10_000, None, ""), (10_020, [0.0] * 24, ""), (10_040, [None] * 24, ""), (10_060, [float("nan")] * 24, ""), (None, [1.0] * 24, ""), (10_080, [1.0, 2.0], ""), (10_081, [3.0, 1.0], ""), (10_100, [], "")]
    got = {}
    for r in ann.nearest(vectors(spark, rows + odd)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert [(v, s) for _, v, s in got.pop(10_080)] == [(10_081, 5.0)]
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        scores = x @ x[q]
        assert np.allclose([f[2] for f in found], scores[[f[1] for f in found]])
        scores[q] = -np.inf
        want = sorted(range(600), key=lambda i: (-scores[i], i))[:20]
        hits += len(set(want) & {f[1] for f in found})
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(vectors(spark, odd[:5])).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 100)), rng.standard_normal((50, 100))
    for dim in (64, 100, 7):
        centre = x[:, :dim].mean(0)
        queries = ann.Queries(np.arange(50), np.arange(50), q[:, :dim], centre)
        mid, err = queries.estimate(slice(0, 50), *ann.encode(x[:, :dim], centre, ann.rotation(dim)))
        assert (np.abs(mid - q[:, :dim] @ x[:, :dim].T) <= err).mean() > 0.94  # two standard deviations
        # But for the query's own rounding, the estimate is the corrected inner product with the code.
        turned = (x[:, :dim] - centre) @ ann.rotation(dim)
        scale = (turned**2).sum(1) / np.abs(turned).sum(1)
        code = (q[:, :dim] @ ann.rotation(dim)) @ np.sign(turned).T * scale + (q[:, :dim] @ centre)[:, None]
        assert (np.abs(mid - code) <= 7 * queries.lost[:, None] * scale * np.sqrt(dim) + 1e-3).all()


def test_recall_of_neighbours(spark):
    table = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert hits >= 0.98 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def test_neighbours_of_repeated_rows(spark, monkeypatch):
    rows = [(20, [1.0, 0.0], ""), (20, [0.0, 1.0], ""), (20, [0.0, 1.0], ""), (7, [2.0, 2.0], ""), (7, [2.0, 2.0], "")]
    for block in (ann.BLOCK, 16):
        monkeypatch.setattr(ann, "BLOCK", block)
        got = sorted(tuple(r) for r in ann.nearest(vectors(spark, rows)).collect())
        # Three rows ask, each of all rows but itself: the others of its own id too.
        first, other = [(7, 2.0), (7, 2.0), (20, 0.0), (20, 0.0)], [(7, 2.0), (7, 2.0), (20, 1.0), (20, 0.0)]
        assert got == sorted((20, i + 1, v, s) for asked in (first, other, other) for i, (v, s) in enumerate(asked))


def test_fingerprints(documents):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    body = text(4000)
    a, b, c = fingerprints.fingerprints([body.encode(), ("zzz" + body).encode(), text(4000).encode()])
    assert fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, c) < 0.05
    rows = [(5, body), (3, "same"), (9, None), (3, "same"), (8, "é" * 7), (None, "no id"), (12, text(50)), (1, "aaaaaaaaaaaa" * 40)]
    got = fingerprints.compare(documents(rows)).collect()
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    want = {}
    import hashlib

    for (doc, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        want.setdefault(doc, []).append((len(t or ""), hashlib.sha256(fingerprints.edited(t or "", after or "").encode()).hexdigest()))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    same = [r for r in got if r["doc_id"] == 3]
    assert same[0]["fingerprint"] == same[1]["fingerprint"] and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in got)
    assert fingerprints.compare(documents(["a"]).where("false")).count() == 0
    assert fingerprints.compare(documents(["only one"])).first()["near_next"] == 1.0


def test_likeness_against_whole_sets(monkeypatch):
    """Estimates from sketches against the sets that they stand for; short texts whose ends change are not all unlike."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pairs = []
    for n in (400, 2000):
        for share in (0.2, 0.5, 0.9):
            a = text(n)
            pairs.append((a, a[: int(len(a) * share)] + text(n)[int(len(a) * share) :]))
    short = [t for t in (text(rng.randint(5, 12)) for _ in range(60))]
    pairs += [(t, t[: len(t) - len(t) // 3] + text(6)[: len(t) // 3]) for t in short] + [(t, text(9)) for t in short]
    flat = [t.encode() for p in pairs for t in p]
    cut = fingerprints.fingerprints(flat)
    assert max(map(len, cut)) == fingerprints.SKETCH
    monkeypatch.setattr(fingerprints, "SKETCH", 1 << 30)
    whole = fingerprints.fingerprints(flat)
    for i in range(len(pairs)):
        a, b = (set(x.tolist()) for x in whole[2 * i : 2 * i + 2])
        if any(x & 1 for x in a) != any(x & 1 for x in b):
            a, b = {x for x in a if not x & 1}, {x for x in b if not x & 1}
        exact = len(a & b) / len(a | b)
        assert abs(fingerprints.likeness(*whole[2 * i : 2 * i + 2]) - exact) < 1e-12
        monkeypatch.setattr(fingerprints, "SKETCH", 128)
        assert abs(fingerprints.likeness(*cut[2 * i : 2 * i + 2]) - exact) < 0.18
        monkeypatch.setattr(fingerprints, "SKETCH", 1 << 30)
    near = [fingerprints.likeness(*whole[2 * i : 2 * i + 2]) for i in range(6, len(pairs))]
    assert sum(x > 0.15 for x in near[:60]) >= 54 and sorted(near[60:])[54] < 0.2


def plain_fingerprint(text: bytes) -> list[int]:
    """The same parse, symbol by symbol."""
    word, mixed = (1 << 64) - 1, lambda x: int(fingerprints._mix(np.array([x], np.uint64))[0])
    low = lambda x: (x & -x).bit_length() - 1
    names, levels = list(text), []
    for level in range(1, max(fingerprints.LEVELS) + 1):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mixed(x + n * 0xD6E8FEB86659FD93 & word) for x, n in runs]
        labels = names
        for _ in range(fingerprints.ROUNDS):
            labels = [2 * (k := low(x ^ y)) + (x >> k & 1) for x, y in zip(labels, [x ^ 1 for x in labels[:1]] + labels, strict=False)]
        cuts = [i for i in range(len(names)) if i == 0 or i + 1 < len(names) and labels[i - 1] < labels[i] > labels[i + 1]]
        parts = [names[i:j] for i, j in zip(cuts, cuts[1:] + [len(names)], strict=False)]
        names = [mixed(sum(mixed(x + (i + 1) * 0xC2B2AE3D27D4EB4F & word) for i, x in enumerate(part)) & word) for part in parts]
        levels.append([mixed(x + level & word) >> 32 for x in names])
    found = {fingerprints.xxhash.xxh3_64_intdigest(text) >> 32 & ~1} | {x & ~1 for level in fingerprints.LEVELS for x in levels[level - 1]}
    for level in range(2, min(fingerprints.LEVELS) + 1):
        if len(levels[level - 1]) < fingerprints.FEW:
            found |= {x | 1 for x in levels[level - 2]}
    return sorted(found)[: fingerprints.SKETCH]


def test_fingerprints_against_a_plain_parse():
    rng = random.Random(11)
    run = lambda: bytes([rng.randrange(256)]) * rng.randint(1, 40)
    texts = [b"", b"a", b"aa", b"ab", b"aab", b"abb", b"", b"z" * 500, b"ab" * 300, bytes(range(256)) * 2, "dé€😀".encode() * 20]
    texts += [bytes(rng.choice(b"ab \xff\0") for _ in range(rng.randint(1, 900))) for _ in range(30)]
    texts += [b"".join(run() for _ in range(rng.randint(1, 60))) for _ in range(30)] + [rng.randbytes(6000)]
    want = [plain_fingerprint(t) for t in texts]
    assert [x.tolist() for x in fingerprints.fingerprints(texts)] == want
    assert [fingerprints.fingerprints([t])[0].tolist() for t in texts] == want and len(want[-1]) == fingerprints.SKETCH


def test_comparing_texts_takes_little_work():
    """CPU seconds of parsing and of likenesses against those of a fixed number of passes over numbers that fit a cache."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(390)) for _ in range(800)]
    press = fingerprints.zstandard.ZstdCompressor(1)
    columns = [[0] * len(texts), list(range(len(texts))), [press.compress(t.encode()) for t in texts], [False] * len(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "doc_id", "blob", "lent"])

    def passes():
        x = np.arange(1 << 15, dtype=np.uint64)
        for _ in range(100 * sum(map(len, texts)) // len(x)):
            x *= np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)

    def seconds(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    compare = lambda: list(fingerprints._compare(iter([batch])))
    compare()
    taken = min(seconds(compare) for _ in range(3)) / min(seconds(passes) for _ in range(3))
    assert taken < 3, taken


def test_neighbouring_labels_differ():
    rng = np.random.default_rng(1)
    names = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64))
    rng.shuffle(names)
    head = np.zeros(len(names), bool)
    head[[0, 700]] = True
    labels = fingerprints._labels(names, head)
    assert labels.max() < 8 and ((labels[1:] != labels[:-1]) | head[1:]).all()


def test_quality(spark, documents):
    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    model = quality.train(docs, labels, f"not ({entry.HELD_OUT})")
    held = quality.score(docs, model).join(labels, "doc_id").where(entry.HELD_OUT).collect()
    right = np.mean([(r["score"] >= quality.ACCEPT) == (r["quality"] == 1) for r in held])
    good = [r["score"] for r in held if r["quality"] == 1]
    bad = [r["score"] for r in held if r["quality"] == 0]
    assert right > 0.93 and np.mean([g > b for g in good for b in bad]) > 0.97
    odd = documents(["", None, "x", "word " * 30000, (3, "twice"), (3, "twice")])
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, model).collect()) and quality.score(odd, model).count() == 6
    assert quality.accepted(odd, model).columns == odd.columns
    assert quality.train(docs, labels.where("false")).constant == 0.5 and quality.train(docs, labels.where("quality = 1")).constant == 1.0


def test_mixing(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["b", "a", None, "é"])) for i in range(200)] + [(1000, None, "empty"), (7, "x y", "a"), (7, "x y", "a"), (None, "q", "b")]
    got = mixing.mix(documents(rows)).collect()
    duck = duckdb.connect()
    import pandas as pd

    duck.register("frame", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    duck.sql("create table documents as select doc_id, text, source from frame")
    want = duck.sql(f"select doc_id, size, source_size, target, taken from ({mixing.SQL}) as q").fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted([(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got], key=key) == sorted(want, key=key)
    total = sum(r["size"] for r in got)
    by = {r["source"]: r for r in got}
    assert abs(sum(r["target"] for r in by.values()) - 1.5 * total) < 1e-6 and all(r["taken"] <= 2 * r["size"] for r in got)
    for s, r in by.items():
        assert abs(sum(x["taken"] for x in got if x["source"] == s) - r["target"]) <= 0.5
    out = mixing.mixed(documents(rows))
    assert out.columns == documents(rows).columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert {d: n for d, n in words.items() if n} == {d: n for d, n in _sum(got).items() if n}
    assert mixing.mix(documents(["a"]).where("false")).count() == 0 == mixing.mixed(documents(["a"]).where("false")).count()


def _sum(rows):
    out = {}
    for r in rows:
        out[r["doc_id"]] = out.get(r["doc_id"], 0) + r["taken"]
    return out


def test_quality_in_bounded_memory():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 399, 2 << 20, 0, 700, 5000)]
    tracemalloc.start()
    x, bags = quality.passages(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * x.nbytes  # 118 MB a slice of 2 MB once
    assert bags.tolist() == [1, 1, 1, 5243, 1, 2, 13] and len(x) == bags.sum()
    for t, e, n in zip(texts, np.cumsum(bags), bags, strict=True):
        assert (x[e - n : e] == quality.passages([t])[0]).all()


def test_workers_give_memory_back(spark):
    def go(batches):
        for batch in batches:
            held = [bytes(1000) for _ in range(100_000)] + [np.ones(1 << 20) for _ in range(4)]
            top = bytes(1000)
            yield batch
            del held
        held = top

    def resident(batches):
        for batch in batches:
            pages = int(open("/proc/self/statm").read().split()[1])
            yield pa.RecordBatch.from_arrays([pa.array([pages >> 8], pa.int64())], ["mb"])

    rows = spark.range(1).coalesce(1)
    before = rows.mapInArrow(resident, "mb long").first()[0]
    rows.mapInArrow(base.frugal(go), "id long").collect()
    assert rows.mapInArrow(resident, "mb long").first()[0] < before + 48
