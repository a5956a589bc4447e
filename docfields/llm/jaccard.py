"""N-gram Jaccard join with a token-group matrix.

A document's tokens are the hashes of its word 5-grams.  Documents with equal token sets are one set.

1. Sets are put into groups of similar sets: those that share a min-hash are compared in blocks, and linked
   sets form a group.
2. The token-group matrix holds (token, group) for the rarest tokens of every set, as many as two similar sets
   cannot both do without.  Two groups that share none of them hold no link.
3. Of two groups that share one, the larger is opened in blocks.  A block stores the union of its members'
   tokens; a query set of the other group is compared with the members only if its overlap with that union
   reaches the threshold; those comparisons are exact.

A link inside a group is already known to join it, and one link between two groups joins them, so the
components are those of all links.  The order of tokens comes from a sketch of their counts whose size is
fixed; any order gives the same result.

Null and empty texts have no tokens and link with nothing; rows with equal texts, repeated ids included, are
linked; a null id takes part and is never the least of a component unless no other id is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.base import cut, frugal, groups, mixed, packed, partitions, release, run_hashes, slices, unpacked
from docfields.llm.graph import components

WORDS, PERCENT = 5, 75
#: Min-hashes of a set, and members of a block of an opened group.
HASHES, BLOCK = 5, 256
#: Counters of the sketch, and parts in which it is summed.
COUNTERS, PARTS = 1 << 20, 64
#: Matrix entries that a task gathers before it sends them.
GATHER = 1 << 20
#: Matrix entries about which a range of tokens holds: there are more ranges, and tasks, for more entries.
RANGE = 4 << 20

#: Bytes of texts whose tokens are made together.
TOGETHER = 1 << 19

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_U = np.uint64
_PLACES = np.random.default_rng(3).integers(1, 1 << 63, WORDS, dtype=np.uint64) * _U(2) + _U(1)
_SEEDS = np.random.default_rng(4).integers(1, 1 << 62, HASHES, dtype=np.uint64) * _U(2) + _U(1)
#: Tokens up to which the min-hashes of a set are worked out together.
WIDE = 4096


def tokens(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its word 5-grams; of all its words, if they are fewer."""
    flat = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]  # a blank after each text, so no word goes on
    edge = np.diff(np.concatenate([[True], _SPACE[flat]]).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    h = run_hashes(flat, starts, np.flatnonzero(edge == 1) - starts)
    last = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])).tolist()
    n = max(0, len(h) - WORDS + 1)
    total = h[:n] * _PLACES[0]
    for i in range(1, WORDS):
        total += h[i : n + i] * _PLACES[i]
    total, out, a = mixed(total), [], 0
    for b in last:
        if b - a >= WORDS:
            t = np.sort(total[a : b - WORDS + 1])
            new = np.ones(len(t), bool)
            new[1:] = t[1:] != t[:-1]
            out.append(t[new])
        else:
            out.append(mixed((h[a:b] * _PLACES[: b - a]).sum(keepdims=True) + _U(b - a)) if b > a else np.zeros(0, np.uint64))
        a = b
    return out


def needed(n: int) -> int:
    """Least intersection that a set of ``n`` tokens has with any set that it links with."""
    return -(-n * PERCENT // 100)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    common = int((b[at] == a).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes that name a row by its id and text."""
    id_, text = doc_id.cast("long"), F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(id_, text), F.xxhash64(text, id_, F.lit(1))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the names of their token sets; a set's text, compressed, and min-hashes stand at one row of it a task.

    At last come the task's counts of tokens, in parts.
    """
    press, sent, counts = zstandard.ZstdCompressor(3), set(), np.zeros(COUNTERS, np.int64)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32())
    names = ["doc_id", "n", "sid", "blob", "k1", "k2", "mins", "part"]
    for batch, texts in slices(batches, "text", TOGETHER):
        sizes, keys, blobs, mins, fresh = [], [], [], [], []
        for text, t in zip(texts, tokens(texts), strict=True):
            sizes.append(len(t))
            key = xxhash.xxh3_64_intdigest(t.tobytes()) >> 1 if len(t) else None
            keys.append(key)
            if key is None or key in sent:
                blobs.append(None)
                mins.append(None)
                continue
            blobs.append(press.compress(text))
            # Tokens are hashes already, so products with odd numbers are enough to order them anew.
            least = np.multiply.outer(t, _SEEDS).min(0) if len(t) <= WIDE else np.array([(t * x).min() for x in _SEEDS])
            mins.append(least.astype(np.int64))
            fresh.append(t)
            if len(sent) < GATHER:
                sent.add(key)
        if fresh:
            counts += np.bincount((np.concatenate(fresh) >> _U(44)).astype(np.int64), minlength=COUNTERS)
        columns = [batch.column("doc_id"), sizes, keys, blobs, batch.column("k1"), batch.column("k2"), mins, [None] * len(texts)]
        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    fast = zstandard.ZstdCompressor(1)
    parts = [fast.compress(p.tobytes()) for p in np.split(np.minimum(counts, 65535).astype(np.uint16), PARTS)]
    none = [None] * PARTS
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([none, none, none, parts, none, none, none, range(PARTS)], kinds, strict=True)], names)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, tokens) of every row that holds a compressed text."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        blobs, at = batch.column("blob"), 0
        for some in groups((press.decompress(b.as_buffer()) for b in blobs), TOGETHER):
            for t in tokens(some):
                yield batch, at, t
                at += 1


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press, total = zstandard.ZstdDecompressor(), {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(press.decompress(blob), np.uint16).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(total, pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in total.values()], pa.binary())], ["part", "counts"]
    )


def sketch(rows: DataFrame) -> np.ndarray:
    """About how many sets hold each token, by the token's first bits: ``COUNTERS`` numbers, whatever the input."""
    parts = rows.where("part is not null").select("part", F.col("blob").alias("counts"))
    rows = parts.repartition(PARTS, "part").mapInArrow(frugal(_sum), "part int, counts binary").collect()
    out = np.zeros(COUNTERS, np.uint32)
    for r in rows:
        out[r["part"] * (COUNTERS // PARTS) :][: COUNTERS // PARTS] = np.frombuffer(r["counts"], np.uint32)
    return out


def opened(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """a, b: a link for each query set with each group block in which it has any.

    ``wanted`` has a row (grp, block, query, sid) for each member (query false) and each query of a block of an
    opened group.  The members of a block, ``BLOCK`` at most, come first and are kept; the queries stream by.
    """
    rows = wanted.join(sets.select("sid", "blob"), "sid").repartition(partitions(sets.sparkSession), "grp", "block")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, union, links = None, [], None, []
        for batch, i, t in _read(batches):
            at, sid = (batch.column("grp")[i].as_py(), batch.column("block")[i].as_py()), batch.column("sid")[i].as_py()
            if at != now:
                now, members, union = at, [], None
            if not batch.column("query")[i].as_py():
                if not members or members[-1][0] != sid:
                    members.append((sid, t))
                continue
            if union is None:
                union = np.unique(np.concatenate([m for _, m in members])) if members else np.zeros(0, np.uint64)
            if not len(union):
                continue
            place = np.searchsorted(union, t)
            place[place == len(union)] = len(union) - 1
            if int((union[place] == t).sum()) < needed(len(t)):
                continue
            for other, m in members:
                if other != sid and linked(t, m):
                    links.append((sid, other))
                    break
            if len(links) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
                links = []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return rows.sortWithinPartitions("grp", "block", "query", "sid").select("grp", "block", "query", "sid", "blob").mapInArrow(frugal(go), "a long, b long")


def _linked_within(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """a, b: links that join all members of a block (grp, block, sid) that any chain of its links joins.

    Members of one component are not compared, so a block of near copies takes about one comparison a member.
    """
    rows = wanted.join(sets.select("sid", "blob"), "sid").repartition(partitions(sets.sparkSession), "grp", "block")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, top, links = None, [], {}, []

        def find(c: int) -> int:
            while top.setdefault(c, c) != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        for batch, i, t in _read(batches):
            at = (batch.column("grp")[i].as_py(), batch.column("block")[i].as_py())
            sid = batch.column("sid")[i].as_py()
            if at != now:
                now, members, top = at, [], {}
            if members and members[-1][0] == sid:
                continue
            for other, m in members:
                if find(other) != find(sid) and linked(t, m):
                    top[find(other)] = find(sid)
                    links.append((sid, other))
            members.append((sid, t))
            if len(links) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])
                links = []
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], ["a", "b"])

    return rows.sortWithinPartitions("grp", "block", "sid").select("grp", "block", "sid", "blob").mapInArrow(frugal(go), "a long, b long")


def _groups(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links, and the components (node, comp) that they make, that put similar sets into groups.

    Sets that share a min-hash are gathered under the least of them and compared in blocks of ``BLOCK`` at most, each
    with that least one.
    """
    own = sets.select("sid", F.posexplode("mins").alias("place", "bucket")).distinct()
    hubs = own.groupBy("place", "bucket").agg(F.min("sid").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    met = own.join(hubs, ["place", "bucket"]).where("sid <> hub").groupBy(F.col("hub").alias("grp"), "sid")
    met = cut(met.agg(F.max("size").alias("size")))
    met = met.withColumn("block", F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / BLOCK)))
    hub = met.select("grp", "block", F.col("grp").alias("sid")).distinct()
    links = cut(_linked_within(sets, hub.unionByName(met.select("grp", "block", "sid"))))
    known = cut(components(links))
    release(sets.sparkSession)
    return links, known


def early(n: int) -> int:
    """How many of its first tokens can be the first that a set of ``n`` shares with one it links with and that is no smaller."""
    return n - -(-n * 2 * PERCENT // (100 + PERCENT)) + 1


def _firsts(t: np.ndarray, g: np.ndarray, late: np.ndarray, *rest: np.ndarray) -> list[np.ndarray]:
    """One entry for each token and group, early if any of them is."""
    o = np.lexsort((late, g, t))
    t, g = t[o], g[o]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    return [t[new], g[new], *(x[o][new] for x in (late, *rest))]


def _matrix(sets: DataFrame, order: np.ndarray, ranges: int) -> DataFrame:
    """p, q: distinct pairs of groups (q the greater) that share a token of the matrix.  ``sets`` has sid, grp, alone, n, blob.

    Entries travel as blocks of sorted tokens, a block for each range of tokens; equal entries of a task are one.
    """
    sent = sets.sparkSession.sparkContext.broadcast(order)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, press = sent.value, zstandard.ZstdCompressor(1)
        parts: list[tuple[np.ndarray, int, int, int]] = []
        held = 0

        def out() -> pa.RecordBatch:
            groups, of = np.unique(np.array([x[1] for x in parts], np.int64), return_inverse=True)
            size = np.zeros(len(groups), np.int32)
            size[of] = [x[2] for x in parts]
            t, g = np.concatenate([x[0] for x in parts]), np.repeat(of, [len(x[0]) for x in parts])
            late = np.concatenate([np.arange(len(x[0])) >= x[3] for x in parts])
            t, g, late = _firsts(t, g, late)
            where = ((t >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
            ends = np.searchsorted(where, np.arange(ranges), "right")
            rows = {"range": [], "tokens": [], "of": [], "groups": [], "size": []}
            for r, (a, b) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
                if b > a:
                    names, local = np.unique(g[a:b], return_inverse=True)
                    rows["range"].append(r)
                    rows["tokens"].append(press.compress(t[a:b].view(np.uint8).reshape(-1, 8).T.tobytes()))
                    rows["of"].append(press.compress((local << 1 | late[a:b]).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()))
                    rows["groups"].append(groups[names].tobytes())
                    rows["size"].append(size[names].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows["range"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in list(rows)[1:])], list(rows))

        for batch, i, t in _read(batches):
            p = len(t) - needed(len(t)) + 1
            rare = t[np.argsort(order[(t >> _U(44)).astype(np.int64)], kind="stable")[:p]]  # tokens ascend, so equal counts stay in their order
            # A size of 0 stands for a group of several sets.
            parts.append((rare, batch.column("grp")[i].as_py(), len(t) if batch.column("alone")[i].as_py() else 0, early(len(t))))
            held += p
            if held >= GATHER:
                yield out()
                parts, held = [], 0
        if parts:
            yield out()

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[bytes, ...]]] = {}
        for batch in batches:
            for r, *blobs in zip(*(batch.column(c).to_pylist() for c in ("range", "tokens", "of", "groups", "size")), strict=True):
                waiting.setdefault(r, []).append(tuple(blobs))
        # Blocks stay packed until their range's turn: one range at a time is unpacked.
        for r in list(waiting):
            yield from met(waiting.pop(r))

    def met(blocks: list[tuple[bytes, ...]]) -> Iterator[pa.RecordBatch]:
        press, held = zstandard.ZstdDecompressor(), []
        while blocks:
            t, of, groups, size = blocks.pop()
            t = np.ascontiguousarray(np.frombuffer(press.decompress(t), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
            of = np.ascontiguousarray(np.frombuffer(press.decompress(of), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            held.append((t, np.frombuffer(groups, np.int64)[of >> 1], (of & 1).astype(bool), np.frombuffer(size, np.int32)[of >> 1]))
        t, g, late, n = (np.concatenate(x) for x in zip(*held, strict=True))
        t, g, late, n = _firsts(t, g, late, n)
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        counts = np.diff(starts, append=len(t))
        found: set[tuple[int, int]] = set()
        for a, k in zip(starts[counts > 1], counts[counts > 1], strict=True):
            # By size, so that each set meets only those that are not too large for it.  The first token that two linked
            # sets share is an early one of the smaller, and of both if they are of one size.
            row = sorted(zip(n[a : a + k].tolist(), g[a : a + k].tolist(), late[a : a + k].tolist(), strict=True))
            for x, (s, one, slow) in enumerate(row):
                for m, two, slow2 in row[x + 1 :]:
                    if s and s * 100 < PERCENT * m:
                        break
                    if not (slow and (slow2 or s) or s == m and s and slow2):
                        found.add((min(one, two), max(one, two)))
            if len(found) > GATHER:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["p", "q"])
                found = set()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["p", "q"])

    entries = sets.select("grp", "alone", "blob").mapInArrow(frugal(gather), "range int, tokens binary, of binary, groups binary, size binary")
    return entries.repartition(ranges, "range").mapInArrow(frugal(pair), "p long, q long").distinct()


def _joined(docs: DataFrame) -> DataFrame:
    """doc_id, n, k1, k2 (hashes of id and text), comp for each row of ``docs``; comp is null without tokens."""
    spark = docs.sparkSession
    k1, k2 = _keys(F.col("doc_id"), F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), k1.alias("k1"), k2.alias("k2"))
    full = cut(rows.mapInArrow(frugal(_sets), "doc_id long, n long, sid long, blob binary, k1 long, k2 long, mins array<long>, part int"))
    rows = full.where("part is null")
    # Equal sets of several tasks come several times; every step below takes them as one.
    sets = rows.where("blob is not null").select("sid", "n", "blob", "mins")
    first, known = _groups(sets)
    size = known.groupBy("comp").agg(F.count(F.lit(1)).alias("members")).withColumnRenamed("comp", "of")
    grouped = sets.select("sid").distinct().join(known, F.col("sid") == F.col("node"), "left").join(size, F.col("comp") == F.col("of"), "left")
    grouped = cut(grouped.select("sid", F.coalesce("comp", "sid").alias("grp"), F.coalesce("members", F.lit(1)).alias("members")))
    named = sets.join(grouped.select("sid", "grp", (F.col("members") == 1).alias("alone")), "sid")
    order = sketch(full)
    # A set enters with the tokens that it can't do without, about a quarter of them.
    entries = int(order.sum(dtype=np.int64)) * (100 - PERCENT) // 100
    near = cut(_matrix(named, order, max(partitions(spark), -(-entries // RANGE))))
    release(spark)
    counts = grouped.select("grp", "members").distinct()
    near = near.join(counts.toDF("p", "mp"), "p").join(counts.toDF("q", "mq"), "q")
    larger = F.col("mp") >= F.col("mq")
    near = cut(near.select(F.when(larger, F.col("p")).otherwise(F.col("q")).alias("grp"), F.when(larger, F.col("q")).otherwise(F.col("p")).alias("other")))
    members = grouped.select("sid", "grp", F.pmod(F.xxhash64("sid"), F.ceil(F.col("members") / (BLOCK // 2))).alias("block"))
    inside = members.join(near.select("grp").distinct(), "grp").select("grp", "block", F.lit(False).alias("query"), "sid")
    blocks = inside.select("grp", "block").distinct()
    asking = near.join(grouped.select("sid", F.col("grp").alias("other")), "other").join(blocks, "grp").select("grp", "block", F.lit(True).alias("query"), "sid")
    second = cut(opened(sets, inside.unionByName(asking)))
    release(spark)
    final = components(first.unionByName(second))
    light = rows.select("doc_id", "n", "sid", "k1", "k2")
    return light.join(final, F.col("sid") == F.col("node"), "left").select("doc_id", "n", "k1", "k2", F.coalesce("comp", "sid").alias("comp"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of ``docs``."""
    light = _joined(docs)
    least = light.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")).withColumnRenamed("comp", "of")
    return light.join(least, F.col("comp") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def one_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: that with the least id (a null id last), of equal rows one.

    Rows without tokens are linked with nothing and all stay.
    """
    light = cut(_joined(docs))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("x")
    kept = light.where("comp is not null").groupBy("comp").agg(first).select("x.k1", "x.k2")
    row = F.col("row")
    k1, k2 = _keys(row["doc_id"], row["text"])
    blank = F.coalesce(F.length(F.btrim(row["text"].cast("string"), F.lit(" \t\n\x0b\f\r"))), F.lit(0)) == 0
    # Equal rows are one before they are dealt out, however many there are.
    ones = packed(docs).where(~blank).groupBy(k1.alias("k1"), k2.alias("k2")).agg(F.first("row").alias("row")).join(kept, ["k1", "k2"])
    return unpacked(ones.select("row").unionByName(packed(docs).where(blank)), docs)


SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
g as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < {WORDS} then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' ')) end) as shingle from w),
n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from g a join g b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= {PERCENT} * (x.n + y.n - common)),
r(doc_id, other) as (select a, a from l union select r.doc_id, l.b from r join l on l.a = r.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce((select min(other) from r where r.doc_id = d.doc_id), d.doc_id) as component_id
from documents d left join n on n.doc_id = d.doc_id
"""
