"""N-gram Jaccard join with PartEnum signatures, and its connected components.

A document is the set of its distinct five-word shingles. Equal sets are one set first. Sets are banded by size; a
set of size a differs from any set linked with it in at most d(a) = a * (1 - t) / t shingles, so it meets sets of its
own band and, where it is large enough, of the next one.

PartEnum: the shingle domain is dealt into N1 first-level partitions (more for larger bands) of N2 = 3 second-level
ones each. Sets that differ in d shingles differ in at most K2 = 1 of them in one of any d // (K2 + 1) + 1 first-level
partitions, and there N2 - K2 second-level ones hold the same shingles in both. So every subset of N2 - K2
second-level partitions gives a signature of what the set holds there. A set goes through the first-level partitions
in their order until d // (K2 + 1) + 1 of them are solid (no subset empty); of two linked sets the one that stops first
shares a signature with the other, so no link is lost and no signature stands for emptiness. A set with too few solid
partitions goes on with the domain dealt anew; both sets of a link do so until one of them stops.

Signatures that name the same documents count once. Documents that share a signature are linked through pivots first:
each is verified against the smallest document of another component that it shares most signatures with. What still
lies in different components is compared pairwise, in blocks of bounded size that Spark deals out, by the parities
of shingles in hashed bins (sets that differ in d shingles differ in at most d of those bits), and the few pairs
left are verified on their texts. Pairs inside a component are never formed.

Defined results: null or empty text, or text without words, has an empty set and links with nothing; fewer than five
words are one shingle; rows that repeat a doc_id count as one document with the links of all of them, each row with
the size of its own set; a row whose doc_id is null links with nothing and has a null component; extra columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, mix, rolling, saved, table, word_hashes

SHINGLE, PERCENT = 5, 80
#: Second-level partitions of a first-level one, and how many of them may differ.
N2, K2 = 3, 1
SUBSETS = list(combinations(range(N2), N2 - K2))
#: Bands are so many steps of 1 / t wide; a band has so many times the first-level partitions its largest sets need.
BAND_STEPS, ROOM = 3, 1.1
#: How often the domain is dealt anew before empty subsets count as signatures too.
DEALS = 64
#: Rounds of pivots before what is left is compared pairwise.
PIVOT_ROUNDS = 2
#: Documents whose equal signatures are brought together before the shuffle, and signatures of one group of buckets.
CHUNK_DOCS, CHUNK_BYTES, BUCKET_SIGS = 2000, 4_000_000, 250_000
#: Documents of one block of a signature's pairwise comparison, pairs compared at once, and pairs that share one copy of their
#: first text.
BLOCK, PAIRS, FAN = 256, 300_000, 256
_A = np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64(0xFFFFFFFF)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; A-Z lower-cased."""
    h, counts = word_hashes([t.lower() for t in texts])
    grams = rolling(h, SHINGLE)
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            s = np.sort(grams[at : at + n - SHINGLE + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(mix(rolling(h[at : at + n], n) + np.uint64(n)) if n else h[:0])
        at += n
    return out


def most_apart(size, percent: int = PERCENT):
    """The most shingles in which a set of that size differs from one linked with it."""
    return size * (100 - percent) // percent


def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, last size and number of first-level partitions of each band."""
    low, high = [1], []
    while low[-1] < 1 << 40:
        high.append(low[-1] * 100**BAND_STEPS // percent**BAND_STEPS)
        low.append(high[-1] + 1)
    need = most_apart(np.array(high), percent) // (K2 + 1) + 1
    return np.array(low[:-1]), np.array(high), np.where(need > 1, np.ceil(ROOM * need), 1).astype(np.int64)


def part_enum(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of all PartEnum signatures of the sets."""
    low, _, n1_of = bands(percent)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    first = np.cumsum(size) - size
    own = np.flatnonzero(most_apart(size, percent) > 0)  # smaller sets are linked with equal ones only
    band = np.searchsorted(low, size[own], side="right") - 1
    up = size[own] * 100 // percent >= low[band + 1]
    who, tag = np.concatenate([own, own[up]]), np.concatenate([band, band[up] + 1])
    found_of, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for deal in range(DEALS):
        if not len(who):
            break
        n, n1, salt = size[who], n1_of[tag], mix(np.full(1, deal, np.uint64) + _A)
        need = most_apart(n, percent) // (K2 + 1) + 1
        base = np.cumsum(n1) - n1
        s = flat[np.repeat(first[who] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        h = mix(s + salt)
        part = ((h >> np.uint64(32)) % np.repeat(n1, n).astype(np.uint64)).astype(np.int64)
        cell = (np.repeat(base, n) + part) * N2 + ((h & np.uint64(0xFFFF)) % np.uint64(N2)).astype(np.int64)
        v, cells = mix(s + _A), int(n1.sum()) * N2
        total = [np.bincount(cell, x.astype(np.float64), cells).astype(np.uint64) for x in (v & _LOW, v >> np.uint64(32))]
        held = (total[0] + (total[1] << np.uint64(32))).reshape(-1, N2)  # sums below 2 ** 53 are exact
        full = (np.bincount(cell, minlength=cells) > 0).reshape(-1, N2)
        solid = full.sum(axis=1) > K2
        owner = np.repeat(np.arange(len(who)), n1)
        before = np.cumsum(solid) - solid
        emit = before - before[base][owner] < need[owner]
        name = mix((tag[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(len(owner)) - base[owner]).astype(np.uint64) + salt)
        last = deal == DEALS - 1
        for k, subset in enumerate(SUBSETS):
            some = emit & (full[:, subset].any(axis=1) | last)
            sig = mix(name[some] + np.uint64(k))
            for column in subset:
                sig = mix(sig * _A + held[some, column])
            found_of.append(who[owner[some]])
            found.append(sig)
        short = np.add.reduceat(solid, base) < need
        who, tag = who[short], tag[short]
    return np.concatenate(found_of), np.concatenate(found)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Runs of rows with the sets of their texts."""
    for batch in batches:
        texts, first, size = as_bytes(batch.column("text")), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK_BYTES or i + 1 - first >= CHUNK_DOCS or i + 1 == len(texts):
                yield batch.slice(first, i + 1 - first), shingle_sets(texts[first : i + 1])
                first, size = i + 1, 0


def _set_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row its document, the size and the hash of its set."""
    for part, sets in _chunks(batches):
        h = np.array([(np.bitwise_xor.reduce(mix(s + _A)), mix(s).sum(dtype=np.uint64)) if len(s) else (0, 0) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc", "n", "h1", "h2"])


_DEALT = "bucket long, sig array<long>, doc array<long>, more array<boolean>"


def _deal(percent: int, n_buckets: int):
    """Signatures of a run of documents, but for those whose set a smaller document of the run has, dealt into buckets: of each
    signature its smallest document, and whether there are more in the run. The others stay together in a bucket of their own below 0, so that no signature gathers them."""

    def lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _chunks(batches):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            first: dict[bytes, int] = {}
            for k in np.argsort(ids, kind="stable").tolist():
                first.setdefault(hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), k)
            at, sig = part_enum([sets[k] for k in first.values()], percent)
            if not len(sig):
                continue
            doc = ids[list(first.values())][at]
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            new = np.append(True, sig[1:] != sig[:-1])
            many = ~new | np.append(~new[1:], False)
            bucket = (sig >> np.uint64(20)) % np.uint64(n_buckets)
            order = np.argsort(bucket[new], kind="stable")
            b, sig = bucket[new][order].astype(np.int64), sig.view(np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
            rows = [b[cuts[:-1]], lists(sig[new][order], cuts), lists(doc[new][order], cuts), lists(many[new][order], cuts)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), *rows[1:]], names=["bucket", "sig", "doc", "more"])
            if len(rest := np.flatnonzero(~new)):
                cuts = np.array([0, len(rest)])
                own = np.array([-1 - int(mix(sig[rest[:1]].view(np.uint64))[0] >> np.uint64(2))])
                yield pa.RecordBatch.from_arrays([pa.array(own), lists(sig[rest], cuts), lists(doc[rest], cuts), lists(np.ones(len(rest), bool), cuts)], names=["bucket", "sig", "doc", "more"])

    return run


def _keep_shared(bucket: pa.Table) -> pa.Table:
    """The (signature, document) rows of one bucket whose signature more than one document has."""
    sig, doc, more = (bucket.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("sig", "doc", "more"))
    if bucket.column("bucket")[0].as_py() >= 0:
        order = np.argsort(sig, kind="stable")
        sig, doc, more = sig[order], doc[order], more[order]
        same = sig[1:] == sig[:-1]
        many = np.append(same, False) | np.append(False, same) | more
        sig, doc = sig[many], doc[many]
    return pa.table({"sig": pa.array(sig, pa.int64()), "doc": pa.array(doc, pa.int64())})


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked; the larger one is searched for the smaller one's shingles."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < percent * len(y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    """a, b of the pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                a, left = as_bytes(part.column("text_a")), []
                for t in a:  # pairs come by a: its set is made once
                    if t is not last:
                        if t != last:
                            one = shingle_sets([t])[0]
                        last = t
                    left.append(one)
                right = shingle_sets(as_bytes(part.column("text_b")))
                keep = [similar(x, y, percent) for x, y in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links. The pairs of one a are parted by b, FAN in a part; each part gets a's text once. Ids meet
    texts in sort-merge joins at every size: neither side has a bound."""
    t = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}")).hint("merge")
    fans = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("fans"))
    pairs = saved(pairs.join(fans, "a").select("a", "b", F.pmod(F.xxhash64("b"), "fans").alias("fan")), "pairs")
    left = saved(pairs.select("a", "fan").distinct(), "firsts").join(t("a"), "a")
    both = pairs.join(t("b"), "b").join(left, ["a", "fan"]).select("a", "b", "text_a", "text_b")
    return both.sortWithinPartitions("a").mapInArrow(_verify(percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable over edges (a, b). Labels spread over edges and then jump to the
    label of their label, until none changes."""
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("m"))
        spread = labels.join(near, labels.node == near.a).select("node", F.least("component", "m").alias("next"), "component")
        up = spread.select(F.col("node").alias("up"), F.col("next").alias("up_next"))
        new = saved(spread.join(up, spread.next == up.up, "left").select("node", F.least("next", F.coalesce("up_next", "next")).alias("component"), (F.col("next") < F.col("component")).alias("moved"), (F.coalesce("up_next", "next") < F.col("next")).alias("jumped")), "labels")
        labels = new.select("node", "component")
        if new.where("moved or jumped").isEmpty():
            return labels


def _best_pivots(rows: DataFrame, tried: DataFrame | None) -> DataFrame:
    """a, b: for each document the pivot it shares most signatures with, among pivots of other components not tried yet. A
    signature's pivot is the smallest document of its smallest component."""
    pivots = rows.groupBy("sig").agg(F.min(F.struct("component", "doc")).alias("p"), F.max("component").alias("z"))
    pivots = pivots.where("p.component < z").select("sig", F.col("p.component").alias("c"), F.col("p.doc").alias("a"))
    met = rows.join(pivots, "sig").where("component <> c").groupBy("a", F.col("doc").alias("b")).agg(F.sum("weight").alias("n"))
    if tried is not None:
        met = met.join(tried, ["a", "b"], "left_anti")
    best = met.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("m"))
    return best.select((-F.col("m.a")).alias("a"), "b")


def parities(s: np.ndarray) -> np.ndarray:
    """Parity of a set's shingles in each of at least four times as many bins, a power of two."""
    bins = max(64, 1 << (4 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parities of fewer bins: upper halves laid over lower ones, along the last axis."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets in _chunks(batches):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([parities(s).tobytes() for s in sets], pa.binary())], names=["doc", "n", "bits"])


def _apart(bits: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bins the parities of x and y differ, row by row, in the bins of the smaller ones."""
    size = np.fromiter(map(len, bits), np.int64, len(bits)) // 8
    place, held = np.zeros(len(bits), np.int64), {}
    for k in np.unique(size[np.concatenate([x, y])]).tolist():  # one matrix for each length
        rows = np.flatnonzero(size == k)
        place[rows] = np.arange(len(rows))
        held[k] = np.frombuffer(b"".join([bits[i] for i in rows.tolist()]), np.uint64).reshape(len(rows), k)
    apart = np.zeros(len(x), np.int64)
    for sx in held:
        for sy in held:
            at, least = np.flatnonzero((size[x] == sx) & (size[y] == sy)), min(sx, sy)
            step = max(1, (1 << 21) // max(sx, sy))
            for k in range(0, len(at), step):
                some = at[k : k + step]
                apart[some] = np.bitwise_count(folded(held[sx][place[x[some]]], least) ^ folded(held[sy][place[y[some]]], least)).sum(axis=1)
    return apart


def _runs(rows: pa.Table) -> Iterator[pa.Table]:
    """Runs of whole groups with about PAIRS pairs."""
    keys = [rows.column(c).to_numpy() for c in ("sig", "i", "j")]
    start = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))) if rows.num_rows else np.zeros(0, np.int64)
    size = np.diff(np.append(start, rows.num_rows))
    share = np.cumsum(size * size) // (2 * PAIRS)
    cuts = np.append(start[np.append(True, share[1:] != share[:-1])] if len(start) else start, rows.num_rows)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield rows.slice(a, b - a)


def _close_pairs(percent: int):
    """Pairs of different components, one of each block, whose sizes and parities allow a link. Rows come sorted by group."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        doc, comp, n, side = (rows.column(c).to_numpy() for c in ("doc", "component", "n", "side"))
        new = np.append(True, np.any([rows.column(c).to_numpy()[1:] != rows.column(c).to_numpy()[:-1] for c in ("sig", "i", "j")], axis=0))
        start = np.flatnonzero(new)
        end = np.repeat(np.append(start[1:], len(doc)), np.diff(np.append(start, len(doc))))
        found, x = [np.zeros((0, 4), np.int64)], np.arange(len(doc))
        for k in range(1, len(doc)):  # each row with the k-th after it in its group
            x = x[x + k < end[x]]
            if not len(x):
                break
            y = x + k
            near = ((side[x] | side[y]) == 3) & (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            u, v = x[near], y[near]
            found.append(np.column_stack([np.minimum(doc[u], doc[v]), np.maximum(doc[u], doc[v]), u, v]))
        found = np.concatenate(found)
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        found = found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)]]
        u, v = found[:, 2], found[:, 3]
        fits = found[(100 + percent) * _apart(rows.column("bits").to_pylist(), u, v) <= (100 - percent) * (n[u] + n[v])]
        return pa.RecordBatch.from_arrays([pa.array(fits[:, 0]), pa.array(fits[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            sig, i, j = (rows.column(c).to_numpy() for c in ("sig", "i", "j"))
            last = int(np.argmax((sig == sig[-1]) & (i == i[-1]) & (j == j[-1])))  # the last group may go on
            for part in _runs(rows.slice(0, last)):
                yield pairs(part)
            held = rows.slice(last)
        if held is not None:
            yield pairs(held)

    return run


def _same_once(shared: DataFrame) -> DataFrame:
    """sig, doc, weight: of signatures that name the same documents one, with their number."""
    groups = shared.groupBy("sig").agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.bit_xor(F.xxhash64("doc")).alias("h"), F.max("doc").alias("high"))
    once = groups.where("n > 1").groupBy("n", "low", "high", "h").agg(F.min("sig").alias("sig"), F.count("*").alias("weight"))
    return shared.join(once.select("sig", "weight"), "sig")


def _cross_pairs(labelled: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of documents of different components that share a signature and may be linked. The documents of a
    signature are dealt into blocks, and each two blocks meet in a group of their own."""
    mixed = labelled.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x < y")
    mixed = saved(mixed.select("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "mixed")
    rows = saved(labelled.join(mixed, "sig").select("sig", "doc", "component", "blocks"), "mixed-rows")
    asked = saved(rows.select(F.col("doc").alias("doc_id")).distinct(), "asked")
    sketches = saved(texts.join(asked.hint("merge"), "doc_id", "left_semi").mapInArrow(_sketch, "doc long, n long, bits binary"), "sketches")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    # a document stands on the left of the pairs of its block with later ones, on the right with earlier ones, on both with its own
    rows = rows.withColumn("meet", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("sig", "doc", "component", F.least("block", "meet").alias("i"), F.greatest("block", "meet").alias("j"), F.when(F.col("meet") == F.col("block"), 3).when(F.col("meet") > F.col("block"), 1).otherwise(2).alias("side"))
    met = rows.join(sketches, "doc").repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return met.mapInArrow(_close_pairs(percent), "a long, b long").distinct()


def ngram_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs."""
    docs = docs.select("doc_id", "text")
    sets = saved(docs.mapInArrow(_set_hashes, "doc long, n long, h1 long, h2 long"), "sets")
    known = sets.where("doc is not null and n > 0")
    # sets that more than one row has; written, so that the planner may broadcast them or split a very common one
    reps = saved(known.groupBy("h1", "h2").agg(F.min("doc").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "reps")
    rep = F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")).alias("rep")
    sets = saved(sets.join(reps, ["h1", "h2"], "left").select("doc", "n", rep), "sets")
    # documents that stand for no set: all of their rows have that of a smaller document
    copies = sets.where("doc is not null").groupBy("doc").agg(F.bool_or(F.col("doc") == F.col("rep")).alias("own")).where("not own").select("doc")
    copies = saved(copies, "copies")
    docs = docs.where("doc_id is not null")

    total = sets.agg(F.sum("n")).first()[0] or 0
    dealt = docs.mapInArrow(_deal(percent, 1 + total // BUCKET_SIGS), _DEALT)
    shared = saved(dealt.groupBy("bucket").applyInArrow(_keep_shared, "sig long, doc long"), "shared")
    shared = saved(_same_once(shared.join(copies, "doc", "left_anti")), "shared-once")
    asked = saved(shared.select(F.col("doc").alias("doc_id")).distinct(), "asked")
    texts = saved(docs.join(asked.hint("merge"), "doc_id", "left_semi"), "texts")

    # rows of one document with different sets are one document
    links = sets.where("rep is not null").groupBy("doc").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("doc")
    links = sets.join(links, "doc").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    # each document against the pivot it shares most signatures with, while that joins components
    labelled, tried = shared.withColumn("component", F.col("doc")), None
    for _ in range(PIVOT_ROUNDS):
        best = saved(_best_pivots(labelled, tried), "pivots")
        tried = best if tried is None else tried.union(best)
        new = saved(_verified(best, texts, percent), "new-links")
        links = links.union(new)
        label = components(links)
        labelled = shared.join(label, shared.doc == label.node, "left").select("sig", "doc", "weight", F.coalesce("component", "doc").alias("component"))
        labelled = saved(labelled, "labelled")
        if new.isEmpty():
            break

    # then what still lies in different components
    cross = saved(_cross_pairs(labelled, texts, percent), "cross")
    more = _verified(cross, texts, percent)
    top = components(saved(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "links"))
    result = sets.join(top, sets.rep == top.node, "left")
    return result.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def drop_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without all but the smallest doc_id of each component. Of rows that repeat a doc_id the one with the smallest
    text stays; rows whose doc_id is null stay."""
    found = saved(ngram_components(docs, percent).where("doc_id is not null").select("doc_id", "component_id"), "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    repeated = saved(repeated, "repeated")
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first()))
    rank = next(c for c in (f"rank_{k}" for k in range(len(docs.columns) + 1)) if c not in docs.columns)
    firsts = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns, ordinal.alias(rank)).where(F.col(rank) == 1).select(docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(firsts)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(doc_id, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, coalesce(min(r.c), s.doc_id) AS component_id FROM s LEFT JOIN r USING (doc_id) GROUP BY s.doc_id, s.s
"""
