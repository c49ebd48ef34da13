"""SimHash near-dedup with pigeonring filtering.

A fingerprint has a bit for each bit that over half of a document's shingle hashes set. Fingerprints link
at a Hamming distance of at most 3. For a total of 3 over a ring of four 16-bit segments, some segment starts
a chain whose first n segments differ by at most n * 3 / 4 bits for every n: none in the first, at most one
in the first two, two in the first three, three in all. So the index holds each fingerprint under its four
(segment, next segment) pairs, and each fingerprint also probes the pairs with one more bit set in the second
segment: of two fingerprints that differ in that bit, one has it clear. Candidates that share such a 32-bit
key must pass the chain's longer prefixes before the full check.

Copies share a fingerprint and are collapsed first. The fingerprints of one key become links of a spanning
forest, never all pairs; a key of many rows is dealt out again by the third segment of its chain, which differs
by two bits at most. Components come from alternating large-star and small-star steps over the links.

Defined cases: texts that are NULL or have no word have fingerprint zero; with fewer than three words the
whole sequence is the one shingle; a component whose ids are all NULL has component_id NULL; repeated rows
stay rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, pieces, set_aside

DISTANCE = 3
SEGMENTS, BITS = 4, 16
SEED = 42
#: Links that a file holds between the steps of the component search.
LINKS_A_FILE = 100_000
#: Neighbours that make a node a hub at least, and hubs that there may be (of 16 bytes each, broadcast).
HUB, HUBS = 100, 100_000
#: Rows of one key that are compared at once.
BLOCK = 2048
#: Rows that a key may have before it is dealt out again.
KEY_ROWS = 4096
_BIT_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_ONES = _BIT_OF.sum(axis=1).astype(np.uint8)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the 3-word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    before: list[bytes] = []
    counts, n = 0, 0
    for piece in pieces(text.encode()) if text else ():
        w = before + piece.lower().split()  # bytes.lower() changes A-Z only
        before = w[-2:]
        if len(w) > 2:
            h = np.array([xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(w, w[1:], w[2:], strict=False))], dtype="<u8")
            counts, n = counts + _set_bits(h), n + len(h)
    if not n:
        return xxh64_intdigest(b" ".join(before), SEED) if before else 0
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _set_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit."""
    columns = h.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BIT_OF for k in range(8)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, fp); fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fp = np.fromiter((fingerprint(texts[i].as_py()) for i in range(b.num_rows)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def ring_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, fingerprints and whether the key is exact (index) or has a bit added (probe)."""
    mask = np.uint64((1 << BITS) - 1)
    keys, owners, exact = [], [], []
    for i in range(SEGMENTS):
        first = (fp >> np.uint64(BITS * i)) & mask
        second = (fp >> np.uint64(BITS * ((i + 1) % SEGMENTS))) & mask
        key = (np.uint64(i) << np.uint64(2 * BITS)) | (first << np.uint64(BITS)) | second
        keys.append(key), owners.append(fp), exact.append(np.ones(len(fp), bool))
        for p in range(BITS):
            clear = (second >> np.uint64(p)) & np.uint64(1) == 0
            keys.append(key[clear] | np.uint64(1 << p)), owners.append(fp[clear]), exact.append(np.zeros(int(clear.sum()), bool))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(exact)


def chain_holds(diff: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the chain from segment ``start`` stays within its proportional budget at every length."""
    at = lambda n: np.bitwise_count((diff >> (np.uint64(BITS) * ((start + np.uint64(n)) % np.uint64(SEGMENTS)))) & np.uint64((1 << BITS) - 1))
    total, ok = np.zeros(diff.shape, np.int64), np.ones(diff.shape, bool)
    for n in range(SEGMENTS):
        total = total + at(n)
        ok &= total * SEGMENTS <= (n + 1) * DISTANCE
    return ok


def _links_of_runs(run: np.ndarray, key: np.ndarray, fp: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect, within each run (rows of one number), all that lies within the distance."""
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    length = np.diff(np.append(start, len(run)))
    out_a, out_b = [], []
    small = (length > 1) & (length <= 64)
    rows = np.repeat(small, length)
    k, r, f, e = key[rows], run[rows], fp[rows], exact[rows]
    for gap in range(1, int(length[small].max(initial=1))):
        # each row against the row ``gap`` places on, where both are of one run
        i = np.flatnonzero((r[gap:] == r[:-gap]) & (e[gap:] | e[:-gap]))
        i = i[chain_holds(f[i] ^ f[i + gap], k[i] >> np.uint64(2 * BITS))]
        out_a.append(f[i]), out_b.append(f[i + gap])
    for s, n in zip(start[length > 64].tolist(), length[length > 64].tolist(), strict=True):
        members, index = fp[s : s + n], np.arange(n)
        label, ex, ring = index.copy(), exact[s : s + n], key[s] >> np.uint64(2 * BITS)

        def root(x: np.ndarray) -> np.ndarray:
            while (label[x] != x).any():
                label[x] = label[label[x]]
                x = label[x]
            return x

        for i0 in range(0, n, BLOCK):
            for j0 in range(i0, n, BLOCK):
                a, b = index[i0 : i0 + BLOCK, None], index[None, j0 : j0 + BLOCK]
                near = (a < b) & (ex[a] | ex[b])
                near &= hamming(members[a], members[b]) <= DISTANCE
                x, y = np.nonzero(near)
                x, y = x + i0, y + j0
                ok = chain_holds(members[x] ^ members[y], np.full(len(x), ring, np.uint64))
                x, y = x[ok], y[ok]
                while len(x):
                    rx, ry = root(x), root(y)
                    apart = rx != ry
                    x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
                    label[np.maximum(rx, ry)] = np.minimum(rx, ry)
        top = root(index)
        moved = top != index
        out_a.append(members[moved]), out_b.append(members[top[moved]])
    empty = np.zeros(0, np.uint64)
    return (np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b]))


def third_keys(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The third segment of each row's chain and its 16 values with one bit changed, each with the row's number.

    The first three segments of a chain differ by at most two bits, so that two rows of one key whose chain holds
    share one of these values.
    """
    ring = key >> np.uint64(2 * BITS)
    third = (fp >> (np.uint64(BITS) * ((ring + np.uint64(2)) % np.uint64(SEGMENTS)))) & np.uint64((1 << BITS) - 1)
    flips = np.concatenate([[0], 1 << np.arange(BITS)]).astype(np.uint64)
    return np.repeat(key, len(flips)), (third[:, None] ^ flips[None, :]).ravel(), np.repeat(np.arange(len(key)), len(flips))


def _batch(u: np.ndarray, v: np.ndarray, key: np.ndarray | None = None, exact: np.ndarray | None = None) -> pa.RecordBatch:
    """Links, or rows of a key that was left alone (fingerprint as u)."""
    n = len(u)
    arrays = [pa.array(u), pa.array(v), pa.nulls(n, pa.int64()) if key is None else pa.array(key.view(np.int64)), pa.nulls(n, pa.bool_()) if exact is None else pa.array(exact)]
    return pa.RecordBatch.from_arrays(arrays, names=["u", "v", "key", "exact"])


def _link_sorted(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``keys`` (the first of them the ring key) to links. A run of more than ``most`` rows is passed on as it is, without being held."""
    held: list[np.ndarray] | None = None
    passing = False  # the held run is too long: what came of it has been passed on

    def runs(cols: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(cols[0]), bool)
        for c in cols[: len(keys)]:
            new[1:] |= c[1:] != c[:-1]
        return np.cumsum(new)

    def links(cols: list[np.ndarray], run: np.ndarray) -> pa.RecordBatch:
        a, b = _links_of_runs(run, cols[0], cols[-2], cols[-1])
        a, b = a.view(np.int64), b.view(np.int64)
        return _batch(np.maximum(a, b), np.minimum(a, b))

    def left(cols: list[np.ndarray]) -> pa.RecordBatch:
        fp = cols[-2].view(np.int64)
        return _batch(fp, fp, cols[0], cols[-1])

    def done(cols: list[np.ndarray], run: np.ndarray) -> Iterator[pa.RecordBatch]:
        long = np.bincount(run)[run] > most if most else np.zeros(len(run), bool)
        if long.any():
            yield left([c[long] for c in cols])
        if not long.all():
            yield links([c[~long] for c in cols], run[~long])

    for b in batches:
        if not b.num_rows:
            continue
        now = [*[b.column(k).to_numpy().view(np.uint64) for k in keys], b.column("fp").to_numpy().view(np.uint64), b.column("exact").to_numpy(zero_copy_only=False).astype(bool)]
        if passing and held is not None:
            same = np.logical_and.reduce([now[i] == held[i][0] for i in range(len(keys))])
            n = int(np.argmin(same)) if not same.all() else len(same)
            if n:
                yield left([c[:n] for c in now])
            if n == len(same):
                continue
            now, held, passing = [c[n:] for c in now], None, False
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        run = runs(now)
        cut = int(np.searchsorted(run, run[-1]))  # the last run may go on in the next batch
        held = [x[cut:] for x in now]
        if cut:
            yield from done([x[:cut] for x in now], run[:cut])
        if most and len(held[0]) > most:
            yield left(held)
            passing, held = True, [c[:1] for c in held]
    if held is not None and not passing:
        yield from done(held, runs(held))


def link_fingerprints(fps: DataFrame, most: int = KEY_ROWS) -> DataFrame:
    """Distinct fingerprints (fp) to links (u, v), u > v as signed longs; each link is within the distance,
    or joins two members of one key's group that such pairs connect.

    A key of more than ``most`` rows is dealt out again under the third segments of its chain, over many tasks.
    What then meets in a task shares three segments but for a bit each, so that its number has a bound.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fp), 4096):
                key, owner, exact = ring_keys(fp[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owner.view(np.int64)), pa.array(exact)], names=["key", "fp", "exact"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                fp, exact = part.column("u").to_numpy(), part.column("exact").to_numpy(zero_copy_only=False).astype(bool)
                key, third, row = third_keys(part.column("key").to_numpy().view(np.uint64), fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(third.view(np.int64)), pa.array(fp[row]), pa.array(exact[row])], names=["key", "third", "fp", "exact"])

    out = "u long, v long, key long, exact boolean"
    keyed = fps.select("fp").mapInArrow(expand, "key long, fp long, exact boolean")
    keyed = keyed.repartition("key").sortWithinPartitions("key")
    found = cut_lineage(keyed.mapInArrow(lambda batches: _link_sorted(batches, ("key",), most), out))
    links = found.where("key is null").select("u", "v")
    hot = found.where("key is not null")
    if not hot.isEmpty():
        dealt = hot.mapInArrow(again, "key long, third long, fp long, exact boolean").repartition("key", "third").sortWithinPartitions("key", "third")
        links = links.unionByName(dealt.mapInArrow(lambda batches: _link_sorted(batches, ("key", "third"), None), out).select("u", "v"))
    return links.distinct()


def _with_least(pairs: DataFrame, least: Column, most: int) -> DataFrame:
    """Pairs (u, v) with ``least`` of their u's group as m. Groups of more than ``most`` pairs are joined by broadcast:
    there are fewer of them than pairs / most."""
    groups = pairs.groupBy("u").agg(least.alias("m"), F.count("*").alias("n"))
    hubs = groups.where(F.col("n") > most).select("u", "m")
    others = pairs.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(groups.where(F.col("n") <= most).select("u", "m"), "u")
    return pairs.join(F.broadcast(hubs), "u").unionByName(others)


def connected_components(edges: DataFrame) -> DataFrame:
    """Links (u, v) to (node, root), root being the component's smallest node; roots and nodes without links are left out.

    Minima are grouped with partial sums and joined back, so that no node's neighbours meet in one row; those of
    nodes with many neighbours don't meet in one task either.
    """
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = edges.count()
    state, files, most = None, n // LINKS_A_FILE + 1, max(HUB, 2 * n // HUBS)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least(F.min("v"), F.col("u")), most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, F.min("v"), most).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        # a step adds no links; they are written to as many files as their number asks for
        edges = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(files))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``. Fingerprints of many copies and components of many
    fingerprints, of which there are few, are joined by broadcast."""
    fps = cut_lineage(fingerprints(docs))
    most = max(HUB, fps.count() // HUBS)
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low_id"), F.count("*").alias("copies"))
    roots = connected_components(link_fingerprints(nodes))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low_id", "copies", F.coalesce("root", "fp").alias("u"))
    component = cut_lineage(_with_least(rooted, F.min("low_id"), most).select("fp", "copies", F.col("m").alias("component_id")))
    often = F.broadcast(component.where(F.col("copies") > most).drop("copies"))
    others = fps.join(often.select("fp"), "fp", "left_anti").join(component.where(F.col("copies") <= most).drop("copies"), "fp")
    return fps.join(often, "fp").unionByName(others).select("doc_id", "fp", "component_id")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row of each component stays: the one with the smallest id.

    Rows whose id is NULL or repeated can't be told apart by id; of those in one component the row with the
    smallest columns stays, and only where no row with a plain id is in it. All columns are kept, whatever their names.
    """
    rows, names, back = set_aside(docs)
    doc, text = names["doc_id"], names["text"]
    found = cut_lineage(near_duplicates(rows.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))))
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    odd = ids.where("doc_id is null or n > 1").select(F.col("doc_id").alias("odd_id"))
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("keep_id")).distinct()
    kept = rows.join(keep, rows[doc] == F.col("keep_id"), "left_semi")
    if odd.isEmpty():
        return back(kept)
    plain = kept.join(odd, kept[doc] == F.col("odd_id"), "left_anti")
    rest = rows.join(odd, rows[doc].eqNullSafe(F.col("odd_id")), "left_semi")
    prints = fingerprints(rest.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))).select("fp").distinct()
    where = found.select("fp", "component_id").distinct().join(prints, "fp")
    # repeated ids: the fingerprint of each such row is taken anew and names its component
    tagged = rest.select(F.struct(*rest.columns).alias("all"), F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    tagged = _with_fingerprint(tagged).join(where, "fp").where("component_id is null or component_id = doc_id")
    one = tagged.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("null_fp")).agg(F.min("all").alias("all"))
    return back(plain.unionByName(one.select("all.*")))


def _with_fingerprint(rows: DataFrame) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            fp = np.fromiter((fingerprint(texts[i].as_py()) for i in range(b.num_rows)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, "fp"])

    return rows.mapInArrow(run, schema)


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
