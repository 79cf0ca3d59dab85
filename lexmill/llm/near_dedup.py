"""SimHash near-dedup with pigeonring filtering.

Two fingerprints of 64 bits that differ in at most 3 have, if cut into a ring of 4 segments, a segment from which every chain
of consecutive segments keeps to its proportional budget: 0 differing bits in the first, 1 in the first two, 2 in three
and 3 in all. So fingerprints meet in buckets of one equal segment; of the other 48 bits the same holds again, so one more
segment of 12 bits joins the key. Buckets of over CROWD fingerprints are cut by a third, a fourth and a fifth ring, whose remainder
of at most 16 bits bounds a bucket by itself. In a bucket, chains of growing length prune pairs before the whole distance
is taken, and of the links only those go on that connect what was not connected: a spanning forest, never all pairs.
Components of these edges are those of all links.

Equal fingerprints are one node. Null and empty texts, and those of white space alone, have fingerprint zero and link to
each other and to any text within 3 bits of it. Texts of any length are hashed in blocks. Rows that repeat get equal
answers. A null doc_id is ignored in the minimum unless a component has no other. An empty table gives no rows. Extra columns
are not read; `deduplicate` returns them.

Texts that share at least 0.8 of their distinct shingles of five words differ in about 10 of 64 bits, which no exact search over
so few bits reaches. For them (`similar_documents`) the fingerprint is a ring of 8 words of 64 bits over the distinct shingles.
Texts meet in buckets of one equal segment of 16 of its 512 bits; chains of 1, 2 and 4 words from the bucket's own must
keep to 13 differing bits a word, then the whole ring to 104. Buckets of over CROWD texts are dealt to cells of bounded size in
which every two of them meet whose numbers of shingles allow a link. Of the pairs left in a bucket a spanning forest of the least
distances goes on, and each of its edges is held against the true share of shingles, so no link is wrong; pairs that
share no segment are missed (the README gives the measured recall). Texts with equal sets of shingles are one node; those
without words link to each other only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, keep_rows, lookup, materialize, text_hash
from .components import components

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: Segment widths of the rings, from the whole fingerprint down; the first two make the key of every fingerprint.
RINGS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6), (6, 5, 5, 5))
CROWD = 1 << 14
#: Rows of a crowded bucket of the ring in a slice; keys of crowded buckets that are broadcast.
SLICE, BROADCAST_KEYS = 1 << 13, 100_000
BLOCK, SMALL = 1024, 48
#: Of the ring: words in a shingle and the share of shingles that links texts; its words, segments, budget of bits a word and the
#: lengths of the chains that are held to it; the distances that a forest takes first; pairs for which one copy of a set is read.
WORDS_A_SHINGLE, SIMILARITY = 5, 0.8
RING, SEGMENTS, BUDGET, CHAINS = 8, 32, 13, (1, 2, 4, 8)
LAYERS, PAIRS_A_COPY = (26, 52, 65, 78, 91, 104), 1000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HASHES = 1 << 16


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in order, in blocks; none if it has no words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    firsts, lasts = starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    for at in range(0, n, _HASHES):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(firsts[at : at + _HASHES], lasts[at : at + _HASHES])], "<u8")


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's shingles as an unsigned integer."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in _hashes(text, SHINGLE):
        ones += _ones(h)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint as a signed integer of the same bits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    return docs.select(docs["doc_id"].cast("bigint"), text_hash().alias("text_hash"), docs["text"]).mapInArrow(rows, "doc_id bigint, text_hash bigint, fp bigint")


def _starts(path: Column, rest: Column, widths: tuple[int, ...]) -> list[tuple[Column, Column]]:
    """For each start of the ring: the path with start and segment appended, and the other segments in ring order."""
    width, found, before = sum(widths), [], 0
    for start, own in enumerate(widths):
        before += own
        turned = F.shiftleft(rest, before).bitwiseOR(F.shiftrightunsigned(rest, width - before)) if before < width else rest
        turned = turned if width == BITS else turned.bitwiseAND(F.lit((1 << width) - 1))
        segment = turned.bitwiseAND(F.lit((1 << own) - 1))
        name = F.shiftleft(F.shiftleft(path, 2).bitwiseOR(F.lit(start)), own).bitwiseOR(segment)
        found.append((name, F.shiftrightunsigned(turned, own)))
    return found


def _rekey(rows: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    each = [F.struct(p.alias("path"), r.alias("rest")) for p, r in _starts(F.col("path"), F.col("rest"), widths)]
    return rows.select("fp", F.explode(F.array(*each)).alias("x")).select("fp", "x.path", "x.rest")


def _link(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (the least member known of each one's set) after joining a[k] with b[k]."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        la, lb = la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
        a, b = a[apart], b[apart]


def _viable(x: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """Which of the differences x keep every chain within its budget, then the whole.

    widths: of the segments behind the equal one, so the budgets are 1, 2 and 3; none if they aren't known.
    """
    left, ok = sum(widths), np.arange(len(x))
    for budget, width in enumerate(widths[:-1], 1):
        left -= width
        ok = ok[np.bitwise_count(x[ok] >> np.uint64(left)) <= budget]
    return ok[np.bitwise_count(x[ok]) <= DISTANCE]


def _forest(path: np.ndarray, rest: np.ndarray, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by path: positions and, for each, the least position it is linked to, where that is another."""
    n = len(path)
    labels = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
    size = np.diff(np.concatenate((first, [n])))
    own = np.repeat(size, size)
    small = np.flatnonzero((own > 1) & (own <= SMALL))
    for step in range(1, SMALL):
        small = small[small + step < n]
        small = small[path[small] == path[small + step]]
        if not len(small):
            break
        hit = small[_viable(rest[small] ^ rest[small + step], widths)]
        labels = _link(labels, hit, hit + step)
    for k in np.flatnonzero(size > SMALL):
        begin, end = first[k], first[k] + size[k]
        for i in range(begin, end, BLOCK):
            for j in range(i, end, BLOCK):
                a, b = rest[i : min(i + BLOCK, end)], rest[j : min(j + BLOCK, end)]
                first_budget, behind = (1, sum(widths[1:])) if widths else (DISTANCE, 0)
                near = np.flatnonzero(np.bitwise_count((a[:, None] ^ b[None, :]).ravel() >> np.uint64(behind)) <= first_budget)
                p, q = np.divmod(near, len(b))
                ok = _viable(a[p] ^ b[q], widths)
                p, q = p[ok] + i, q[ok] + j
                labels = _link(labels, p[p < q], q[p < q])
    moved = np.flatnonzero(labels != np.arange(n))
    return moved, labels[moved]


def _bucket_edges(rows: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Spanning forests of the buckets. Rows arrive sorted; a bucket is held whole, and it has a bounded size."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3
        for columns in (*([c.to_numpy() for c in b.columns] for b in batches), None):
            if columns is not None:
                kept = [np.concatenate((k, c)) for k, c in zip(kept, columns)]
            n = len(kept[0])
            cut = n if columns is None else int(np.searchsorted(kept[0], kept[0][-1])) if n else 0
            if cut < 1:
                continue
            path, rest, fp = (k[:cut] for k in kept)
            kept = [k[cut:] for k in kept]
            child, root = _forest(path, rest.view(np.uint64), widths)
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root])], names=["a", "b"])

    return rows.repartition("path").sortWithinPartitions("path").select("path", "rest", "fp").mapInArrow(edges, "a bigint, b bigint")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints fp of fps that connect exactly what links of 3 or fewer bits connect."""
    rows = fps.select("fp", F.lit(0).cast("bigint").alias("path"), F.col("fp").alias("rest"))
    rows = _rekey(_rekey(rows, RINGS[0]), RINGS[1])
    found = None
    for depth, widths in enumerate(RINGS[2:], 2):
        crowded = checkpoint(rows.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("path"))
        crowds = not crowded.isEmpty()
        calm = rows.join(crowded.hint("merge"), "path", "left_anti") if crowds else rows
        # Segments of unequal widths lie otherwise for each start, so there only the whole distance is taken.
        above = RINGS[depth - 1]
        edges = _bucket_edges(calm, above[1:] if len(set(above)) == 1 else ())
        found = edges if found is None else found.unionByName(edges)
        if not crowds:
            return found
        rows = _rekey(rows.join(crowded.hint("merge"), "path", "left_semi"), widths)
    return found.unionByName(_bucket_edges(rows, ()))


def _grouped(prints: DataFrame, node: str, edges: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """prints (doc_id, text_hash, node and more, the same for rows of one node) with root, component_id and group_size.

    edges gives the edges (a, b) between the nodes, which come with the columns of prints, and with first_id and first_hash of a row of each.
    """
    prints = checkpoint(prints)
    more = [F.first(c).alias(c) for c in prints.columns if c not in ("doc_id", "text_hash", node)]
    first_hash = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("first_hash")
    nodes = checkpoint(prints.groupBy(node).agg(F.min("doc_id").alias("first_id"), first_hash, F.count("*").alias("n"), *more))
    total = prints.count()
    roots = components(edges(nodes))
    joined = nodes.select(node, "n", "first_id").join(roots.withColumnRenamed("node", node).hint("merge"), node, "left")
    named = checkpoint(joined.withColumn("root", F.coalesce("root", node)))
    groups = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("group_size"), F.count("*").alias("n_nodes"))
    sized = lookup(named, groups, "root", "n_nodes", max(1, named.count()))
    return lookup(prints.select("doc_id", "text_hash", node), sized, node, "n", total).select("doc_id", "text_hash", node, "root", "component_id", "group_size")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, fp, root (names the component), component_id and group_size."""
    return _grouped(fingerprints(docs), "fp", links)


def similar_documents(docs: DataFrame, shingle: int = WORDS_A_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: doc_id, text_hash, node (names the set of shingles), root, component_id and group_size.

    Documents are linked if their sets of shingles have at least `similarity` of their union in common.
    """
    return _grouped(rings(docs, shingle), "node", lambda nodes: _similar(docs, nodes, shingle, similarity))


def _keep(docs: DataFrame, found: DataFrame) -> DataFrame:
    found = checkpoint(found)
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("best")
    keepers = rows.groupBy("root").agg(best).select(F.col("best.doc_id").alias("keep_id"), F.col("best.text_hash").alias("keep_hash"), F.col("best.n").alias("keep_rows"))
    return keep_rows(docs, keepers)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component of fingerprints the row with the smallest doc_id."""
    return _keep(docs, near_duplicates(docs))


def deduplicate_similar(docs: DataFrame, shingle: int = WORDS_A_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each component of similar texts the row with the smallest doc_id."""
    return _keep(docs, similar_documents(docs, shingle, similarity))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; none if it has no words."""
    parts = list(_hashes(text, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _ones(x: np.ndarray) -> np.ndarray:
    """How often each bit is set in the 64-bit values x: byte lanes add up to 255 values at once."""
    cuts = np.arange(0, len(x), 255)
    counts = np.empty((8, 8), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat(x >> np.uint64(shift) & np.uint64(0x0101010101010101), cuts)
        counts[:, shift] = lanes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return counts.ravel()


def ring(hashes: np.ndarray) -> np.ndarray:
    """The 8 words of the fingerprint of a set of hashes: a bit is 1 if set in over half of the hashes, mixed anew for each word."""
    words = np.zeros(RING, np.uint64)
    for at in range(RING) if len(hashes) else ():
        salt = np.uint64((at + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        ones = sum(_ones(_mixed(hashes[i : i + _HASHES] + salt)) for i in range(0, len(hashes), _HASHES))
        words[at] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]
    return words


RING_COLUMNS = [f"w{k}" for k in range(RING)]


def rings(docs: DataFrame, shingle: int = WORDS_A_SHINGLE) -> DataFrame:
    """doc_id, text_hash, node (a hash of the set of shingles), n_shingles and the words of the ring as signed integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), xxhash.xxh64_intdigest(s.tobytes()), ring(s)) for s in (shingle_set(t.as_py(), shingle) for t in batch.column(2))]
            words = np.array([w for _, _, w in sets], np.uint64).reshape(-1, RING).view(np.int64)
            node = pa.array(np.array([h for _, h, _ in sets], np.uint64).view(np.int64))
            columns = [batch.column(0), batch.column(1), node, pa.array([n for n, _, _ in sets], pa.int32()), *map(pa.array, np.ascontiguousarray(words.T))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "node", "n_shingles", *RING_COLUMNS])

    schema = "doc_id bigint, text_hash bigint, node bigint, n_shingles int, " + ", ".join(f"{c} bigint" for c in RING_COLUMNS)
    return docs.select(docs["doc_id"].cast("bigint"), text_hash().alias("text_hash"), docs["text"]).mapInArrow(rows, schema)


def _segment(k: int) -> Column:
    """The k-th segment of the ring."""
    return F.shiftright(RING_COLUMNS[k // 4], 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))


def _close(words: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) of rows of words: which keep to every chain's budget from their word `start`, and their distances."""
    ok, total = np.arange(len(a)), np.zeros(len(a), np.int64)
    for length in range(1, RING + 1):
        at = (start[ok] + length - 1) % RING
        total = total + np.bitwise_count(words[a[ok], at] ^ words[b[ok], at])
        if length in CHAINS:
            near = total <= length * BUDGET
            ok, total = ok[near], total[near]
    return ok, total


def _least_forest(n: int, a: np.ndarray, b: np.ndarray, distance: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the pairs that prefers small distances, as a, b, and the new labels. labels: as in _link."""
    from_a, from_b = [], []
    for low, high in zip((-1, *LAYERS), LAYERS):
        layer = np.flatnonzero((distance > low) & (distance <= high))
        p, q = a[layer], b[layer]
        while len(p):
            la, lb = labels[p], labels[q]
            apart = la != lb
            p, q, la, lb = p[apart], q[apart], la[apart], lb[apart]
            if not len(p):
                break
            upper, lower = np.maximum(la, lb), np.minimum(la, lb)
            # Each root that isn't the least of its own hangs itself under another once in a round.
            order = np.lexsort((lower, upper))
            chosen = order[np.concatenate(([True], upper[order][1:] != upper[order][:-1]))]
            from_a.append(p[chosen])
            from_b.append(q[chosen])
            labels[upper[chosen]] = lower[chosen]
            while (labels[labels] != labels).any():
                labels = labels[labels]
    empty = np.empty(0, np.int64)
    return np.concatenate((empty, *from_a)), np.concatenate((empty, *from_b)), labels


def _near_pairs(key: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key: edges between rows of one key that are within the budgets, a spanning forest for each key."""
    n = len(key)
    start = (key >> 18) % RING  # word of the segment that made the bucket
    labels = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [n])))
    own = np.repeat(size, size)
    small = np.flatnonzero((own > 1) & (own <= SMALL))
    found = [(np.empty(0, np.int64),) * 3]
    for step in range(1, SMALL):
        small = small[small + step < n]
        small = small[key[small] == key[small + step]]
        if not len(small):
            break
        ok, distance = _close(words, small, small + step, start[small])
        found.append((small[ok], small[ok] + step, distance))
    a, b, distance = (np.concatenate(c) for c in zip(*found))
    a, b, labels = _least_forest(n, a, b, distance, labels)
    out_a, out_b = [a], [b]
    for k in np.flatnonzero(size > SMALL):
        begin, end = first[k], first[k] + size[k]
        word = words[begin:end, start[begin]]
        for low, high in zip((-1, *LAYERS), LAYERS):
            for i in range(begin, end, BLOCK):
                for j in range(i, end, BLOCK):
                    if (labels[i : min(i + BLOCK, end)] == labels[i]).all() and (labels[j : min(j + BLOCK, end)] == labels[i]).all():
                        continue  # all of them are connected already
                    x, y = word[i - begin : i - begin + BLOCK], word[j - begin : j - begin + BLOCK]
                    p, q = np.divmod(np.flatnonzero((np.bitwise_count(x[:, None] ^ y[None, :]) <= BUDGET).ravel()), len(y))
                    p, q = p + i, q + j
                    use = (p < q) & (labels[p] != labels[q])
                    p, q = p[use], q[use]
                    ok, distance = _close(words, p, q, start[p])
                    ok, distance = ok[distance <= high], distance[distance <= high]
                    a, b, labels = _least_forest(n, p[ok], q[ok], distance, labels)
                    out_a.append(a)
                    out_b.append(b)
    return np.concatenate(out_a), np.concatenate(out_b)


def _ring_edges(rows: DataFrame) -> DataFrame:
    """Edges of the buckets of rows (key, node and the ring). A bucket is held whole, in order of node, so its edges are the same every time."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * (RING + 2)
        for columns in (*([c.to_numpy() for c in b.columns] for b in batches), None):
            if columns is not None:
                kept = [np.concatenate((k, c)) for k, c in zip(kept, columns)]
            n = len(kept[0])
            cut = n if columns is None else int(np.searchsorted(kept[0], kept[0][-1])) if n else 0
            if cut < 1:
                continue
            key, node, *words = (k[:cut] for k in kept)
            kept = [k[cut:] for k in kept]
            a, b = _near_pairs(key, np.stack(words, 1).view(np.uint64))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    return rows.select("key", "node", *RING_COLUMNS).repartition("key").sortWithinPartitions("key", "node").mapInArrow(edges, "a bigint, b bigint")


def _cells(rows: DataFrame, similarity: float) -> DataFrame:
    """Rows of crowded buckets dealt to cells as their new key, so that every two of a bucket that can be linked share a cell of about 2 * SLICE rows.

    Sets of the similarity differ in size by at most its inverse, so by at most one in its logarithm. Rows of a bucket and class are dealt to slices
    by a hash of node; each slice meets all slices of its class and of the two beside it.
    """
    rows = rows.withColumn("class", F.floor(F.log("n_shingles") / max(-math.log(similarity), 1e-6) + 1e-9))
    counted = checkpoint(rows.groupBy("key", "class").agg(F.count("*").alias("n"))).withColumn("slices", F.ceil(F.col("n") / SLICE))
    beside = lambda step, name: counted.select("key", (F.col("class") - step).alias("class"), F.col("slices").alias(name))
    sizes = counted.join(beside(1, "above").hint("merge"), ["key", "class"], "left").join(beside(-1, "below").hint("merge"), ["key", "class"], "left")
    group = F.xxhash64("key", "class").alias("group")
    total = counted.agg(F.sum("n")).first()[0]
    dealt = lookup(rows.select("*", group), checkpoint(sizes.select(group, "n", "slices", "above", "below")), "group", "n", total)
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("node"), "slices"))
    own = F.col("slice")

    def each(n: str, cell: Callable[[Column], Column]) -> Column:
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1), cell)).otherwise(F.array().cast("array<bigint>"))

    within = each("slices", lambda i: F.xxhash64("key", "class", F.lit(0), F.least(own, i), F.greatest(own, i)))
    above = each("above", lambda i: F.xxhash64("key", "class", F.lit(1), own, i))
    below = each("below", lambda i: F.xxhash64("key", F.col("class") - 1, F.lit(1), i, own))
    # As in the keys of buckets, the word of the segment is in the bits from 18 on.
    word = F.lit(RING - 1 << 18).cast("bigint")
    return dealt.withColumn("cell", F.explode(F.concat(within, above, below))).withColumn(
        "key", F.col("cell").bitwiseAND(F.bitwise_not(word)).bitwiseOR(F.col("key").bitwiseAND(word))
    )


def _ring_pairs(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs (a, b) of nodes that pass all filters, enough to connect what all such pairs of a bucket connect."""
    # A key: the segment's number, and its value in the low bits.
    first = [F.lit(k << 16).cast("bigint").bitwiseOR(_segment(k)) for k in range(SEGMENTS)]
    rows = nodes.filter("n_shingles > 0").select("node", "n_shingles", *RING_COLUMNS)
    keyed = rows.withColumn("key", F.explode(F.array(*first)))
    crowded = checkpoint(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("key"))
    n = crowded.count()
    if not n:
        return _ring_edges(keyed).distinct()
    crowded = F.broadcast(crowded) if n <= BROADCAST_KEYS else crowded.hint("merge")
    calm = _ring_edges(keyed.join(crowded, "key", "left_anti"))
    return calm.unionByName(_ring_edges(_cells(keyed.join(crowded, "key", "left_semi"), similarity))).distinct()


def _similar(docs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs of nodes whose sets of shingles are alike enough, by the sets themselves."""
    pairs = checkpoint(_ring_pairs(nodes, similarity))
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("uses"))
    # A node of many pairs is given out in copies, each for a bounded number of them.
    copies = ends.withColumn("copies", F.ceil(F.col("uses") / PAIRS_A_COPY).cast("int"))
    wanted = nodes.join(copies.hint("merge"), "node").select("node", "copies", F.col("first_id").alias("id"), F.col("first_hash").alias("hash"))
    texts = docs.select(docs["doc_id"].cast("bigint").alias("id"), text_hash().alias("hash"), docs["text"].alias("text"))
    found = texts.join(wanted.hint("merge"), texts["id"].eqNullSafe(wanted["id"]) & (texts["hash"] == wanted["hash"])).select("node", "copies", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = [shingle_set(t.as_py(), shingle).astype("<u8").tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashed, pa.binary())], names=["node", "copies", "hashes"])

    # Rows that repeat give one node several times: any of them will do.
    held = materialize(found.mapInArrow(sets, "node bigint, copies int, hashes binary").dropDuplicates(["node"]), "shingles")
    given = held.select("node", "copies", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "hashes")
    of = lambda name: given.select(F.col("node").alias(name), F.col("copy").alias(f"copy_{name}"), F.col("hashes").alias(f"of_{name}"))
    number = held.select("node", "copies")
    placed = pairs.join(number.withColumnRenamed("node", "a").hint("merge"), "a").withColumn("copy_a", F.pmod(F.xxhash64("b"), "copies").cast("int")).drop("copies")
    placed = placed.join(number.withColumnRenamed("node", "b").hint("merge"), "b").withColumn("copy_b", F.pmod(F.xxhash64("a"), "copies").cast("int")).drop("copies")
    both = placed.join(of("a").hint("merge"), ["a", "copy_a"]).join(of("b").hint("merge"), ["b", "copy_b"]).select("a", "b", "of_a", "of_b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), "<u8") for c in (2, 3))
                least = similarity * max(len(x), len(y))
                if min(len(x), len(y)) >= least:
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[k] = common >= similarity * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(alike, "a bigint, b bigint")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", hexed, "component_id", "group_size")
