"""Near-duplicates by SimHash fingerprints, all pairs within the distance.

Equal fingerprints are one node throughout.

``links`` (64 bits, at most two bits apart) uses multi-index hashing: each half
has a table keyed by its value, and the ball of one bit about a fingerprint's
own value is looked up there. Matches are verified by the complete distance. Of
two values one bit apart, one has a 0 where the other has a 1; only that one
asks, so a ball costs half its size. A table entry with more than ``HOT``
fingerprints isn't expanded into pairs and is exact all the same: two words are
at most two bits apart exactly if some word is at most one bit from both, so
the fingerprints that touch a hot entry are grouped by the 65 words around
each; no such group can have more than 65.

``wide_links`` (more bits, larger distance) has a table for every segment of
``SEGMENT`` bits. Of two fingerprints within the distance some segment differs
in at most distance / segments bits (rounded down: 92 / 24 = 3), so the balls of
that radius about each segment meet every pair, whatever the number of rows. A
table is one task, or one for each bucket of its keys' first bits. A task holds
its bucket's entries; those of other buckets within the radius visit it in
batches. Keys are looked up in an array and candidates verified by the complete
distance. Rows that are connected already aren't compared. In larger inputs a
key with many entries names a leader; entries within the distance of one leader
are connected through it, so that they needn't visit each other, only the rest.
The other blocks of an oversized bucket visit each other. Nothing is left out.

Defined results: null text counts as empty; texts without words have fingerprint
zero, linked like any other; a null doc_id is no candidate for a component's
least; repeated rows are all returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazlens.llm import runs, scratch
from hazlens.llm.components import components

SEED = 42
HOT = 64
#: Bits of a segment of a wide fingerprint; three to a word.
SEGMENT = 21
#: Entries that one task holds (some 120 bytes each); those that visit its bucket pass by in batches.
TASK_ROWS = 1 << 21
#: Pairs compared at once, and rows held against the whole of two long runs first.
MOST_PAIRS, LEADERS = 1 << 18, 16


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of ``width`` words, in turn, and the offset of each text."""
    data, at = runs.flat(texts)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    begin, end, first = runs.words(data, at)
    size = end - begin
    count = first[1:] - first[:-1]
    # all words again, one space after each, so that a shingle is one slice
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[~runs.SPACE[data]]
    start = np.cumsum(size + 1) - size - 1
    stop = start + size
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(shingles)]).astype(np.int64)
    head = np.arange(ends[-1]) - np.repeat(ends[:-1] - first[:-1], shingles)
    tail = np.minimum(head + width, np.repeat(first[1:], shingles)) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    found = [digest(raw[a:b], SEED) for a, b in zip(start[head].tolist(), stop[tail].tolist())]
    return np.array(found, np.uint64), ends


def once_a_text(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once in its text, and the offset of each text."""
    owner = np.repeat(np.arange(len(ends) - 1), ends[1:] - ends[:-1])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], np.searchsorted(owner[first], np.arange(len(ends)))


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text the word of the bits set in over half of its hashes."""
    out = np.zeros(len(ends) - 1, np.uint64)
    some = np.flatnonzero(ends[1:] > ends[:-1])
    if not len(some):
        return out
    # bits as bytes, eight to a word; up to 255 rows can be added without a carry
    first, count = ends[:-1][some], (ends[1:] - ends[:-1])[some]
    blocks = -(-count // 255)
    block_at = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    sums = np.zeros((len(block_at), 64), np.uint8)
    for a in range(0, len(block_at), 2048):
        part = block_at[a : a + 2048]
        last = int(block_at[a + 2048]) if a + 2048 < len(block_at) else len(hashes)
        bits = np.unpackbits(hashes[part[0] : last].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        sums[a : a + len(part)] = np.add.reduceat(bits, part - part[0], axis=0).view(np.uint8).reshape(len(part), 64)
    total = np.add.reduceat(sums.astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    out[some] = np.packbits(2 * total > count[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """A further 64 bits of each hash, by the finalizer of a splitting generator."""
    # The constants of that generator (SplitMix64).
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _fingerprints(width: int, words: int, once: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs.pieces(batches, limit=2 << 20):
            hashes, ends = shingle_hashes(batch.column("text"), width)
            if once:
                hashes, ends = once_a_text(hashes, ends)
            prints = [majority(mixed(hashes, k) if k else hashes, ends).view(np.int64) for k in range(words)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), *map(pa.array, prints)], [*(c for c in batch.schema.names if c != "text"), *(f"f{k}" for k in range(words))])

    return work


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, once: bool = False) -> DataFrame:
    """The columns of ``docs`` but text, and f0, f1, ...: 64 bits of the fingerprint each. once: a repeated shingle counts once."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return runs.mapped(docs, _fingerprints(width, words, once), ", ".join([kept, *(f"f{k} long" for k in range(words))]))


def _touching(table: DataFrame, probes: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries that aren't hot, and the probes into hot entries."""
    return table.join(hot, ["segment", "key"], "left_anti"), probes.join(hot, ["segment", "key"], "left_semi")


def _hot(table: DataFrame, limit: int) -> DataFrame:
    return scratch.written(table.groupBy("segment", "key").agg(F.count("*").alias("entries")).where(F.col("entries") > limit), "hot")


def links(prints: DataFrame, hot_limit: int = HOT) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints (column f0) at most two bits apart, or enough to connect them."""
    high, low = F.shiftrightunsigned("f0", 32), F.col("f0").bitwiseAND(F.lit(0xFFFFFFFF))
    one = lambda segment, key: prints.select(F.lit(segment).alias("segment"), key.alias("key"), "f0")
    # two bits apart: both or one in the low half (then at most one in the high half), or none there
    table = scratch.written(one(0, high).unionByName(one(1, low)), "simhash-table")
    flips = F.array(*(F.lit(1 << k) for k in range(32)))
    ball = prints.select(F.lit(0).alias("segment"), F.explode(F.filter(flips, lambda m: high.bitwiseAND(m) == 0)).alias("flip"), "f0").select("segment", high.bitwiseOR(F.col("flip")).alias("key"), "f0")
    probes = table.unionByName(ball)
    hot = _hot(table, hot_limit)
    cold, touching = _touching(table, probes, hot.select("segment", "key"))
    pairs = probes.join(cold.withColumnRenamed("f0", "other"), ["segment", "key"]).where((F.col("f0") != F.col("other")) & (F.bit_count(F.col("f0").bitwiseXOR(F.col("other"))) <= 2))
    around = F.concat(F.array(F.col("f0")), *(F.array(F.col("f0").bitwiseXOR(F.lit(-(1 << 63) if k == 63 else 1 << k))) for k in range(64)))
    # at most 65 fingerprints are within one bit of a word, so the set is bounded
    # a hot entry is met by its own members and by what is one bit off, both of which are in ``touching``
    stars = touching.select("f0").distinct().select("f0", F.explode(around).alias("word")).groupBy("word").agg(F.collect_set("f0").alias("near")).where(F.size("near") > 1)
    star_edges = stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
    return pairs.select(F.least("f0", "other").alias("a"), F.greatest("f0", "other").alias("b")).unionByName(star_edges).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, hot_limit: int = HOT) -> DataFrame:
    """doc_id, fingerprint and component_id of every row: links are 64-bit fingerprints at most two bits apart."""
    of_doc = scratch.written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width), "fingerprints")
    prints = scratch.written(of_doc.groupBy("f0").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints.select("f0"), hot_limit))
    return with_component(of_doc, prints, roots, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(prints: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``prints`` with root, which is the node itself where no edge meets it."""
    return prints.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))


def with_component(of_doc: DataFrame, prints: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``of_doc`` with component_id, the least doc_id of its component. prints: (key, least); roots: (node, root)."""
    own = scratch.written(_rooted(prints, roots, key), "own-roots")
    least = scratch.written(own.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = scratch.written(own.join(least, "root").select(key, "component_id"), "named")
    return of_doc.join(named, key)


# ---- wide fingerprints ----------------------------------------------------


def _masks(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` set, those with fewer first."""
    return np.array([sum(1 << k for k in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)], np.int64)


class _Side:
    """Rows of one block in order of their keys, with the run of each key."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        self.rows = rows[order]
        self.keys, self.first, self.size = np.unique(keys[order], return_index=True, return_counts=True)
        self.many, self.one = self.size > 1, self.rows[self.first]

    def table(self) -> np.ndarray:
        """The run of every possible key, -1 where there is none."""
        out = np.full(1 << SEGMENT, -1, np.int32)
        out[self.keys] = np.arange(len(self.keys), dtype=np.int32)
        return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits of each row differ. Overwrites a."""
    count = np.bitwise_count(np.bitwise_xor(a, b, out=a))
    out = count[:, 0].astype(np.uint16)
    for k in range(1, count.shape[1]):
        out += count[:, k]
    return out


class _Tile:
    """The matches of one table of the index, as a partition of its rows into connected ones.

    Rows that are connected already aren't compared, which keeps exact what would
    be the square of a large group of near copies.
    """

    def __init__(self, bits: np.ndarray, label: np.ndarray, distance: int) -> None:
        # a row's words lie together, and the half that is looked at first by itself
        self.bits, self.front = bits, np.ascontiguousarray(bits[:, : bits.shape[1] // 2])
        self.label, self.distance, self.changed = label, distance, True

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows are within the distance, judged on half of the words first."""
        found = np.flatnonzero(_apart(self.front.take(a, axis=0), self.front.take(b, axis=0)) <= self.distance)
        return found[_apart(self.bits.take(a[found], axis=0), self.bits.take(b[found], axis=0)) <= self.distance] if len(found) else found

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Rows a[k] and b[k] are connected."""
        pairs = np.unique(np.stack([self.label[a], self.label[b]], 1), axis=0)
        of: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := of.get(x, x)) != x:
                of[x] = of.get(up, up)
                x = up
            return x

        for x, y in pairs.tolist():
            x, y = root(x), root(y)
            if x != y:
                of[max(x, y)] = min(x, y)
        if of:
            to = np.arange(len(self.label))
            to[list(of)] = [root(x) for x in of]
            self.label, self.changed = to[self.label], True

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.label.take(a) != self.label.take(b)
        if not apart.all():
            a, b = a[apart], b[apart]
        if len(a):
            found = self.near(a, b)
            if len(found):
                self.join(a[found], b[found])

    def runs(self, one: _Side, i: np.ndarray, two: _Side, j: np.ndarray) -> None:
        """Compare the rows of runs i[k] of ``one`` with those of runs j[k] of ``two``."""
        # the first rows of all runs, then the other pairs of the long ones
        for at in range(0, len(i), MOST_PAIRS):
            self.compare(one.one.take(i[at : at + MOST_PAIRS]), two.one.take(j[at : at + MOST_PAIRS]))
        many = np.flatnonzero(one.many.take(i) | two.many.take(j))
        if not len(many):
            return
        i, j = i[many], j[many]
        product = one.size[i] * two.size[j]
        for k in np.flatnonzero(product > MOST_PAIRS).tolist():
            self.large(one.rows[one.first[i[k]] : one.first[i[k]] + one.size[i[k]]], two.rows[two.first[j[k]] : two.first[j[k]] + two.size[j[k]]])
        few = product <= MOST_PAIRS
        i, j, product = i[few], j[few], product[few]
        ends = np.cumsum(product)
        at = 0
        while at < len(i):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, "right")))
            n = product[at:stop]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(two.size[j[at:stop]], n)
            self.compare(one.rows[np.repeat(one.first[i[at:stop]], n) + place // width], two.rows[np.repeat(two.first[j[at:stop]], n) + place % width])
            at = stop

    def large(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of two long runs: a few rows are held against all first, then what they leave apart is compared."""
        both = np.unique(np.concatenate([a, b]))
        led: set[int] = set()
        for _ in range(LEADERS):
            left = both[~np.isin(self.label[both], list(led))]
            if not len(left):
                break
            self.compare(np.full(len(both), left[0]), both)
            led.add(int(self.label[left[0]]))
        for g in np.unique(self.label[a]).tolist():
            own = a[self.label[a] == g]
            others = b[self.label[b] != g]
            step = max(1, MOST_PAIRS // max(len(others), 1))
            for k in range(0, len(own) if len(others) else 0, step):
                part = own[k : k + step]
                self.compare(np.repeat(part, len(others)), np.tile(others, len(part)))

    def uniform(self, side: _Side) -> np.ndarray:
        """The label that all rows of a run have, -1 where they differ."""
        labels = self.label[side.rows]
        low, high = np.minimum.reduceat(labels, side.first), np.maximum.reduceat(labels, side.first)
        return np.where(low == high, low, -1)

    def probe(self, one: _Side, two: _Side, table: np.ndarray, masks: np.ndarray, upward: bool) -> None:
        """Look the ball about each key of ``one`` up in the ``table`` of ``two``; ``upward``: only larger keys, and each run in itself."""
        for turn, mask in enumerate(masks.tolist()):
            if not turn or (turn % 16 == 0 and self.changed):  # labels only merge, so older ones never skip too much
                mine, theirs, self.changed = self.uniform(one), self.uniform(two), False
            sought = one.keys ^ mask
            j = table.take(sought)
            i = np.flatnonzero((j >= 0) & (sought >= one.keys) if upward else j >= 0)
            j = j.take(i)
            label = mine.take(i)
            open_ = (label != theirs.take(j)) | (label < 0)
            if open_.all():
                self.runs(one, i, two, j)
            elif open_.any():
                self.runs(one, i[open_], two, j[open_])


class _Home(_Tile):
    """The rows of one block of a table, held in memory, which visiting rows are compared with as they come."""

    def __init__(self, rows: list[dict[str, np.ndarray]], words: int, distance: int, masks: np.ndarray, low: int) -> None:
        # in order of keys, so that the rows about a key and about its ball lie together in memory
        key = np.concatenate([r["key"] for r in rows])
        order = np.argsort(key, kind="stable")
        take = lambda name: np.concatenate([r[name] for r in rows])[order]
        self.node, lead, key = take("node"), take("lead"), key[order]
        # rows of one leader are connected from the start; 0 is none
        label = np.arange(len(key))
        led = np.flatnonzero(lead != 0)
        _, first, of = np.unique(lead[led], return_index=True, return_inverse=True)
        label[led] = led[first][of]
        super().__init__(np.stack([take(f"f{k}").view(np.uint64) for k in range(words)], 1), label, distance)
        self.words, self.low, self.bucket = words, low, int(key[0]) >> low
        self.inner, self.outer = masks[masks >> low == 0], masks[masks >> low != 0]
        self.side = _Side(np.arange(len(key)), key)
        self.known = self.side.table()
        self.probe(self.side, self.side, self.known, self.inner, True)

    def visited(self, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Edges (visiting node, node here)."""
        own, n = len(self.node), len(rows["node"])
        home = self.bits, self.front, self.label
        bits = np.stack([rows[f"f{k}"].view(np.uint64) for k in range(self.words)], 1)
        self.bits, self.front = _Grown(home[0], bits), _Grown(home[1], bits[:, : bits.shape[1] // 2])
        self.label, self.changed = np.concatenate([home[2], np.arange(own, own + n)]), True
        same = rows["key"] >> self.low == self.bucket
        for on, masks in ((same, self.inner), (~same, self.outer)):
            if on.any():
                self.probe(_Side(own + np.flatnonzero(on), rows["key"][on]), self.side, self.known, masks, False)
        met = np.flatnonzero(self.label[own:] < own)
        edges = rows["node"][met], self.node[self.label[own + met]]
        # visitors that met here connected what they met
        self.bits, self.front, self.label, self.changed = home[0], home[1], self.label[:own].copy(), True
        return edges

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.node[moved], self.node[self.label[moved]]


class _Grown:
    """The rows of two arrays as one, without copying the first."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second, self.shape = first, second, first.shape

    def take(self, at: np.ndarray, axis: int = 0) -> np.ndarray:
        n = len(self.first)
        if not len(at) or at.min() >= n:
            return self.second.take(at - n, axis=axis)
        if at.max() < n:
            return self.first.take(at, axis=axis)
        out = np.empty((len(at), self.shape[1]), self.first.dtype)
        here = at < n
        out[here], out[~here] = self.first.take(at[here], axis=axis), self.second.take(at[~here] - n, axis=axis)
        return out


def _matched(words: int, distance: int, radius: int, low: int):
    """Edges of the tables' blocks; rows come in order of (segment, bucket, x), those of the block before its visitors."""
    masks = _masks(SEGMENT, radius)
    columns = ("key", "node", "lead", *(f"f{k}" for k in range(words)))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        home, at = None, None

        def settled() -> _Home | None:
            nonlocal held
            made = _Home(held, words, distance, masks, low) if held else None
            held = []
            return made

        for batch in batches:
            if not len(batch):
                continue
            rows = {c: batch.column(c).to_numpy() for c in ("segment", "bucket", "x", "role", *columns)}
            where = np.stack([rows["segment"], rows["bucket"], rows["x"], rows["role"]])
            cuts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                block, role = tuple(where[:3, begin].tolist()), int(where[3, begin])
                if block != at:
                    home = home or settled()
                    if home is not None:
                        yield out(*home.edges())
                    home, at = None, block
                part = {c: rows[c][begin:end] for c in columns}
                if role == 0:
                    held.append(part)
                else:
                    home = home or settled()
                    if home is not None:
                        yield out(*home.visited(part))
        home = home or settled()
        if home is not None:
            yield out(*home.edges())

    return work


def _entries(prints: DataFrame, words: int) -> DataFrame:
    """The index: (segment, key) of each segment of each fingerprint."""
    each = 64 // SEGMENT
    keys = [F.struct(F.lit(w * each + k).alias("segment"), F.shiftrightunsigned(f"f{w}", k * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1)).alias("key")) for w in range(words) for k in range(each)]
    fs = [f"f{k}" for k in range(words)]
    return prints.select("node", *fs, F.explode(F.array(*keys)).alias("e")).select("node", *fs, "e.segment", "e.key")


def _visits(entries: DataFrame, bits: int, radius: int) -> DataFrame:
    """Each entry in the bucket of its key's first ``bits`` bits, and in those that its ball reaches; of two
    buckets in reach of each other, a hash says which one's entries visit the other."""
    own = F.shiftrightunsigned("key", SEGMENT - bits)
    masks = [int(m) for m in _masks(bits, min(radius, bits)) if m]
    if not masks:
        return entries.withColumn("bucket", own)
    lowest = lambda m: m.bitwiseAND(-m)
    goes = lambda m: (own.bitwiseAND(lowest(m)) != 0) == (F.xxhash64(own.bitwiseAND(F.bitwise_not(m)), m).bitwiseAND(F.lit(1)) == 0)
    reached = F.transform(F.filter(F.array(*map(F.lit, masks)).cast("array<long>"), goes), lambda m: own.bitwiseXOR(m))
    return entries.withColumn("bucket", F.explode(F.concat(F.array(own), reached)))


def _leaders(entries: DataFrame, words: int, distance: int, many: int) -> DataFrame:
    """(node, lead): one fingerprint of each key with over ``many`` entries, for those of that key within the distance."""
    fs = [f"f{k}" for k in range(words)]
    first = entries.groupBy("segment", "key").agg(F.count("*").alias("n"), F.min(F.struct("node", *fs)).alias("l")).where(F.col("n") > many)
    first = scratch.written(first.select("segment", "key", "l"), "leaders")
    apart = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"l.{f}"))) for f in fs), F.lit(0))
    met = entries.join(first, ["segment", "key"]).where(apart <= distance)
    return scratch.written(met.groupBy("node").agg(F.min("l.node").alias("lead")), "led")


def wide_links(prints: DataFrame, words: int, distance: int, rows: int, task_rows: int = TASK_ROWS, radius: int | None = None) -> DataFrame:
    """Edges (a, b), enough to connect all nodes at most ``distance`` bits apart. prints: node, f0, f1, ...

    ``rows`` only decides on how the work is cut: into buckets of about ``task_rows`` entries.
    radius: of the balls; a smaller one than by default is cheaper and misses some pairs.
    """
    segments = words * (64 // SEGMENT)
    radius = distance // segments if radius is None else radius
    bits = min(SEGMENT, max(0, (max(rows, 1) - 1) // task_rows).bit_length())
    fs = [f"f{k}" for k in range(words)]
    table = ["segment", "bucket"]
    cells = [*table, "x", "role", "key", "node", "lead", *fs]
    entries = _entries(prints, words)
    if not bits:
        visits = _visits(entries, 0, radius).withColumns({"x": F.lit(0).cast("long"), "role": F.lit(0), "lead": F.lit(0).cast("long")})
        return _edges(visits.select(*cells), words, distance, radius, 4 * segments, SEGMENT)
    led = _leaders(entries, words, distance, max(1, task_rows // 4))
    visits = scratch.written(_visits(entries, bits, radius).join(led, "node", "left").withColumn("lead", F.coalesce("lead", F.lit(0).cast("long"))), "visits")
    own = F.shiftrightunsigned("key", SEGMENT - bits) == F.col("bucket")
    # a leader's rows in a table are a class of their own if they are many; the other rows are class 0
    sizes = visits.where(own).groupBy(*table, "lead").agg(F.count("*").alias("n")).withColumn("class", F.when(F.col("n") > task_rows // 4, F.col("lead")).otherwise(F.lit(0).cast("long")))
    sizes = scratch.written(sizes, "classes")
    blocks = sizes.groupBy(*table, "class").agg(F.ceil(F.sum("n") / (2 * task_rows)).cast("int").alias("blocks"))
    sets = scratch.written(blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("x", F.xxhash64("class", "block")), "blocks")
    # rows of one leader are connected, so they don't meet
    apart = lambda a, b: (F.col(a) == 0) | (F.col(a) != F.col(b))
    classed = visits.where(own).join(sizes.select(*table, "lead", "class"), [*table, "lead"]).join(blocks, [*table, "class"])
    home = scratch.written(classed.withColumn("own", F.xxhash64("class", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))).select(*table, "own", "key", "node", "lead", *fs), "home")
    # blocks of one table visit each other once, and rows of other tables visit every block
    one, two = sets.select(*table, F.col("class").alias("class_x"), "x"), sets.select(*table, F.col("class").alias("class_y"), F.col("x").alias("own"))
    pairs = one.join(two, table).where((F.col("x") < F.col("own")) & apart("class_x", "class_y")).select(*table, "x", "own")
    dealt = home.withColumns({"x": F.col("own"), "role": F.lit(0)}).select(*cells)
    dealt = dealt.unionByName(home.join(pairs, [*table, "own"]).withColumn("role", F.lit(1)).select(*cells))
    dealt = dealt.unionByName(visits.where(~own).join(one, table).where(apart("class_x", "lead")).withColumn("role", F.lit(1)).select(*cells))
    found = _edges(dealt, words, distance, radius, 2 * segments << bits, SEGMENT - bits)
    return found.unionByName(led.select(F.col("node").alias("a"), F.col("lead").alias("b"))).where("a <> b").distinct()


def _edges(dealt: DataFrame, words: int, distance: int, radius: int, parts: int, low: int) -> DataFrame:
    """The matches of every block, each block in one task."""
    block = ["segment", "bucket", "x"]
    sorted_rows = dealt.repartition(parts, *block).sortWithinPartitions(*block, "role")
    return runs.mapped(sorted_rows, _matched(words, distance, radius, low), "a long, b long").where("a <> b").distinct()


def keep_one(docs: DataFrame, width: int = 5, words: int = 8, distance: int = 92, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the least doc_id, of equal rows one.

    The distance stands for a similarity of shingle sets: at a share p of differing
    bits cos(pi p) = 2 J / (1 + J). Of 512 bits, 77 are expected to differ at J = 0.8
    with a deviation of 8, so 92 bits take 96 % of such pairs, and 0.3 % at J = 0.6.
    What fingerprints join is then held to the sets themselves: only links of ``least`` or
    more count.
    """
    from hazlens.llm import verified  # which uses this module

    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    of_doc = fingerprints(rows, width, words, once=True).withColumn("node", F.xxhash64(*(f"f{k}" for k in range(words))))
    of_doc = scratch.written(of_doc, "fingerprints")
    prints = scratch.written(of_doc.groupBy("node").agg(*(F.first(f"f{k}").alias(f"f{k}") for k in range(words))), "prints")
    roots = components(wide_links(prints, words, distance, prints.count()))
    rooted = scratch.written(_rooted(prints.select("node"), roots, "node"), "rooted")
    # of a text its rows' least order: of equal doc_ids with different texts the least text hash stays
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("sha").alias("sha"))
    texts = of_doc.groupBy("sha").agg(F.first("node").alias("node"), F.min(order).alias("s"))
    texts = scratch.written(texts.join(rooted, "node").select("sha", "root", "s"), "rooted-texts")
    place = verified.places(rows.select("sha", F.col("doc_id").alias("id"), "text"), texts.select("sha", F.col("s.id").alias("id"), "root"), width, least)
    stay = texts.join(place, "sha", "left").groupBy(F.coalesce("place", "sha").alias("place")).agg(F.min("s").alias("s"))
    # one key for the join and for equal rows, so that texts are exchanged once
    key = lambda id_, sha: F.concat(F.coalesce(id_.cast("long").cast("string"), F.lit("null")), F.lit(":"), sha)
    stay = scratch.written(stay.select(key(F.col("s.id"), F.col("s.sha")).alias("__key")), "stay")
    kept = docs.withColumn("__key", key(F.col("doc_id"), F.sha2(text, 256))).join(stay, "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).select(*names)
