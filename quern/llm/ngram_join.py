"""Exact n-gram Jaccard join of documents with signature trees.

Documents with one set of shingles form a class. Prefix filtering deals classes
into groups: two sets that are similar enough share one of their first shingles
in a common order (by hash, shingles found to be frequent last). In a group, a
signature tree holds in each node the OR of its sets' token bitmaps and the
range of their sizes. The tree is traversed against itself; a pair of nodes is
left out if no two sets below can overlap enough. What is left is compared
exactly, and the links are joined into components.

Groups are joined into spanning trees, not expanded into pairs: each group gives
a spanning forest of the pairs that its tree lets pass. What these forests
connect is a block; every link of a group lies inside of one. Each set of a
block is brought there once, and a second traversal compares exactly.

No task gets an unbounded group. A first shingle of very many sets is wide: it
is cut into parts, and so is a large block. Parts are joined first; then
representatives of what hangs together in different parts meet, again and
again, so that a family of near copies becomes one component in a few rounds.
In the end, only sets outside of their group's main component meet all parts of
the group, in cells of two parts each: by bitmaps first, exactly then.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import bound_batches, own_name, stored
from quern.operators.graphs import component_roots

WORDS = 5
#: Similarity as a fraction of whole numbers.
LIKE = (3, 4)
#: Documents in which frequent shingles are looked for, at most; shingles in a share of at least HOT_SHARE of them, and in
#: at least HOT_LEAST, come last in the order, at most MAX_HOT of them. Any choice gives the same links.
HOT_DOCS, HOT_SHARE, HOT_LEAST, MAX_HOT = 4_000, 0.002, 8, 200_000
#: Documents in whose prefixes frequent shingles are looked for, at most, and in how many of them a shingle is frequent.
QUOTED_DOCS, QUOTED_LEAST = 65_536, 4
#: Bits of a bitmap for each shingle, about.
BITS = 4
LEAF, FAN = 64, 8
#: Bits of the matrix of sets by shared shingles that a group may take; larger groups are compared set by set.
MAX_MATRIX = 1 << 31
#: Identifiers that are broadcast, at most.
MAX_BROADCAST = 500_000
#: Sets of a part of a wide shingle or large block, and shingles of its sets, about.
PART_SETS, PART_SHINGLES = 1024, 1 << 22
#: Share of the rows in which wide shingles are looked for.
WIDE_SHARE = 1 / 16
#: Lists of each set in which its smaller lists are looked for.
HOMES = 4
_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_BLANK = re.compile(rb"[ \t-\r]")
#: Bytes of a text whose words are held at once, about.
PIECE = 1 << 18
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words in their order. The words of a long text exist as objects piece by piece only; pieces end at blanks."""
    out, start = [np.zeros(0, np.uint64)], 0
    while start < len(text):
        blank = _BLANK.search(text, start + PIECE)
        end = blank.start() if blank else len(text)
        found = text[start:end].split()
        out.append(np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)))
        start = end
    return np.concatenate(out)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of a shorter text, of the whole sequence; of none, nothing.

    A-Z count as a-z; words are parted by blanks and \\t to \\r.
    """
    h = _word_hashes(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else np.zeros(0, np.uint64)
    if not len(h):
        return h
    width = min(words, len(h))
    mixed = h[: len(h) - width + 1] + np.uint64(width)
    for k in range(1, width):
        mixed = mixed * _M1
        mixed ^= mixed >> np.uint64(29)
        mixed += h[k : len(h) - width + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _M2
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def least_overlap(n: int, m: int) -> int:
    """The shared shingles that sets of these sizes need."""
    p, q = LIKE
    return ceil_div(p * (n + m), p + q)


def prefix(sorted_set: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles in the common order, and how many of them count where the set is the smaller one of a pair."""
    p, q = LIKE
    n = len(sorted_set)
    if len(hot) and n:
        at = np.minimum(np.searchsorted(hot, sorted_set), len(hot) - 1)
        is_hot = hot[at] == sorted_set
        sorted_set = np.concatenate([sorted_set[~is_hot], sorted_set[is_hot]])
    return sorted_set[: n - ceil_div(p * n, q) + 1], n - ceil_div(2 * p * n, p + q) + 1


def bitmap(some: np.ndarray) -> np.ndarray:
    """Bits (as bytes 0 and 1 packed) at the hashes modulo a power of two, so that bitmaps fold onto smaller ones."""
    width = 64
    while width < BITS * len(some):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(some & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    return bits if len(bits) == size else np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def most_overlap(n: int, a: np.ndarray, m: int, b: np.ndarray) -> int:
    """An upper bound of the overlap of two sets: each bit that one has alone stands for a shingle of its own at least."""
    size = min(len(a), len(b))
    a, b = fold(a, size), fold(b, size)
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


class Node:
    """Sets from ``low`` to before ``high`` in order of size."""

    __slots__ = ("bits", "children", "extra", "high", "largest", "low", "smallest")

    def __init__(self, low, high, smallest, largest, bits, extra, children):
        self.low, self.high, self.smallest, self.largest = low, high, smallest, largest
        self.bits, self.extra, self.children = bits, extra, children


def signature_tree(sizes: list[int], maps: list[np.ndarray]) -> Node:
    """The tree over sets sorted by size."""

    def combined(low, high, smallest, largest, bits, extra, children):
        size = min(map(len, bits))
        return Node(low, high, smallest, largest, np.bitwise_or.reduce([fold(b, size) for b in bits], axis=0), extra, children)

    level = []
    for low in range(0, len(sizes), LEAF):
        high = min(low + LEAF, len(sizes))
        size = min(len(m) for m in maps[low:high])
        # Shingles beyond the first of each bit, at the width that the node has.
        extra = max(sizes[i] - int(np.bitwise_count(fold(maps[i], size)).sum()) for i in range(low, high))
        level.append(combined(low, high, sizes[low], sizes[high - 1], maps[low:high], extra, ()))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), FAN):
            some = level[i : i + FAN]
            size = min(len(c.bits) for c in some)
            # Narrower bits hold more shingles each; the bound is safe if it's the largest set's all.
            extra = max(c.extra if len(c.bits) == size else c.largest for c in some)
            up.append(combined(some[0].low, some[-1].high, some[0].smallest, some[-1].largest, [c.bits for c in some], extra, tuple(some)))
        level = up
    return level[0]


def _may_overlap(a: Node, b: Node) -> bool:
    """Whether sets of two nodes, of which ``a`` has the smaller sizes, can be similar enough."""
    p, q = LIKE
    if a is b:
        return True
    if a.largest * q < b.smallest * p:
        return False
    size = min(len(a.bits), len(b.bits))
    shared = int(np.bitwise_count(fold(a.bits, size) & fold(b.bits, size)).sum())
    extra = min(n.extra if len(n.bits) == size else n.largest for n in (a, b))
    return min(shared + extra, a.largest) >= least_overlap(a.smallest, b.smallest)


class Union:
    def __init__(self, n: int):
        self.of = list(range(n))

    def root(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.of[max(x, y)] = min(x, y)
        return x != y


def _node_pairs(sizes: list[int], maps: list[np.ndarray], union: Union) -> Iterator[tuple[Node, Node]]:
    """Dual traversal: pairs of leaves that may have links between sets that don't hang together yet."""
    tree = signature_tree(sizes, maps)
    todo = [(tree, tree)]
    while todo:
        a, b = todo.pop()
        if not _may_overlap(a, b):
            continue
        root = union.root(a.low)
        if all(union.root(i) == root for n in ((a,) if a is b else (a, b)) for i in range(n.low, n.high)):
            continue
        if a.children or b.children:
            todo += [(x, y) for x in a.children or (a,) for y in b.children or (b,) if x.low <= y.low]
        else:
            yield a, b


def passing(n: np.ndarray, left: list[np.ndarray], m: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets with these sizes and bitmaps may be similar enough."""
    p, q = LIKE
    width = min(map(len, [*left, *right]))
    a = np.stack([fold(x, width) for x in left]).view(np.uint64)
    b = np.stack([fold(x, width) for x in right]).view(np.uint64)
    shared = np.stack([np.bitwise_count(row & b).sum(axis=1, dtype=np.int64) for row in a])
    # A bit that one set has alone stands for a shingle of its own at least.
    alone_n = np.bitwise_count(a).sum(axis=1, dtype=np.int64)[:, None] - shared
    alone_m = np.bitwise_count(b).sum(axis=1, dtype=np.int64)[None, :] - shared
    most = np.minimum(n[:, None] - alone_n, m[None, :] - alone_m)
    total = n[:, None] + m[None, :]
    return (most * (p + q) >= p * total) & (n[:, None] * q >= m[None, :] * p) & (m[None, :] * q >= n[:, None] * p)


def _passing(a: Node, b: Node, sizes: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """For two leaves, which pairs of sets the bitmaps and sizes let pass."""
    out = passing(sizes[a.low : a.high], maps[a.low : a.high], sizes[b.low : b.high], maps[b.low : b.high])
    return np.triu(out, 1) if a is b else out


def spanning_pairs(sizes: list[int], maps: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of places in the order of size: a spanning forest of the pairs that the tree lets pass."""
    union, out = Union(len(sizes)), []

    def try_pair(x: int, y: int) -> None:
        if union.root(x) != union.root(y):
            out.append((x, y))
            union.join(x, y)

    # Neighbours first: among many copies, they join what then needs no traversal.
    for x in range(len(sizes) - 1):
        if most_overlap(sizes[x], maps[x], sizes[x + 1], maps[x + 1]) >= least_overlap(sizes[x], sizes[x + 1]):
            try_pair(x, x + 1)
    n = np.array(sizes)
    for a, b in _node_pairs(sizes, maps, union):
        for x, y in np.argwhere(_passing(a, b, n, maps)).tolist():
            try_pair(a.low + x, b.low + y)
    return out


def exact_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets in order of size that join all that hang together."""
    p, q = LIKE
    sizes = [len(s) for s in sets]
    n = np.array(sizes)
    union = Union(len(sets))
    shared, count = np.unique(np.concatenate(sets), return_counts=True)
    shared = shared[count > 1]
    matrix = None
    if len(sets) * max(64, len(shared)) <= MAX_MATRIX:
        matrix = np.zeros((len(sets), -(-max(1, len(shared)) // 64) * 8), np.uint8)
        for i, s in enumerate(sets):
            at = np.searchsorted(shared, s)
            at = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == s)] if len(shared) else at[:0]
            bits = np.zeros(matrix.shape[1] * 8, np.uint8)
            bits[at] = 1
            matrix[i] = np.packbits(bits, bitorder="little")
        matrix = matrix.view(np.uint64)
    maps, out = [bitmap(s) for s in sets], []
    for a, b in _node_pairs(sizes, maps, union):
        some = _passing(a, b, n, maps)
        for x in np.flatnonzero(some.any(axis=1)).tolist():
            x_at, root = a.low + x, union.root(a.low + x)
            others = [b.low + y for y in np.flatnonzero(some[x]).tolist() if union.root(b.low + y) != root]
            if not others:
                continue
            if matrix is not None:
                overlap = np.bitwise_count(matrix[others] & matrix[x_at]).sum(axis=1, dtype=np.int64)
            else:
                overlap = np.array([len(np.intersect1d(sets[x_at], sets[y], assume_unique=True)) for y in others])
            for y in np.array(others)[overlap * (p + q) >= p * (n[x_at] + n[others])].tolist():
                if union.join(x_at, y):
                    out.append((x_at, y))
    return out


def hot_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles that are frequent in bounded samples of documents, sorted. They only order the shingles.

    First those frequent in a few documents; then, among the prefixes that this
    order gives in more documents, those of passages that are rarer, but would
    bring every document that quotes them into a list for each.
    """
    rows = max(1, docs.count())
    # The texts of a sample stay where they are; only counts of shingles move.
    first = _frequent(docs.select(text).sample(min(1.0, HOT_DOCS / rows), seed=3), None, max(HOT_LEAST, int(HOT_DOCS * HOT_SHARE)))
    return np.union1d(first, _frequent(docs.select(text).sample(min(1.0, QUOTED_DOCS / rows), seed=4), first, QUOTED_LEAST))


def _frequent(sample: DataFrame, hot: np.ndarray | None, least: int) -> np.ndarray:
    """Shingles of at least ``least`` texts, the most frequent ones; with ``hot``, those of the prefixes only."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shingles(t.as_py()) for t in batch.column(0)]
            got = [(s if hot is None else prefix(s, hot)[0]).view(np.int64) for s in got if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got) if got else np.zeros(0, np.int64))], ["shingle"])

    counted = sample.mapInArrow(keys, "shingle long").groupBy("shingle").count().where(F.col("count") >= least)
    rows = counted.orderBy(F.desc("count"), "shingle").limit(MAX_HOT).select("shingle").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """For rows (doc_id, text, mark): size and digest of the set, its bitmap, and its prefix with the number that counts for the smaller set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, maps, keys, small = [], [], [], [], []
            for t in batch.column(1):
                s = shingles(t.as_py())
                first, count = prefix(s, hot)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                maps.append(bitmap(s).tobytes() if len(s) else b"")
                keys.append(first.view(np.int64) if len(s) else np.zeros(0, np.int64))
                small.append(count if len(s) else 0)
            offsets = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=offsets[1:])
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(maps, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), flat),
                    pa.array(small, pa.int32()),
                ],
                ["doc_id", "mark", "n", "digest", "bits", "keys", "small"],
            )

    return docs.mapInArrow(run, "doc_id long, mark binary, n long, digest binary, bits binary, keys array<long>, small int")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by key: for each key, the classes that have partners of fitting size, as a list."""
    p, q = LIKE

    def lists(keys, ids, signed) -> list[np.ndarray]:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[starts, len(keys)])
        out = []
        for start, count in zip(starts[counts > 1].tolist(), counts[counts > 1].tolist()):
            s = signed[start : start + count]
            n = np.abs(s)
            order = np.argsort(n, kind="stable")
            n, small, who = n[order], s[order] > 0, ids[start : start + count][order]
            breaks = np.flatnonzero(n[:-1] * q < n[1:] * p) + 1
            for low, high in zip([0, *breaks.tolist()], [*breaks.tolist(), count]):
                if high - low > 1 and small[low:high].any():
                    # A set that only counts as the larger one needs a smaller or equal one before it.
                    first = low + int(small[low:high].argmax())
                    kept = who[np.searchsorted(n, n[first], side="left") : high] if first > low else who[low:high]
                    if len(kept) > 1:
                        out.append(np.sort(kept))
        return out

    rest = None
    for batch in batches:
        columns = [np.asarray(batch.column(i)) for i in range(3)]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns)]
        if not len(columns[0]):
            continue
        cut = int(np.flatnonzero(np.r_[True, columns[0][1:] != columns[0][:-1]])[-1])
        rest = [c[cut:] for c in columns]
        found = lists(*(c[:cut] for c in columns)) if cut else []
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], ["members"])
    if rest is not None:
        yield pa.RecordBatch.from_arrays([pa.array(lists(*rest), pa.list_(pa.int64()))], ["members"])


def _by_list(finish):
    """A function over batches sorted by their first column: ``finish`` gets each of its values and its rows, and yields rows of three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != name:
                    if held:
                        out += finish(name, held)
                    name, held = row[0], []
                held.append(row)
            yield made(out)
        if held:
            yield made(list(finish(name, held)))

    def made(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["list", "x", "y"])

    return run


def _span(name, rows):
    """Of members (list, n, x, bits): a spanning forest of the pairs that pass."""
    some = sorted((r[1], r[2], r[3]) for r in rows)
    for x, y in spanning_pairs([m[0] for m in some], [np.frombuffer(m[2], np.uint8) for m in some]):
        yield name, some[x][1], some[y][1]


def _finish(name, rows):
    """Of rows (block, x, set): the links that join all that hang together."""
    some = sorted(((np.frombuffer(s, np.uint64), x) for x, s in {r[1]: r[2] for r in rows}.items()), key=lambda r: (len(r[0]), r[1]))
    for x, y in exact_links([r[0] for r in some]):
        yield name, some[x][1], some[y][1]


def _crossing(rows, exact: bool) -> Iterator[tuple[int, int]]:
    """Of members (cell, side, x, component, n, bits or set) of a cell: pairs of the two sides in different components that pass."""
    p, q = LIKE
    sides = [sorted((r for r in rows if r[1] == k), key=lambda r: (r[4], r[2])) for k in (0, 1)]
    if not all(sides):
        return
    sets = [[np.frombuffer(r[5], np.uint64) for r in side] if exact else None for side in sides]
    maps = [[bitmap(s) for s in sets[k]] if exact else [np.frombuffer(r[5], np.uint8) for r in side] for k, side in enumerate(sides)]
    n, home = ([np.array([r[i] for r in side]) for side in sides] for i in (4, 3))
    for low in range(0, len(sides[0]), LEAF):
        for start in range(0, len(sides[1]), LEAF):
            a, b = slice(low, low + LEAF), slice(start, start + LEAF)
            if n[0][a][-1] * q < n[1][b][0] * p or n[1][b][-1] * q < n[0][a][0] * p:
                continue
            some = passing(n[0][a], maps[0][a], n[1][b], maps[1][b]) & (home[0][a][:, None] != home[1][b][None, :])
            for x, y in np.argwhere(some).tolist():
                x, y = x + low, y + start
                if exact:
                    shared = len(np.intersect1d(sets[0][x], sets[1][y], assume_unique=True))
                    if shared * (p + q) < p * int(n[0][x] + n[1][y]):
                        continue
                yield sides[0][x][2], sides[1][y][2]


def _flag(name, rows):
    """The members of a cell that have partners by their bitmaps."""
    yield from ((name, x, 0) for x in {x for pair in _crossing(rows, False) for x in pair})


def _link(name, rows):
    """The links of a cell that join what doesn't hang together yet."""
    rows = list({(r[1], r[2]): r for r in rows}.values())
    at = {r[2]: i for i, r in enumerate(rows)}
    union, first = Union(len(rows)), {}
    for r in rows:
        union.join(at[r[2]], first.setdefault(r[3], at[r[2]]))
    for x, y in _crossing(rows, True):
        if union.join(at[x], at[y]):
            yield name, x, y


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(x, set) of the classes in ``wanted`` (x, digest, least_id), from the texts of ``docs`` (doc_id, text).

    A task gives each set once, but different tasks may give the same one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = {}
            for t in batch.column(1):
                some = shingles(t.as_py()).tobytes()
                digest = xxhash.xxh3_128_digest(some)
                if digest not in seen:
                    seen.add(digest)
                    out[digest] = some
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.binary())], ["digest", "set"])

    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    some = docs.join(wanted, docs.doc_id.eqNullSafe(F.col("least_id")), "left_semi").select("doc_id", "text")
    return some.mapInArrow(run, "digest binary, set binary").join(wanted, "digest").select("x", "set")


def _by(df: DataFrame, finish, *order: str) -> DataFrame:
    """(list, x, y) that ``finish`` makes of the rows of each value of the first column, which one task gets."""
    by = df.columns[0]
    return df.repartition(by).sortWithinPartitions(by, *order).mapInArrow(_by_list(finish), "list long, x long, y long")


def _parts(n: str = "n") -> F.Column:
    """Parts of a group, by how many sets it has and their shingles."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / PART_SETS, F.sum(n) / PART_SHINGLES))


def _dealt(salt: int, *keys) -> F.Column:
    """The part of a member among ``parts``."""
    return F.pmod(F.xxhash64(F.lit(salt), *keys), F.col("parts"))


def _wide(sets: DataFrame) -> DataFrame:
    """(key, many) of the keys that more than PART_SETS rows of ``sets`` have.

    Only keys that are frequent in a share of the rows are counted, in all rows
    then: a key of PART_SETS rows is among them but for a chance of 1e-11, and
    one that isn't stays in a list of its own, at no loss of links.
    """
    some = sets.sample(WIDE_SHARE, seed=5).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("many"))
    some = stored(some.where(F.col("many") >= PART_SETS * WIDE_SHARE / 4).select("key"), "frequent")
    n = some.count()
    if n <= MAX_BROADCAST:
        counted = _keys_among(sets, np.sort(some.toArrow().column(0).to_numpy().astype(np.int64)))
    else:
        counted = sets.select(F.explode("keys").alias("key")).join(some, "key", "left_semi")
    counted = counted.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > PART_SETS)
    return stored(counted if n else counted.where("false"), "wide")


def _keys_among(sets: DataFrame, named: np.ndarray) -> DataFrame:
    """(key) of every row of ``sets`` and each of its keys that is among ``named``, which is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten(), np.int64)
            at = np.searchsorted(named, flat)
            yield pa.RecordBatch.from_arrays([pa.array(flat[named[np.minimum(at, len(named) - 1)] == flat] if len(named) else flat[:0])], ["key"])

    return sets.select("keys").mapInArrow(run, "key long")


def _outermost(lists: DataFrame) -> DataFrame:
    """(list, x) of the lists of ``lists`` (list, members) but for those all of whose members are in a larger list too.

    A larger list is looked for among the HOMES largest ones of each member; one
    that isn't found there costs work, not links.
    """
    members = lists.select("list", F.size("members").alias("n"), F.explode("members").alias("x"))
    # As many lists as a set has shingles, at most.
    of = members.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("n", "list")), asc=False).alias("of"))
    of = of.select(F.explode("of").alias("own"), F.slice("of", 1, HOMES).alias("homes"))
    pairs = of.select("own", F.explode(F.filter("homes", lambda h: h > F.col("own"))).alias("home"))
    inside = pairs.groupBy("own", "home").agg(F.count(F.lit(1)).alias("many")).where("many = own.n")
    inside = stored(inside.select("own.list").distinct(), "inside-lists")
    if inside.count() <= MAX_BROADCAST:
        inside = F.broadcast(inside)
    return lists.join(inside, "list", "left_anti").select("list", F.explode("members").alias("x"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


class _Join:
    """The join of one table: ``rows`` (doc_id, text) and the classes of its sets (digest, x, least_id, n, bits)."""

    def __init__(self, rows: DataFrame, classes: DataFrame, bits: DataFrame):
        self.rows, self.classes, self.bits = rows, classes, bits
        self.edges: list[DataFrame] = []

    def sets(self, some: DataFrame) -> DataFrame:
        """(x, set) of the classes named in ``some`` (x)."""
        return _sets_of(self.rows, stored(some.select("x").distinct().join(self.classes, "x").select("x", "digest", "least_id"), "wanted"))

    def compare(self, cells: DataFrame) -> None:
        """Find links in each cell of ``cells`` (cell, x)."""
        cells = stored(cells, "cells")
        found = _by(cells.join(self.sets(cells), "x").select("cell", "x", "set"), _finish)
        self.edges.append(stored(found.select("x", "y").distinct(), "edges"))

    def roots(self) -> DataFrame:
        return component_roots(_all(self.edges), "x", "y")

    def join_parts(self, spread: DataFrame) -> None:
        """Links that join what hangs together in the groups of ``spread`` (grp, x, n), each of which has been compared part by part."""
        before = None
        while True:
            now = spread.join(self.roots(), F.col("x") == F.col("id"), "left").select("grp", "x", "n", F.coalesce("root", "x").alias("component"))
            now = stored(now, "spread")
            of = stored(now.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("many"), F.min("x").alias("a"), F.max("x").alias("b")), "hanging")
            main = of.groupBy("grp").agg(F.count(F.lit(1)).alias("components"), F.max_by("component", F.struct("many", "component")).alias("main"))
            main = stored(main.where("components > 1"), "main")
            left = main.agg(F.sum("components")).first()[0]
            if not left:
                return
            if before is not None and left * 2 > before:
                break
            before = left
            # Two sets of each component of several members meet those of other components, some at a time.
            chosen = of.where("many > 1").join(main, "grp").withColumn("parts", F.ceil(2 * F.col("components") / PART_SETS))
            chosen = chosen.select("grp", "parts", F.explode(F.array("a", "b")).alias("x"))
            self.compare(chosen.select(F.xxhash64("grp", _dealt(left, "x")).alias("cell"), "x").distinct())
        self.compare_outside(now.join(main, "grp"))

    def compare_outside(self, inside: DataFrame) -> None:
        """Compare what isn't in its group's main component with all of the group: (grp, x, n, component, main)."""
        # Sizes of linked sets lie in one band or in neighbouring ones.
        inside = stored(inside.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.34)))), "inside")
        outside = inside.where("component <> main")

        def placed(df: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
            parts = df.groupBy("grp", "band").agg(_parts().alias("parts"))
            return df.join(parts, ["grp", "band"]).withColumn("part", _dealt(salt, "x")), parts.select("grp", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

        (out, out_parts), (every, parts) = placed(outside, 3), placed(inside, 4)
        near = out_parts.select("grp", F.col("band").alias("out_band"), F.col("part").alias("out_part"), F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("band"))
        cells = stored(near.join(parts, ["grp", "band"]).withColumn("cell", F.xxhash64("grp", "out_band", "out_part", "band", "part")), "crossings")
        of_out = cells.select("cell", "grp", F.col("out_band").alias("band"), F.col("out_part").alias("part"))
        of_every = cells.select("cell", "grp", "band", "part")
        side = lambda df, of, k: df.join(of, ["grp", "band", "part"]).select("cell", F.lit(k).alias("side"), "x", "component", "n")
        meet = stored(side(out, of_out, 0).unionByName(side(every, of_every, 1)), "meet")
        flagged = _by(meet.join(self.bits.select("x", "bits"), "x").select("cell", "side", "x", "component", "n", "bits"), _flag)
        flagged = stored(flagged.select(F.col("list").alias("cell"), "x").distinct(), "flagged")
        exact = meet.join(flagged, ["cell", "x"]).join(self.sets(flagged), "x").select("cell", "side", "x", "component", "n", "set")
        self.edges.append(stored(_by(exact, _link).select("x", "y").distinct(), "edges"))


def components_of_rows(docs: DataFrame, doc_id: str, text: str, mark: F.Column) -> DataFrame:
    """doc_id, ``mark``, n (size of the set), root (of the row's component) and component (its least number) of every row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), mark.cast("binary").alias("mark"))
    sets = shingle_sets(rows, hot_shingles(rows, "text")).withColumn("row", F.monotonically_increasing_id())
    sets = stored(sets, "shingles")
    # The rows are stored, so that their places are fixed numbers: that of its first row names a class.
    classes = sets.where("n > 0").groupBy("digest").agg(F.min("row").alias("x"), F.min("doc_id").alias("least_id"), F.min("n").alias("n"))
    classes = stored(classes, "classes")
    few = classes.count() <= MAX_BROADCAST
    first = F.broadcast(classes.select("x")) if few else classes.select("x")
    firsts = sets.join(first, F.col("row") == F.col("x"), "left_semi").select(F.col("row").alias("x"), "n", "small", "keys", "bits")
    # Where the join moves the rows, it does so once.
    firsts = firsts if few else stored(firsts, "firsts")
    postings = firsts.select("x", "n", "small", F.posexplode("keys").alias("at", "key"))
    postings = postings.select("key", "x", F.when(F.col("at") < F.col("small"), F.col("n")).otherwise(-F.col("n")).alias("signed"))
    # Copies count here too; that makes no more than a part of its own of a short list.
    wide = _wide(sets)
    n_wide = wide.count()
    named = F.broadcast(wide) if n_wide <= MAX_BROADCAST else wide
    narrow = postings.join(named, "key", "left_anti") if n_wide else postings
    lists = stored(
        narrow.repartition("key").sortWithinPartitions("key").mapInArrow(_groups, "members array<long>")
        .withColumns({"one": F.xxhash64("members"), "other": F.hash("members")}).dropDuplicates(["one", "other"])
        .select("members", F.monotonically_increasing_id().alias("list")),
        "lists",
    )
    members = _outermost(lists)
    spread = None
    if n_wide:
        # A set is compared within one of its wide shingles, the one of most sets, part by part.
        spread = stored(postings.join(named, "key", "left_semi").select("key", "x", F.abs("signed").alias("n")).distinct(), "spread")
        many = spread.groupBy("key").agg(F.count(F.lit(1)).alias("many"))
        home = spread.join(many, "key").groupBy("x").agg(F.max_by("key", F.struct("many", "key")).alias("key"), F.min("n").alias("n"))
        home = stored(home, "home")
        dealt = home.join(home.groupBy("key").agg(_parts().alias("parts")), "key")
        members = members.unionByName(dealt.select(F.xxhash64("key", _dealt(1, "x")).alias("list"), "x"))
        spread = spread.select(F.xxhash64(F.lit("key"), "key").alias("grp"), "x", "n")
    bits = firsts.select("x", "n", "bits")
    pairs = stored(_by(members.join(bits, "x").select("list", "n", "x", "bits"), _span).select("x", "y").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("x", "y")).alias("x")).distinct()
    roots = component_roots(pairs, "x", "y")
    blocks = ids.join(roots, F.col("x") == F.col("id"), "left").select("x", F.coalesce("root", "x").alias("block"))
    blocks = stored(blocks.join(classes.select("x", "n"), "x"), "blocks")
    parts = stored(blocks.groupBy("block").agg(_parts().alias("parts")), "parts")
    join = _Join(rows, classes, bits)
    join.compare(blocks.join(parts, "block").select(F.xxhash64("block", _dealt(2, "x")).alias("cell"), "x"))
    large = blocks.join(parts.where("parts > 1"), "block").select(F.xxhash64(F.lit("block"), "block").alias("grp"), "x", "n")
    spread = large if spread is None else spread.unionByName(large)
    if spread.take(1):
        join.join_parts(stored(spread, "spread"))
    of_class = classes.join(join.roots(), F.col("x") == F.col("id"), "left").select("digest", "least_id", F.coalesce("root", "x").alias("root"))
    of_class = stored(of_class, "roots")
    of_class = of_class.join(of_class.groupBy("root").agg(F.min("least_id").alias("component")), "root").select("digest", "root", "component")
    some = sets.select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    return some.join(of_class, "digest", "left").select("doc_id", "mark", "n", "root", "component")


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least number that links lead to) of every row of ``docs``.

    Texts are linked if the Jaccard similarity of their sets of five-word
    shingles is 3/4 or more. Null texts are empty; empty and blank texts have
    no shingles and hang together with nothing. Links are between rows, so rows
    that share a number but not a text have links of their own; rows without a
    number link too, and their component is null if no number is reached. Other
    columns are left out; an empty table gives no rows. Nothing but the
    frequent shingles of a sample comes to the driver.
    """
    found = components_of_rows(docs, doc_id, text, F.lit(None))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each component: that of the least number, rows without one last.

    Of several texts with that number, the one of least MD5 stays, and of rows
    alike in number and text the one whose other columns have the least hash.
    Rows without words hang together with nothing and stay.
    """
    mark = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("mark").alias("mark"))
    found = stored(components_of_rows(docs, doc_id, text, mark).where("n > 0"), "of-rows")
    kept = stored(found.groupBy("root").agg(F.min(rank).alias("kept")), "kept")
    rows = found.join(kept, "root").select(rank.alias("row"), "kept")
    gone = stored(rows.where("row <> kept").select("row.*").distinct(), "gone")
    again = stored(rows.where("row = kept").groupBy("row").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("row.*"), "again")

    def those(df: DataFrame, named: DataFrame, how: str) -> DataFrame:
        number, other = own_name(docs, "gone_id"), own_name(docs, "gone_mark")
        named = named.select(F.col("doc_id").alias(number), F.col("mark").alias(other))
        if named.count() <= MAX_BROADCAST:
            named = F.broadcast(named)
        return df.join(named, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(number)) & (mark == F.col(other)), how)

    left = those(docs, gone, "left_anti")
    if not again.take(1):
        return left
    columns = [F.col(f"`{c}`") for c in docs.columns]
    twice = those(left, again, "left_semi").select(F.struct(*columns).alias("row"), F.col(f"`{doc_id}`").alias("number"), mark.alias("mark"))
    one = twice.groupBy("number", "mark").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return those(left, again, "left_anti").unionByName(one.select("row.*"))
