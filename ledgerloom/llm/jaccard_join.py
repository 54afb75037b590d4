"""N-gram Jaccard join with count vectors in R-trees.

A document's set is its distinct three-word shingles. Two documents link when
the Jaccard similarity of their sets reaches percent / 100.

The tokens are hashed into groups. If two sets of at most m elements reach the
threshold, at most D = 2 m (100 - p) / (100 + p) elements are in one of them alone, so among
more than D groups one is the same in both. Documents are therefore dealt out by
the contents of D + 1 of their groups, per band of sizes: those that hold the rarest shingles.
What ranks a group is its content alone, so two linked documents both choose
the best of the groups that they share, and no link is lost; rarity is read
from a table of counts of all shingles by hash, of fixed size. Documents
that share such a key are connected to a block; blocks are packed in order of size into
the leaves of an R-tree over the documents' group counts. Trees are searched from
node to point with the bound that an overlap is at most the sum of the
coordinate minima of a document and a node's upper corner; pairs that remain
are verified by intersecting their sets. A block over several leaves is
searched leaf against leaf, where the leaves' corners allow a link.

Equal sets are one class from the start and are compared through its smallest
doc_id. No pair leaves a task: a task returns for every class its number of
links and an edge to the least class that it reaches there. Where many pairs of two leaves remain,
they are verified by one product of matrices over the shingles that both have;
`keep_one`, which needs no numbers of links, doesn't verify pairs that are joined already.

Defined cases: a null text, or one without words, has an empty set and links
with nothing; a text of one or two words is one shingle; rows that share a
doc_id are one document in `join`'s components and links are counted by rows, while `keep_one`
judges every row by its own text (rows equal in id and text stay or go together); a row with a null doc_id
takes component and number of links of equal sets, null and 0 if there are none with an id; doc_ids are whole numbers; long texts
are handled whole; extra columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm import _text as X
from ledgerloom.llm._components import components
from ledgerloom.store import discard, stash

NGRAM, PERCENT = 3, 90
#: Coordinates of a point: groups that its tokens are hashed into.
GROUPS = 128
#: Documents and bytes of sets in a leaf of the distributed tree, at most (a larger set is a leaf of its own).
LEAF_ROWS, LEAF_BYTES = 512, 8 << 20
#: Points under a node of a leaf's own tree.
NODE = 16
#: Corners of a block that one corner is compared with in a task, about.
LEAVES = 64
#: Shingles in one slice of a product of matrices, and how many of its steps take the time of one element of a list.
SLICE, DENSE = 4096, 40
#: Members of blocks whose ids are broadcast to fetch their texts, at most (40 bytes each); more are fetched by a shuffle join.
BROADCAST_MEMBERS = 500_000

#: Keys of several documents that are broadcast to find these, at most (16 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Cells of the table of shingle counts (8 bytes each), and the parts that it is summed in.
CELL_BITS, PARTS = 20, 64
#: Tasks that add up the tables of a part, before one adds up theirs.
SUMMED = 16

_U = np.uint64


def _shingles(column: pa.Array, ngram: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds, sorted distinct shingle hashes) of chunks of texts; bounds has one more entry than texts."""
    for a, _, raw, offsets in X.pieces(column):
        words = X.split(raw, offsets, X.SPACES, lower=True)
        row, left, found = words.text_of, words.left, []
        h = X.windows(words.hashes, ngram)
        ok = left[: len(h)] >= ngram
        found.append((row[: len(h)][ok], h[ok]))
        for n in range(1, ngram):
            text = np.flatnonzero(words.counts == n)
            if len(text):
                found.append((text, X.windows(words.hashes, n)[words.first[text]]))
        row, h = np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        row, h = row[new], h[new]
        yield a, np.searchsorted(row, np.arange(len(words.counts) + 1)), h


def _sums(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, from sums over its elements."""
    size = np.diff(bounds).astype(np.uint64)
    return X.mix(_sums(X.mix(h), bounds) + size), X.mix(_sums(X.mix(h ^ _U(0x5851F42D4C957F2D)), bounds) - size)


class Bands:
    """Bands of set sizes, and the number of groups that a band's sets are dealt into."""

    def __init__(self, percent: int):
        self.percent = percent
        self.starts = [1, 2]

    def up_to(self, n: int) -> np.ndarray:
        while self.starts[-1] <= n:
            at = self.starts[-1]
            self.starts.append(max(at + 1, at * 3 // 2, -(-at * 100 // self.percent)))
        return np.array(self.starts)

    def apart(self, band: int) -> int:
        """Elements that may be in one alone of two linked sets of which the larger is in the band."""
        largest = self.starts[band + 1] - 1
        return 2 * largest * (100 - self.percent) // (100 + self.percent)


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - CELL_BITS)).astype(np.int64)


def _keys(h: np.ndarray, bounds: np.ndarray, bands: Bands, rarity: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(set, key) of the groups that deal the sets out."""
    size = np.diff(bounds)
    if not len(size) or not size.max():
        return
    most = int(size.max()) * 100 // bands.percent + 1
    starts = bands.up_to(most)
    low = np.searchsorted(starts, np.maximum(size, 1), "right") - 1
    high = np.searchsorted(starts, np.maximum(size, 1) * 100 // bands.percent, "right") - 1
    for band in range(int(low[size > 0].min()), int(high.max()) + 1):
        member = np.flatnonzero((size > 0) & (low <= band) & (band <= high))
        if not len(member):
            continue
        apart = bands.apart(band)
        groups = apart + 1 + max(1, (apart + 1) // 4) if apart else 1
        at = np.repeat(np.arange(len(member)), size[member])
        own = h[np.repeat(bounds[member] - np.concatenate(([0], np.cumsum(size[member])[:-1])), size[member]) + np.arange(len(at))]
        mixed = X.mix(own + _U(band))
        cell = at * groups + ((mixed >> _U(32)) % _U(groups)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        count = np.bincount(cell, minlength=len(member) * groups)
        content = X.mix(_sums(mixed[order], np.concatenate(([0], np.cumsum(count)))) + count.astype(np.uint64))
        full = np.flatnonzero(count)
        rarest = np.minimum.reduceat(rarity[_cells(own[order])], np.concatenate(([0], np.cumsum(count[full])[:-1])))
        rank = np.full(len(count), np.iinfo(np.uint64).max, np.uint64)  # the rarest first, then the largest, then by content
        graded = (np.log2(1.0 + rarest) * (1 << 17)).astype(np.uint64)  # in order at any size, in 23 bits
        rank[full] = (graded << _U(40)) | ((255 - np.minimum(count[full], 255)).astype(np.uint64) << _U(32)) | (content[full] >> _U(32))
        rank = rank.reshape(len(member), groups)
        last = np.partition(rank, apart, axis=1)[:, apart]
        row, group = np.nonzero(rank <= last[:, None])
        yield member[row], X.mix(content[row * groups + group] ^ X.mix(_U(band << 32) + group.astype(np.uint64)))


_SKETCH = "doc_id bigint, t bigint, n bigint, d1 bigint, d2 bigint, part int, counts binary"


def _sketch(ngram: int):
    """Size and hashes of the set of every row (columns doc_id, t and text), and the task's counts of shingles by cell, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELL_BITS, np.int64)
        names = [x.split(" ")[0] for x in _SKETCH.split(", ")]
        for batch in batches:
            ids = batch.column(0)
            for a, bounds, h in _shingles(batch.column(2), ngram):
                one, two = _digests(h, bounds)
                n, known = len(one), ids.slice(a, len(one)).is_valid().to_numpy(zero_copy_only=False)
                total += np.bincount(_cells(h[np.repeat(known, np.diff(bounds))]), minlength=len(total))
                yield pa.record_batch([ids.slice(a, n), batch.column(1).slice(a, n), np.diff(bounds), X.signed(one), X.signed(two), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        counts = pa.array([zlib.compress(x.tobytes(), 1) for x in np.split(total, PARTS)], pa.binary())
        yield pa.record_batch([*(pa.nulls(PARTS, pa.int64()) for _ in range(5)), pa.array(range(PARTS), pa.int32()), counts], names=names)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the parts (columns part and counts), however many rows each has."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(counts), np.int64)
            total[part] = total[part] + own if part in total else own
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["part", "counts"])


def shingle_counts(sketched: DataFrame) -> np.ndarray:
    """The table of shingle counts over all texts: 2^CELL_BITS cells, whatever the corpus."""
    tables = sketched.where("part IS NOT NULL").select("part", "counts", (F.spark_partition_id() % SUMMED).alias("some"))
    summed = tables.repartition("part", "some").select("part", "counts").mapInArrow(_add, "part int, counts binary")  # a tree: no task adds the tables of all others
    rows = summed.repartition("part").mapInArrow(_add, "part int, counts binary").collect()
    table = np.zeros((PARTS, (1 << CELL_BITS) // PARTS), np.int64)
    for r in rows:
        table[r.part] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return table.ravel()


def _deal(ngram: int, percent: int, rarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for _, bounds, h in _shingles(batch.column(0), ngram):
                one, _ = _digests(h, bounds)
                for member, key in _keys(h, bounds, bands, rarity.value):
                    yield pa.record_batch([X.signed(key), X.signed(one[member])], names=["key", "d1"])

    return run


def _points(ngram: int, groups: int):
    """Rows with the sets and count vectors of the members' texts; columns text and the member's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d1 = batch.column(2).to_numpy()
            for a, bounds, h in _shingles(batch.column(0), ngram):
                one, size = X.signed(_digests(h, bounds)[0]), np.diff(bounds)
                cell = np.repeat(np.arange(len(size)), size) * groups + (X.mix(h + _U(1)) % _U(groups)).astype(np.int64)
                counts = np.bincount(cell, minlength=len(size) * groups).reshape(-1, groups).astype(np.int32)
                own = np.flatnonzero(one == d1[a : a + len(size)])
                kept = batch.slice(a, len(size)).take(pa.array(own))
                yield pa.record_batch(
                    [*(kept.column(k) for k in (1, 3, 2, 4)), size[own], pa.array([counts[i].tobytes() for i in own], pa.binary()), pa.array([h[bounds[i] : bounds[i + 1]].tobytes() for i in own], pa.binary())],
                    names=["block", "rep", "d1", "copies", "n", "point", "elements"],
                )

    return run


class Leaf:
    """Points in order of block and size, with the upper corners of nodes of NODE points, and the sets behind them."""

    def __init__(self, rows: pa.Table):
        column = lambda k: rows.column(k).to_numpy()
        self.block, self.rep, self.d1, self.copies, self.n = (column(k) for k in ("block", "rep", "d1", "copies", "n"))
        self.points = np.stack([np.frombuffer(x, np.int32) for x in rows.column("point").to_pylist()]) if len(self.rep) else np.zeros((0, 1), np.int32)
        self.sets = [np.frombuffer(x, np.uint64) for x in rows.column("elements").to_pylist()]
        at = np.arange(0, len(self.rep), NODE)
        self.first = at
        self.corner = np.maximum.reduceat(self.points, at, axis=0) if len(at) else self.points
        self.least = np.minimum.reduceat(self.n, at) if len(at) else at
        self.blocks = (self.block[at], self.block[np.minimum(at + NODE, len(self.rep)) - 1]) if len(at) else (at, at)

    def search(self, point: np.ndarray, n: int, block: int, after: int, percent: int) -> np.ndarray:
        """Points from `after` on that may link with a set of that size and point."""
        enough = lambda bound, sizes: (100 + percent) * bound >= percent * (n + sizes)
        nodes = np.flatnonzero((self.blocks[0] <= block) & (block <= self.blocks[1]) & (self.first + NODE > after))
        nodes = nodes[enough(np.minimum(self.corner[nodes], point).sum(1), self.least[nodes])]
        if not len(nodes):
            return nodes
        own = (self.first[nodes][:, None] + np.arange(NODE)).ravel()
        own = own[(own >= after) & (own < len(self.n))]
        own = own[(self.block[own] == block)]
        return own[enough(np.minimum(self.points[own], point).sum(1), self.n[own])]


def _common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Elements that a set has in common with each of the others."""
    flat, size = np.concatenate(others), np.array([len(x) for x in others])
    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
    return np.add.reduceat(hit.astype(np.int64), np.concatenate(([0], np.cumsum(size)[:-1])))


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def _all_common(ours: list[np.ndarray], theirs: list[np.ndarray], shared: np.ndarray) -> np.ndarray:
    """Common elements of every set of the one list with every set of the other, as products over slices of the shared elements."""
    sides = []
    for sets in (ours, theirs):
        flat, row = _flat(sets)
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        there = shared[at] == flat
        order = np.argsort(at[there], kind="stable")
        sides.append((at[there][order], row[there][order], len(sets)))
    total = np.zeros((len(ours), len(theirs)), np.float32)
    for low in range(0, len(shared), SLICE):
        parts = []
        for at, row, n in sides:
            x, y = np.searchsorted(at, [low, low + SLICE])
            part = np.zeros((n, min(SLICE, len(shared) - low)), np.float32)
            part[row[x:y], at[x:y] - low] = 1
            parts.append(part)
        total += parts[0] @ parts[1].T
    return total


def _candidates(a: Leaf, b: Leaf | None, percent: int) -> list[tuple[int, np.ndarray]]:
    """(i, the js) of the pairs of a's points with b's, or among a's own, that the tree leaves."""
    other = a if b is None else b
    found = ((i, other.search(a.points[i], int(a.n[i]), int(a.block[i]), i + 1 if b is None else 0, percent)) for i in range(len(a.n)))
    return [(i, js) for i, js in found if len(js)]


def _links(a: Leaf, b: Leaf | None, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the js) of all links between a's sets and b's, or among a's own."""
    other, maybe = a if b is None else b, _candidates(a, b, percent)
    if not maybe:
        return
    size = np.array([len(x) for x in other.sets])
    rows, columns = np.array([i for i, _ in maybe]), np.unique(np.concatenate([js for _, js in maybe]))
    ours, theirs = [a.sets[i] for i in rows], [other.sets[j] for j in columns]
    work = sum(int(size[js].sum()) for _, js in maybe)
    whole = None
    if work > len(rows) * len(columns):
        shared = np.intersect1d(np.unique(_flat(ours)[0]), np.unique(_flat(theirs)[0]), assume_unique=True)
        if len(shared) * len(rows) * len(columns) < DENSE * work:  # either way gives the same numbers
            whole = _all_common(ours, theirs, shared)
    for k, (i, js) in enumerate(maybe):
        common = _common(a.sets[i], [other.sets[j] for j in js]) if whole is None else whole[k, np.searchsorted(columns, js)].astype(np.int64)
        js = js[(100 + percent) * common >= percent * (len(a.sets[i]) + size[js])]
        if len(js):
            yield i, js


def _joins(a: Leaf, b: Leaf | None, percent: int, label: np.ndarray) -> None:
    """Joins the labels of sets that links connect, looking at no pair whose labels are equal already; b's sets follow a's."""
    other, shift = (a, 0) if b is None else (b, len(a.n))
    for i, js in _candidates(a, b, percent):
        while len(js := js[label[js + shift] != label[i]]):
            some, js = js[:NODE], js[NODE:]
            common = _common(a.sets[i], [other.sets[j] for j in some])
            for j in some[(100 + percent) * common >= percent * (len(a.sets[i]) + np.array([len(other.sets[j]) for j in some]))].tolist():
                label[label == label[j + shift]] = label[i]


def _joined(a: Leaf, b: Leaf | None, percent: int, count: bool, home: np.ndarray | None = None) -> pa.Table:
    """rep and d1, least_rep and least_d1 (the least class that it reaches here) and links, of every class that is linked.

    home: numbers of the components that the classes are known to be in, a's first.
    """
    parts = [a] if b is None else [a, b]
    rep, d1, copies = (np.concatenate([getattr(x, k) for x in parts]) for k in ("rep", "d1", "copies"))
    label, links = np.arange(len(rep)) if home is None else home.copy(), np.zeros(len(rep), np.int64)
    if count:
        shift = 0 if b is None else len(a.rep)
        for i, js in _links(a, b, percent):
            js = js + shift
            links[i] += copies[js].sum()
            links[js] += copies[i]
            for other in np.unique(label[js]):
                label[label == other] = label[i]
    else:
        _joins(a, b, percent, label)
    order = np.lexsort((d1, rep))
    _, first = np.unique(label[order], return_index=True)
    least = np.zeros(int(label.max(initial=-1)) + 1, np.int64)
    least[label[order[first]]] = order[first]
    to = least[label] if len(label) else label
    at = np.flatnonzero((links > 0) | (to != np.arange(len(rep))))
    return pa.table({"rep": rep[at], "d1": d1[at], "least_rep": rep[to[at]], "least_d1": d1[to[at]], "links": links[at]})


_OUT = "rep bigint, d1 bigint, least_rep bigint, least_d1 bigint, links bigint, leaf bigint, block bigint, copies bigint, n bigint, point binary, elements binary, least bigint, most bigint, corner binary"
_OUT_ARROW = pa.schema([(x.split(" ")[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _OUT.split(", ")])


def _padded(rows: pa.Table, **more) -> Iterator[pa.RecordBatch]:
    columns = {n: rows.column(n) for n in rows.schema.names} | more
    yield from pa.table([columns.get(f.name, pa.nulls(len(rows), f.type)) for f in _OUT_ARROW], schema=_OUT_ARROW).combine_chunks().to_batches()


def _homes(table: pa.Table) -> np.ndarray:
    """A number for each component that rows with least_rep and least_d1 are in."""
    pairs = np.stack([table.column(k).to_numpy() for k in ("least_rep", "least_d1")], 1)
    return np.unique(pairs, axis=0, return_inverse=True)[1].ravel()


def _pack(percent: int, count: bool):
    """Packs rows sorted by block and size into leaves and joins each leaf with itself. Rows of blocks that may go on in another leaf
    are handed on with the leaf's number and the class that they reach in it; so is, for each such block, the corner of these rows."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows, size = [], 0, 0
        for batch in batches:
            weight = np.array([len(x) for x in batch.column(6).to_pylist()], np.int64)
            at = 0
            while at < len(batch):
                fits = int(np.searchsorted(np.cumsum(weight[at:]), LEAF_BYTES - size, "right"))
                take = min(len(batch) - at, LEAF_ROWS - rows, max(fits, 1 if not rows else 0))
                if take:
                    held.append(batch.slice(at, take))
                    rows, size, at = rows + take, size + int(weight[at : at + take].sum()), at + take
                if at < len(batch) or rows == LEAF_ROWS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, rows, size = [], 0, 0
        if rows:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, rows in enumerate(leaves(batches)):
            leaf, name = Leaf(rows), (task << 32) + number
            links = _joined(leaf, None, percent, count)
            yield from _padded(links)
            reached = {(r, d): (x, y) for r, d, x, y in zip(*(links.column(k).to_pylist() for k in ("rep", "d1", "least_rep", "least_d1")), strict=True)}
            for block in sorted({int(leaf.block[0]), int(leaf.block[-1])}):
                own = leaf.block == block
                edge = rows.filter(pa.array(own))
                homes = [reached.get(x, x) for x in zip(edge.column("rep").to_pylist(), edge.column("d1").to_pylist(), strict=True)]
                yield from _padded(edge, leaf=pa.array([name] * len(edge), pa.int64()), least_rep=pa.array([x for x, _ in homes], pa.int64()), least_d1=pa.array([x for _, x in homes], pa.int64()))
                corner = pa.array([leaf.points[own].max(0).astype(np.int32).tobytes()], pa.binary())
                yield from _padded(pa.table({"block": [block]}), leaf=pa.array([name], pa.int64()), least=pa.array([leaf.n[own].min()], pa.int64()), most=pa.array([leaf.n[own].max()], pa.int64()), corner=corner)

    return run


def _near_corners(percent: int):
    """one and two, the leaves of rows with two corners that leave a link possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            ours, theirs = (np.stack([np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(k)]) for k in ("corner", "corner2"))
            least, least2 = batch.column("least").to_numpy(), batch.column("least2").to_numpy()
            near = (100 + percent) * np.minimum(ours, theirs).sum(1, dtype=np.int64) >= percent * (least + least2)
            yield pa.record_batch([batch.column(k).filter(pa.array(near)) for k in ("block", "leaf", "leaf2")], names=["block", "one", "two"])

    return run


def _across(percent: int, count: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("side", "ascending"), ("n", "ascending"), ("rep", "ascending"), ("d1", "ascending")])
        side = table.column("side").to_numpy()
        a, b = (Leaf(table.filter(pa.array(side == s))) for s in (0, 1))
        return _joined(a, b, percent, count, _homes(table))

    return run


def _node(rep: str, d1: str) -> Column:
    return F.struct(F.col(rep).alias("rep"), F.col(d1).alias("d1"))


def _classes(docs: DataFrame, ngram: int, percent: int, groups: int, broadcast_members: int, broadcast_keys: int, id_col: str, text_col: str, count: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketched, classes, found): the rows with t (a hash of the text), n, d1 and d2 of their sets; the classes of equal sets with rep and copies;
    and per class and task rep, d1, least_rep, least_d1 and links."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = stash(read.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(_sketch(ngram), _SKETCH), "sketch")
    rarity = docs.sparkSession.sparkContext.broadcast(shingle_counts(held))
    sketched = held.where("part IS NULL").select("doc_id", "t", "n", "d1", "d2")
    classes = stash(sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")

    keys = read.where("doc_id IS NOT NULL").select("text").mapInArrow(_deal(ngram, percent, rarity), "key bigint, d1 bigint")
    shared = stash(keys.groupBy("key").agg(F.min("d1").alias("least"), F.max("d1").alias("most")).where("least < most").select("key", "least"), "shared")
    few = shared.count() <= broadcast_keys
    near = keys.join(F.broadcast(shared) if few else shared, "key").where("d1 <> least").select(F.col("d1").alias("u"), F.col("least").alias("v"))
    blocks = components(near)
    blocks = blocks.unionByName(blocks.select(F.col("component").alias("node"), "component").distinct())

    members = stash(classes.join(blocks, classes.d1 == blocks.node).select(F.col("component").alias("block"), "d1", "rep", "copies"), "members")
    n_members = members.count()
    texts = read.join(F.broadcast(members) if n_members <= broadcast_members else members, F.col("doc_id") == F.col("rep")).select("text", "block", "d1", "rep", "copies")
    points = stash(texts.mapInArrow(_points(ngram, groups), "block bigint, rep bigint, d1 bigint, copies bigint, n bigint, point binary, elements binary"), "points")
    if points.count() > n_members:  # rows equal in id and set are one point
        first = [F.any_value(c).alias(c) for c in ("copies", "n", "point", "elements")]
        points = stash(points.groupBy("block", "rep", "d1").agg(*first), "points")
    order = ("block", "n", "rep", "d1")
    packed = stash(points.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack(percent, count), _OUT), "leaves")

    rows = packed.where("leaf IS NOT NULL AND corner IS NULL").select("leaf", "block", "rep", "d1", "least_rep", "least_d1", "copies", "n", "point", "elements")
    corners = packed.where("corner IS NOT NULL").select("block", "leaf", "least", "most", "corner")
    # a block of many leaves is dealt out in slices of its leaves, one corner against the corners of a slice
    slices = corners.groupBy("block").agg(F.count(F.lit(1)).alias("leaves")).where("leaves > 1").select("block", F.ceil(F.col("leaves") / LEAVES).cast("int").alias("slices"))
    corners = stash(corners.join(slices, "block"), "corners")
    left = corners.select("*", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    right = corners.select("block", F.pmod(F.xxhash64("leaf"), F.col("slices")).cast("int").alias("slice"), *[F.col(c).alias(f"{c}2") for c in ("leaf", "least", "most", "corner")])
    pairs = left.join(right, ["block", "slice"]).where((F.col("leaf") < F.col("leaf2")) & (100 * F.col("most") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least")))
    pairs = stash(pairs.mapInArrow(_near_corners(percent), "block bigint, one bigint, two bigint"), "pairs")
    sides = pairs.select("block", "one", "two", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("leaf")), F.struct(F.lit(1).alias("side"), F.col("two").alias("leaf")))).alias("s"))
    sides = sides.select("block", "one", "two", "s.side", "s.leaf")
    result = "rep bigint, d1 bigint, least_rep bigint, least_d1 bigint, links bigint"
    across = rows.join(sides, ["block", "leaf"]).groupBy("block", "one", "two").applyInArrow(_across(percent, count), result)
    found = stash(packed.where("links IS NOT NULL").select("rep", "d1", "least_rep", "least_d1", "links").unionByName(across), "links")
    discard(shared, members, points, packed, corners, pairs)
    return sketched, classes, found


def _edges(found: DataFrame) -> DataFrame:
    return found.select(_node("rep", "d1").alias("u"), _node("least_rep", "least_d1").alias("v"))


def _shared_ids(sketched: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Edges between the classes of ids that have more than one, or None without such ids."""
    known = sketched.where("n > 0 AND doc_id IS NOT NULL")
    ids = stash(known.groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a < b").select("doc_id"), "ids")
    if ids.isEmpty():
        return None
    nodes = known.join(ids, "doc_id").select("doc_id", "n", "d1", "d2").distinct().join(classes, ["n", "d1", "d2"]).select("doc_id", _node("rep", "d1").alias("u"))
    nodes = stash(nodes, "nodes")
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("u").alias("v")), "doc_id").select("u", "v")


def join(
    docs: DataFrame, *, ngram: int = NGRAM, percent: int = PERCENT, groups: int = GROUPS, broadcast_members: int = BROADCAST_MEMBERS,
    broadcast_keys: int = BROADCAST_KEYS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable by links, its own included) and n_links (rows that it links with)."""
    sketched, classes, found = _classes(docs, ngram, percent, groups, broadcast_members, broadcast_keys, id_col, text_col, True)
    edges, more = _edges(found), _shared_ids(sketched, classes)
    linked = components(edges if more is None else edges.unionByName(more)).select(F.col("node").alias("u"), F.col("component.rep").alias("component_id"))
    links = found.groupBy(_node("rep", "d1").alias("w")).agg(F.sum("links").alias("links"))
    classes = classes.withColumn("node", _node("rep", "d1"))
    classes = classes.join(links, F.col("node") == F.col("w"), "left").join(linked, F.col("node") == F.col("u"), "left")
    classes = classes.select("n", "d1", "d2", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sketched.join(classes, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(
    docs: DataFrame, *, ngram: int = NGRAM, percent: int = PERCENT, groups: int = GROUPS, broadcast_members: int = BROADCAST_MEMBERS,
    broadcast_keys: int = BROADCAST_KEYS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The documents without those whose text reaches, by links, that of a smaller doc_id; all columns stay.

    Of texts of one doc_id that reach each other, one stays. Rows with a null id stay.
    """
    sketched, classes, found = _classes(docs, ngram, percent, groups, broadcast_members, broadcast_keys, id_col, text_col, False)
    linked = components(_edges(found)).select(F.col("node").alias("u"), "component")
    classes = classes.withColumn("node", _node("rep", "d1")).join(linked, F.col("node") == F.col("u"), "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("first"))
    gone = sketched.where("doc_id IS NOT NULL").join(classes, ["n", "d1", "d2"]).where((F.col("doc_id") != F.col("first.rep")) | (F.col("d1") != F.col("first.d1")))
    gone = stash(gone.select("doc_id", "t").distinct(), "gone")
    few = gone.count() <= broadcast_members
    same = (F.col(f"d.{_quoted(id_col)}").cast("long") == F.col("g.doc_id")) & (F.xxhash64(f"d.{_quoted(text_col)}") == F.col("g.t"))
    return docs.alias("d").join((F.broadcast(gone) if few else gone).alias("g"), same, "left_anti")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p : p + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
l AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id LEFT JOIN l ON l.x = d.doc_id
"""
