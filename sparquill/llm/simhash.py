"""SimHash near-duplicates by a self-join of binary tries.

A document's 128-bit signature is the sign of a weighted sum over its words, every word weighing
1 + ln(count). The bits are dealt to ``BLOCKS`` blocks of two halves each. By the pigeonhole principle
two signatures that differ in at most ``BUDGET`` bits differ in at most ``BUDGET // BLOCKS`` = 3 bits of
one block, and so in at most one bit of one of its halves. A task is therefore a half and a value of it:
it has the signatures with that value, and those that have one more bit set there. So a signature goes to
1 + (bits set in the half) tasks a half, 75 in all on average, however many signatures there are.

In its tasks the signatures form a binary trie over the other half of the block, which is joined with
itself: pairs of nodes of one depth are traversed together, their differing bits add up, and a pair is
dropped as soon as the block's budget is exceeded. Pairs of leaves that are left are held against the
whole budget. The search is exact for the Hamming distance.

A task holds at most ``TASK_ROWS`` signatures of either side: a value that has more is cut into chunks by
hash, and each pair of chunks is a task. Leaves of many signatures (near copies of one text) are first
gathered around leaders; clusters are linked by their leaders, or kept apart by the triangle inequality,
and only what neither decides is compared signature by signature. Tasks give a spanning forest of what
they linked, so that a group of n copies yields n edges, never n squared. Groups are connected components
of the edges, found by alternating star contraction.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import ship, stored
from .common import add_columns, keyed, mix64, strings

BITS = 128
BLOCKS = 5
#: Signatures that differ in so many bits, or fewer, are near-duplicates.
BUDGET = 19
#: Signatures of either side of a task, about.
TASK_ROWS = 1 << 20
#: Rows of tasks that are joined at once; a larger task stands alone.
AT_ONCE = 1 << 19
#: Node pairs handled at once.
FRONTIER = 1 << 20
#: A leaf of more signatures is gathered around leaders.
HOT_LEAF = 64
CACHE = 200_000
_WORD = re.compile(r"\w+")
_WIDTHS = [BITS // BLOCKS + (i < BITS % BLOCKS) for i in range(BLOCKS)]
#: (first bit, bits) of each half, two a block.
_HALVES = [h for b, w in enumerate(_WIDTHS) for h in ((sum(_WIDTHS[:b]), w - w // 2), (sum(_WIDTHS[:b]) + w - w // 2, w // 2))]
_WIDE = max(w for _, w in _HALVES)
#: Kinds of tasks: a value whole; a chunk of it with itself, with another, with a chunk of its neighbours.
WHOLE, SELF, OTHER, BESIDE = range(4)


class Signer:
    """Signatures of texts; the bits of words already met are kept, up to ``CACHE`` words."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, BITS), np.int8)

    def _add(self, words: list[str]) -> None:
        first = len(self.number)
        for w in words:
            self.number[w] = len(self.number)
        need = len(self.number)
        if need > len(self.rows):
            more = np.zeros((max(need, 2 * len(self.rows)), BITS), np.int8)
            more[:first] = self.rows[:first]
            self.rows = more
        h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        both = np.stack((h, mix64(h)), 1)
        self.rows[first:need] = np.unpackbits(both.view(np.uint8), axis=1).view(np.int8) * 2 - 1

    def sign(self, texts: pa.Array) -> list[bytes | None]:
        if len(self.number) > CACHE:
            self.reset()
        out: list[bytes | None] = []
        for t in texts.to_pylist():
            counts = Counter(_WORD.findall(t.lower())) if t else None
            if not counts:
                out.append(None)
                continue
            number = self.number
            new = [w for w in counts if w not in number]
            if new:
                self._add(new)
            ids = np.fromiter(map(number.__getitem__, counts), np.int64, len(counts))
            weight = np.round((1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))) * 1024).astype(np.float64)
            # whole numbers: sums don't depend on the order of the words
            sums = sum(weight[k : k + 4096] @ self.rows[ids[k : k + 4096]].astype(np.float64) for k in range(0, len(ids), 4096))
            out.append(np.packbits(sums > 0).tobytes())
        return out


_SIGNER: list[Signer] = []


def signatures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``signature`` (16 bytes). A text that is null or has no word has none (null)."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not _SIGNER:
            _SIGNER.append(Signer())
        return {"signature": pa.array(_SIGNER[0].sign(strings(batch.column(text_col))), pa.binary())}

    return add_columns(docs, make, [T.StructField("signature", T.BinaryType())], text_col)


# the trie self-join


def half_keys(words: np.ndarray, half: int) -> np.ndarray:
    """The bits of a half, from signatures as rows of 16 bytes."""
    at, width = _HALVES[half]
    bits = np.unpackbits(words, axis=1)[:, at : at + width]
    return bits.astype(np.int64) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signatures as rows of two words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


class Trie:
    """Binary tries over sorted keys of ``width`` bits below their roots: levels of children, and the keys of each leaf."""

    def __init__(self, keys: np.ndarray, width: int):
        self.order = np.argsort(keys, kind="stable")
        keys = keys[self.order]
        new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(keys)))
        self.levels = []
        below = keys[self.first]
        for _ in range(width):
            up = below >> 1
            new = np.concatenate(([True], up[1:] != up[:-1])) if len(up) else np.zeros(0, bool)
            child = np.full((2, int(new.sum())), -1, np.int32)
            child[below & 1, np.cumsum(new) - 1] = np.arange(len(below))
            self.levels.append(child)
            below = up[new]
        self.levels.reverse()

    def rows(self, leaf: int) -> np.ndarray:
        return self.order[self.first[leaf] : self.first[leaf] + self.count[leaf]]


def leaf_pairs(trie: Trie, x: np.ndarray, y: np.ndarray, e: np.ndarray, most: int):
    """Pairs of leaves whose keys differ in ``most`` bits at most, below pairs of roots that differ in ``e`` already."""
    stack = [(0, x, y, e)]
    while stack:
        depth, x, y, e = stack.pop()
        if depth == len(trie.levels):
            yield x, y
            continue
        parts = []
        for p in (0, 1):
            cx = trie.levels[depth][p][x]
            for q in (0, 1):
                cy = trie.levels[depth][q][y]
                ok = (cx >= 0) & (cy >= 0)
                if p != q:
                    ok &= e < most
                    if p:
                        ok &= x != y  # else it is the pair that (0, 1) gives
                if ok.any():
                    parts.append((cx[ok], cy[ok], e[ok] + np.int8(p != q)))
        if not parts:
            continue
        x, y, e = (np.concatenate(c) for c in zip(*parts))
        for k in range(0, len(x), FRONTIER):
            stack.append((depth + 1, x[k : k + FRONTIER], y[k : k + FRONTIER], e[k : k + FRONTIER]))


def clusters(w: np.ndarray, rows: np.ndarray, budget: int) -> list[tuple[int, int, np.ndarray]]:
    """(leader, radius, members) of ``rows``: every member is within the budget of its leader."""
    out = []
    while len(rows):
        d = apart(w[rows], w[rows[0]])
        near = d <= budget
        out.append((int(rows[0]), int(d[near].max()), rows[near]))
        rows = rows[~near]
    return out


def _linked(w: np.ndarray, a: tuple, b: tuple, budget: int) -> tuple[int, int] | None:
    """A pair within the budget that links two clusters; all their points are compared if need be."""
    (la, ra, ma), (lb, rb, mb) = a, b
    if int(apart(w[la], w[lb])) <= budget:
        return la, lb
    ma = ma[apart(w[ma], w[lb]) <= budget + rb]
    mb = mb[apart(w[mb], w[la]) <= budget + ra]
    step = max(1, FRONTIER // max(1, len(mb)))
    for k in range(0, len(ma), step):
        i, j = np.nonzero(apart(w[ma[k : k + step], None], w[None, mb]) <= budget)
        if len(i):
            return int(ma[k + i[0]]), int(mb[j[0]])
    return None


def joined(trie: Trie, w: np.ndarray, x: np.ndarray, y: np.ndarray, budget: int):
    """Rows of pairs within the budget that link what the pairs of leaves (x, y) hold."""
    hot = (trie.count[x] > HOT_LEAF) | (trie.count[y] > HOT_LEAF)
    gathered: dict[int, list] = {}

    def gather(leaf: int) -> list:
        if leaf not in gathered:
            gathered[leaf] = clusters(w, trie.rows(leaf), budget)
        return gathered[leaf]

    for p, q in zip(x[hot].tolist(), y[hot].tolist()):
        one, two = gather(p), gather(q)
        if p == q:
            for lead, _, members in one:
                yield np.full(len(members), lead), members
        near = apart(w[[c[0] for c in one]][:, None], w[[c[0] for c in two]][None]) - np.array([c[1] for c in one])[:, None] - np.array([c[1] for c in two])[None] <= budget
        found = [_linked(w, one[i], two[j], budget) for i, j in np.argwhere(near).tolist() if p != q or i < j]
        found = [f for f in found if f]
        if found:
            yield tuple(np.array(found).T)
    x, y = x[~hot], y[~hot]
    sizes = trie.count[x].astype(np.int64) * trie.count[y]
    ends, at = np.cumsum(sizes), 0
    while at < len(x):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + (FRONTIER << 1), side="right")))
        n = sizes[at:end]
        which = np.repeat(np.arange(at, end), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        cy = trie.count[y[which]]
        i, j = trie.order[trie.first[x[which]] + k // cy], trie.order[trie.first[y[which]] + k % cy]
        ok = apart(w[i], w[j]) <= budget
        ok &= (x[which] != y[which]) | (i < j)
        if ok.any():
            yield i[ok], j[ok]
        at = end


def join_tasks(task: np.ndarray, side: np.ndarray, words: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """A forest (rows, rows) over what the tasks link. ``words`` are signatures as rows of 16 bytes.

    Side 0 is the task's own chunk, 1 another chunk of its value, 2 and more the neighbours by the bit that differs.
    """
    w = np.ascontiguousarray(words).view(np.uint64)
    slot = (task >> 42) >> _WIDE
    rest = np.zeros(len(task), np.int64)
    for half in np.unique(slot).tolist():
        at = slot == half
        rest[at] = half_keys(words[at], half ^ 1)
    order = np.lexsort((side, task))
    new = np.concatenate(([True], (task[order][1:] != task[order][:-1]) | (side[order][1:] != side[order][:-1])))
    root = np.empty(len(task), np.int64)
    root[order] = np.cumsum(new) - 1
    rt, rs = task[order][new], side[order][new].astype(np.int64)
    trie = Trie(root << _WIDE | rest, _WIDE)
    each = np.arange(len(rt))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], rt[1:] != rt[:-1])), each, 0))
    owned, kind = rs[first] == 0, rt & 15
    alone = (rs == 0) & ((kind == WHOLE) | (kind == SELF))
    beside = owned & (rs >= 2) & ((kind == WHOLE) | (kind == BESIDE))
    other = owned & (rs == 1) & (kind == OTHER)
    x = np.concatenate((each[alone], first[beside], first[other])).astype(np.int32)
    y = np.concatenate((each[alone], each[beside], each[other])).astype(np.int32)
    e = np.repeat(np.array([0, 1, 0], np.int8), [alone.sum(), beside.sum(), other.sum()])
    none = np.zeros(0, np.int64)
    held, size = [(none, none)], 0
    for k in range(0, len(x), FRONTIER):
        for p, q in leaf_pairs(trie, x[k : k + FRONTIER], y[k : k + FRONTIER], e[k : k + FRONTIER], budget // BLOCKS):
            for pair in joined(trie, w, p, q, budget):
                held.append(pair)
                size += len(pair[0])
                if size > 4 * FRONTIER:  # what is held stays a forest
                    held = [forest(*(np.concatenate(c) for c in zip(*held)))]
                    size = len(held[0][0])
    return forest(*(np.concatenate(c) for c in zip(*held)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that join what the pairs (a, b) join: each member with the least of its component."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        differ = ru != rv
        if not differ.any():
            break
        u, v, ru, rv = u[differ], v[differ], ru[differ], rv[differ]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[member]], nodes[member]


def chunk_counts(own: np.ndarray, task_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of every value of every half, and of its neighbours, from the number of signatures that have it."""
    values = np.arange(1 << _WIDE)
    beside = np.zeros_like(own)
    for half, (_, width) in enumerate(_HALVES):
        for bit in range(width):
            free = (values >> bit & 1 == 0) & (values < 1 << width)
            beside[half, free] += own[half, values[free] | 1 << bit]
    return np.maximum(1, -(-own // task_rows)).ravel(), np.maximum(1, -(-beside // task_rows)).ravel()


def dealt(words: np.ndarray, half: int, chunks: np.ndarray, beside: np.ndarray):
    """(row, task, side) arrays of the tasks that signatures take part in by one half."""
    own = half_keys(words, half)
    hashed = mix64(np.ascontiguousarray(words).view(np.uint64)[:, 0])
    every = np.arange(len(words))

    def number(slot, i, j, kind):
        return slot << 42 | i << 23 | j << 4 | kind

    slot = half << _WIDE | own
    whole = (chunks[slot] == 1) & (beside[slot] == 1)
    yield every[whole], number(slot[whole], 0, 0, WHOLE), np.zeros(int(whole.sum()), np.int8)
    rows = every[~whole]
    many, mine = chunks[slot[rows]], (hashed[rows] % chunks[slot[rows]].astype(np.uint64)).astype(np.int64)
    for j in range(int(many.max(initial=0))):
        r, m = rows[many > j], mine[many > j]
        yield r, number(slot[r], np.minimum(m, j), np.maximum(m, j), np.where(m == j, SELF, OTHER)), (m > j).astype(np.int8)
    for q in range(int(beside[slot[rows]].max(initial=0))):
        some = beside[slot[rows]] > q
        yield rows[some], number(slot[rows[some]], mine[some], q, BESIDE), np.zeros(int(some.sum()), np.int8)
    for bit in range(_HALVES[half][1]):
        set_ = every[own >> bit & 1 == 1]
        slot = half << _WIDE | own[set_] ^ 1 << bit
        whole = (chunks[slot] == 1) & (beside[slot] == 1)
        yield set_[whole], number(slot[whole], 0, 0, WHOLE), np.full(int(whole.sum()), 2 + bit, np.int8)
        rows, at = set_[~whole], slot[~whole]
        q = (hashed[rows] % beside[at].astype(np.uint64)).astype(np.int64)
        for i in range(int(chunks[at].max(initial=0))):
            some = chunks[at] > i
            yield rows[some], number(at[some], i, q[some], BESIDE), np.full(int(some.sum()), 2 + bit, np.int8)


def _words(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(-1, 16)


def near_pairs(unique: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """Edges (src, dst) that connect the signatures within the budget of each other.

    ``unique`` has ``signature``, each once; ``n`` is the number of its rows.
    """
    spark = unique.sparkSession
    ship(spark)
    task_rows = TASK_ROWS

    def count(batches):
        own = np.zeros((len(_HALVES), 1 << _WIDE), np.int64)
        for batch in batches:
            words = _words(batch)
            for half in range(len(_HALVES)):
                own[half] += np.bincount(half_keys(words, half), minlength=1 << _WIDE)
        slot = np.flatnonzero(own.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(own.ravel()[slot], pa.int64())], names=["slot", "n"])

    own = np.zeros(len(_HALVES) << _WIDE, np.int64)
    # a row a value of a half: 81,920 at most, whatever the corpus
    for r in unique.select("signature").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        own[r.slot] = r.n
    sizes = spark.sparkContext.broadcast(tuple(a.astype(np.int32) for a in chunk_counts(own.reshape(len(_HALVES), -1), task_rows)))

    def deal(batches):
        for batch in batches:
            words = _words(batch)
            pair = np.ascontiguousarray(words).view(np.int64)
            chunks, beside = sizes.value
            for half in range(len(_HALVES)):
                for row, task, side in dealt(words, half, chunks, beside):
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(task.astype(np.int64)), pa.array(side), pa.array(pair[row, 0]), pa.array(pair[row, 1])], names=["task", "side", "hi", "lo"])

    def join(batches):
        held: list[pa.RecordBatch] = []
        for batch in _then_none(batches):
            if batch is not None:
                held.append(batch)
            if not held or (batch is not None and sum(b.num_rows for b in held) < AT_ONCE):
                continue
            rows = pa.Table.from_batches(held)
            task = rows.column("task").to_numpy()
            # all tasks but the last one are whole: rows come sorted by task
            end = len(task) if batch is None else int(np.searchsorted(task, task[-1]))
            held = rows.slice(end).to_batches() if end < len(task) else []
            if not end:
                continue
            pair = np.stack([rows.column(c).to_numpy()[:end] for c in ("hi", "lo")], 1)
            words = np.ascontiguousarray(pair).view(np.uint8).reshape(-1, 16)
            src, dst = join_tasks(task[:end], rows.column("side").to_numpy()[:end], words, budget)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(bytes, words[k])), pa.binary()) for k in (src, dst)], names=["src", "dst"])

    tasks = unique.select("signature").mapInArrow(deal, "task bigint, side tinyint, hi bigint, lo bigint")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-75 * n // (8 * AT_ONCE)))
    return tasks.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(join, "src binary, dst binary")


def _then_none(items):
    yield from items
    yield None


def components(edges: DataFrame) -> DataFrame:
    """``(id, group)``: the least id of the component, for every id that has an edge.

    Alternating large-star and small-star steps, which end after about log n rounds; each round is written to the shared folder.
    """
    edges = stored(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = stored(small.where("u <> v").distinct(), "edges")
        # done when every node has one edge, and no centre is a member elsewhere
        state = new.groupBy("u").count().agg(F.max("count")).first()[0]
        chained = new.join(new.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() if state == 1 else 1
        edges = new
        if state is None or (state == 1 and not chained):
            return new.select(F.col("u").alias("id"), F.col("v").alias("group"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """``(id_col, group_id, keep, n_links)`` of every row: its group's least id, and whether it is the row that stays.

    Documents with equal signatures, and groups joined by pairs within the budget, are one group. ``n_links`` is the
    number of links between different signatures that hold the group together. The row with the least id stays (a null
    id comes last), of rows with that id the one whose columns hash lowest; rows that repeat it in all columns are
    marked like it. Of two different texts under one id each belongs to its own group. A text that is null or has no
    word is a group of its own and stays, as do its repetitions. The id may have any type that has an order.
    """
    signed, classes = _grouped(docs, id_col, text_col, budget)
    known = signed.where("signature IS NOT NULL").join(classes, "signature")
    same = (F.col("k") == F.col("keeper.k")) & (F.col("h") == F.col("keeper.h"))
    found = known.select("id", F.col("keeper.id").alias("group_id"), same.alias("keep"), "n_links")
    bare = signed.where("signature IS NULL").select("id", F.col("id").alias("group_id"), F.lit(True).alias("keep"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(bare).withColumnRenamed("id", id_col)


def _grouped(docs: DataFrame, id_col: str, text_col: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """``(id, k, h, signature)`` of every row, and ``(signature, keeper, n_links)`` of every signature."""
    k, h = keyed(docs, id_col)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), k.alias("k"), h.alias("h"), F.col(f"`{text_col}`").alias("text"))
    signed = stored(signatures(own).select("id", "k", "h", "signature"), "signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "k")).alias("first")
    unique = stored(signed.where("signature IS NOT NULL").groupBy("signature").agg(first), "unique")
    roots = components(near_pairs(unique, unique.count(), budget))
    placed = unique.join(roots.withColumnRenamed("id", "signature"), "signature", "left").withColumn("root", F.coalesce("group", "signature")).drop("group")
    placed = stored(placed, "placed")
    groups = placed.groupBy("root").agg(F.min("first").alias("keeper"), (F.count("*") - 1).alias("n_links"))
    return signed, stored(placed.join(groups, "root").select("signature", "keeper", "n_links"), "classes")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the one that ``near_duplicates`` marks, once.

    Rows whose text is null or has no word all stay.
    """
    signed, classes = _grouped(docs, id_col, text_col, budget)
    stay = classes.select("keeper.k", "keeper.h", F.lit(True).alias("once")).distinct()
    stay = stay.unionByName(signed.where("signature IS NULL").select("k", "h", F.lit(False).alias("once")).distinct())
    repeated = not signed.where("signature IS NOT NULL").groupBy("k", "h").count().where("count > 1").isEmpty()
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no column's name clashes
    k, h = keyed(docs, id_col)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], k.alias("k"), h.alias("h")).join(stay, ["k", "h"])
    if repeated:  # rows that are equal in all columns: one of them
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k", "h").orderBy("once"))).where("NOT once OR nth = 1")
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document, and which one of the group stays."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
