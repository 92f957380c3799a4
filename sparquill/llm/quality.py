"""Quality rules by line sequence labelling, and a quality classifier by pairwise ranking.

Both are fitted on all labelled rows and then judge every document whole, without a shuffle: the models are a few
thousand numbers, and boilerplate lines' hashes, that travel with the task. What is made of labelled rows is stored and
added up where it lies, so that the driver has sums alone, whatever the number of labels and of rows that repeat an id.

Labels are of documents, so those of lines are found on the way. A line that several labelled texts
have, each among other lines, is boilerplate, wherever it is. The other lines of good documents are content. Those of
bad documents are latent: they start from hand-set weights and go by the model's own Viterbi path in turns
(hard EM), under the constraint that their label sets: half of their bytes are boilerplate at least.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import scratch, ship, stored
from .common import add_columns, blocks, strings
from .features import GRAMS, NAMES, document_features, gram_shares, line_features

#: What is made of the labelled rows is fitted on by the driver alone up to so many bytes, beyond it where it lies; the sums are the same.
LOCAL_BYTES = 1 << 22
#: Text bytes whose features are made at once: making them takes some 40 times as much memory.
PART_BYTES = 1 << 20
#: Tasks whose sums go to the driver at once.
TASKS = 64
#: Bits of the bitmap of labelled ids.
FILTER_BITS = 1 << 26
#: Padded lines of a block of documents that the CRF is fitted on together; a longer document is a block of its own.
FIT_BLOCK = 1 << 18
#: Labelled texts that a boilerplate line is in, at least, and the share of different neighbours it has in them.
LINE_TEXTS, LINE_NEIGHBOURS = 3, 0.8
#: Content share, by bytes, from which a document is retained: this, or this quantile of the labelled good ones if it is less.
MIN_CONTENT_SHARE, SHARE_QUANTILE = 0.5, 0.004
#: The classifier's threshold is this quantile of the labelled good documents' scores.
SCORE_QUANTILE = 0.002
#: Cells of the scores by which the pairs of documents add up: in the slope, linearly between cells, and in the curvature.
CELL, WIDE_CELL = 1 / 64, 1 / 2


def _id(column: str = "doc_id") -> F.Column:
    """An id of any type as text."""
    return F.col(column).cast("string")


def _marks(labels: DataFrame) -> DataFrame:
    """``(doc_id, quality)``: ids of any type, as text, each once.

    Labels with nulls, and other values than 0 and 1, count for nothing; of repeated labels the highest counts.
    """
    known = labels.select(_id().alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    return known.groupBy("doc_id").agg(F.max("quality").alias("quality"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, quality)`` of every row of ``docs`` that has a label."""
    return docs.select(_id().alias("doc_id"), "text").join(_marks(labels), "doc_id")


#: The former name.
labelled_sample = labelled


def _made(docs: DataFrame, labels: DataFrame, make, fields: list[str]) -> DataFrame:
    """``(doc_id, quality)`` and what ``make`` gives (lists of bytes by field) of every row that has a label, as a stored table.

    Texts aren't shuffled: a bitmap of hashed ids tells which rows may have a label, and what is made of them is joined.
    """
    spark = docs.sparkSession
    ship(spark)
    marks = stored(_marks(labels), "labels")
    bit = f"pmod(xxhash64(doc_id), {FILTER_BITS})"
    words = marks.selectExpr(f"{bit} DIV 64 AS word", f"shiftleft(1L, CAST({bit} % 64 AS INT)) AS mask").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        for batch in batches:
            at = batch.column("bit").to_numpy()
            whole = batch.filter(pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool)))
            for a, b in blocks(whole.column("text"), PART_BYTES):
                part = whole.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), *[pa.array(c, pa.binary()) for c in make(strings(part.column("text")))]], names=["doc_id", *fields])

    own = docs.select(_id().alias("doc_id"), "text").selectExpr("doc_id", f"{bit} AS bit", "text")
    made = own.mapInArrow(run, "doc_id string, " + ", ".join(f"{f} binary" for f in fields))
    # spread anew: one id may have most rows
    return stored(made.join(marks, "doc_id").hint("rebalance"), "made")


def _collected(made: DataFrame, fields: list[str], most: int) -> tuple[list[list[bytes]], np.ndarray] | None:
    """The fields and labels of all rows, in an order by id and value; none if they take more than ``most`` bytes."""
    size = made.agg(F.sum(sum(F.length(f) + 64 for f in fields))).first()[0] or 0
    if size > most:
        return None
    got = made.select("doc_id", "quality", *fields).collect()
    got.sort(key=lambda r: (r.doc_id, r.quality, bytes(r[2])))
    return [[bytes(r[2 + k]) for r in got] for k in range(len(fields))], np.array([r.quality for r in got], np.int64)


def _merged(parts: list) -> list:
    """Sums by place of arrays, and by cell of pairs (cells, sums); parts are put in an order, so that they add up alike each time."""
    out = []
    for column in zip(*sorted(parts, key=pickle.dumps)):
        if isinstance(column[0], tuple):
            cells = np.unique(np.concatenate([c for c, _ in column]))
            sums = np.zeros((len(cells), *column[0][1].shape[1:]))
            for c, v in column:
                sums[np.searchsorted(cells, c)] += v
            out.append((cells, sums))
        else:
            out.append(sum(column[1:], column[0]))
    return out


def _total(made: DataFrame, each) -> list:
    """What ``each`` gives for the parts of all Arrow batches, merged in each task and then by the driver, from ``TASKS`` tasks at most or one a core."""

    def run(batches):
        held = []
        for batch in batches:
            for part in each(batch):
                held = [_merged([*held, part])]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held[0])], pa.binary())], names=["v"])

    few = made.coalesce(max(TASKS, made.sparkSession.sparkContext.defaultParallelism))
    return _merged([pickle.loads(r.v) for r in few.mapInArrow(run, "v binary").collect()])


# linear-chain conditional random field

LINE_NAMES = (*NAMES, "again", "symbol_much", "upper_much", "adjacent_much", "known")
#: What a model without labels goes by: weights of "boilerplate" against "content".
PRIOR = dict.fromkeys(LINE_NAMES, 0.0) | {"one": -3.0, "symbol": 8.0, "upper": 3.0, "adjacent": 6.0, "symbol_much": 4.0, "upper_much": 3.0, "adjacent_much": 4.0, "known": 4.0}


def crf_inputs(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Line features with the derived ones, bytes of the lines, their hashes, lines of each text. ``known`` are hashes of boilerplate lines."""
    x, size, again, hashes, lines = line_features(texts)
    col = NAMES.index
    more = np.stack([again, x[:, col("symbol_words")] > 0.4, x[:, col("upper")] > 0.5, x[:, col("adjacent")] > 0.3, np.isin(hashes, known)], 1).astype(np.float32) if len(x) else np.zeros((0, 5), np.float32)
    return np.concatenate((x, more), 1), size, hashes, lines


def boilerplate_lines(docs: list[np.ndarray]) -> np.ndarray:
    """Hashes of the lines that are boilerplate: in ``LINE_TEXTS`` texts or more, among different lines in most of them.

    ``docs`` has the line hashes of each text; equal texts count once. Copies of a text share its lines, but with their
    neighbours, so these aren't boilerplate. A line that is alone, or first and last, has no neighbour to tell by.
    """
    before, after, texts = defaultdict(list), defaultdict(list), defaultdict(int)
    for doc in {d.tobytes(): d for d in docs}.values():
        line = doc.tolist()
        for k, h in enumerate(line):
            if k:
                before[h].append(line[k - 1])
            if k + 1 < len(line):
                after[h].append(line[k + 1])
        for h in set(line):
            texts[h] += 1
    out = [h for h, n in texts.items() if n >= LINE_TEXTS and any(len(s) >= LINE_TEXTS and len(set(s)) >= LINE_NEIGHBOURS * len(s) for s in (before[h], after[h]))]
    return np.array(sorted(out), np.uint64)


def line_states(rows: list[np.ndarray], quality: np.ndarray, model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """States of all lines, 1 being boilerplate: as the document's label has it where that tells, else by the model."""
    known = LINE_NAMES.index("known")
    out = []
    for x, q in zip(rows, quality):
        fixed = x[:, known] > 0
        state = fixed.astype(np.int8)
        if not q and len(x):
            state |= viterbi(x, np.array([len(x)]), model)
            size = np.expm1(10.0 * x[:, LINE_NAMES.index("length")])
            order = np.argsort(-(x @ model["w"]), kind="stable")
            order = order[state[order] == 0]
            # the likeliest of the rest, until half of the bytes are boilerplate
            lacking = size.sum() / 2 - size[state == 1].sum()
            state[order[: int(np.searchsorted(np.cumsum(size[order]), lacking)) + 1] if lacking > 0 else order[:0]] = 1
        out.append(state)
    return out


def _padded(rows: list[np.ndarray], states: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), max(1, lengths.max(initial=0)), len(LINE_NAMES)), np.float32)
    y = np.zeros(out.shape[:2], np.int8)
    for i, (r, s) in enumerate(zip(rows, states)):
        out[i, : len(r)] = r
        y[i, : len(r)] = s
    return out, y, lengths


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def prior_model() -> dict[str, np.ndarray]:
    return {"w": np.array([PRIOR[k] for k in LINE_NAMES]), "trans": np.array([[0.5, -0.5], [-0.5, 0.5]])}


def fit_crf(rows: list[np.ndarray], states: list[np.ndarray], quality: np.ndarray, start: dict[str, np.ndarray] | None = None, steps: int = 60, rate: float = 0.2, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights by gradient ascent (Adam) on the likelihood of the lines' states, documents of either label weighing alike.

    State 1 is boilerplate. Without lines of both states the start stays, which is the prior if none is given.
    """
    start = start or prior_model()
    groups = list(_groups(rows, states, quality, FIT_BLOCK))
    return _ascend(lambda f: _merged([f(*g) for g in groups]), start, steps, rate, l2)


def _groups(rows: list[np.ndarray], states: list[np.ndarray], quality: np.ndarray, limit: int):
    """(features, states, lines, labels) of documents of like lengths, padded: none is shorter than half the longest."""
    docs = sorted(((r, s, q) for r, s, q in zip(rows, states, quality) if len(r)), key=lambda p: -len(p[0]))
    at = 0
    while at < len(docs):
        long = len(docs[at][0])
        end = at + 1
        while end < len(docs) and (end - at + 1) * long <= limit and 2 * len(docs[end][0]) >= long:
            end += 1
        yield *_padded([d[0] for d in docs[at:end]], [d[1] for d in docs[at:end]]), np.array([d[2] for d in docs[at:end]])
        at = end


def _ascend(run, start: dict[str, np.ndarray], steps: int, rate: float = 0.2, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Adam on the likelihood of all groups; ``run(f)`` gives the merged f(features, states, lines, labels) of the groups."""
    prior = prior_model()["w"]
    w, trans = start["w"].copy(), start["trans"].copy()
    counts = run(lambda x, y, n, q: (np.bincount(q, n, 2), np.bincount(y[np.arange(y.shape[1])[None] < n[:, None]], minlength=2).astype(float)))
    if not counts or not counts[1].all():
        return {"w": w, "trans": trans}
    total = counts[0].sum()
    weight = 0.5 / np.maximum(counts[0] / total, 1e-6) if counts[0].all() else np.ones(2)
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        gw, gt = run(lambda x, y, n, q: crf_slope(x, y, n, weight[q] / total, w, trans))
        g = np.concatenate((gw - l2 * (w - prior), (gt - l2 * trans).ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, trans = w + move[: len(w)], np.clip(trans + move[len(w) :].reshape(2, 2), -3, 3)
    return {"w": w, "trans": trans}


def crf_slope(x: np.ndarray, y: np.ndarray, n: np.ndarray, scale: np.ndarray, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the likelihood of a padded group, its documents weighing ``scale``."""
    gt = np.zeros((2, 2))
    size, long = x.shape[:2]
    unary = np.zeros((size, long, 2))
    unary[:, :, 1] = x @ w
    live = np.arange(long)[None, :] < n[:, None]
    alpha, beta = np.zeros((size, long, 2)), np.zeros((size, long, 2))
    alpha[:, 0] = unary[:, 0]
    for t in range(1, long):
        alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + trans[None], 1) + unary[:, t]
    for t in range(long - 2, -1, -1):
        nxt = _log_sum(trans[None] + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(live[:, t + 1, None], nxt, 0)
    z = _log_sum(alpha[np.arange(size), n - 1], 1)
    # what follows a text's end would overflow, so it is left out before exp
    p = np.exp(np.where(live, alpha[:, :, 1] + beta[:, :, 1] - z[:, None], -np.inf))
    gw = ((y - p) * live * scale[:, None]).ravel() @ x.reshape(-1, x.shape[2])
    both = np.where(live[:, 1:, None, None], alpha[:, :-1, :, None] + trans + (unary[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None], -np.inf)
    gt -= (np.exp(both) * scale[:, None, None, None]).sum((0, 1))
    step_in = live[:, 1:] * scale[:, None]
    return gw, gt + np.bincount((2 * y[:, :-1].astype(int) + y[:, 1:]).ravel(), step_in.ravel(), 4).reshape(2, 2)


def viterbi(x: np.ndarray, lines: np.ndarray, model: dict[str, np.ndarray]) -> np.ndarray:
    """The likeliest states of all lines; all texts advance together, a line at a time. Ties go to content."""
    total = int(lines.sum())
    states = np.zeros(total, np.int8)
    if not total:
        return states
    unary = x @ model["w"]
    trans = model["trans"]
    starts = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    order = order[lines[order] > 0]
    count = lines[order]
    back = np.zeros((total, 2), np.int8)
    first = starts[order]
    s0, s1 = np.zeros(len(order)), unary[first].astype(np.float64)
    for t in range(1, int(count[0])):
        live = int(np.searchsorted(-count, -t, side="left"))  # texts with more than t lines
        at = first[:live] + t
        a0, a1 = s0[:live], s1[:live]
        to0 = np.stack((a0 + trans[0, 0], a1 + trans[1, 0]))
        to1 = np.stack((a0 + trans[0, 1], a1 + trans[1, 1]))
        back[at, 0], back[at, 1] = to0.argmax(0), to1.argmax(0)
        s0[:live], s1[:live] = to0.max(0), to1.max(0) + unary[at]
    state = (s1 > s0).astype(np.int8)
    for t in range(int(count[0]) - 1, -1, -1):
        live = int(np.searchsorted(-count, -t, side="left"))
        at = first[:live] + t
        states[at] = state[:live]
        if t:
            state[:live] = back[at, state[:live]]
    return states


def content_shares(rows: list[np.ndarray], sizes: list[np.ndarray], model: dict[str, np.ndarray]) -> np.ndarray:
    """Share of content by bytes of documents with lines; nan without."""
    lines = np.array([len(r) for r in rows])
    states = np.split(viterbi(np.concatenate(rows), lines, model), np.cumsum(lines)[:-1]) if rows else []
    return np.array([n[s == 0].sum() / n.sum() if len(n) else np.nan for s, n in zip(states, sizes)])


def fit_rules(rows: list[np.ndarray], hashes: list[np.ndarray], sizes: list[np.ndarray], quality: np.ndarray, rounds: int = 3, steps: int = 30) -> dict[str, np.ndarray]:
    """The model of labelled documents: weights, transitions, hashes of boilerplate lines, and the share to be retained."""
    known = boilerplate_lines(hashes)
    for x, h in zip(rows, hashes):
        x[:, LINE_NAMES.index("known")] = np.isin(h, known)
    model = prior_model()
    for _ in range(rounds):
        model = fit_crf(rows, line_states(rows, quality, model), quality, model, steps)
    good = [k for k, (r, q) in enumerate(zip(rows, quality)) if q and len(r)]
    shares = content_shares([rows[k] for k in good], [sizes[k] for k in good], model)
    least = float(np.quantile(shares, SHARE_QUANTILE, method="lower")) if len(good) else MIN_CONTENT_SHARE
    return model | {"known": known, "min_share": np.array(min(least, MIN_CONTENT_SHARE))}


def train_rules(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """A model of all lines of all labelled documents. Without labels it is the prior."""

    def make(texts):
        x, size, hashes, lines = crf_inputs(texts, np.zeros(0, np.uint64))
        cuts = np.cumsum(lines)[:-1]
        return [[p.tobytes() for p in np.split(a, cuts)] for a in (x, hashes, size.astype(np.int64))]

    with scratch(docs.sparkSession):
        fields = ["x", "hashes", "sizes"]
        made = _made(docs, labels, make, fields)
        local = _collected(made, fields, LOCAL_BYTES)
        if local is None:
            return _fit_rules_spread(made)
        (x, hashes, sizes), quality = local
        rows = [np.frombuffer(v, np.float32).reshape(-1, len(LINE_NAMES)).copy() for v in x]
        return fit_rules(rows, [np.frombuffer(v, np.uint64) for v in hashes], [np.frombuffer(v, np.int64) for v in sizes], quality)


def boilerplate_spread(made: DataFrame) -> np.ndarray:
    """``boilerplate_lines`` of stored rows: each text once, its lines and their neighbours counted by shuffles of hashes."""
    BEFORE, AFTER, TEXTS = range(3)

    def run(batches):
        for batch in batches:
            docs = batch.column("hashes").to_pylist()
            h = np.frombuffer(b"".join(docs), np.int64)
            of = np.repeat(np.arange(len(docs)), [len(d) // 8 for d in docs])
            inner = of[1:] == of[:-1]
            order = np.lexsort((h, of))
            new = np.concatenate(([True], (of[order][1:] != of[order][:-1]) | (h[order][1:] != h[order][:-1]))) if len(h) else np.zeros(0, bool)
            once = h[order][new]
            line = np.concatenate((h[1:][inner], h[:-1][inner], once))
            beside = np.concatenate((h[:-1][inner], h[1:][inner], np.zeros(len(once), np.int64)))
            side = np.repeat(np.array([BEFORE, AFTER, TEXTS], np.int8), [inner.sum(), inner.sum(), len(once)])
            yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(side), pa.array(beside)], names=["line", "side", "beside"])

    pairs = made.select("hashes").distinct().mapInArrow(run, "line bigint, side tinyint, beside bigint").groupBy("line", "side", "beside").agg(F.count("*").alias("n"))
    many = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    kinds = lambda side: F.count(F.when(F.col("side") == side, 1))
    lines = pairs.groupBy("line").agg(many(TEXTS).alias("texts"), many(BEFORE).alias("n0"), kinds(BEFORE).alias("d0"), many(AFTER).alias("n1"), kinds(AFTER).alias("d1"))
    apart = [(F.col(f"n{k}") >= LINE_TEXTS) & (F.col(f"d{k}") >= LINE_NEIGHBOURS * F.col(f"n{k}")) for k in (0, 1)]
    found = lines.where((F.col("texts") >= LINE_TEXTS) & (apart[0] | apart[1])).select("line").toArrow()
    return np.sort(found.column("line").to_numpy().astype(np.int64).view(np.uint64))


def _fit_rules_spread(made: DataFrame, rounds: int = 3, steps: int = 30) -> dict[str, np.ndarray]:
    """``fit_rules`` of stored rows: in each round their groups are stored with the states, and slopes add up where they lie."""
    spark = made.sparkSession
    known = boilerplate_spread(made)
    shared = spark.sparkContext.broadcast(known)

    def rows_of(batch):
        rows = [np.frombuffer(v, np.float32).reshape(-1, len(LINE_NAMES)).copy() for v in batch.column("x").to_pylist()]
        is_known = np.isin(np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64), shared.value)
        for x, own in zip(rows, np.split(is_known, np.cumsum([len(x) for x in rows])[:-1])):
            x[:, LINE_NAMES.index("known")] = own
        return rows

    def grouped(model):
        def run(batches):
            rows, quality, lines = [], [], 0
            for batch in _then_none(batches):
                if batch is not None:
                    rows += rows_of(batch)
                    quality += batch.column("quality").to_pylist()
                    lines = sum(map(len, rows))
                if rows and (batch is None or lines >= FIT_BLOCK):
                    q = np.array(quality, np.int64)
                    for g in _groups(rows, line_states(rows, q, model), q, FIT_BLOCK // 4):
                        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in packed(*g)], names=["x", "y", "n", "q"])
                    rows, quality = [], []

        return made.select("quality", "x", "hashes").mapInArrow(run, "x binary, y binary, n binary, q binary")

    model = prior_model()
    for _ in range(rounds):
        with scratch(spark):
            groups = stored(grouped(model), "groups")

            def run(f):
                def each(batch):
                    for row in zip(*[batch.column(c) for c in ("x", "y", "n", "q")]):
                        yield f(*unpacked(*[a.as_buffer() for a in row]))

                return _total(groups, each)

            model = _ascend(run, model, steps)

    def share(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(content_shares(rows_of(batch), [np.frombuffer(v, np.int64) for v in batch.column("sizes").to_pylist()], model))], names=["v"])

    good = made.where("quality = 1 AND length(x) > 0")
    n = good.count()
    least = _quantile(good.select("x", "hashes", "sizes").mapInArrow(share, "v double"), n, SHARE_QUANTILE, lower=True) if n else MIN_CONTENT_SHARE
    return model | {"known": known, "min_share": np.array(min(least, MIN_CONTENT_SHARE))}


def packed(x: np.ndarray, y: np.ndarray, n: np.ndarray, q: np.ndarray) -> list[bytes]:
    """A group's features, states, lines and labels as they are stored. Features go one by one and compressed, without loss: every step of the fit reads them."""
    features = np.ascontiguousarray(x.reshape(-1, len(LINE_NAMES)).T, np.float32)
    return [pa.compress(features.tobytes(), "zstd", asbytes=True), *[np.asarray(a, kind).tobytes() for a, kind in ((y, np.int8), (n, np.int64), (q, np.int64))]]


def unpacked(x, y, n, q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The group that ``packed`` gave."""
    y, n, q = np.frombuffer(y, np.int8), np.frombuffer(n, np.int64), np.frombuffer(q, np.int64)
    raw = np.frombuffer(pa.decompress(x, 4 * len(y) * len(LINE_NAMES), "zstd"), np.float32)
    return np.ascontiguousarray(raw.reshape(len(LINE_NAMES), -1).T).reshape(len(n), -1, len(LINE_NAMES)), y.reshape(len(n), -1), n, q


def _then_none(items):
    yield from items
    yield None


def quality_rules(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", min_share: float | None = None) -> DataFrame:
    """Add ``n_lines``, ``n_content_lines``, ``content_share`` (by bytes, of the lines that aren't blank) and ``keep``.

    A document is kept from the model's content share up (or ``min_share``), if it has any content. A null text, and
    one without a line that isn't blank, has the share null and isn't kept. Very long texts are labelled whole. Repeated
    rows are judged alike, an empty table gives no row. Input columns named like the added ones are replaced; all others stay.
    """
    least = float(model["min_share"]) if min_share is None else min_share

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = strings(batch.column(text_col))
        x, size, _, lines = crf_inputs(texts, model["known"])
        content = viterbi(x, lines, model) == 0
        sums = np.concatenate(([0], np.cumsum(np.where(content, size, 0))))
        count = np.concatenate(([0], np.cumsum(content)))
        alls = np.concatenate(([0], np.cumsum(size)))
        ends = np.cumsum(lines)
        starts = ends - lines
        whole = alls[ends] - alls[starts]
        share = (sums[ends] - sums[starts]) / np.maximum(whole, 1)
        return {"n_lines": pa.array(lines.astype(np.int32)), "n_content_lines": pa.array((count[ends] - count[starts]).astype(np.int32)), "content_share": pa.array(share, mask=whole == 0), "keep": pa.array((share >= least) & (share > 0))}

    fields = [T.StructField("n_lines", T.IntegerType()), T.StructField("n_content_lines", T.IntegerType()), T.StructField("content_share", T.DoubleType()), T.StructField("keep", T.BooleanType())]
    return add_columns(docs, make, fields, text_col, PART_BYTES)


# Bradley-Terry ranking


def fit_ranker(x: np.ndarray, quality: np.ndarray, pairs: int | None = None, seed: int = 7, l2: float = 1e-2, quantile: float = SCORE_QUANTILE) -> dict:
    """Weights by logistic loss on feature differences of all (good, bad) pairs, or of ``pairs`` drawn ones, and the threshold.

    The threshold is the ``quantile`` of the good documents' scores. Without a pair there is none: all texts pass.
    """
    if pairs is None:
        model = fit_pairs(lambda f: _merged([f(x, quality)] if len(x) else []), x.shape[1], l2)
    else:
        good, bad = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
        mean, std = x.mean(0), x.std(0) + 1e-3
        z = (x - mean) / std
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]

        def slope(w):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            return d.T @ (1 - p) / pairs, (d * (p * (1 - p))[:, None]).T @ d / pairs

        model = {"mean": mean, "std": std, "w": _newton(slope, x.shape[1], l2), "threshold": None}
    if len(set(quality.tolist())) == 2:
        model["threshold"] = float(np.quantile(((x - model["mean"]) / model["std"] @ model["w"])[quality == 1], quantile))
    return model


def _newton(slope, width: int, l2: float) -> np.ndarray:
    """The weights at which the slope vanishes; ``slope`` gives it and the curvature, without the penalty."""
    w = np.zeros(width)
    for _ in range(25):
        g, h = slope(w)
        step = np.linalg.solve(h + l2 * np.eye(width), g - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigma(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_pairs(run, width: int, l2: float = 1e-2) -> dict:
    """Weights by the mean logistic loss over all pairs of a good and a bad document; the threshold is left open.

    ``run(f)`` gives the merged f(features, labels) of blocks of documents. The pairs aren't formed: a document's slope is the sum
    over the other label's scores, which are counted by cells, and shared out linearly between the two next to them.
    """
    got = run(lambda x, q: (np.bincount(q, minlength=2).astype(float), x.sum(0), np.square(x).sum(0)))
    if not got or not got[0].all():
        mean = got[1] / got[0].sum() if got else np.zeros(width)
        return {"mean": mean, "std": np.ones(width), "w": np.zeros(width), "threshold": None}
    n, mean = got[0], got[1] / got[0].sum()
    std = np.sqrt(np.maximum(got[2] / n.sum() - mean**2, 0)) + 1e-3
    pairs = n[0] * n[1]

    def slope(w):
        def count(x, q):
            s = (x - mean) / std @ w
            out = []
            for label in (0, 1):
                at = s[q == label] / CELL
                low = np.floor(at)
                cells, where = np.unique(np.concatenate((low, low + 1)), return_inverse=True)
                out.append((cells, np.bincount(where, np.concatenate((1 - (at - low), at - low)), len(cells))))
                wide, many = np.unique(np.round(s[q == label] / WIDE_CELL), return_counts=True)
                out.append((wide, many.astype(float)))
            return out

        (bad, nb), (wide_bad, wb), (good, ng), (wide_good, wg) = run(count)
        bend = _sigma((wide_good[:, None] - wide_bad[None]) * WIDE_CELL)
        bend = bend * (1 - bend)
        most = max(1, (1 << 22) // len(bad))
        # of every pair the chance that the bad one is above, summed over the other side
        pull = {0: np.zeros(len(bad)), 1: np.zeros(len(good))}
        for k in range(0, len(good), most):
            p = _sigma((bad[None] - good[k : k + most, None]) * CELL)
            pull[1][k : k + most] = p @ nb
            pull[0] += ng[k : k + most] @ p
        cells, wide, weight = {0: bad, 1: good}, {0: wide_bad, 1: wide_good}, {0: wg @ bend, 1: bend @ wb}

        def add(x, q):
            z = (x - mean) / std
            s = z @ w
            g, h, out = np.zeros(width), np.zeros((width, width)), []
            for label in (0, 1):
                own, at = z[q == label], s[q == label]
                g += (1 if label else -1) * (np.interp(at / CELL, cells[label], pull[label]) @ own)
                cell, where = np.unique(np.round(at / WIDE_CELL), return_inverse=True)
                # where scores differ by rounding from those that were counted, the nearest cell
                near = np.minimum(np.searchsorted(wide[label], cell), len(wide[label]) - 1)
                h += (own * weight[label][near][where][:, None]).T @ own
                sums = np.zeros((len(wide[label]), width))
                np.add.at(sums, near[where], own)
                some = np.unique(near)
                out.append((some, sums[some]))  # cells by their place
            return g, h, *out

        g, h, (cb, zb), (cg, zg) = run(add)
        cross = zg.T @ bend[np.ix_(cg, cb)] @ zb
        return g / pairs, (h - cross - cross.T) / pairs

    return {"mean": mean, "std": std, "w": _newton(slope, width, l2), "threshold": None}


RANKED = ("upper", "symbol", "adjacent", "distinct", "symbol_words")
#: Where a feature's scale is bent: what exceeds this counts less.
BENT = {"upper": 0.3, "symbol": 0.05, "adjacent": 0.1, "distinct": 0.8, "symbol_words": 0.3}
WIDTH = 2 * len(RANKED) + GRAMS
#: Rows whose features are added up at once.
RANKED_ROWS = 1 << 14


def ranker_inputs(texts: pa.Array) -> np.ndarray:
    """Document features: shares of characters and words, plain and bent, and hashed byte trigrams."""
    x = document_features(texts)
    some = np.stack([x[:, NAMES.index(k)] for k in RANKED], 1)
    return np.concatenate((some, np.minimum(some, np.array([BENT[k] for k in RANKED], np.float32)), gram_shares(texts)), 1)


def train_ranker(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of all labelled rows, their features stored and added up where they lie."""
    with scratch(docs.sparkSession):
        made = _made(docs, labels, lambda texts: [[r.tobytes() for r in ranker_inputs(texts)]], ["x"])
        local = _collected(made, ["x"], LOCAL_BYTES)
        if local is not None:
            (values,), quality = local
            x = np.stack([np.frombuffer(v, np.float32) for v in values]).astype(np.float64) if values else np.zeros((0, WIDTH))
            return fit_ranker(x, quality)
        return _fit_spread(made)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)


def _fit_spread(made: DataFrame) -> dict:
    """``fit_ranker`` of stored rows."""

    def run(f):
        def each(batch):
            for k in range(0, batch.num_rows, RANKED_ROWS):
                part = batch.slice(k, RANKED_ROWS)
                yield f(_rows(part), part.column("quality").to_numpy().astype(np.int64))

        return _total(made.select("x", "quality"), each)

    model = fit_pairs(run, WIDTH)
    if not model["w"].any():
        return model

    def score(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, RANKED_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array((_rows(batch.slice(k, RANKED_ROWS)) - model["mean"]) / model["std"] @ model["w"])], names=["v"])

    good = made.where("quality = 1")
    return model | {"threshold": _quantile(good.select("x").mapInArrow(score, "v double"), good.count(), SCORE_QUANTILE)}


def _quantile(values: DataFrame, n: int, q: float, lower: bool = False) -> float:
    """The quantile of the ``n`` numbers ``v``, as numpy has it; only those below it are brought to the driver."""
    at = q * (n - 1)
    k = int(at)
    least = [r.v for r in values.orderBy("v").limit(k + 2).collect()]
    return least[k] if lower or at == k else least[k] + (at - k) * (least[k + 1] - least[k])


def quality_classifier(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Add ``quality_score`` and ``keep``, whether it reaches the model's threshold.

    A null or blank text has a null score and isn't kept. Very long texts are scored whole. Repeated rows have the same
    score, ties at the threshold are kept, an empty table gives no row. Input columns named like the added ones are
    replaced; all others stay.
    """

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = strings(batch.column(text_col))
        score = (ranker_inputs(texts) - model["mean"]) / model["std"] @ model["w"]
        blank = np.array([not t or t.isspace() for t in texts.to_pylist()], bool)
        keep = ~blank if model["threshold"] is None else ~blank & (score >= model["threshold"])
        return {"quality_score": pa.array(score.astype(np.float64), mask=blank), "keep": pa.array(keep)}

    return add_columns(docs, make, [T.StructField("quality_score", T.DoubleType()), T.StructField("keep", T.BooleanType())], text_col, PART_BYTES)


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content share of every document, and whether it is retained."""
    docs, labels = _tables(spark, sf_dir)
    return quality_rules(docs.select("doc_id", "text"), train_rules(docs, labels)).drop("text")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, and whether it is kept."""
    docs, labels = _tables(spark, sf_dir)
    return quality_classifier(docs.select("doc_id", "text"), train_ranker(docs, labels)).drop("text")
