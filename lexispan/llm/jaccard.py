"""N-gram Jaccard join by prefix trees, without loss: documents whose sets of word n-grams reach Jaccard similarity THRESHOLD, their classes and links.

Two documents are alike if |A and B| / |A or B| of their sets of N-word grams is at least THRESHOLD; classes are the connected components of likeness.
Every document is a query, and no link between different texts is lost.

1. Order. Grams get one global order, rarest first as far as two tables of COUNTERS counts of all documents tell (of words and of grams, by hash; fixed
   in size whatever the input): a gram that is more frequent than its counter's share of all grams comes late, others go by how frequent their words are.
   Any order is right; a good one is fast.
   Grams that only one text has lead to no partner; those that several have are marked in a bitmap (for some others, too, by hash; bounded in size), and the sets of
   2. and 4. are cut to them: what a set has left from a gram on are marked grams only, so most prefixes are short or empty.
2. Top of the tree. In this order the first gram that two alike sets share leaves at least THRESHOLD / (1 + THRESHOLD) * (n + m) grams from it on in both, so
   only the grams of the first part of a set (its prefix) open a bucket. Of the first SHARED grams that they share each leaves at most SHARED - 1 fewer, so prefixes are longer
   by that, and a pair must meet in SHARED buckets (in one, if so small that it may have fewer grams in common). In every bucket each set makes a pair with the smallest one if remaining lengths allow; in one of
   SOME sets or fewer, with every other.
3. A pair whose marks (the parities of a hash table of its grams, some 1/30 of a text) differ in more places than alike sets can differ in grams is out. The
   others are verified in prefix trees: sets, most frequent grams first, are stored in a tree whose unbranched stretches are one node, BLOCK at a time;
   the smaller set walks the tree, overlaps add up along shared paths, and subtrees are left out if the remaining lengths cannot reach the threshold.
   Verified links make classes.
4. What is left are pairs of different classes that share a bucket and whose remaining lengths allow a link; they are verified in the same way, and classes that are linked
   become one. Of a bucket of too many such pairs (over FEW for each set) no pair is put out: it is cut in blocks, and each of its sets walks the tree of each.
   Buckets are opened in rounds, of some ROUND grams of all sets each (by hash), so what a shuffle holds at once doesn't grow with the input.
5. n_links counts the other texts that a text is alike with: its class is walked in blocks, each set against the tree of each block.

Copies of one text are collapsed first, so thousands of copies cost no more than one; texts are told apart by two 64-bit hashes, grams by one.
A null text and one without words are in no class. A text of 1 to N - 1 words has one gram of all of them. Very long
texts are compared whole. Null doc_ids lose to any other and are never a group_id unless all are null. Repeated rows are copies like any other. Only doc_id and text
are used, and columns of any other name pass through onto what is kept. No rows, no classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispan.llm.common import apart, freed, gram_instances, gram_sets, mixed, remove, shared_folder, slices, utf8, word_hashes, written

N, THRESHOLD = 2, 0.5
#: Counts in each of the two tables that make the order; what is broadcast is 3 bytes for each.
COUNTERS, STRIDE = 1 << 20, 1 << 16
#: Sets in one prefix tree; pairs for each set of a bucket beyond which it is walked in blocks; sets of a bucket, and pairs, that are held at once;
#: sets of a bucket up to which all its pairs are tried at once.
BLOCK, FEW, HELD, PAIRS, SOME = 256, 64, 1 << 20, 1 << 20, 4
#: Buckets that two alike sets share at least, if they must have as many grams in common: pairs that share fewer are out.
SHARED = 4
#: Keys or labels that are broadcast, if a count finds no more of them; beyond that they are joined by shuffle, after a bitmap of SLOTS bits has left out most other rows.
BROADCAST_ROWS, SLOTS = 1 << 18, 1 << 27
#: Most bits of the bitmap of grams that several texts have; grams of a task that are sorted out at once, and parts that they are counted in.
MARKED_BITS, GATHERED, PARTS = 29, 1 << 20, 1 << 10
#: Leading bits that tell grams apart there: a part and 32 more.
GRAM_BITS = PARTS.bit_length() - 1 + 32
#: Grams of all sets (a third to a half of them are entries) whose buckets are opened in one round.
ROUND = 1 << 29
KEY = ("v", "w")
#: Whether a text has words.
_WORDS = "text RLIKE '[0-9A-Za-z\\\\x{80}-\\\\x{10FFFF}]'"
ENTRY = "gram long, v long, n int, left int"


class _Node:
    __slots__ = ("children", "leaves", "low", "high", "grams", "end")

    def __init__(self, grams: np.ndarray, end: int):
        self.children: list[_Node] = []
        self.leaves: list[int] = []
        self.grams, self.end = grams, end
        self.low = self.high = -1


def _tree(sets: list[np.ndarray], order: list[int]) -> _Node:
    """Prefix tree of sorted sets given in lexicographic order; a node holds the grams of an unbranched stretch."""
    root = _Node(np.zeros(0, np.int64), 0)
    path, last = [root], np.zeros(0, np.int64)
    for i in order:
        s = sets[i]
        k = min(len(s), len(last))
        differ = np.flatnonzero(s[:k] != last[:k])
        shared = int(differ[0]) if len(differ) else k
        while path[-1].end > shared:
            node = path.pop()
            start = node.end - len(node.grams)
            if start < shared:  # the stretch branches here
                upper = _Node(node.grams[: shared - start], shared)
                node.grams = node.grams[shared - start :]
                upper.children.append(node)
                path[-1].children[-1] = upper
                path.append(upper)
        if len(s) > shared:
            node = _Node(s[shared:], len(s))
            path[-1].children.append(node)
            path.append(node)
        path[-1].leaves.append(i)
        last = s
    todo, nodes = [root], []
    while todo:
        nodes.append(node := todo.pop())
        todo += node.children
    for node in reversed(nodes):
        sizes = [node.end] * bool(node.leaves) + [c.low for c in node.children]
        node.low, node.high = min(sizes, default=0), max([node.end] * bool(node.leaves) + [c.high for c in node.children], default=0)
    return root


class Tree:
    """A prefix tree of sets of grams, none of them empty."""

    def __init__(self, sets: list[np.ndarray]):
        self.words, index, freq = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.words), np.int64)
        self.rank[np.lexsort((self.words, -freq))] = np.arange(len(self.words))
        self.size, lo, ranked = [len(s) for s in sets], 0, []
        for n in self.size:
            ranked.append(np.sort(self.rank[index[lo : lo + n]]))
            lo += n
        self.root = _tree(ranked, sorted(range(len(sets)), key=lambda i: ranked[i].astype(">u4").tobytes()))
        self.inside = np.zeros(len(self.words), dtype=bool)

    def alike(self, probe: np.ndarray, threshold: float = THRESHOLD) -> list[int]:
        """Indexes of the stored sets whose Jaccard similarity with probe (sorted, distinct) reaches the threshold."""
        n, share = len(probe), threshold / (1 + threshold)
        place = np.minimum(np.searchsorted(self.words, probe), len(self.words) - 1)
        s = np.sort(self.rank[place[self.words[place] == probe]])
        self.inside[s] = True
        todo, out = [(self.root, 0)], []
        while todo:
            node, overlap = todo.pop()
            if node.high < n * threshold - 1e-9 or node.low * threshold > n + 1e-9:
                continue
            if len(node.grams):
                overlap += int(np.count_nonzero(self.inside[node.grams]))
                left = len(s) - int(np.searchsorted(s, node.grams[-1], side="right"))
                if overlap + min(left, node.high - node.end) < share * (n + node.low) - 1e-9:
                    continue
            out += [j for j in node.leaves if overlap >= threshold * (n + self.size[j] - overlap) - 1e-9]
            todo += [(c, overlap) for c in node.children]
        self.inside[s] = False
        return out


def hashed(docs: DataFrame) -> DataFrame:
    """docs with __v and __w, which tell texts apart."""
    return docs.withColumns({"__v": F.xxhash64("text"), "__w": F.xxhash64(F.lit(1), "text")})


def _texts(docs: DataFrame) -> DataFrame:
    """v, w and text of every row with words."""
    return docs.where(_WORDS).select(F.xxhash64("text").alias("v"), F.xxhash64(F.lit(1), "text").alias("w"), "text")


def _small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if a count says that they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _met(keys: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash v is one of keys: true for all of them, and for some others. What is broadcast is a bitmap of SLOTS bits, whatever the number of keys."""
    size = min(SLOTS, STRIDE)

    def blocks(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for b, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["block", "bits"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = np.unique(batch.column("v").to_numpy() & (SLOTS - 1))
            for part in np.split(slot, np.flatnonzero(np.diff(slot // size)) + 1):
                if len(part):
                    x = np.zeros(size, np.uint8)
                    x[part % size] = 1
                    b, x = int(part[0] // size), np.packbits(x, bitorder="little")
                    found[b] = found[b] | x if b in found else x
        yield from blocks(found)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("bits")):
                x = np.frombuffer(x.as_buffer(), np.uint8)
                found[b] = found[b] | x if b in found else x
        yield from blocks(found)

    bits = np.zeros((SLOTS // size, size // 8), np.uint8)
    for r in keys.select("v").mapInArrow(mark, "block int, bits binary").repartition("block").mapInArrow(add, "block int, bits binary").collect():  # SLOTS / 8 bytes at most
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(bits.ravel())

    def test(v: pa.Array) -> pa.Array:
        slot = v.to_numpy(zero_copy_only=False) & (SLOTS - 1)
        return pa.array((shared.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool))

    return F.arrow_udf(test, "boolean")


def _labelled(rows: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """rows, left-joined with labels by on, of which the first is a hash. Labels too many to be broadcast meet by shuffle only rows that may have one."""
    if labels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(labels), on, "left")
    met = _met(labels.select(F.col(on[0]).alias("v")))(F.col(on[0]))
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in labels.schema if f.name not in on]
    columns = [*on, *[c for c in rows.columns if c not in on]]
    return rows.where(met).join(labels, on, "left").unionByName(rows.where(~met).select(*columns, *others))


class _Once:
    """Tells which keys of a batch a task hasn't seen yet, so that copies meet before the shuffle. Forgets what it saw rather than to grow; that costs time only."""

    def __init__(self, most: int = 1 << 18):
        self.seen, self.most = set(), most

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if len(self.seen) > self.most:
            self.seen.clear()
        keep = []
        for i, key in enumerate(zip(batch.column("v").to_pylist(), batch.column("w").to_pylist())):
            if key not in self.seen:
                self.seen.add(key)
                keep.append(i)
        return batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))


def counts(texts: DataFrame, n: int, folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words, and how many grams of all sets, fall on each counter; and a bitmap of the grams that several texts have, which some others pass, too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, once, held = np.zeros((2, COUNTERS), np.int64), _Once(), []
        for batch in batches:
            for part in slices(once(batch), "text"):
                words, grams, *_ = _sets(part, n)
                for k, x in ((0, words), (1, grams)):
                    table[k] += np.bincount(_slot(x), minlength=COUNTERS)
                held.append(_leading(grams, GRAM_BITS))
                if sum(map(len, held)) >= GATHERED:
                    yield from gathered(held)
                    held = []
        yield from gathered(held)
        yield from blocks({b: x for b, x in enumerate(table.reshape(-1, STRIDE)) if x.any()}, int(table.sum()) % 16)

    def gathered(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
        cut = np.searchsorted(x, np.arange(PARTS + 1) << 32)
        yield from blocks({-1 - k: x[cut[k] : cut[k + 1]].astype(np.uint32) for k in np.flatnonzero(np.diff(cut)).tolist()}, 0)

    def blocks(found: dict[int, np.ndarray], salt: int) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([salt] * len(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["block", "salt", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("counts")):
                total[b] = total.get(b, 0) + np.frombuffer(x.as_buffer(), np.int64)
        yield from blocks(total, 0)

    kind = "block int, salt int, counts binary"
    seen = written(texts.mapInArrow(count, kind), folder, "counts")
    each = seen.where("block >= 0").repartition("block", "salt").mapInArrow(add, kind).repartition("block").mapInArrow(add, kind)
    out = np.zeros((2, COUNTERS), np.int64)
    for r in each.collect():  # 2 * COUNTERS / STRIDE rows, whatever the input
        out.reshape(-1, STRIDE)[r["block"]] = np.frombuffer(r["counts"], np.int64)
    # As many bits as grams of all sets, or twice that.
    bits = min(MARKED_BITS, max(PARTS.bit_length() + 5, int(out[1].sum()).bit_length()))
    size = (1 << bits) // PARTS

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for b, x in zip(batch.column("block").to_pylist(), batch.column("counts")):
                if b != block and held:
                    yield from blocks({block: marked(held)}, 0)
                    held = []
                block = b
                held.append(np.frombuffer(x.as_buffer(), np.uint32))
        if held:
            yield from blocks({block: marked(held)}, 0)

    def marked(held: list[np.ndarray]) -> np.ndarray:
        x = np.sort(np.concatenate(held))
        on = np.zeros(size, np.uint8)
        on[x[1:][x[1:] == x[:-1]].astype(np.int64) >> (32 - size.bit_length() + 1)] = 1
        return np.packbits(on, bitorder="little")

    found = np.zeros((PARTS, size // 8), np.uint8)
    for r in seen.where("block < 0").repartition("block").sortWithinPartitions("block").mapInArrow(several, kind).collect():  # 2 ** MARKED_BITS / 8 bytes at most
        found[-1 - r["block"]] = np.frombuffer(r["counts"], np.uint8)
    remove(texts.sparkSession, f"{folder}/counts")
    return out[0], out[1], found.ravel()


def _leading(grams: np.ndarray, bits: int) -> np.ndarray:
    return (grams >> np.uint64(64 - bits)).astype(np.int64)


def _marked(grams: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which grams several texts have, by a bitmap of counts."""
    slot = _leading(grams, (8 * len(bitmap)).bit_length() - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


def order_of(words: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What places a gram in the order: a code for each word's counter, and one for each gram's that is 0 unless the counter stands out."""
    mean = grams.sum() / len(grams)
    above = np.maximum(grams - mean - 2 * np.sqrt(mean), 0)
    return np.round(8 * np.log2(np.maximum(words, 1))).astype(np.uint16), np.floor(np.log2(1 + above)).astype(np.uint8)


def _sets(part: pa.RecordBatch, n: int, order: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes; grams of the set of each row, sorted within it (in the order, if there is one, else by hash); and the size of each set."""
    data, at = utf8(part.column("text"))
    words, rows = word_hashes(data, at)
    count = len(at) - 1
    grams, owner, where, width = gram_instances(words, rows, count, n)
    if order is None:
        by = np.lexsort((grams, owner))
    else:
        code, above = order
        sums = np.concatenate([[0], np.cumsum(code[_slot(words)], dtype=np.int64)])
        key = above[_slot(grams)].astype(np.int64) * 4096 + np.minimum(sums[where + width] - sums[where], 4095)
        by = np.lexsort((grams, owner * (1 << 20) + key))
    grams, owner = grams[by], owner[by]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return words, grams[new], np.bincount(owner[new], minlength=count)


def _rows(columns: dict[str, np.ndarray], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    total = len(next(iter(columns.values())))
    for lo in range(0, total, most):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + most]) for x in columns.values()], list(columns))


def entries(texts: DataFrame, order, bitmap, n: int, threshold: float, turn: int = 0, turns: int = 1) -> DataFrame:
    """gram, v, n, left: of the marked grams of each set those of its prefix and SHARED - 1 more, with the set's size and how many marked grams it has from there on. Only grams of one of turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in batches:
            for part in slices(once(batch), "text"):
                _, grams, size = _sets(part, n, order.value)
                row = np.repeat(np.arange(len(size)), size)
                some = _marked(grams, bitmap.value)
                grams, row = grams[some], row[some]
                many = np.bincount(row, minlength=len(size))
                left = np.repeat(np.cumsum(many), many) - np.arange(len(grams))
                full = size[row]
                # A partner has at least threshold * full grams in common with the set, all of them marked.
                keep = (left >= threshold * full - (SHARED - 1) - 1e-9) & (many[row] >= threshold * full - 1e-9)
                if turns > 1:
                    keep &= mixed(grams) % np.uint64(turns) == turn
                yield from _rows({"gram": grams[keep].view(np.int64), "v": part.column("v").to_numpy()[row[keep]], "n": full[keep].astype(np.int32), "left": left[keep].astype(np.int32)})

    return texts.mapInArrow(run, ENTRY)


def _allowed(n: np.ndarray, left: np.ndarray, m: np.ndarray, rest: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of sizes n and m with so many grams left from a shared one on may be alike, and that gram be one of the first SHARED that they share."""
    least = np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)
    spare = np.where(least >= SHARED, SHARED - 1, 0)
    return (np.minimum(left, rest) >= least - spare) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)


def _weight(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """What a shared bucket counts for sets of sizes n and m: SHARED, all that is asked for, if alike ones may have fewer grams than that in common."""
    return np.where(np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9) >= SHARED, 1, SHARED).astype(np.int32)


def _summed(a: np.ndarray, b: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair a, b once, with the sum of its k."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    edge = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    return a[edge], b[edge], np.add.reduceat(k[order], edge).astype(np.int32) if len(a) else k


def _enough(pairs: DataFrame) -> DataFrame:
    """Distinct pairs a, b whose k make up SHARED."""
    return pairs.groupBy("a", "b").agg(F.sum("k").alias("k")).where(F.col("k") >= SHARED).select("a", "b")


def _columns(batch: pa.RecordBatch, held: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
    x = {k: batch.column(k).to_numpy() for k in batch.schema.names}
    return x if held is None else {k: np.concatenate([held[k], c]) for k, c in x.items()}


def _starts(gram: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1]) if len(gram) else np.zeros(0, np.int64)


def _in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], int | None]]:
    """Rows sorted by gram: whole buckets, many at a time; one of more than HELD rows comes alone and in parts, with its gram."""
    held = flood = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _columns(batch, held)
        if flood is not None:
            end = int(np.searchsorted(x["gram"] != flood, True)) if x["gram"][0] == flood else 0
            if end:
                yield {k: c[:end] for k, c in x.items()}, flood
                x = {k: c[end:] for k, c in x.items()}
            if not len(x["gram"]):
                held = None
                continue
        flood, last = None, int(_starts(x["gram"])[-1])
        if last:
            yield {k: c[:last] for k, c in x.items()}, None
        held = {k: c[last:] for k, c in x.items()}
        if len(held["gram"]) > HELD:
            flood = held["gram"][0]
            yield held, flood
            held = None
    if held is not None:
        yield held, None


def _useful(x: dict[str, np.ndarray], threshold: float) -> dict[str, np.ndarray]:
    """Without entries whose set has too few grams left for any partner in the bucket; rows are sorted by gram, size and v."""
    share = threshold / (1 + threshold)
    for _ in range(2):
        if not len(x["gram"]):
            return x
        starts = _starts(x["gram"])
        many = np.diff(np.append(starts, len(x["gram"])))
        head = np.repeat(starts, many)
        other = (x["v"] != x["v"][head]).astype(np.int64)
        several = np.repeat(np.add.reduceat(other, starts) > 0, many)
        # The smallest partner of the first set is not below itself; of any other, not below the first and the size that the threshold allows.
        least = np.maximum(np.ceil(threshold * x["n"] - 1e-9), x["n"][head])
        keep = several & (x["left"] >= share * (x["n"] + least) - (SHARED - 1) - 1e-9)
        x = {k: c[keep] for k, c in x.items()}
    return x


def _partners(many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within stretches of rows, many rows each, some PAIRS at a time."""
    end = np.repeat(np.cumsum(many), many)
    after = end - np.arange(len(end)) - 1
    total, lo = np.cumsum(after), 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, side="right")))
        a = np.repeat(np.arange(lo, hi), after[lo:hi])
        yield a, np.arange(len(a)) - np.repeat(np.cumsum(after[lo:hi]) - after[lo:hi], after[lo:hi]) + a + 1
        lo = hi


def _once_each(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Without copies of a set in a bucket; rows are sorted by gram, size and v."""
    new = np.ones(len(x["gram"]), dtype=bool)
    new[1:] = (x["v"][1:] != x["v"][:-1]) | (x["n"][1:] != x["n"][:-1]) | (x["gram"][1:] != x["gram"][:-1])
    return {k: c[new] for k, c in x.items()}


def buckets(rows: DataFrame, threshold: float) -> DataFrame:
    """The entries of buckets of two sets or more that may have a partner; h names the smallest set of the bucket where an entry's set may be alike with it, k is what the bucket counts for that.

    Of a bucket of SOME sets or fewer only the pairs (h, v) that may be alike are left, without a gram: most buckets are such, and need no second look."""

    def put(x: dict[str, np.ndarray], h: np.ndarray, m: np.ndarray, none: np.ndarray) -> Iterator[pa.RecordBatch]:
        weight = _weight(x["n"], m, threshold)
        for lo in range(0, len(none), 1 << 16):
            cut = slice(lo, lo + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(x[k][cut]) for k in ("gram", "v", "n", "left")] + [pa.array(h[cut], mask=none[cut]), pa.array(weight[cut])], ["gram", "v", "n", "left", "h", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # the smallest set of a bucket that comes in parts
        for x, flood in _in_buckets(batches):
            if flood is not None:
                first = first if first is not None and first["gram"][0] == flood else {k: c[:1] for k, c in x.items()}
                h, n, left = (np.repeat(first[k], len(x["gram"])) for k in ("v", "n", "left"))
                yield from put(x, h, n, (x["v"] == h) | ~_allowed(x["n"], x["left"], n, left, threshold))
                continue
            x, first = _useful(_once_each(x), threshold), None
            if not len(x["gram"]):
                continue
            many = np.diff(np.append(_starts(x["gram"]), len(x["gram"])))
            few = np.repeat(many <= SOME, many)
            y, x = {k: c[few] for k, c in x.items()}, {k: c[~few] for k, c in x.items()}
            for a, b in _partners(many[many <= SOME]):
                ok = _allowed(y["n"][a], y["left"][a], y["n"][b], y["left"][b], threshold) & (y["v"][a] != y["v"][b])
                h, v, k = _summed(y["v"][a[ok]], y["v"][b[ok]], _weight(y["n"][a[ok]], y["n"][b[ok]], threshold))
                none = pa.nulls(len(h), pa.int64())
                if len(h):
                    yield pa.RecordBatch.from_arrays([none, pa.array(v), none.cast(pa.int32()), none.cast(pa.int32()), pa.array(h), pa.array(k)], ["gram", "v", "n", "left", "h", "k"])
            many = many[many > SOME]
            head = np.repeat(np.cumsum(many) - many, many)
            if len(head):
                yield from put(x, x["v"][head], x["n"][head], (x["v"] == x["v"][head]) | ~_allowed(x["n"], x["left"], x["n"][head], x["left"][head], threshold))

    return rows.repartition("gram").sortWithinPartitions("gram", "n", "v").mapInArrow(run, f"{ENTRY}, h long, k int")


def crossing(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs a, b of different classes that share a bucket and may be alike, with what their buckets count (k), in parts; of a bucket that has too many such pairs its sets (a) under one key.

    rows: entries with the class c of each set."""

    def put(a: np.ndarray, b: np.ndarray | None = None, k: np.ndarray | None = None, key: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([none if key is None else pa.array(key), pa.array(a), none if b is None else pa.array(b), none.cast(pa.int32()) if k is None else pa.array(k)], ["key", "a", "b", "k"])

    def whole(x: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """All buckets of x at once."""
        x = _once_each(x)
        starts = _starts(x["gram"])
        many = np.diff(np.append(starts, len(x["gram"])))
        several = np.logical_or.reduceat(x["c"] != x["c"][np.repeat(starts, many)], starts)
        x = {k: c[np.repeat(several, many)] for k, c in x.items()}
        if not len(x["gram"]):
            return
        many = many[several]
        of = np.repeat(np.arange(len(many)), many)
        # Pairs of different classes in each bucket: all but those of one class.
        order = np.lexsort((x["c"], of))
        edge = np.flatnonzero(np.append(True, (of[order][1:] != of[order][:-1]) | (x["c"][order][1:] != x["c"][order][:-1])))
        alike = np.bincount(of[order][edge], np.diff(np.append(edge, len(of))).astype(float) ** 2, len(many))
        hot = (many.astype(float) ** 2 - alike) / 2 > FEW * np.maximum(many, FEW)
        if hot.any():
            # Buckets of the same sets, as the grams of one passage open, have one key.
            keys = np.bitwise_xor.reduceat(mixed(x["v"].view(np.uint64)), np.cumsum(many) - many).view(np.int64)
            yield put(x["v"][hot[of]], key=keys[of][hot[of]])
            x, of, many = {k: c[~hot[of]] for k, c in x.items()}, of[~hot[of]], many[~hot]
        for a, b in _partners(many):
            ok = (x["c"][a] != x["c"][b]) & _allowed(x["n"][a], x["left"][a], x["n"][b], x["left"][b], threshold)
            if ok.any():
                yield put(*_summed(x["v"][a[ok]], x["v"][b[ok]], _weight(x["n"][a[ok]], x["n"][b[ok]], threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, flood in _in_buckets(batches):
            if flood is not None:
                yield put(x["v"], key=np.full(len(x["v"]), flood))
            else:
                yield from whole(x)

    return rows.repartition("gram").sortWithinPartitions("gram", "n", "v").mapInArrow(run, "key long, a long, b long, k int")


def signed(texts: DataFrame, n: int) -> DataFrame:
    """v, w, n and mark of every text: mark has a bit for each of a power of two of slots, at least twice as many as grams, that tells whether an odd number of grams falls on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in batches:
            for part in slices(once(batch), "text"):
                grams, at = gram_sets(*utf8(part.column("text")), n)
                size = np.diff(at)
                bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
                lo = np.cumsum(bits) - bits
                row = np.repeat(np.arange(len(size)), size)
                odd = np.bincount(lo[row] + (grams & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())) & 1
                packed = np.packbits(odd.astype(np.uint8), bitorder="little")
                ends = pa.array(np.append(lo, bits.sum()) // 8, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("v"), part.column("w"), pa.array(size.astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(size), [None, ends.buffers()[1], pa.py_buffer(packed)])], ["v", "w", "n", "mark"])

    return texts.mapInArrow(run, "v long, w long, n int, mark binary").dropDuplicates([*KEY])


def sieved(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Pairs av, aw, bv, bw (a the smaller set) of distinct pairs a, b whose marks allow likeness: sets differ in at least as many grams as their marks in bits, so no alike pair is lost.

    A v that two texts have stands for both."""
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in ("an", "bn"))
            keep = np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9
            most = (n + m) - 2 * np.ceil(share * (n + m) - 1e-9)
            for i in np.flatnonzero(keep):
                x, y = (np.frombuffer(batch.column(k)[int(i)].as_buffer(), np.uint64) for k in ("am", "bm"))
                while len(x) > len(y):  # a mark of half the slots is one half against the other
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while len(y) > len(x):
                    y = y[: len(y) // 2] ^ y[len(y) // 2 :]
                keep[i] = int(np.bitwise_count(x ^ y).sum()) <= most[i]
            out = batch.select(["av", "aw", "bv", "bw"]).filter(pa.array(keep))
            if out.num_rows:
                yield out

    side = lambda x: marks.select(F.col("v").alias(x), F.col("w").alias(f"{x}w"), F.col("n").alias(f"{x}n"), F.col("mark").alias(f"{x}m"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("a").alias("av"), "aw", "an", "am", F.col("b").alias("bv"), "bw", "bn", "bm")
    return both.mapInArrow(run, "av long, aw long, bv long, bw long")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = _Once()
    for batch in batches:
        yield once(batch)


def _wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with the text of each v and w. Copies of a text meet in each task first; what reads this takes the same row twice for one."""
    keys = wanted.select(*KEY).distinct()
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    some = texts.join(F.broadcast(keys), [*KEY], "left_semi") if few else texts.where(_met(keys)(F.col("v")))
    return some.mapInArrow(_once, "v long, w long, text string").join(_small(wanted), [*KEY])


def walked(wanted: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """Pairs (av, aw; bv, bw) of a walking set (role 1) and a stored one (role 0) of the same key (kv, kw) and block that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stored, sets, tree, last = None, [], [], None, None
        for batch in batches:
            for part in slices(batch, "text"):
                grams, at = gram_sets(*utf8(part.column("text")), n)
                out: list[tuple[int, int, int, int]] = []
                for i, (*key, role, v, w) in enumerate(zip(*(part.column(k).to_pylist() for k in ("kv", "kw", "block", "role", "v", "w")))):
                    if key != block:
                        block, stored, sets, tree, last = key, [], [], None, None
                    if last == (role, v, w):
                        continue
                    last = (role, v, w)
                    own = grams[at[i] : at[i + 1]]
                    if not role:
                        stored.append((v, w))
                        sets.append(own.copy())
                        continue
                    if tree is None and stored:
                        tree, sets = Tree(sets), []
                    if tree is not None:
                        out += [(v, w, *stored[j]) for j in tree.alike(own, threshold) if stored[j] != (v, w)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["av", "aw", "bv", "bw"])

    rows = _wanted(texts, wanted).repartition("kv", "kw", "block").sortWithinPartitions("kv", "kw", "block", "role", "v", "w")
    return rows.mapInArrow(run, "av long, aw long, bv long, bw long")


def verified(pairs: DataFrame, texts: DataFrame, folder: str, n: int, threshold: float) -> DataFrame:
    """Those of distinct pairs (av, aw; bv, bw) that are alike: a walks the trees of its partners, BLOCK of them or so in each."""
    heavy = pairs.groupBy("av", "aw").count().where(F.col("count") > BLOCK).withColumnRenamed("count", "many")
    block = F.pmod(F.xxhash64("bv", "bw"), F.ceil(F.coalesce("many", F.lit(1)) / F.lit(BLOCK))).cast("int")
    stored = pairs.join(heavy, ["av", "aw"], "left").select(F.col("av").alias("kv"), F.col("aw").alias("kw"), block.alias("block"), F.lit(0).alias("role"), F.col("bv").alias("v"), F.col("bw").alias("w"))
    walking = stored.select("kv", "kw", "block", F.lit(1).alias("role"), F.col("kv").alias("v"), F.col("kw").alias("w")).distinct()
    return walked(written(stored.unionByName(walking), folder, "wanted"), texts, n, threshold)


def among(members: DataFrame, texts: DataFrame, folder: str, n: int, threshold: float) -> DataFrame:
    """All alike pairs, in both directions, of the sets (v, w) of each key (kv, kw): it is cut in blocks, and each of its sets walks the tree of each."""
    sizes = members.groupBy("kv", "kw").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("many"))
    members = members.join(sizes.where("many > 1"), ["kv", "kw"], "left").withColumn("many", F.coalesce("many", F.lit(1)))
    stored = members.select("kv", "kw", F.pmod(F.xxhash64("v", "w"), "many").cast("int").alias("block"), F.lit(0).alias("role"), "v", "w")
    walking = members.select("kv", "kw", F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("block"), F.lit(1).alias("role"), "v", "w")
    return walked(written(stored.unionByName(walking), folder, "wanted"), texts, n, threshold)


def counted(labels: DataFrame, texts: DataFrame, folder: str, n: int, threshold: float) -> DataFrame:
    """v, w, n_links: the number of other texts that each text of a class is alike with."""
    members = labels.select(F.col("a.v").alias("v"), F.col("a.w").alias("w"), F.col("b.v").alias("kv"), F.col("b.w").alias("kw"))
    return among(members, texts, folder, n, threshold).groupBy(F.col("av").alias("v"), F.col("aw").alias("w")).agg(F.count("*").alias("n_links"))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """a, b for every vertex a of edges: b is the least vertex of its component."""
    now, k, before = written(edges, folder, "edges0"), 0, None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before, k = mark, k + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least("a", F.min("b").over(Window.partitionBy("a")))
        large = both.select(F.col("b").alias("u"), F.col("a").alias("of"), least.alias("m")).where("u > of").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
        small = large.select("a", "b", F.min("b").over(Window.partitionBy("a")).alias("m"))
        pairs = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.*").where("a > b").distinct()
        now = written(pairs, folder, f"edges{k}")
        remove(now.sparkSession, f"{folder}/edges{k - 1}")
    return now.unionByName(now.select(F.col("b").alias("a"), "b").distinct())


def _edges(pairs: DataFrame) -> DataFrame:
    a, b = (F.struct(F.col(f"{x}v").alias("v"), F.col(f"{x}w").alias("w")) for x in "ab")
    return pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def classes(texts: DataFrame, folder: str, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """a, b (structs of v and w) for every text that is alike with another: b is the least text of its class."""
    spark = texts.sparkSession
    words, grams, bitmap = counts(texts, n, folder)
    turns = max(1, -(-int(grams.sum()) // ROUND))
    order, bitmap = spark.sparkContext.broadcast(order_of(words, grams)), spark.sparkContext.broadcast(bitmap)
    freed(spark)
    for k in range(turns):
        written(buckets(entries(texts, order, bitmap, n, threshold, k, turns), threshold), folder, f"buckets{k}")
        freed(spark)
    several = [spark.read.parquet(f"{folder}/buckets{k}") for k in range(turns)]
    opened = reduce(DataFrame.unionByName, several)
    marks = written(signed(texts, n), folder, "marks")
    freed(spark)
    of_buckets = opened.where("h IS NOT NULL").select(F.col("h").alias("a"), F.col("v").alias("b"), "k", F.col("gram").isNull().alias("all"))
    tried = written(_enough(of_buckets), folder, "tried")
    maybe = written(sieved(tried, marks, threshold), folder, "maybe0")
    links = written(verified(maybe, texts, f"{folder}/0", n, threshold), folder, "links0")
    labels = written(components(_edges(links), f"{folder}/0"), folder, "labels0")
    freed(spark)
    # A v that two texts have is in no class yet, so that all its pairs are tried.
    of = labels.select(F.col("a.v").alias("v"), F.xxhash64("b").alias("c")).groupBy("v").agg(F.count("*").alias("texts"), F.first("c").alias("c")).where("texts = 1").select("v", "c")
    of = written(of, folder, "of")
    for k, some in enumerate(several):
        rows = _labelled(some.where("gram IS NOT NULL").select("gram", "v", "n", "left"), of, ["v"]).withColumn("c", F.coalesce("c", "v"))
        written(crossing(rows, threshold), folder, f"crossing{k}")
        freed(spark)
    met = reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/crossing{k}") for k in range(turns)])
    # Small buckets count again, all their pairs; those with the smallest set of a large one are among the pairs of that.
    every = met.where("b IS NOT NULL").select("a", "b", "k").unionByName(of_buckets.where("all").select("a", "b", "k"))
    pairs = _enough(every).join(tried, ["a", "b"], "left_anti")
    maybe = written(sieved(pairs, marks, threshold), folder, "maybe1")
    links = links.unionByName(written(verified(maybe, texts, f"{folder}/1", n, threshold), folder, "links1"))
    hot = met.where("b IS NULL").select(F.col("key").alias("kv"), F.lit(0).cast("long").alias("kw"), F.col("a").alias("v")).distinct()
    if not hot.isEmpty():
        hot = written(hot.join(marks.select(*KEY), "v"), folder, "hot")
        links = links.unionByName(written(among(hot, texts, f"{folder}/2", n, threshold), folder, "links2"))
    labels = written(components(_edges(links), f"{folder}/all"), folder, "labels")
    for name in ("marks", "tried", "of", "maybe0", "maybe1", "hot", "0", "1", "2", "all", "links0", "links1", "links2", "labels0", *[f"{x}{k}" for x in ("buckets", "crossing") for k in range(turns)]):
        remove(spark, f"{folder}/{name}")
    freed(spark)
    return labels


def texts_in_groups(docs: DataFrame, folder: str, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, __v, __w, g_v, g_w for every row of docs with words: its text and the first text of its class; and the labels and texts that were used."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = _texts(rows)
    labels = classes(texts, folder, n, threshold)
    of = labels.select(F.col("a.v").alias("__v"), F.col("a.w").alias("__w"), F.col("b.v").alias("g_v"), F.col("b.w").alias("g_w"))
    named = _labelled(hashed(rows.where(_WORDS)).drop("text"), of, ["__v", "__w"])
    return named.select("doc_id", "__v", "__w", F.coalesce("g_v", "__v").alias("g_v"), F.when(F.col("g_v").isNull(), F.col("__w")).otherwise(F.col("g_w")).alias("g_w")), labels, texts


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, group_id (the least doc_id of its class) and n_links (how many other texts it is alike with) of every row of a class of two rows or more."""
    folder = shared_folder(docs.sparkSession)
    rows, labels, texts = texts_in_groups(docs, folder, n, threshold)
    rows = written(rows, folder, "rows")
    several = written(rows.groupBy("g_v", "g_w").agg(F.count("*").alias("n"), F.min("doc_id").alias("group_id")).where("n > 1").drop("n"), folder, "several")
    links = written(counted(labels, texts, f"{folder}/n", n, threshold), folder, "n_links").select(F.col("v").alias("__v"), F.col("w").alias("__w"), "n_links")
    found = rows.join(_small(several), ["g_v", "g_w"]).join(_small(links), ["__v", "__w"], "left")
    return found.select("doc_id", "group_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def thinned(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, that of the least doc_id, and of equal ones that of the least hash of the text; rows in no class stay."""
    return apart(lambda d: _thinned(d, n, threshold), docs)


def _thinned(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    folder = shared_folder(docs.sparkSession)
    rows = written(texts_in_groups(docs, folder, n, threshold)[0], folder, "rows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__v", "__w")
    least = rows.groupBy("g_v", "g_w").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    # Only texts of classes have a row here; the others find none and stay.
    verdict = written(rows.select("__v", "__w", "g_v", "g_w").distinct().join(least, ["g_v", "g_w"]).select("__v", "__w", F.col("first").alias("__first")), folder, "verdict")
    first = F.col("__first")
    judged = _labelled(hashed(docs), verdict, ["__v", "__w"])
    left = judged.where(first.isNull() | ((first["__v"] == F.col("__v")) & (first["__w"] == F.col("__w")) & first["doc_id"].eqNullSafe(F.col("doc_id").cast("long"))))
    # What is left of a class are rows of one doc_id and text; one of them stays.
    several = least.where("n > 1").select(F.col("first.__v").alias("__v"), F.col("first.__w").alias("__w"), F.col("first.doc_id").alias("__id"))
    again = rows.join(_small(several), ["__v", "__w"]).where(F.col("doc_id").eqNullSafe(F.col("__id"))).groupBy("__v", "__w").count().where("count > 1")
    if again.isEmpty():
        return left.drop("__v", "__w", "__first")
    turn = F.row_number().over(Window.partitionBy("__v", "__w").orderBy(F.lit(1)))
    once = left.where(first.isNotNull()).withColumn("__turn", turn).where("__turn = 1").drop("__turn")
    return left.where(first.isNull()).unionByName(once).drop("__v", "__w", "__first")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same classes and links by comparing all pairs, for N = 2.
GROUPS_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, text, regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= {THRESHOLD}e0 * (x.n + y.n - k)),
r AS (SELECT DISTINCT a, a AS m FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.m),
h AS (SELECT a AS doc_id, min(m) AS group_id FROM r GROUP BY a),
l AS (SELECT e.a AS doc_id, count(DISTINCT y.text) FILTER (WHERE y.text <> x.text) AS n_links FROM e JOIN w x ON x.doc_id = e.a JOIN w y ON y.doc_id = e.b GROUP BY e.a)
SELECT doc_id, group_id, n_links FROM h JOIN l USING (doc_id)
"""
