"""Links between case narratives whose word n-grams overlap: a Jaccard self-join by T-occurrence search."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import settle
from plumbline.llm.components import connected_components
from plumbline.llm.word_ids import release_memory, text_slices

SHINGLE, PERCENT = 5, 80
#: N-grams known as frequent are counted as shared at once and never shuffled. The number never changes a result.
FREQUENT = 1 << 16
COUNT_BLOCK = 1_000_000
#: A block of a neighbourhood: so many cases, or so many n-grams, and a little more.
BLOCK_CASES, BLOCK_GRAMS = 512, 1_000_000
#: Cases of a block whose sketches are compared.
SKETCH_CASES = 8_192
#: Pairs of sketches compared at once.
SKETCH_PAIRS = 1 << 17
BYTES_PER_STEP = 2_000_000
#: Sets up to this size are looked up by all their n-grams.
SMALL = 128
_VIEW = np.array([0, 0, 0x5851F42D4C957F2D, 0x14057B7EF767814F], np.uint64)
#: Bits of the filter that keeps most other cases from being read twice; a full one only lets more through.
FILTER_BITS = 1 << 25
#: Bits of a key that go over the network to tell whether two classes have it; keys that meet by chance only let more classes through.
KEY_BITS = 40
_CELLS = "array<struct<low:int,i:int,j:int,next:boolean,side:int>>"
#: Weight of a binary probe against a step of the heap, as DivideSkip has it.
PROBE = 0.01


def _mix(h: np.ndarray, n: int, count: int) -> np.ndarray:
    """Digests of `count` runs of n words that begin at 0, 1, 2, ... of the word digests h."""
    out = np.full(count, n, np.uint64)
    for j in range(n):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : count + j]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def word_digests(texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit digests of the words of some texts in a row, and where each text's begin and the last one's end.

    A-Z are lower-cased, words are runs of anything but ASCII white space; a null text has none. Distinct words of
    a slice are digested once.
    """
    for _, some in text_slices(texts.fill_null(""), BYTES_PER_STEP):
        cut = pc.ascii_split_whitespace(pc.ascii_lower(some))
        words = cut.flatten().dictionary_encode()
        digests = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
        at = words.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])
        if (empty := words.dictionary.index("").as_py()) >= 0:  # before a leading and behind a trailing space
            real = at != empty
            ends = np.concatenate([[0], np.cumsum(real)])[ends]
            at = at[real]
        yield digests[at] if len(at) else np.zeros(0, np.uint64), ends


def ngram_sets(texts: pa.StringArray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit digests of the word n-grams of the whole of it.

    Words are those of `word_digests`. Fewer words than `size` make one n-gram; a null text or one without words has none.
    """
    for h, ends in word_digests(texts):
        grams = _mix(h, size, max(len(h) - size + 1, 0))
        for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            else:
                yield _mix(h[a:b], b - a, 1) if b > a else np.zeros(0, np.uint64)


def run_seeds(h: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, seed) of every run of `size` words inside a text. Equal runs have equal seeds: the least digest of the
    n-grams of half that size in them, which neighbouring runs mostly share."""
    gram = size // 2
    least, span, wanted = _mix(h, gram, max(len(h) - gram + 1, 0)), 1, size - gram + 1
    while 2 * span <= wanted:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[: max(len(least) - (wanted - span), 0)], least[wanted - span :])
    counts = np.maximum(np.diff(ends) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts - ends[:-1], counts)
    return text, place, least[place]


def ngram_set(text: str | None, size: int) -> np.ndarray:
    """The set of one text."""
    return next(ngram_sets(pa.array([text], pa.string()), size))


def least_overlap(n: int, m: int, percent: int) -> int:
    """The least intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def most_missing(n: int, percent: int) -> int:
    """The most n-grams of a set of n that a set linked to it can lack."""
    return n - -(-percent * n // 100)


def views(grams: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """(view, keys) under which a set is looked up; keys of different views never meet.

    Up to SMALL n-grams a set is looked up by all of them (view 1), above by those whose digest falls in a fixed share of
    all digests (view 2), twice what a linked set can lack. Sets a little over SMALL are in both views, so
    two sets that can be linked have a view in common. A large set with no more keys than it
    can lack is also looked up by all its n-grams (view 3). So of two linked sets
    at least one has, in a common view, more keys than it can lack, and they share a key.
    """
    n, out = len(grams), []
    if n == 0:
        return out
    if 100 * SMALL >= percent * n:
        out.append((1, grams))
    if n > SMALL:
        few = grams[(grams % np.uint64(100)) < np.uint64(2 * (100 - percent))] if percent > 50 else grams
        out.append((2, few ^ _VIEW[2]))
        if len(few) <= most_missing(n, percent):
            out.append((3, grams ^ _VIEW[3]))
    return out


def set_key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def class_number(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) >> 3


def _measure(size: int):
    """A row per case, and rows (gram, often) of the n-grams that a block of the task's sets has more than twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        kept, held = [], 0

        def often() -> pa.RecordBatch:
            grams, counts = np.unique(np.concatenate(kept), return_counts=True)
            grams, counts = grams[counts > 2], counts[counts > 2]
            none = [pa.nulls(len(grams), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(grams.view(np.int64)), pa.array(counts)], names)

        names = ["id", "text", "n", "key", "class", "gram", "often"]
        for batch in batches:
            n, keys, numbers = [], [], []
            for grams in ngram_sets(batch.column("rationale"), size):
                n.append(len(grams)), keys.append(set_key(grams)), numbers.append(class_number(grams))
                kept.append(grams)
                held += len(grams)
                if held >= COUNT_BLOCK:
                    yield often()
                    kept, held = [], 0
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(numbers, pa.int64()), none, none], names
            )
        if kept:
            yield often()
        release_memory()

    return run


def frequent_ngrams(counts: DataFrame) -> np.ndarray:
    """Sorted digests of the n-grams (gram, often) that tasks met most often: at most FREQUENT.

    A histogram of the counts in quarter octaves, some hundred rows, gives the least count that is taken.
    """
    totals = counts.groupBy("gram").agg(F.sum("often").alias("n"))
    step = F.floor(F.log2("n") * F.lit(4.0)).cast("int")
    histogram = sorted(((r["step"], r["n"]) for r in totals.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, taken = None, 0
    for at, n in histogram:
        taken += n
        if taken > FREQUENT:
            break
        least = at
    top = [] if least is None else totals.filter(step >= least).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in top], np.int64).view(np.uint64))


def _keys(size: int, percent: int, frequent: np.ndarray):
    """(owner, key) of every set's keys that are not frequent; owner is four times the class plus the view.

    For each owner one more row, with a key of its own, says how many of its keys have to be shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, keys, needs = [], [], []
            done = set()  # equal sets of a batch give equal rows
            for grams in ngram_sets(batch.column("rationale"), size):
                number = class_number(grams)
                if number in done:
                    continue
                done.add(number)
                for v, own in views(grams, percent):
                    plain = own ^ _VIEW[v]
                    if len(frequent):
                        own = own[frequent[np.minimum(np.searchsorted(frequent, plain), len(frequent) - 1)] != plain]
                    owners.append(np.full(len(own) + 1, 4 * number + v, np.int64))
                    keys.append(np.append(own.view(np.int64), 4 * number + v) & ((1 << KEY_BITS) - 1))
                    # of the keys that are left, those that must be shared
                    needs.append(np.append(np.full(len(own), -1, np.int32), np.int32(max(0, len(own) - most_missing(len(grams), percent)))))
            if owners:
                owner, key, need = map(np.concatenate, (owners, keys, needs))
                yield pa.RecordBatch.from_pydict({"owner": owner, "key": key, "need": need})
        release_memory()

    return run


def _whole_sets(size: int, bits: np.ndarray):
    """Sets of the cases that the filter lets through, each once a task; the text of the others is not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            batch = batch.filter(batch.column("id").is_valid())
            at = filter_places(batch.column("id").to_numpy())
            batch = batch.filter(pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))
            sets = {number: grams for grams in ngram_sets(batch.column("rationale"), size) if len(grams) and (number := class_number(grams)) not in done}
            done |= sets.keys()
            n, raw = pa.array([len(s) for s in sets.values()], pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), n, raw], ["class", "n", "grams"])
        release_memory()

    return run


def _each_class_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = set()
    for batch in batches:
        fresh = []
        for number in batch.column("class").to_pylist():
            fresh.append(number not in done)
            done.add(number)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def filter_places(ids: np.ndarray) -> np.ndarray:
    """The bit of each id in a filter of FILTER_BITS."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) % FILTER_BITS


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        at = filter_places(batch.column("id").to_numpy())
        np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    words = bits.view(np.int64)
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "word": words[at]})


def id_filter(ids: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of the given ids set: of a fixed size, so that it may go to every task."""
    words = ids.select("id").mapInArrow(_filter_words, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for part in words.toArrow().to_batches():
        out[part.column("at").to_numpy()] = part.column("word").to_numpy()
    return out.view(np.uint8)


def _maybe_in(bits: np.ndarray) -> Callable[[Column], Column]:
    """Whether an id may be one of those of the filter; NULL may. Ids alone go to Python."""

    @F.pandas_udf("boolean")
    def found(ids: pd.Series) -> pd.Series:
        at = filter_places(ids.fillna(0).to_numpy().astype(np.int64))
        return pd.Series(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool) | ids.isna().to_numpy())

    return found


def _maybe_met(bits: np.ndarray):
    """Rows whose class may be one of those of the filter; sets pass in bounded batches, a function of the class alone would queue them by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = filter_places(batch.column("class").to_numpy())
            yield batch.filter(pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)))

    return run


def _view_keys(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, number, view, key, most = batch.column("class").to_pylist(), [], [], [], []
            for i, raw in zip(ids, batch.column("grams").to_pylist(), strict=True):
                grams = np.frombuffer(raw, np.uint64)
                for v, keys in views(grams, percent):
                    number.append(np.full(len(keys), i, np.int64))
                    view.append(np.full(len(keys), v, np.int8))
                    key.append(keys.view(np.int64))
                    most.append(np.full(len(keys), most_missing(len(grams), percent) + 1, np.int32))
            if number:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (number, view, key, most)], ["class", "view", "key", "prefix"])

    return run


def merge_skip(lists: list[np.ndarray], least: int) -> Iterator[tuple[int, int]]:
    """(number, count) of the numbers that are in at least `least` of the sorted lists, by a heap that jumps."""
    lists = [x.tolist() for x in lists]
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top = heap[0][0]
        popped = []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= least:
            yield top, len(popped)
            to = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            to = heap[0][0]  # nothing below it can be in `least` lists
        for _, i, at in popped:
            at = bisect_left(lists[i], to, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))


class Links:
    """Union of local numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def divide_skip(queries: list[int], index: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between cases of `queries` and of `index` (numbers into sets), as a spanning forest.

    The numbers of the index that hold an n-gram form its inverted list. For a query the L longest of
    its lists are put aside; the short ones are merged with a heap for numbers met T - L times, which are
    then probed in the long lists by binary search, until T is reached or out of reach. Pairs
    that are linked through others already are not probed.
    """
    if not queries or not index:
        return []
    own = sorted(index, key=lambda i: len(sets[i]))
    grams = np.concatenate([sets[i] for i in own])
    numbers = np.repeat(np.arange(len(own)), [len(sets[i]) for i in own])
    order = np.argsort(grams, kind="stable")
    grams, numbers = grams[order], numbers[order]
    keys, starts = np.unique(grams, return_index=True)
    ends = np.append(starts[1:], len(grams))
    sizes = np.array([len(sets[i]) for i in own])
    links, out = Links(len(sets)), []
    for q in queries:
        x = sets[q]
        at = np.searchsorted(keys, x)
        at = at[keys[np.minimum(at, len(keys) - 1)] == x] if len(keys) else at[:0]
        low, high = -(-percent * len(x) // 100), 100 * len(x) // percent
        lo, hi = int(np.searchsorted(sizes, low)), int(np.searchsorted(sizes, high, side="right"))
        least = low  # of the smallest partner that is possible
        if len(at) < least or lo >= hi:
            continue
        # of each list only the numbers whose size fits
        lists = [numbers[starts[k] : ends[k]] for k in at]
        if lo > 0 or hi < len(own):
            lists = [v for v in (v[np.searchsorted(v, lo) : np.searchsorted(v, hi)] for v in lists) if len(v)]
        if len(lists) < least:
            continue
        lists.sort(key=len)
        long = min(least - 1, int(least / (PROBE * np.log2(len(lists[-1]) + 1) + 1)))
        short, probed = lists[: len(lists) - long], lists[len(lists) - long :]
        for y, met in merge_skip(short, least - long):
            other = own[y]
            if other == q or links.root(other) == links.root(q):
                continue
            need = least_overlap(len(x), len(sets[other]), percent)
            left = len(probed)
            for v in probed:
                if met >= need or met + left < need:
                    break
                left -= 1
                k = bisect_left(v, y)
                met += k < len(v) and v[k] == y
            if met >= need:
                links.up[links.root(other)] = links.root(q)
                out.append((q, other))
    return out


def sketch(grams: np.ndarray) -> np.ndarray:
    """For each residue of the digests whether an odd number of them has it, as a bit: a power of two bits, a bit for each n-gram at least.

    Bits in which the sketches of two sets differ are n-grams that only one of them has, each at least one of them. A sketch that is
    folded by xor is that of half the bits.
    """
    size = 64 << max(0, (len(grams) - 1) // 64).bit_length()
    odd = np.bincount((grams & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def likely_forest(left: np.ndarray, right: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """For each number the least number it is tied to: left and right ones are tied where sizes and sketches leave room for a link."""
    widths, folded, root = np.array(list(map(len, sketches))), {}, np.arange(len(n))
    left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
    step = min(64, max(1, SKETCH_PAIRS // max(1, len(right))))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        lo, hi = np.searchsorted(n[right], [-(-percent * n[some[0]] // 100), 100 * n[some[-1]] // percent + 1])
        near = right[lo:hi]
        if not len(near):
            continue
        words = min(widths[some].min(), widths[near].min())
        if words not in folded:
            folded[words] = np.stack([np.bitwise_xor.reduce(x.reshape(-1, words), axis=0) if len(x) >= words else np.zeros(words, np.uint64) for x in sketches])
        bits = folded[words]
        both = n[some][:, None] + n[near][None, :]
        room = both - 2 * (-(-percent * both // (100 + percent)))  # as least_overlap has it
        fits = np.abs(n[some][:, None] - n[near][None, :]) <= room
        differ = np.zeros(both.shape, np.int32)
        for k in range(words):
            differ += np.bitwise_count(bits[some, k][:, None] ^ bits[near, k][None, :])
        i, j = np.nonzero(fits & (differ <= room))
        a, b = some[i], near[j]
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return root


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [sketch(np.frombuffer(x, np.uint64)).tobytes() for x in batch.column("grams").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("n"), pa.array(bits, pa.binary())], ["class", "n", "bits"])
    release_memory()


def _sketch_cell(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        ids, side = rows.column("class").to_numpy(), rows.column("side").to_numpy()
        bits = [np.frombuffer(x, np.uint64) for x in rows.column("bits").to_pylist()]
        root = likely_forest(np.flatnonzero(side < 2), np.flatnonzero(side > 0), rows.column("n").to_numpy(), bits, percent)
        tied = np.flatnonzero(root != np.arange(len(root)))
        release_memory()
        return pa.table({"a": pa.array(ids[tied], pa.int64()), "b": pa.array(ids[root[tied]], pa.int64())})

    return run


def _join_cell(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("grams").to_pylist()]
        ids, side = rows.column("class").to_pylist(), rows.column("side").to_pylist()
        left, right = [r for r, s in enumerate(side) if s < 2], [r for r, s in enumerate(side) if s > 0]
        found = divide_skip(left, right, sets, percent)
        return pa.table({"a": pa.array([ids[a] for a, _ in found], pa.int64()), "b": pa.array([ids[b] for _, b in found], pa.int64())})

    return run


def linkable(cases: DataFrame, frequent: np.ndarray, size: int, percent: int) -> DataFrame:
    """class: the sets that can have a link, lacking in some view no more shared keys than a linked set may.

    A key is shared where two classes have it. Keys go over the network once, without the
    frequent ones, which are taken for shared. A class met by several tasks counts its shared keys
    several times, which can only let more through.
    """
    rows = cases.select("rationale").mapInArrow(_keys(size, percent, frequent), "owner long, key long, need int")
    met = Window.partitionBy("key")
    shared = rows.withColumn("__two", F.min("owner").over(met) < F.max("owner").over(met))
    counts = shared.groupBy("owner").agg(F.max("need").alias("need"), F.count_if("__two").alias("shared"))
    return counts.filter("shared >= need").select(F.shiftright("owner", 2).alias("class")).distinct()


def neighbourhoods(sets: DataFrame, percent: int) -> DataFrame:
    """node, root: classes whose rarest keys meet, directly or through others.

    sets: class, grams, a row for each class. In every view a class keeps one key more than it can lack, the rarest among the
    given classes first; two linked ones then have one in common. Each key ties its
    classes to the least of them. Counts combine on the map side; frequent keys are split by the join.
    """
    keys = sets.mapInArrow(_view_keys(percent), "class long, view byte, key long, prefix int")
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("hub"))
    rarest = Window.partitionBy("class", "view").orderBy("n", "key")
    first = keys.join(often, "key").withColumn("__at", F.row_number().over(rarest)).filter("__at <= prefix and n > 1")
    return connected_components(first.select(F.col("class").alias("a"), F.col("hub").alias("b")))


def block_cells(members: DataFrame, percent: int, size: Column) -> DataFrame:
    """class, unit, low, i, j, next, side: the pairs of blocks in which each member (class, n, unit) meets others.

    A neighbourhood is cut by size into bands as wide as a link allows, and a band by hash into blocks, `size` many.
    A block meets the blocks of its own band and of the next; each such pair of blocks is
    one group. So no task holds more than two blocks, however large a
    neighbourhood is. Blocks are dealt out on numbers and sizes.
    """
    # a little narrower than exact, so that rounding never parts a link by two bands
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) * F.lit(1 - 1e-6)).cast("int")
    members = members.select("class", "n", "unit", band.alias("band"))
    blocks = settle(members.groupBy("unit", "band").agg(size.cast("int").alias("own"), F.count(F.lit(1)).alias("cases")))
    above = blocks.select("unit", (F.col("band") - 1).alias("band"), F.col("own").alias("above"))
    below = blocks.select("unit", (F.col("band") + 1).alias("band"), F.col("own").alias("below"))
    near = blocks.join(above, ["unit", "band"], "left").join(below, ["unit", "band"], "left")
    dealt = members.select("class", "unit", "band").join(near, ["unit", "band"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.col("own")).cast("int"))

    def cells(count: str, cell) -> Column:
        """A group for each block of a band: (lower band, its block, the other's block, whether bands differ, the side)."""
        each = F.sequence(F.lit(0), F.coalesce(count, F.lit(0)) - 1)
        return F.when(F.coalesce(count, F.lit(0)) > 0, F.transform(each, cell)).otherwise(F.array().cast(_CELLS))

    me, here = F.col("block"), F.col("band")

    def cell(low: Column, i: Column, j: Column, next_: bool, side: Column) -> Column:
        return F.struct(low.alias("low"), i.alias("i"), j.alias("j"), F.lit(next_).alias("next"), side.cast("int").alias("side"))

    def inside(x: Column) -> Column:  # side 0 is searched for, 2 is the index, 1 is both
        return cell(here, F.least(me, x), F.greatest(me, x), False, F.when(x == me, 1).when(me < x, 0).otherwise(2))

    groups = F.concat(
        F.when(F.col("cases") > 1, cells("own", inside)).otherwise(F.array().cast(_CELLS)),  # one case alone has nobody to meet
        cells("above", lambda x: cell(here, me, x, True, F.lit(0))),
        cells("below", lambda x: cell(here - 1, x, me, True, F.lit(2))),
    )
    return dealt.select("class", "unit", F.inline(groups))


def _members(sets: DataFrame, units: DataFrame) -> DataFrame:
    return sets.select("class", "n").join(units.select(F.col("node").alias("class"), F.col("root").alias("unit")), "class")


def parted(sets: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """node, root: the neighbourhoods, the large ones parted where sketches leave no room for a link; a class without any drops out.

    In a large corpus rare n-grams meet by chance, and such ties join a growing share of all classes to one neighbourhood, whose blocks
    would each be sent to all others. A sketch has a few hundredths of the bytes of its set and parts unlinked sets almost
    always; linked ones it never parts. Neighbourhoods of one block stay as they are.
    """
    members = settle(_members(sets, units))
    crowds = members.groupBy("unit").agg(F.count(F.lit(1)).alias("cases"), F.sum("n").alias("grams"))
    crowds = settle(crowds.filter((F.col("cases") > BLOCK_CASES) | (F.col("grams") > BLOCK_GRAMS)).select("unit"))
    if crowds.isEmpty():
        return units
    placed = block_cells(members.join(crowds, "unit"), percent, F.ceil(F.count(F.lit(1)) / SKETCH_CASES))
    sketches = sets.mapInArrow(_sketches, "class long, n long, bits binary")
    likely = sketches.join(placed, "class").groupBy("unit", "low", "i", "j", "next").applyInArrow(_sketch_cell(percent), "a long, b long")
    others = members.join(crowds, "unit", "left_anti").select(F.col("class").alias("node"), F.col("unit").alias("root"))
    return others.unionByName(connected_components(likely))


def verified_links(sets: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """a, b: links of a spanning forest between the classes of each neighbourhood.

    Each pair of blocks is searched with an index of the one. Sets join the blocks they are dealt to once; those that meet
    nobody are not exchanged.
    """
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CASES), F.ceil(F.sum("n") / BLOCK_GRAMS))
    placed = settle(block_cells(_members(sets, units), percent, size))
    met = sets.select("class", "grams").mapInArrow(_maybe_met(id_filter(placed.select(F.col("class").alias("id")))), "class long, grams binary")
    return met.join(placed, "class").groupBy("unit", "low", "i", "j", "next").applyInArrow(_join_cell(percent), "a long, b long")


def _linked_classes(cases: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, text, n, key, class); classes (key, rep, class) of equal sets, rep the least id; links (a, b) between class numbers.

    text: a digest of the rationale. Classes without any id are not searched.
    """
    told = cases.withColumn("text", F.xxhash64("rationale"))
    both = settle(told.mapInArrow(_measure(size), "id long, text long, n long, key binary, class long, gram long, often long"))
    measured = both.filter("key is not null").drop("gram", "often")
    frequent = frequent_ngrams(both.filter("key is null").select("gram", "often"))
    classes = measured.filter("n > 0").groupBy("key").agg(F.min("id").alias("rep"), F.first("class").alias("class"))
    found = classes.join(linkable(cases, frequent, size, percent), "class").filter("rep is not null")
    found = settle(found.select("class", F.col("rep").alias("id")).distinct())
    kinds = "class long, n long, grams binary"
    sets = cases.mapInArrow(_whole_sets(size, id_filter(found)), kinds)
    if found.count() > FILTER_BITS // 64:  # then a filter lets many others through; as such they do no harm
        sets = sets.join(found, "class", "left_semi")
    # rows with one id can hold one set several times, and several sets
    sets = settle(sets.repartition("class").mapInArrow(_each_class_once, kinds))
    units = parted(sets, neighbourhoods(sets, percent), percent)
    return measured, classes, verified_links(sets, units, percent)


def link_cases(cases: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate components: id, n_shingles (set size), component_id (the least id reachable by links, its own included).

    cases: id (long), rationale. Two cases link when 100 * |A and B| >= percent * |A or B| of
    their sets of word n-grams. Cases with equal sets form a class, which is searched once, whatever ids its rows have. Classes
    that share too few n-grams with any other are set aside; those left whose rarest n-grams meet form
    neighbourhoods, large ones are parted by sketches, and inside them DivideSkip finds the links. All of it is exact.

    Nulls: a null, empty or blank rationale has an empty set, links with nothing and is its own component;
    a case without an id takes its class's component, or null alone. An id that occurs in several
    rows is one node that has the links of each. Very long texts are read whole. No cases: no rows. Other columns are not carried.
    """
    cases = cases.select(F.col("id").cast("long").alias("id"), "rationale")
    measured, classes, links = _linked_classes(cases, size, percent)
    full = measured.filter("n > 0")
    node = classes.filter("rep is not null").select("class", "rep")
    links = links.join(node.select(F.col("class").alias("a"), F.col("rep").alias("__a")), "a").join(node.select(F.col("class").alias("b"), F.col("rep").alias("__b")), "b")
    links = links.select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    # an id with several rows ties their classes together
    copies = classes.select("key", "rep")
    several = full.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 and id is not null").select("id")
    ties = full.join(several, "id").join(copies, "key").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = connected_components(links.unionByName(ties))
    out = measured.select("id", "n", "key").join(copies, "key", "left")
    out = out.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "id").alias("component_id"))


def one_of_each(cases: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of every group of near copies, with all its columns: the one with the least id, of equal ids the least digest of its text.

    Groups are of texts, not of ids: rows that share an id but not their text are judged each by its own links. Rows without an
    id rank last; a text that only such rows have is compared with equal sets alone. Of rows equal in id and text one
    stays. Null, empty and blank rationales have no set and all stay; very long texts are read whole. `kept_id`, `kept_text` and `kept_row` are taken by
    the operator, other columns may have any name. No cases: no rows.
    """
    named = cases.select(F.col("id").cast("long").alias("id"), "rationale")
    measured, _, links = _linked_classes(named, size, percent)
    roots = connected_components(links)
    grouped = measured.filter("n > 0").join(roots.withColumnRenamed("node", "class"), "class", "left")
    rank = F.struct(F.col("id").isNull().alias("late"), "id", "text")
    first = grouped.groupBy(F.coalesce("root", "class").alias("group")).agg(F.min(rank).alias("first"))
    chosen = settle(first.select(F.col("first.id").alias("kept_id"), F.col("first.text").alias("kept_text")))
    # an id with one row, which is chosen, needs no join: only the texts of other rows go over the network
    rows = measured.filter("n > 0 and id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    plain = chosen.groupBy("kept_id").agg(F.count(F.lit(1)).alias("chosen"))
    unsure = rows.join(plain, F.col("id") == F.col("kept_id"), "left").filter("rows > 1 or chosen is null").select("id")
    unsure = _maybe_in(id_filter(unsure))(F.col("id").cast("long"))
    blank = F.coalesce(F.rtrim(F.translate("rationale", "\t\n\v\f\r", "     ")), F.lit("")) == F.lit("")
    same = F.col("id").cast("long").eqNullSafe(F.col("kept_id")) & (F.xxhash64("rationale") == F.col("kept_text"))
    by_row = Window.partitionBy("kept_id", "kept_text").orderBy("kept_text")
    kept = cases.filter(~blank & unsure).join(chosen, same)
    kept = kept.withColumn("kept_row", F.row_number().over(by_row)).filter("kept_row = 1").drop("kept_id", "kept_text", "kept_row")
    return kept.unionByName(cases.filter(blank | ~unsure))
