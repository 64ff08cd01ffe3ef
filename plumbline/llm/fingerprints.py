"""Threshold-scaled fingerprints of case narratives: all shingle hashes below a fixed fraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import settle
from plumbline.llm.word_ids import release_memory, text_slices

#: Code points of a shingle; a power of two.
SHINGLE = 16
#: One hash in 2 ** SCALE_BITS is retained.
SCALE_BITS = 5
BYTES_PER_STEP = 1_000_000
#: Code points hashed at once; stretches of a longer text overlap by a shingle less one.
POINTS_PER_STEP = 1_000_000
ROWS_PER_CELL = 500
#: Bound of the table of cells that is broadcast: one row each.
MAX_CELLS = 1 << 20

_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that equal fractions of the range are equally likely."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(points: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of `size` code points, built from halves; `size` is a power of two."""
    h, width, factor = _mixed(points.astype(np.uint64) + np.uint64(1)), 1, _BASE
    while width < size:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    return _mixed(h)


def plain_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row and where each ends: A-Z lower-cased, a run of ASCII white space as one space."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points + np.where((points >= 65) & (points <= 90), np.uint32(32), np.uint32(0))
    space = ((points >= 9) & (points <= 13)) | (points == 32)
    points[space] = 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    starts = (ends - np.diff(ends, prepend=0))[np.diff(ends, prepend=0) > 0]
    keep[starts] = True
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The retained hashes of every text, sorted and distinct.

    A text shorter than a shingle is one shingle. A text none of whose hashes is low enough keeps its least one.
    """
    points, ends = plain_points(texts)
    starts = np.concatenate([[0], ends[:-1]])
    found_at, found = [], []
    for since in range(0, len(points) - SHINGLE + 1, POINTS_PER_STEP):
        h = shingle_hashes(points[since : since + POINTS_PER_STEP + SHINGLE - 1])
        at = np.flatnonzero(h >> np.uint64(64 - SCALE_BITS) == 0)
        found_at.append(at + since), found.append(h[at])
    at, h = np.concatenate([np.zeros(0, np.int64), *found_at]), np.concatenate([np.zeros(0, np.uint64), *found])
    text_of = np.searchsorted(ends, at, side="right")
    whole = at + SHINGLE <= ends[text_of] if len(at) else np.zeros(0, bool)
    at, h, text_of = at[whole], h[whole], text_of[whole]
    cut = np.searchsorted(text_of, np.arange(len(texts) + 1))
    out = []
    for t, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        some = np.unique(h[cut[t] : cut[t + 1]])
        if not len(some) and b > a:
            rest = points[a:b]
            if b - a < SHINGLE:  # padded with no code point
                rest = np.concatenate([rest, np.full(SHINGLE - (b - a), 0xFFFFFFFF, np.uint32)])
            some = np.array([min(shingle_hashes(rest[i : i + POINTS_PER_STEP + SHINGLE - 1]).min() for i in range(0, len(rest) - SHINGLE + 1, POINTS_PER_STEP))])
        out.append(some)
    return out


def as_text(sketch: np.ndarray) -> str:
    """Hashes as 16 hex digits each, in order, joined by commas."""
    return sketch.astype(">u8").tobytes().hex(",", 8)


def _fingerprint(columns: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in columns:
                prints = []
                for _, some in text_slices(batch.column(c), BYTES_PER_STEP):
                    prints += map(as_text, sketches([x or "" for x in some.to_pylist()]))
                out.append(pa.array(prints, pa.string()))
            keep = [i for i, name in enumerate(batch.schema.names) if name not in columns]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *out], [*(batch.schema.names[i] for i in keep), *names])
        release_memory()

    return run


def fingerprint_cases(cases: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Fingerprints of whole texts: every hash of a 16-point shingle below one part in 32 of the range.

    cases: id and further columns. columns: text column to name of its fingerprint, `rationale` to `fingerprint` by
    default; the text columns named are replaced, all others are kept as they are. A fingerprint is
    a string of sorted 16-digit hex hashes joined by commas. The threshold is the same for every text, so
    fingerprints can be merged (`merged`) and compared however unequal the texts are (`containment`, `similarity`).

    A-Z count as a-z, runs of ASCII white space as one space. A text shorter than a shingle is one shingle; a
    text none of whose hashes is below the threshold keeps its least hash, so only null and empty texts have the empty
    fingerprint. Equal texts have equal fingerprints. Very long texts are hashed whole, in overlapping stretches. Repeated
    rows and null ids are kept. A new name that another column has is refused by Spark. No cases: no rows.
    """
    columns = columns or {"rationale": "fingerprint"}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in cases.schema if f.name not in columns]
    return cases.mapInArrow(_fingerprint(list(columns), list(columns.values())), ", ".join([*kept, *(f"`{n}` string" for n in columns.values())]))


def _hashes(fingerprint: Column) -> Column:
    return F.filter(F.split(F.coalesce(fingerprint, F.lit("")), ","), lambda h: h != F.lit(""))


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts together: of both, not of their concatenation, whose seam has shingles of its own."""
    return F.array_join(F.array_sort(F.array_union(_hashes(a), _hashes(b))), ",")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; equal fingerprints contain each other, else an empty one nothing."""
    hashes = _hashes(a)
    share = F.size(F.array_intersect(hashes, _hashes(b))) / F.greatest(F.size(hashes), F.lit(1))
    return F.when(a.eqNullSafe(b), F.lit(1.0)).otherwise(share)


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles of two texts, 0 to 1; 1 for equal fingerprints, empty ones too."""
    x, y = _hashes(a), _hashes(b)
    both = F.size(F.array_intersect(x, y))
    return F.when(a.eqNullSafe(b), F.lit(1.0)).otherwise(both / F.greatest(F.size(x) + F.size(y) - both, F.lit(1)))


def with_next(cases: DataFrame) -> DataFrame:
    """Every case with the rationale of the next one by descending id; after the last case comes the first.

    cases: id (a number), rationale. Returns id, rationale, next_rationale. Ids are cut into cells of some hundred cases
    along an even grid; only the first case of a cell is copied, to the end of the cell before it, so texts are shuffled once
    and no window spans the table. Null ids come last, dealt by a digest of their text. Cases of one id follow each other by
    text. A single case is its own next one. Null and empty texts are carried as they are. Other columns are not carried.
    No cases: no rows.
    """
    base = cases.select("id", "rationale")
    ids = base.select("id")
    rows, least, most = ids.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
    count = max(1, min(MAX_CELLS // 2, rows // ROWS_PER_CELL))
    least, most = (0, 0) if least is None else (least, most)
    grid = F.floor((F.col("id") - F.lit(least)).cast("double") / F.lit(max(1.0, float(most - least + 1) / count)))
    late = F.pmod(F.xxhash64("rationale"), F.lit(count)) - F.lit(count)  # null ids: cells below all others
    if base.filter("id IS NULL").isEmpty():
        base = base.withColumn("cell", grid)
    else:
        base = base.withColumn("cell", F.coalesce(grid, late))
    heads = settle(base.groupBy("cell").agg(F.max("id").alias("head")))
    first = heads.agg(F.min("cell")).first()[0]  # the first case of all goes behind the last cell
    order = Window.orderBy(F.desc("cell"))  # at most MAX_CELLS narrow rows
    heads = heads.withColumn("before", F.coalesce(F.lag("cell").over(order), F.lit(first)))
    met = base.join(F.broadcast(heads), "cell")
    own = F.struct("cell", F.lit(False).alias("guest"))
    copy = F.struct(F.col("before").alias("cell"), F.lit(True).alias("guest"))
    is_head = F.col("id").eqNullSafe(F.col("head"))
    placed = met.select("id", "rationale", F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    along = Window.partitionBy("at.cell").orderBy("at.guest", F.desc_nulls_last("id"), "rationale")
    follows = placed.withColumn("next_rationale", F.lead("rationale").over(along))
    return follows.filter(~F.col("at.guest")).select("id", "rationale", "next_rationale")
