"""Removal of lines and passages that other case narratives already have."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import settle
from plumbline.llm.ngram_join import filter_places, id_filter, run_seeds, word_digests
from plumbline.llm.word_ids import release_memory

#: Words of a unit: a line has them alone or together with the lines around it. Shorter lines meet by chance.
MIN_WORDS = 20
ROWS_PER_BATCH = 20_000
#: Words of a run that may begin and end inside lines.
RUN_WORDS = 40
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passage_units(text: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normalised text) of the units of a text: its lines of `min_words` words, and the shortest runs of lines that have
    so many together, from every line on and up to every line.

    Normalised: A-Z lower-cased, runs of ASCII white space as one space, none at the ends. Blank lines are no part of a run. A
    unit depends on its own words alone, so two equal passages of lines with `min_words` words or more are covered by
    equal units, wherever they stand and however short their lines are.
    """
    lines, at = [], 0
    for line in text.split("\n"):
        if words := line.encode().lower().split():
            lines.append((at, at + len(line), words))
        at += len(line) + 1
    before = [0, *accumulate(len(words) for _, _, words in lines)]
    ahead = {(i, bisect_left(before, n + min_words) - 1) for i, n in enumerate(before[:-1]) if n + min_words <= before[-1]}
    back = {(bisect_right(before, n - min_words) - 1, i) for i, n in enumerate(before[1:]) if n >= min_words}
    for first, last in sorted(ahead | back):
        yield lines[first][0], lines[last][1], b" ".join(chain.from_iterable(words for _, _, words in lines[first : last + 1]))


def _units(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, digest = [], [], [], []

            def flush() -> pa.RecordBatch:
                of_row = [batch.column(c).take(pa.array(row, pa.int32())) for c in ("id", "text")]
                arrays = [*of_row, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(digest, pa.binary())]
                return pa.RecordBatch.from_arrays(arrays, ["id", "text", "start", "end", "digest"])

            for i, text in enumerate(batch.column("rationale")):
                for at, to, unit in passage_units(text.as_py() or "", min_words):
                    row.append(i), start.append(at), end.append(to), digest.append(xxhash.xxh3_128_digest(unit))
                if len(row) >= ROWS_PER_BATCH:
                    yield flush()
                    row, start, end, digest = [], [], [], []
            yield flush()
        release_memory()

    return run


def case_units(cases: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Units of all cases: id, text (a digest of the rationale), start, end (code points in the whole rationale), digest (128 bits)."""
    kind = cases.schema["id"].dataType.simpleString()
    told = cases.select("id", "rationale", F.xxhash64("rationale").alias("text"))
    return told.mapInArrow(_units(min_words), f"id {kind}, text long, start long, end long, digest binary")


def _place() -> Column:
    """The rank of an occurrence: cases without an id come last, then by id, text and place."""
    return F.struct(F.col("id").isNull().alias("late"), "id", "text", "start", "end")


def _repeated(cases: DataFrame, min_words: int) -> DataFrame:
    """The units behind the earliest ranked one of their digest, but for those that overlap it, with the digest of their text."""
    units = settle(case_units(cases, min_words))
    often = units.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = settle(units.join(often.select("digest"), "digest", "left_semi"))
    first = met.groupBy("digest").agg(F.min(_place()).alias("first"))
    met = met.join(first, "digest")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text") == F.col("first.text"))
    later = met.filter(~(same & (F.col("start") < F.col("first.end"))))
    return later.select("id", "text", "start", "end", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))


def repeated_units(cases: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every unit (see `passage_units`) that is not the earliest ranked occurrence of its digest.

    cases: id, rationale. Rank is id, then place in the text. Returns id, start, end (offsets in the original rationale, end
    excluded), first_id, first_start: the occurrence that stays. Spans can overlap one another, but never
    the occurrence that stays for them, so of each text that goes a copy is left.

    Texts are cut once; digests are counted with a combine on the map side, and only units whose digest is met twice are
    looked at again, by a join that Spark splits where a unit is very frequent.

    Nulls: a null or empty rationale has no units; null ids rank last. Rows that share id and text are one case: where it holds the
    first occurrence, all of them keep it. Rows that share an id alone are cases of their own. Very long texts are cut
    whole. Other columns are not carried. No cases: no rows.
    """
    return _repeated(cases, min_words).drop("text")


def _seeds(size: int):
    """(id, case): the seeds of the runs of every case, once where neighbours share them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cases, since = batch.column("case").to_numpy(), 0
            for h, ends in word_digests(batch.column("rationale")):
                text, _, seed = run_seeds(h, ends, size)
                fresh = np.ones(len(seed), bool)
                fresh[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_pydict({"id": seed[fresh].view(np.int64), "case": cases[since + text[fresh]]})
                since += len(ends) - 1
        release_memory()

    return run


def _seeded_runs(size: int, bits: np.ndarray):
    """Runs whose seed the filter lets through, as units; texts without one are not looked at again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, rationale, since = batch.column("id"), batch.column("text"), batch.column("rationale"), 0
            for h, ends in word_digests(rationale):
                text, place, seed = run_seeds(h, ends, size)
                at = filter_places(seed)
                hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                text, place = text[hit], place[hit]
                some, first = np.unique(text, return_index=True)
                for t, a, b in zip(some.tolist(), first, np.append(first, len(text))[1:], strict=True):
                    spans = np.array([m.span() for m in _WORD.finditer(rationale[since + t].as_py())], np.int64)
                    for cut in range(a, b, ROWS_PER_BATCH):
                        p = place[cut : min(b, cut + ROWS_PER_BATCH)]
                        digest = pa.array([xxhash.xxh3_128_digest(h[i : i + size].tobytes()) for i in p.tolist()], pa.binary())
                        of_case = [x.take(pa.array(np.full(len(p), since + t))) for x in (ids, texts)]
                        start, end = spans[p - ends[t], 0], spans[p - ends[t] + size - 1, 1]
                        yield pa.RecordBatch.from_arrays([*of_case, pa.array(start), pa.array(end), digest], ["id", "text", "start", "end", "digest"])
                since += len(ends) - 1
        release_memory()

    return run


def repeated_runs(cases: DataFrame, words: int = RUN_WORDS) -> DataFrame:
    """Every run of `words` words, wherever it begins and ends, that an earlier ranked case has too: id, text, start, end, first_id, as in `repeated_units`.

    So all of a passage of at least as many words that two cases share goes from the later one; repeats inside one case
    alone stay. Words are compared with A-Z lower-cased, whatever white space is between them.

    Only seeds of runs, about one for every ten words, are exchanged for all cases. A filter of fixed size of those that several cases have
    goes to every task, and the runs behind it, few but for shared passages, are then compared by 128 bits of their words' digests.

    Nulls: a null or short rationale has no runs; null ids rank last. Rows that share id and text are one case. Very long texts are read whole. No cases: no rows.
    """
    kind = cases.schema["id"].dataType.simpleString()
    told = cases.select("id", "rationale", F.xxhash64("rationale").alias("text"))
    seeds = told.select("rationale", F.xxhash64("id", "rationale").alias("case")).mapInArrow(_seeds(words), "id long, case long")
    shared = seeds.groupBy("id").agg(F.min("case").alias("low"), F.max("case").alias("high")).filter("low < high")
    runs = settle(told.mapInArrow(_seeded_runs(words, id_filter(shared)), f"id {kind}, text long, start long, end long, digest binary"))
    first = runs.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "text")).alias("first"))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text") == F.col("first.text"))
    return runs.join(first, "digest").filter(~same).select("id", "text", "start", "end", F.col("first.id").alias("first_id"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, on = batch.schema.get_field_index("rationale"), batch.schema.get_field_index("removed")
        texts, removed = [], []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(on).to_pylist(), strict=True):
            if text is not None and spans:
                parts, since, gone = [], 0, []
                for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
                    start = max(since, s["start"])  # what an earlier span has is gone
                    if start < s["end"]:
                        parts.append(text[since:start])
                        since = s["end"] + 1  # with the line end
                        gone.append(s | {"start": start})
                text, spans = "".join([*parts, text[since:]]), gone
            texts.append(text), removed.append(spans)
        batch = batch.set_column(at, "rationale", pa.array(texts, pa.string()))
        yield batch.set_column(on, "removed", pa.array(removed, batch.schema.field(on).type))
    release_memory()


def drop_repeated_units(cases: DataFrame, min_words: int = MIN_WORDS, run_words: int | None = None) -> DataFrame:
    """All columns of `cases`, with `rationale` freed of the union of `repeated_units`, with `run_words` also of `repeated_runs`, and `removed`: the array
    of (start, end, first_id) of what went, disjoint, as offsets in the original rationale, in order.

    Spans belong to an id and its text: rows that share an id alone keep what is their own; null ids are freed too. A case that loses all its
    units stays, with what is left. A null or empty rationale stays as it is, very long ones are cut whole, repeated rows are freed alike. A column
    `removed` of the input is replaced; `span_id` and `span_text` are taken by the operator. No cases: no rows.
    """
    spans = _repeated(cases, min_words).select("id", "text", "start", "end", "first_id")
    if run_words is not None:
        spans = spans.unionByName(repeated_runs(cases, run_words))
    spans = spans.distinct()
    spans = spans.groupBy(F.col("id").alias("span_id"), F.col("text").alias("span_text")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "first_id"))).alias("removed"))
    same = F.col("id").eqNullSafe(F.col("span_id")) & (F.xxhash64("rationale") == F.col("span_text"))
    out = cases.drop("removed").join(spans, same, "left").drop("span_id", "span_text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.mapInArrow(_without, kinds)
