"""Line and passage dedup against a plain loop over whole texts."""

import random
import re

from plumbline.llm import unit_dedup


def runs(text, min_words):
    """Shortest runs of lines with `min_words` words, by trying all of them."""
    lines, at = [], 0
    for line in (text or "").split("\n"):
        words = line.encode().lower().split()
        if words:
            lines.append((at, at + len(line), words))
        at += len(line) + 1
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            words = [w for _, _, some in lines[i : j + 1] for w in some]
            short_ahead = sum(len(x[2]) for x in lines[i:j]) < min_words
            short_back = sum(len(x[2]) for x in lines[i + 1 : j + 1]) < min_words
            if len(words) >= min_words and (short_ahead or short_back):
                yield lines[i][0], lines[j][1], b" ".join(words)


def brute(rows, min_words):
    units = [((i is None, i or 0, at, end), i, text, at, end, n) for i, text in rows for at, end, n in runs(text, min_words)]
    first = {}
    for _, i, text, at, end, n in sorted(units, key=lambda u: u[0]):
        first.setdefault(n, (i, text, at, end))
    return sorted((i, at, end, first[n][0], first[n][2]) for _, i, text, at, end, n in units if (i, text) != first[n][:2] or at >= first[n][3])


def corpus():
    draw = random.Random(8)
    shared = ["No focal consolidation is seen in either lung field today.", "Findings were discussed with the referring team by phone."]
    rows = []
    for i in range(40):
        parts = [" ".join(draw.choice("abcdefgh") * 3 for _ in range(draw.randint(1, 12))) + "." for _ in range(4)]
        parts.insert(draw.randint(0, 4), draw.choice(shared))
        rows.append((i, draw.choice(["\n", " \n\n"]).join(parts)))
    return [*rows, (50, shared[0].upper().replace(" ", "  ")), (51, ""), (52, None), (53, shared[1] + "\n" + shared[1]), (54, "é " * 9 + "\n" + "é " * 9)]


def test_matches_brute_force(spark):
    rows = corpus()
    cases = spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, rationale string, first_id int").repartition(4)
    got = sorted(tuple(r) for r in unit_dedup.repeated_units(cases, 6).collect())
    assert got == brute(rows, 6) and len(got) > 30


def test_offsets_and_texts(spark):
    rows = corpus()
    texts = dict(rows)
    cases = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "id long, rationale string, text int, removed string")
    freed = unit_dedup.drop_repeated_units(cases, 6).collect()
    for r in freed:
        whole, spans = texts[r["id"]], r["removed"] or []
        if whole is None:
            assert r["rationale"] is None
        else:
            gone = set().union(*(range(s["start"], s["end"] + 1) for s in spans))
            assert r["rationale"] == "".join(c for i, c in enumerate(whole) if i not in gone)
            assert all(a["end"] < b["start"] for a, b in zip(spans, spans[1:]))
    once = spark.createDataFrame([(r["id"], r["rationale"]) for r in freed], "id long, rationale string")
    assert {r["id"] for r in unit_dedup.repeated_units(once, 6).collect()} <= {r["id"] for r in freed if r["removed"]}  # new neighbours can meet
    assert len(freed) == len(rows)


def test_nulls_repeated_rows_and_no_rows(spark):
    line = "one two three four five six seven eight nine"
    rows = [(None, line), (3, line), (3, line), (4, line)]
    got = unit_dedup.repeated_units(spark.createDataFrame(rows, "id long, rationale string"), 8).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["first_id"]) for r in got) == [(False, 4, 3), (True, 0, 3)]
    freed = unit_dedup.drop_repeated_units(spark.createDataFrame(rows, "id long, rationale string"), 8).collect()
    assert sorted((r["id"] or 0, r["rationale"]) for r in freed) == [(0, ""), (3, line), (3, line), (4, "")]
    empty = spark.createDataFrame([], "id long, rationale string")
    assert unit_dedup.repeated_units(empty).count() == unit_dedup.drop_repeated_units(empty).count() == 0


def test_one_id_with_two_texts(spark):
    line = "one two three four five six seven eight nine"
    other = "another entirely different text that nobody else has at all here"
    rows = [(1, line), (2, line + "\nown words"), (2, other), (2, line)]
    freed = unit_dedup.drop_repeated_units(spark.createDataFrame(rows, "id long, rationale string"), 8).collect()
    assert sorted((r["id"], r["rationale"]) for r in freed) == [(1, line), (2, ""), (2, other), (2, "own words")]


def test_passages_of_short_lines(spark):
    draw = random.Random(3)
    line = " ".join(f"w{draw.randrange(99)} v{draw.randrange(99)} u{i}!!" for i in range(20))  # 60 words, three a sentence
    block = "\n".join(f"a{i} b{draw.randrange(9)}" for i in range(30))  # 60 words, two a line
    rows = [(1, f"Before one.\n{line}\nAfter."), (2, f"Other.\n{line}"), (3, f"Head.\n{block}\nTail."), (4, f"{block}\nEnd of four."), (5, "Ha.\n" * 90)]
    got = {r["id"]: r for r in unit_dedup.drop_repeated_units(spark.createDataFrame(rows, "id long, rationale string").repartition(3)).collect()}
    assert {i: got[i]["rationale"] for i in (1, 2, 3, 4)} == {1: rows[0][1], 2: "Other.\n", 3: rows[2][1], 4: "End of four."}
    assert got[5]["rationale"] == "Ha.\n" * 20  # the occurrence that stays is whole


def test_equal_passages_are_covered_whole():
    draw = random.Random(12)
    for _ in range(300):
        part = lambda n: [" ".join(draw.choice("abc") for _ in range(draw.randint(1, 11))) + "." for _ in range(n)]
        passage = part(draw.randint(1, 9))
        digests, texts = [], []
        for _ in range(2):
            head, tail = part(draw.randint(0, 4)), part(draw.randint(0, 4))
            texts.append(("\n".join([*head, *passage, *tail]), sum(len(x) + 1 for x in head)))
            units = list(unit_dedup.passage_units(texts[-1][0], 8))
            assert sorted(units) == sorted(runs(texts[-1][0], 8))
            digests.append({w for _, _, w in units})
        if len(" ".join(passage).split()) >= 8:
            text, at = texts[1]
            seen = set()
            for a, b, words in unit_dedup.passage_units(text, 8):
                seen |= set(range(a, b + 1)) if words in digests[0] else set()
            assert set(range(at, at + len("\n".join(passage)))) <= seen


def test_shared_passages_inside_lines_match_brute_force(spark):
    draw = random.Random(5)
    word = lambda: f"w{draw.randint(0, 10**6)}"
    passage = [word() for _ in range(14)]
    rows = []
    for i in range(30):
        words = [word() for _ in range(draw.randint(0, 40))]
        if i % 3 == 0:
            at, cut = draw.randint(0, len(words)), draw.randint(0, 5)
            words[at:at] = passage[cut:] if i % 2 else [w.upper() for w in passage]
        rows.append((i, "".join(w + draw.choice([" ", " ", "\n", "  ", "\t"]) for w in words)))
    rows += [(40, None), (41, ""), (42, "one two " * 30), (None, "é\x1c ½ " + " ".join(passage)), (43, " ".join(passage)), (43, "x " + " ".join(passage)), (44, "y z"), (44, "y z")]
    size, first, expected = 10, {}, set()
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if i == 43:
            continue
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        for p in range(len(spans) - size + 1):
            start, end = spans[p][0], spans[p + size - 1][1]
            n = tuple(text[start:end].encode().lower().split())
            if first.setdefault(n, i) != i:
                expected.add((i, start, end, first[n]))
    cases = spark.createDataFrame(rows, "id long, rationale string").repartition(3)
    got = [(r["id"], r["start"], r["end"], r["first_id"]) for r in unit_dedup.repeated_runs(cases, size).collect()]
    assert {x for x in got if x[0] != 43} == expected and len(expected) > 30
    assert sorted(x for x in got if x[0] == 43) == sorted(
        (43, m, e, 0) for t in (rows[-4][1], rows[-3][1]) for s in [[w.span() for w in re.finditer(r"\S+", t)]] for p in range(len(s) - size + 1)
        for m, e in [(s[p][0], s[p + size - 1][1])] if t[m:e].split()[0] in passage
    )
    freed = unit_dedup.drop_repeated_units(cases, 20, size).collect()
    assert not any(" ".join(passage[5:]) in " ".join((r["rationale"] or "").lower().split()) for r in freed if r["id"] != 0)
    assert {r["id"]: r["rationale"] for r in freed}[42] == "one two " * 30
