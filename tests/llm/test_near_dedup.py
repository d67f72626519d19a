import random
import re

from hearthbook.llm import near_dedup
from hearthbook.llm.near_dedup import banding, least_matches, near_duplicates, one_of_each


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def brute(rows, width, percent):
    """Components by comparing every pair of full sets."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min((d for d in groups[find(k)] if d is not None), default=None)) for k in range(len(rows))]


def corpus(seed):
    """Exact copies, a large group of near copies around a base, chains, and unrelated texts that share a line."""
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 4, 40, 150]))]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for _ in range(edits):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            rows.append(" ".join(copy))
    base = [draw.choice(vocabulary) for _ in range(120)]
    for _ in range(60):
        copy = list(base)
        for _ in range(draw.randrange(8)):
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        rows.append(" ".join(copy).upper())
    line = " ".join(draw.choice(vocabulary) for _ in range(20))
    rows += [line + " " + " ".join(draw.choice(vocabulary) for _ in range(60)) for _ in range(20)]
    rows += [None, "", " \t\n", "x", "x", "one two", "One  TWO "]
    order = list(range(len(rows)))
    draw.shuffle(order)
    return [(k, rows[i]) for k, i in enumerate(order)]


def test_components_match_brute_force(spark, monkeypatch):
    for seed, width, percent, block in ((1, 3, 85, 512), (2, 5, 80, 4)):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        rows = corpus(seed)
        found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found)
        assert got == sorted(brute(rows, width, percent))
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 2), (3, "a b c d e f", 3), (None, "q r s t u v", 4), (7, None, 5), (9, "z " * 30000, 6), (8, "z " * 30000, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(frame).collect())
    assert got == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (8, 8, True), (9, 8, False)]


def test_one_row_of_each_group_stays(spark):
    """Also where doc_ids repeat, within a group and across groups, or are null."""
    a, b, c = "a b c d e f g", "q w e r t y u", "z x c v b n m"
    rows = [(5, b, 0), (5, a, 1), (3, a, 2), (3, a, 3), (None, c, 4), (None, c, 5), (None, a, 6), (None, None, 7), (7, "", 8), (7, "", 9)]
    found = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row int"))
    got = sorted(((r.doc_id, r.text, r.row) for r in found.collect()), key=lambda r: r[2])
    assert found.columns == ["doc_id", "text", "row"]
    assert len(got) == 6 and got[0] == (5, b, 0) and got[1] in [(3, a, 2), (3, a, 3)] and got[2] in [(None, c, 4), (None, c, 5)] and got[3:] == [(None, None, 7), (7, "", 8), (7, "", 9)]
    assert one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_texts_without_an_id(spark):
    rows = [(None, " ".join(f"{k}w{i}" for i in range(8))) for k in range(40)] * 3
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 120 and all(r.kept and r.component_id is None for r in got)


def test_bands_by_threshold():
    assert banding(0.85) == (21, 6) and banding(0.8) == (25, 5)
    for threshold in (0.5, 0.7, 0.9, 0.99):
        bands, rows = banding(threshold)
        assert bands * rows <= 128 and (1 - threshold**rows) ** bands <= 5e-5 or rows == 1


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_table_ascends_and_keeps_true_pairs():
    least = least_matches(0.85, 1e-5)
    assert (least[1:] > least[:-1]).all() and least[-1] <= 128 * 0.85
