"""Every stage of the pipeline on a small table with planted cases, and the whole run."""

import hashlib
import random
import re

import pytest

import corpus_pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PASSAGE = " ".join(f"pass{k}age" + ("." if k % 9 == 8 else "") for k in range(81))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdeiou") for _ in range(6)) for _ in range(600)]
    prose = lambda n: " ".join(draw.choice(vocabulary) + ("." if draw.random() < 0.1 else "") for _ in range(n))
    texts, toxic = {}, {}
    for k in range(400):
        texts[k] = prose(60)
        toxic[k] = int(k % 10 == 3)
        if toxic[k]:
            texts[k] += " grumpfel snarkzig blorfen"
    for k in range(400, 410):
        texts[k] = texts[k - 400] if k % 10 != 3 else prose(60)  # exact copies
    for k in range(410, 415):
        texts[k] = texts[k - 400 + 10] + " extra"  # near copies
    for k in range(415, 420):
        texts[k] = prose(30) + " " + PASSAGE + " " + prose(30)
    texts[420], texts[421] = None, ""
    rows = [(k, t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "more") for k, t in texts.items()]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, toxic


def test_stages_take_effect_and_keep_clean_documents(spark, folder):
    path, texts, toxic = folder
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    mild = stage["toxicity"](spark, docs, path)
    assert mild.columns == COLUMNS
    ids = {r.doc_id for r in mild.select("doc_id").collect()}
    assert not ids & {k for k, t in toxic.items() if t} and len(set(texts) - ids - {k for k, t in toxic.items() if t}) <= 4
    single = stage["near_dedup"](spark, mild, path)
    left = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == COLUMNS and not set(left) & (set(range(400, 415)) - {403}) and set(range(415, 422)) & ids <= set(left)
    cut = stage["span_dedup"](spark, single, path)
    after = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == COLUMNS and all(after[k].text == t for k, t in left.items() if k < 415)
    assert "pass40age" in after[415].text and all("pass40age" not in after[k].text and after[k].n_chars == len(after[k].text) for k in range(416, 420))
    mixed = stage["mixing"](spark, cut, path)
    times = {}
    for r in mixed.collect():
        assert r.text == after[r.doc_id].text
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert mixed.columns == COLUMNS and set(times.values()) <= {1, 2} and len(set(times.values())) == 2
    packed = stage["packing"](spark, mixed, path)
    placed = {r.doc_id: r.n for r in packed.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert set(placed) == set(times)


def test_run_and_empty_documents(spark, folder):
    path, texts, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 0
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    assert docs.count() == 0


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "span_dedup", "mixing", "packing"]
    assert re.fullmatch(r"(?s)Documents through.*", corpus_pipeline.__doc__)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Against components by comparing all pairs, with ids that repeat or are missing and columns that differ."""
    draw = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    base = [[draw.choice(words) for _ in range(40)] for _ in range(12)]
    texts = []
    for text in base:
        for edits in (0, 0, 1, 1, 2):
            copy = list(text)
            for _ in range(edits):
                copy[draw.randrange(40)] = draw.choice(words)
            texts.append(" ".join(copy))
    texts += [None, None, "", " "]
    rows = [(draw.choice([None, 1, 2, 3, k, k]), t, "en", "s", k) for k, t in enumerate(texts)]
    shingled = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) if t and t.split() else frozenset() for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if shingled[a] and 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    left = [r.n_chars for r in kept]
    assert sorted(group[k] for k in left) == sorted({group[k] for k in range(len(rows))})
    least = lambda k: min((rows[m][0] for m in range(len(rows)) if group[m] == group[k] and rows[m][0] is not None), default=None)
    assert all(rows[k][0] == least(k) for k in left if shingled[k])


def test_mixing_matches_a_queue_worked_through_by_hand(spark):
    """Copies served one after another by virtual finish time, each source its target's share, until the budget ends."""
    draw = random.Random(22)
    rows = [(k, " ".join(["w"] * draw.randrange(0, 30)), "en", draw.choice(["a", "a", "a", "b", None]), 0) for k in range(120)]
    sizes = {k: len(t.split()) for k, t, *_ in rows}
    sources = sorted({r[3] for r in rows if r[3]}) + [None]
    total = {s: sum(sizes[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    goal, left, budget = {}, set(sources), 1.5 * sum(total.values())
    while left:
        level = (budget - sum(goal.values())) / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] > 2 * total[s]}
        goal |= {s: 2.0 * total[s] for s in full} if full else {s: level * weight[s] for s in left}
        left = left - full if full else set()
    queue = []
    for s in sources:
        mine, at = sorted((r for r in rows if r[3] == s and sizes[r[0]]), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()), 0
        for _ in range(2):
            for r in mine:
                served = max(0, min(sizes[r[0]], int(goal[s]) - at))
                queue += [((at + served) / goal[s], r[0], served)] if served else []
                queue += [((at + sizes[r[0]]) / goal[s], r[0], sizes[r[0]] - served)] if served < sizes[r[0]] else []
                at += sizes[r[0]]
    want, rest = [], sum(int(g) for g in goal.values())
    for _, k, words in sorted(queue):
        taken = min(words, rest)
        rest -= taken
        want += [k] if 2 * taken >= sizes[k] and taken else []
    got = dict(corpus_pipeline.STAGES)["mixing"](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


ODD = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_with_nulls_repeated_rows_and_long_texts(spark, folder):
    """A toxic row goes as often as it stands; repeated rows lose the same passages; all tokens of all rows are packed."""
    path, texts, toxic = folder
    stage, bad = dict(corpus_pipeline.STAGES), " grumpfel snarkzig blorfen" * 3
    docs = spark.read.parquet(f"{path}/documents.parquet").select(*COLUMNS)
    odd = [(None, texts[1] + bad, None, None, None), (None, texts[1] + bad, None, None, None), (1, texts[1], None, None, None), (1, texts[1], None, None, None), (None, None, None, None, None), (None, None, None, None, None), (5, "", "en", "s", 0), (6, f"{texts[6]} " * 3000, "en", "s", 7)]
    left = stage["toxicity"](spark, docs.unionAll(spark.createDataFrame(odd, ODD)), path)
    assert not left.where("text like '%blorfen%' and doc_id is null").count() and left.where("doc_id = 1 and lang is null").count() == 2 and left.where("doc_id is null and text is null").count() == 2

    again = [(None, PASSAGE, None, None, None), (None, PASSAGE, None, None, None), (7, f"one more. {PASSAGE} at last.", None, None, 3), (7, f"one more. {PASSAGE} at last.", None, None, 3), (8, None, None, None, None), (8, "", None, None, 0)]
    cut = stage["span_dedup"](spark, spark.createDataFrame(again, ODD), path).collect()
    assert sorted(str(r.doc_id) for r in cut) == ["7", "7", "8", "8", "None", "None"]
    assert all("pass40age" not in r.text and r.text.endswith("at last.") and r.n_chars == len(r.text) for r in cut if r.doc_id == 7) and {r.text for r in cut if r.doc_id is None} == {PASSAGE}

    same = [(k % 3 or None, t, None, None, None) for k, t in enumerate([None, "", "a b", "a b"] * 200 + ["long " * 200_000])]
    packed = stage["packing"](spark, spark.createDataFrame(same, ODD), path)
    whole = packed.selectExpr("sum(length) as placed", "sum(case when start = 0 then doc_tokens end) as tokens", "count_if(start = 0) as rows").first()
    assert whole.rows == 801 and whole.placed == whole.tokens
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").isEmpty()
