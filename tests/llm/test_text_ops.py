import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hearthbook.llm import _text, language_id, mixing, packing, toxicity
from hearthbook.llm._store import Scratch
from hearthbook.llm.span_dedup import remove_repeats

VOCABULARY = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
TOKENIZER = Tokenizer.from_buffer(VOCABULARY)
FAST = packing.ChunkTokenizer(VOCABULARY)


def table(texts):
    return _text.utf8(pa.array(texts, pa.string()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab 'sé 　\n\t.,1<|endoftext|>日"), max_size=30)), min_size=1, max_size=5))
def test_chunked_ids_are_the_tokenizers_ids(texts):
    ids, at = FAST.encode(*table(texts))
    want = TOKENIZER.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [w.ids for w in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "a", "b.", "日", "\n"]), max_size=8).map("".join)), min_size=1, max_size=6))
def test_added_tokens_are_the_unchanged_tokenizers(texts):
    ids, at = FAST.encode(*table(texts))
    want = Tokenizer.from_buffer(VOCABULARY).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [w.ids for w in want]


def test_a_text_with_an_added_token_is_packed_by_its_named_ids(spark):
    row = packing.pack(spark.createDataFrame([(1, "one<|endoftext|> two")], "doc_id long, text string"), VOCABULARY).first()
    assert row.doc_tokens == len(Tokenizer.from_buffer(VOCABULARY).encode("one<|endoftext|> two", add_special_tokens=False).ids) + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \té", max_size=20), min_size=1, max_size=5), st.integers(1, 4))
def test_shingles_match_words(texts, width):
    hashed, of = _text.shingles(*table(texts), width)
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        want = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [tuple(words)] if words else []
        got = hashed[of == k].tolist()
        assert len(got) == len(want) and len(set(got)) == len(set(want))


def reference_cost(pos, cost):
    """The recurrence without a queue."""
    best = [0] + [None] * (len(pos) - 1)
    for i in range(1, len(pos)):
        for j in range(i):
            size = pos[i] - pos[j]
            if size <= packing.WINDOW:
                pad = 0 if size in packing.EXEMPT else packing.WINDOW - size
                value = best[j] + pad + packing.OPEN_COST + cost[i]
                best[i] = value if best[i] is None else min(best[i], value)
    return best[-1]


def test_cuts_have_the_least_cost():
    draw = np.random.default_rng(3)
    for _ in range(30):
        pos = np.concatenate([[0], np.cumsum(draw.integers(1, 700, size=60))])
        cost = draw.choice([0, 16, 64], size=61)
        chosen = packing.cut_windows(pos, cost)
        sizes = np.diff(pos[chosen])
        total = sum(0 if s in packing.EXEMPT else packing.WINDOW - s for s in sizes.tolist()) + packing.OPEN_COST * len(sizes) + cost[chosen[1:]].sum()
        assert total == reference_cost(pos.tolist(), cost.tolist())


def test_chunks_that_share_a_hash_are_told_apart(monkeypatch):
    tokenizer, hashes = packing.ChunkTokenizer(VOCABULARY), _text.span_hashes
    # first hashes of two bits: nearly all chunks collide
    monkeypatch.setattr(_text, "span_hashes", lambda data, starts, ends, base="": hashes(data, starts, ends, base) >> np.uint64(0 if base else 62))
    texts = ["one two three four five", "", "six seven", "<|endoftext|> one", "eight nine ten one two"] * 3
    for _ in range(2):
        ids, at = tokenizer.encode(*table(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def test_windows_do_not_depend_on_segments(spark):
    draw = random.Random(9)
    texts = [" ".join(draw.choice(["one", "two.", "three\n", "naïve", "x"]) for _ in range(draw.choice([1, 40, 300, 2500]))) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    found = []
    try:
        for tokens in (1 << 20, 5000, 1):
            found.append(sorted(map(tuple, packing.pack(frame, VOCABULARY, segment=tokens).collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2]


def test_packing_repeated_and_null_ids(spark):
    rows = packing.pack(spark.createDataFrame([(1, "one two", 5), (1, "one two", 5), (None, "three", 5), (None, None, 5)], "doc_id long, text string, length int").coalesce(1), VOCABULARY).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, len(TOKENIZER.encode("three").ids) + 1), (1, 3), (1, 3)] or sum(r.length for r in rows) == 3 + 3 + 1 + len(TOKENIZER.encode("three").ids) + 1


def test_packing_places_every_id_once(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["one", "two.", "three\n", "naïve", "x"]) for _ in range(draw.choice([0, 1, 5, 300, 9000]))) for _ in range(60)] + [None, "", "word" * 20000, "same", "same"]
    frame = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, start int").coalesce(2)
    rows = packing.pack(frame, VOCABULARY).collect()
    ids = {k: np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for k, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k in ids:
        at = 0
        for start, length in sorted(pieces[k]):
            assert start == at
            at += length
        assert at == len(ids[k])
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.05 * sum(map(len, ids.values()))


def test_packing_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


PASSAGE = "The committee met on a cold morning to hear the long report. Its members spoke in turn about the bridge and the river below it. Nobody could agree on who should pay for the new stones. At last they voted to ask the council for a loan, and went home."


def test_repeated_passages_go_and_the_first_stays(spark):
    own = ["Alpha beta gamma delta went there. ", "Quite another text begins here. ", "A third one, with its own words. "]
    rows = [(k, o + PASSAGE + " And " + o) for k, o in enumerate(own)] + [(9, own[0] + own[1]), (10, None), (11, ""), (12, PASSAGE + "\n" + PASSAGE)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, covered string")).collect()}
    texts = dict(rows)
    assert got[0].text == texts[0] and got[0].n_removed == 0
    for k in (1, 2):
        assert "committee" not in got[k].text and "loan" not in got[k].text and own[k].strip() in got[k].text
    assert got[9].text == texts[9] and got[10].text is None and got[11].text == "" and got[12].text.strip() == ""


def test_span_removal_matches_brute_force(spark):
    draw = random.Random(5)
    sentences = [" ".join(draw.choice("abcdefgh") * 3 + str(draw.randrange(9)) for _ in range(draw.randrange(4, 25))) + "." for _ in range(40)]
    rows = [(k, " ".join(draw.choice(sentences) for _ in range(draw.randrange(1, 12)))) for k in range(60)]

    def runs(parts):
        out = set()
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                if j - i >= 2 and sum(len(p.split()) for p in parts[i:j]) >= 24:
                    out.add((i, j))
                    break
            for k in range(i, -1, -1):
                if i + 1 - k >= 2 and sum(len(p.split()) for p in parts[k : i + 1]) >= 24:
                    out.add((k, i + 1))
                    break
        return out

    seen, lost = {}, {}
    for k, text in rows:
        parts = [p.lower() + "." for p in re.split(r"\.\s*", text) if p]
        for i, j in sorted(runs(parts)):
            key = tuple(" ".join(parts[i:j]).split())
            if seen.setdefault(key, (k, i)) != (k, i):
                lost.setdefault(k, set()).update(range(i, j))
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: len(lost.get(k, ())) for k, _ in rows}


def test_passages_of_51_words_lose_words_wherever_they_are_cut(spark):
    draw = random.Random(11)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    own = lambda: " ".join(word() for _ in range(20))
    rows = []
    for n, lengths in enumerate([(51,), (25, 26), (25, 35), (30, 25), (20, 20, 20), (13, 13, 25), (39, 12), (10, 41), (70,)]):
        passage = " ".join(" ".join(word() for _ in range(k)) + "." for k in lengths)[:-1]
        rows += [(10 * n + k, f"{own()} {passage} {own()}. {own()}.") for k in range(3)]
    rows += [(900 + k, " ".join(word() for _ in range(200))) for k in range(3)]
    texts = dict(rows)
    for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        before, after = texts[r.doc_id].split(), (r.text or "").split()
        if r.doc_id % 10 == 0 or r.doc_id >= 900:
            assert r.text == texts[r.doc_id] and r.n_removed == 0
        else:
            assert r.n_removed > 0 and len(before) - len(after) >= 24
            assert before[:20] == after[:20] and before[-40:] == after[-40:]


def test_spans_with_clashing_names_null_ids_and_repeated_rows(spark):
    names = ["in_doc", "in_print", "print", "covered", "h1", "c0", "start", "text", "doc_id", "n_removed"]
    rows = [(1, 2, 3, 4, 5, 6, 7, t, d, 9) for d, t in [(2, PASSAGE), (2, PASSAGE), (1, "Own words. " + PASSAGE), (None, PASSAGE + " And more."), (None, "Nothing that repeats here."), (5, None), (6, "x " * 200000)]]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    found = remove_repeats(frame)
    got = sorted(found.collect(), key=lambda r: (r.doc_id or 0, r.text or ""))
    assert found.columns == [*names[:-1], "n_sentences", "n_removed"] and all(tuple(r)[:7] == (1, 2, 3, 4, 5, 6, 7) for r in got)
    texts = {(r.doc_id, r.n_removed > 0): r.text for r in got}
    assert texts[None, False].startswith(PASSAGE) or texts[None, False] == "Nothing that repeats here."
    assert {r.text for r in got if r.doc_id is None} == {PASSAGE + " And more.", "Nothing that repeats here."}  # the null id is first
    assert texts[1, True].strip() == "Own words." and [r.text.strip() for r in got if r.doc_id == 2] == ["", ""]
    assert texts[5, False] is None
    assert remove_repeats(frame.limit(0)).count() == 0


def words(count):
    return " ".join(["w"] * count)


def test_mix_meets_targets_and_repeats(spark):
    draw = random.Random(6)
    rows = [(k, words(draw.randrange(0, 200)), draw.choice(["big"] * 6 + ["mid", "small", None])) for k in range(300)] + [(300, None, "mid"), (7, words(10), "big")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    a, b = (sorted(tuple(r) for r in mixing.decide(f).select("doc_id", "source", "size", "source_size", "target", "taken").fillna("-", ["source"]).collect()) for f in (frame, frame.repartition(7)))
    assert a == b
    totals, taken, target = {}, {}, {}
    for _, source, size, whole, goal, got in a:
        assert 0 <= got <= 2 * size
        totals[source] = totals.get(source, 0) + size
        taken[source] = taken.get(source, 0) + got
        target[source] = goal
        assert whole == sum(len((t or "").split()) for _, t, s in rows if (s or "-") == source)
    assert all(abs(taken[s] - target[s]) < 1 for s in totals)
    # water filling by hand: big, mid, small and null weigh 5, 2, 1 and 5
    weight, left, budget, fixed = {"big": 5, "mid": 2, "small": 1, "-": 5}, set(totals), 1.5 * sum(totals.values()), {}
    while left:
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * totals[s]}
        if not over:
            fixed |= {s: level * weight[s] for s in left}
            break
        fixed |= {s: 2.0 * totals[s] for s in over}
        left -= over
    assert all(abs(fixed[s] - target[s]) < 1e-6 * max(1, fixed[s]) for s in totals)


def test_mix_is_in_order_of_finish_times(spark):
    frame = spark.createDataFrame([(k, words(5 + k % 7), f"s{k % 3}", k, k) for k in range(100)], "doc_id long, text string, source string, size int, mix_pass int")
    rows = mixing.mix(frame).collect()
    assert [r.mix_finish for r in rows] == sorted(r.mix_finish for r in rows) and max(r.mix_finish for r in rows) <= 1.0
    assert abs(sum(r.mix_words for r in rows) - 1.5 * sum(5 + k % 7 for k in range(100))) <= 3
    assert all(r.size == r.doc_id and r.mix_size == 5 + r.doc_id % 7 for r in rows) and rows[0].__fields__ == [*frame.columns[:-1], "mix_size", "mix_pass", "mix_words", "mix_finish"]
    taken = {}
    for r in rows:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.mix_words
    assert taken == {r.doc_id: r.taken for r in mixing.decide(frame).collect() if r.taken}
    assert mixing.decide(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert [r.taken for r in mixing.decide(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [0]


def test_a_mix_of_rows_without_ids_many_sources_and_clashing_names(spark):
    rows = [(None if k % 2 else k, words(1 + k % 5), f"s{k % 40:02}", 0, 0, "x", 0.0) for k in range(400)]
    names = ["doc_id", "text", "source", "ahead", "range", "row", "virtual_finish"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, ahead int, range int, row string, virtual_finish double")
    decided, mixed = mixing.decide(frame).collect(), mixing.mix(frame)
    assert len(decided) == 400 and all(0 <= r.taken <= 2 * r["size"] for r in decided) and mixed.columns[:7] == names
    targets = {r.source: r.target for r in decided}
    for source, target in targets.items():
        assert abs(sum(r.taken for r in decided if r.source == source) - target) < 1
    assert sum(r.taken for r in decided) == sum(r.mix_words for r in mixed.collect())


def test_the_decision_sorts_by_range(spark):
    frame = spark.createDataFrame([(k, words(3), "s") for k in range(20)], "doc_id long, text string, source string")
    seen = []
    keep = Scratch.keep
    try:
        Scratch.keep = lambda self, name, table: (seen.append((name, table._jdf.queryExecution().executedPlan().toString())), keep(self, name, table))[1]
        mixing.decide(frame)
    finally:
        Scratch.keep = keep
    assert "rangepartitioning(virtual_finish" in dict(seen)["queued"]


def test_toxicity_finds_planted_words_in_unseen_texts(spark):
    draw = random.Random(7)
    vocabulary = ["".join(draw.choice("abcdeiou") for _ in range(6)) for _ in range(400)]
    bad = ["grumpfel", "snarkzig", "blorfen"]
    rows, toxic = [], {}
    for k in range(1200):
        text = [draw.choice(vocabulary) for _ in range(60)]
        toxic[k] = int(k % 8 == 0)
        if toxic[k]:
            for _ in range(3):
                text[draw.randrange(60)] = draw.choice(bad) + draw.choice(["", "s", "ly"])
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, t) for k, t in toxic.items() if k < 800 and k % 3], "doc_id long, toxic int")
    model = toxicity.train(docs.where("doc_id < 800"), labels)
    more = docs.unionByName(spark.createDataFrame([(5000, None), (5001, ""), (5002, "x" * 200000)], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in toxicity.score(more.selectExpr("doc_id", "text", "0.5 as score"), model).collect()}
    unseen = range(800, 1200)
    assert sum((got[k] >= 0.3) == bool(toxic[k]) for k in unseen) >= 0.97 * len(unseen)
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001] < 0.3


def test_the_risk_and_its_gradient():
    """Against the risk written out text by text and its finite differences, on both sides of the bound."""
    draw = np.random.default_rng(12)
    xp, xu = ((draw.random((n, 6)) < 0.4).astype(float) for n in (9, 14))

    def parts(w, b, prior):
        loss = lambda x, sign: 1 / (1 + np.exp(sign * (sum(a * c for a, c in zip(x, w, strict=True)) + b)))
        mean = lambda rows, sign: sum(loss(x, sign) for x in rows) / len(rows)
        return prior * mean(xp, 1), mean(xu, -1) - prior * mean(xp, -1)

    sides = set()
    for prior in (0.1, 0.4, 0.95):
        for _ in range(4):
            w, b = draw.normal(size=6), float(draw.normal())
            risk, gradient, descends = toxicity.step(xp, xu, w, b, prior)
            positive, negative = parts(w, b, prior)
            assert abs(risk - (positive + max(0.0, negative))) < 1e-12 and descends == (negative >= 0)
            sides.add(bool(descends))
            goal = (lambda w, b: sum(parts(w, b, prior))) if descends else (lambda w, b: -parts(w, b, prior)[1])  # noqa: B023
            for k in range(7):
                d = np.eye(7)[k] * 1e-6
                slope = (goal(w + d[:6], b + d[6]) - goal(w - d[:6], b - d[6])) / 2e-6
                assert abs(slope + (toxicity.DECAY * w[k] if k < 6 else 0) - gradient[k]) < 1e-6
    assert sides == {True, False}


def test_scores_are_those_of_a_plain_loop(spark):
    texts = ["Grumpfel snarkzig and more", "naïve GRUMPFELS 12", None, "", "x" * 30]
    known = [1, 5, 9, *(int(h) for h in toxicity.features(*table(["grumpfel"]))[0])]
    chosen = np.array(sorted(set(known)), dtype=np.int32)
    model = chosen, np.linspace(-1, 2, len(chosen)).astype(np.float32), -0.5
    frame = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, c0 int")
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    for k, text in enumerate(texts):
        mine = set()
        for word in re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
            mine |= {int(h) for h in toxicity.features(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0]}
        total = -0.5 + sum(float(v) for f, v in zip(chosen, model[1], strict=True) if f in mine)
        assert abs(got[k] - 1 / (1 + np.exp(-total))) < 1e-6


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [0 <= r.score <= 1 for r in toxicity.score(docs, model).collect()] == [True, True]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_language_codes_and_prediction(spark):
    for count in (1, 2, 4, 7, 8, 9, 40):
        code = language_id.codewords(count)
        assert all((code[a] != code[b]).any() for a in range(count) for b in range(a))
        splits = {tuple(c * c[-1]) for c in code.T}
        assert len(splits) == code.shape[1] and (count == 1 or all(min(s) < 0 for s in splits))
    draw = random.Random(8)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst", "ee": "uvwxyz"}
    make = lambda lang: " ".join("".join(draw.choice(letters[lang]) for _ in range(5)) for _ in range(30))
    rows = [(k, make(lang), lang) for k in range(200) for lang in [draw.choice(list(letters))]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34", "bb"), (902, "", None)], "doc_id long, text string, lang string")
    model = language_id.train(docs.where("doc_id < 100"))
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert all(got[k].lang_pred == lang and 0 <= got[k].score <= 1 for k, _, lang in rows)
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].ambiguous
    # a naive decoding of the same model: n-grams counted one by one, losses added bit by bit
    for k, text, _ in rows[:10]:
        low, held = re.sub(r"\s", " ", text.lower()).encode(), {}
        for size in language_id.SIZES:
            for i in range(len(low) - size + 1):
                code = int.from_bytes(low[i : i + size], "big") ^ (size * 0x1F123BB5 & 0xFFFFFFFF)
                bucket = (code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language_id.BITS)
                held[bucket] = held.get(bucket, 0) + 1
        root = sum(held.values()) ** 0.5
        losses = []
        for word in model["code"]:
            margins = [sum((n**0.5 / root) * float(model["w"][b, j]) for b, n in held.items()) + float(model["b"][j]) for j in range(len(word))]
            losses.append(sum(float(t) * np.log1p(np.exp(-m * s)) for m, s, t in zip(margins, word, model["trust"], strict=True)))
        odds = np.exp(min(losses) - np.array(losses))
        assert got[k].lang_pred == model["names"][int(np.argmin(losses))] and abs(got[k].score - odds.max() / odds.sum()) < 1e-3
    held = language_id.predict(docs.selectExpr("doc_id", "text", "1 as has_letter", "'x' as c0", "2 as score"), model)
    assert held.columns == ["doc_id", "text", "has_letter", "c0", "lang_pred", "score", "ambiguous"] and {(r.has_letter, r.c0) for r in held.collect()} == {(1, "x")}
    many = spark.range(30).selectExpr("id as doc_id", "concat('text ', id) as text", "cast(id as string) as lang")
    with pytest.raises(ValueError):
        language_id.train(many, most=20)
    nothing = language_id.train(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


class PlainTokens:
    """Stands for a tokenizer of 1000 ids, of which 7 ends a sentence."""

    ends = np.arange(1001) == 7


def same_documents(kind, total):
    body = {"empty": np.zeros(0), "of 700": np.full(699, 5), "of 700 with sentences": np.where(np.arange(699) % 23 == 22, 7, 5), "of 1024": np.full(1023, 5), "one long": np.full(total - 1, 5)}[kind]
    document = np.append(body, 1).astype(np.uint32)
    return [document] * (total // len(document))


@pytest.mark.parametrize("kind, total", [("empty", 2_500_000), ("of 700", 10_000_000), ("of 700 with sentences", 10_000_000), ("of 1024", 10_000_000), ("one long", 10_000_000)])
def test_equal_documents_do_not_pile_up(kind, total):
    """Tokens that wait stay bounded, and no token is solved over and over."""
    stream, placed, solved = packing._Stream(0, PlainTokens), 0, 0
    for k, document in enumerate(same_documents(kind, total)):
        stream.add(k, document)
        for _, rows in stream.ready(1 << 20):
            placed += int(rows[1].sum())
            solved += int(rows[1].sum()) + stream.open
            assert kind == "one long" or stream.tokens <= packing.MOST_TOKENS
            assert stream.open <= packing.APART_TOKENS + packing.WINDOW
    placed += sum(int(rows[1].sum()) for _, rows in stream.ready(1 << 20, last=True))
    assert placed == total // len(same_documents(kind, total)[0]) * len(same_documents(kind, total)[0]) and not stream.docs
    assert solved <= 2 * total


def test_ways_that_stay_apart_are_decided(monkeypatch):
    monkeypatch.setattr(packing, "APART_TOKENS", 0)
    stream = packing._Stream(0, PlainTokens)
    pieces = []
    for k in range(60):
        stream.add(k, np.append(np.full(699, 5), 1).astype(np.uint32))
        pieces += [rows for _, rows in stream.ready(5000)]
    pieces += [rows for _, rows in stream.ready(5000, last=True)]
    rows = np.concatenate(pieces, axis=1)
    assert rows[1].sum() == 60 * 700 and (np.bincount(rows[4].astype(int), rows[1]) <= packing.WINDOW).all()
