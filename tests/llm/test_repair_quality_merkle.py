"""Conversation repair, compression bands and Merkle manifests against plain forms."""

import base64
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from hearthbook.llm import conversation_repair as C
from hearthbook.llm import merkle, quality

ROWS = "conv_id long, turn long, role string, text string, cost int"


def plain_cost(rows, entry=C.START, exits=C.ACCEPTS):
    """(cost, audit) by a table over (row, state), every tie kept."""
    into = {C.START: C.USER, C.SYSTEM: C.USER, C.ASSISTANT: C.USER, C.USER: C.ASSISTANT}
    layer = {entry: (0, "")}
    for k in range(len(rows) + 1):
        for _ in range(4):
            for s, (cost, audit) in list(layer.items()):
                layer[into[s]] = min(layer.get(into[s], (1 << 60, "")), (cost + 5, audit + "I"))
        if k == len(rows):
            break
        initial, wrong = rows[k]
        after = {}
        for s, (cost, audit) in layer.items():
            ways = [(s, 2, "D")]
            if wrong not in ("blank", "duplicate"):
                more = 5 if wrong else 0
                kept = {"s": C.SYSTEM if s == C.START else None, "u": C.USER if s != C.USER else None, "a": C.ASSISTANT if s == C.USER else None}.get(initial)
                ways += [(kept, more, "K")] if kept is not None else []
                ways.append((into[s], 1 + more, "R"))
            for t, price, edit in ways:
                after[t] = min(after.get(t, (1 << 60, "")), (cost + price, audit + edit))
        layer = after
    return min((layer[t] for t in exits if t in layer), default=None)


def lattice(draw, n):
    return [(draw.choice("suuaax"), draw.choice([None, None, None, *C.FAULTS])) for _ in range(n)]


def test_bidirectional_search_finds_the_least_cost_and_audit():
    draw = random.Random(3)
    for _ in range(1500):
        rows = lattice(draw, draw.choice([0, 1, 2, 3, 5, 8, 13]))
        entry, exits = draw.choice([0, 0, 1, 2, 3]), draw.choice([C.ACCEPTS, (0,), (1,), (2,), (3,)])
        assert C.cheapest(rows, entry, exits) == plain_cost(rows, entry, exits)


def test_slices_meet_as_one_search_would():
    draw = random.Random(4)
    for _ in range(200):
        rows = lattice(draw, draw.choice([5, 13, 40]))
        cuts = sorted({0, len(rows), *(draw.randrange(len(rows)) for _ in range(draw.choice([1, 4, 12])))})
        chain, tables = C.Chain(), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            ways = [C.cheapest(rows[a:b], s, (t,)) for s in range(4) for t in range(4)]
            tables.append([w and {"cost": w[0], "audit": w[1]} for w in ways])
            chain.add(tables[-1])
        cost, states = chain.close()
        assert (cost, "".join(table[4 * s + t]["audit"] for table, (s, t) in zip(tables, states, strict=True))) == plain_cost(rows)


def test_shortened_heads_compare_alike():
    draw = random.Random(5)
    for _ in range(300):
        base = "".join(draw.choice("DKR") for _ in range(6))
        heads = [draw.choice([None, base[: draw.randrange(7)] + draw.choice(["", "I", "II"]) + base[3:], base, base + "I"]) for _ in range(4)]
        same = {h.replace("I", "") for h in heads if h}
        if len({len(h) for h in same}) > 1:
            continue  # heads of one cut have read the same rows
        short = C.shorten(heads)
        assert [h is None for h in short] == [h is None for h in heads]
        for x, sx in zip(heads, short, strict=True):
            for y, sy in zip(heads, short, strict=True):
                if x is not None and y is not None:
                    for a in ("", "D", "I", "K"):
                        for b in ("", "D", "I", "K"):
                            if x != y:
                                assert (x + a < y + b) == (sx + a < sy + b) or x + a == y + b


def plain_repair(rows):
    """Result columns of one conversation's (turn, role, text) rows, by the rules alone."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    tie = lambda r: hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))
    seen, faults = set(), []
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = plain_cost([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
    fixed = list(C.apply(audit, [(r[1], r[2]) for r in rows]))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in fixed))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in C.FAULTS), illegal, cost, audit, digest), fixed


def conversations(seed):
    draw = random.Random(seed)
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(draw.choice([1, 2, 6, 9]) if conv != 3 else 300):
            text = draw.choice([None, "", " \t", "Yes.", "No!", "Well, perhaps", f"line {turn}.\nand {draw.random()}?", "é" * 40 + "。"])
            rows.append((conv, draw.choice([turn, turn, turn * 3, None]), draw.choice(["user", "assistant", "user", "assistant", "system", None, "tool"]), text, 7))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [(C.SLICE_ROWS, C.SLICE_BYTES), (3, 1 << 20), (512, 40)])
def test_repair_matches_the_rules(spark, limits):
    rows = conversations(6)
    found = C.repair(spark.createDataFrame(rows, ROWS), limits)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = {conv: plain_repair([r[1:4] for r in rows if r[0] == conv]) for conv in {r[0] for r in rows}}
    assert {r.conv_id: tuple(r)[1:] for r in found.collect()} == {conv: w[0] for conv, w in want.items()}
    fixed = {}
    for r in sorted(C.rewrite(spark.createDataFrame(rows, ROWS), limits).collect(), key=lambda r: (r.part, r.seq, r.k)):
        fixed.setdefault(r.conv_id, []).append((r.role, r.text))
    assert fixed == {conv: w[1] for conv, w in want.items() if w[1]}


def test_repair_of_an_empty_table_and_long_texts(spark):
    assert C.repair(spark.createDataFrame([], ROWS)).count() == 0
    rows = [(1, 0, "user", "x" * 3_000_000 + ".", 0), (1, 1, "assistant", "y" * 2_000_000 + "!", 0)]
    found = C.repair(spark.createDataFrame(rows, ROWS)).collect()
    assert [(r.cost, r.audit) for r in found] == [(0, "KK")]
    assert found[0].repaired_sha256 == hashlib.sha256(f"user:{rows[0][3]}\nassistant:{rows[1][3]}".encode()).hexdigest()


def test_damage_by_crc(spark):
    rows = [(c, t, "assistant", "Yes. No! Why?", 0) for c in (None, 1, 2) for t in [None, *range(60)]]
    want = []
    for c, t, role, text, _ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, {1: "", 2: "Yes No Why"}.get(kind, text))
        want += [row] * {0: 0, 3: 2}.get(kind, 1)
    got = [tuple(r) for r in C.damage(spark.createDataFrame(rows, ROWS)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def plain_counts(text):
    words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    shown = [text[a:b] for a, b in words]
    windows = [tuple(shown[k : k + 8]) for k in range(len(shown) - 7)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return (len(shown), sum(map(len, shown)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def test_counts_match_plain_ones_and_bands_reject(spark):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(draw.randint(2, 9))) for _ in range(600)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    line = prose(9)
    texts = [None, "", " \n\t", "one", prose(30), f"{line}\n{prose(40)}\n{line}\n{line}", " ".join([prose(12)] * 9), "a " * 40, "# * $ é|\r\n<b>&\n" * 3, prose(3000), f"{prose(10)}\n \n{prose(10)}\n \n"]
    loops = " ".join(w for w in vocabulary[:30] for _ in range(7))
    noise = " ".join(base64.b64encode(draw.randbytes(30)).decode() for _ in range(60))
    half = prose(700) + " " + " ".join(f"{draw.choice(vocabulary)} " * 6 for _ in range(500))
    texts += [loops, noise, half, prose(400)]
    frame = spark.createDataFrame([(k, t, -1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    found = sorted(quality.rules(frame).collect(), key=lambda r: r.doc_id)
    for r in found:
        want = plain_counts(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and r.kept == (not r.base_failed and r.verdict is None)
    verdicts = {r.doc_id: r.verdict for r in found}
    assert verdicts[11] == "repetitive" and verdicts[12] == "incompressible" and verdicts[4] is verdicts[9] is verdicts[14] is None
    assert verdicts[13] in ("repetitive", "repetitive parts") and found[14].kept
    assert quality.rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_are_compressed_as_a_stream():
    bands = quality.Bands()
    text = b"".join(hashlib.sha256(bytes([k % 251, k // 251])).hexdigest().encode() + b" " for k in range(60000))
    ratio, _, why = bands.judge(memoryview(text))
    assert len(text) > quality._text.PASS_BYTES and 0.5 < ratio < 0.6 and why is None


def plain_tree(leaves):
    paths, nodes = [[] for _ in leaves], [(h, [k]) for k, h in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for k in range(0, len(nodes), 2):
            run = nodes[k : k + 2]
            for j, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append(("".join(h for h, _ in run[:j]), "".join(h for h, _ in run[j + 1 :])))
            above.append((hashlib.sha256("".join(h for h, _ in run).encode()).hexdigest(), [m for _, ms in run for m in ms]))
        nodes = above
    return nodes[0][0], paths


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 3, "b": 700}, {"x": 256, "y": 257, "é": 2, "": 5}])
def test_manifest_matches_a_plain_tree(spark, sizes):
    sha = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    draw, rows = random.Random(9), []
    for lang, n in sizes.items():
        rows += [(draw.randrange(10**6) if k else None, draw.choice([None, "s"]), lang, draw.choice([None, 5, 2**63 - 1]), draw.choice([None, "", "ü", "t" * 9]), 1) for k in range(n)]
    rows += rows[-1:]  # a repeated row
    hashed = lambda r, n: sha(*map(shown, (r[0], r[1], r[2], n, r[4])))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, hashed(r, r[3]), r))
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {lang: plain_tree([g[2] for g in sorted(groups[lang], key=lambda g: g[:3])]) for lang in langs}
    root, tops = plain_tree([trees[lang][0] for lang in langs])
    want = []
    for lang, top in zip(langs, tops, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[lang], key=lambda g: g[:3]), trees[lang][1], strict=True):
            way = path + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = hashed(r, r[3] + 1 if r[3] is not None else None) if hit else leaf
            for before, after in way:
                folded = sha(before, folded, after)
            want.append((r[0], leaf, trees[lang][0], root, sha(*(b + a for b, a in way)), folded))
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, root int")
    found = merkle.documents_manifest(frame)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_manifest(spark):
    assert merkle.documents_manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0
