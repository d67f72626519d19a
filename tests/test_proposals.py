"""Proposals for lines: the outcomes of a plain walk, with one shuffle and one reading of the lines."""

import random

import pytest
from pyspark.sql import functions as F

from hearthbook.operators import products
from hearthbook.plans.fixtures import Ledger
from hearthbook.plans.lifecycle import op_propose


def _plain(lines, resolutions, proposals):
    """(line_id, seq, name) -> outcomes, one proposal after another by seq, null first."""
    there, done, said = set(lines), {k for k, status, _ in resolutions if status in ("proposed", "verified")}, []
    norm = lambda name: " ".join((name or "").upper().split())
    refused = {(k, norm(name)) for k, status, name in resolutions if status == "rejected"}
    for k, seq, name in sorted(proposals, key=lambda p: (p[1] is not None, p[1] or 0)):
        why = "unknown_line" if k is None or k not in there else "settled" if k in done else "rejected_before" if (k, norm(name)) in refused else None
        if why is None:
            why = "repeated" if any(x[0] == k and x[3] == "proposed" for x in said) else "proposed"
        said.append((k, seq, name, why))
    return sorted(said, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_outcomes_are_those_of_a_plain_walk(spark, seed):
    draw = random.Random(seed)
    ids, names = [*range(12), None], ["Milk", " milk ", "Cream", "", None, "Soap  bar"]
    lines = [draw.choice(ids[:9]) for _ in range(12)] + [None]  # some twice
    resolutions = [(draw.choice(ids), draw.choice(["proposed", "verified", "rejected", "rejected", "rejected", "rejected", "superseded", None]), draw.choice(names)) for _ in range(15)]
    proposals = [(draw.choice(ids), seq if seq else None, draw.choice(names)) for seq in range(60)]
    found = products.propose(
        spark.createDataFrame([(k,) for k in lines], "line_id long"), spark.createDataFrame(resolutions, "line_id long, review_status string, name string"),
        spark.createDataFrame([(*p, "kept") for p in proposals], "line_id long, seq int, name string, method string"))
    assert found.columns == ["line_id", "seq", "name", "method", "outcome"]
    assert sorted(((r.line_id, r.seq, r.name, r.outcome) for r in found.collect()), key=repr) == _plain(lines, resolutions, proposals)


def test_equal_seqs_are_proposed_once(spark):
    found = products.propose(spark.createDataFrame([(1,)], "line_id long"), spark.createDataFrame([], "line_id long, review_status string, name string"), spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, "b"), (1, 2, "c")], "line_id long, seq int, name string"))
    assert sorted(r.outcome for r in found.collect()) == ["proposed", "repeated", "repeated", "repeated"]


def _separate(ledger):
    """What op_propose asks, of three tables."""
    named = F.when(F.col("seq") == 1, F.upper("name")).otherwise(F.concat("name", F.lit(" deluxe")))
    offered = ledger.lines.select("line_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "name").withColumn("name", named)
    resolutions = ledger.lines.where("resolution <> 'none'").select("line_id", F.col("resolution").alias("review_status"), "name")
    return products.propose(ledger.lines, resolutions, offered).select("line_id", "seq", "outcome")


def test_lines_are_dealt_out_once(spark):
    ledger = Ledger(spark, "/root/testdata/sf0.001")
    asked, separate = op_propose(ledger), _separate(ledger)
    for frame, scans in ((asked, 1), (separate, 3)):
        plan = frame._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sum("FileScan" in x and "l_orderkey" in x for x in plan) == scans
        assert sum("Exchange hashpartitioning(line_id" in x for x in plan) == 1  # by line, and not again by line and name
    assert sorted(map(tuple, asked.collect())) == sorted(map(tuple, separate.collect()))
