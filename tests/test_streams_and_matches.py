"""Streams with state, table functions, and joins held against plain rules."""

import datetime
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from hearthbook.operators import forecast, items, merge, reconcile, rules, search
from hearthbook.streaming import intake, lots

D = datetime.date.fromisoformat
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def timers(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_fold_is_the_step_machine(spark):
    draw, rows = random.Random(1), []
    for lot in range(40):
        for k in range(25):
            day = D("2026-01-01") + datetime.timedelta(days=draw.randrange(60))
            rows.append((lot, k, day, draw.choice(["still_have", "finished", "thrown_out", "opened", "reopened", "undo", "eaten"]), draw.choice([None, day, day - datetime.timedelta(days=3), day + datetime.timedelta(days=9)]), draw.choice([None, 0, 3]), draw.choice([None, None, D("2026-01-10")]), draw.choice([None, True, False]), draw.choice([None, True, False])))
    frame = spark.createDataFrame(rows, "lot_id long, seq long, day date, event string, today date, precision int, bought_on date, consumable boolean, openable boolean")
    got = {r.lot_id: tuple(r)[1:] for r in lots.fold(frame).collect()}
    for lot in range(40):
        state, before = lots.State(), None
        for _, _, day, event, today, precision, bought, consumable, openable in (r for r in rows if r[0] == lot):
            state, before = lots.step(state, before, lots.Command(event, day, today or day, precision or 0, bought, consumable is not False, openable is not False))
        assert got[lot] == tuple(state)
    assert "Python" not in lots.fold(frame)._jdf.queryExecution().executedPlan().toString()
    assert lots.fold(frame.limit(0)).count() == 0


def test_time_alone_asks_about_a_lot(timers, tmp_path):
    spark, day = timers, D("2026-01-01")
    schema = "lot_id long, seq long, day date, event string, ts timestamp"
    at = lambda d: datetime.datetime(2026, 1, d)
    # lot 1 is asked about on the 8th; lot 2 is finished; lot 4 answers again before it is due
    parts = [[(1, 0, day, "still_have", at(1)), (2, 0, day, "still_have", at(1)), (2, 1, day, "finished", at(1)), (4, 0, day, "still_have", at(1))], [(4, 1, D("2026-01-05"), "still_have", at(5))], [(3, 0, D("2026-01-12"), "opened", at(12))]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1 if k < 2 else 0)  # files are taken in the order of their seconds
    stream, seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), []
    query = lots.asking(stream, "ts").writeStream.outputMode("update").foreachBatch(lambda b, k: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(180) and query.exception() is None
    assert [(r.lot_id, r.asks) for r in seen if r.asks] == [(1, D("2026-01-08"))]
    assert {r.lot_id: (r.status, r.next_check_on) for r in seen if not r.asks} == {1: ("in_stock", D("2026-01-08")), 2: ("finished", None), 3: ("in_stock", None), 4: ("in_stock", D("2026-01-19"))}


def test_a_growing_file_is_taken_once_and_whole(timers, tmp_path):
    spark, folder, taken = timers, tmp_path / "inbox", []
    folder.mkdir()
    spark.dataSource.register(intake.Looks)
    (folder / "b.part").write_text("under way")
    looks = spark.readStream.format("looks").load(str(folder))
    query = intake.whole_files(looks).writeStream.outputMode("append").foreachBatch(lambda b, k: taken.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        def until(done, seconds=90):
            end = time.time() + seconds
            while not done() and time.time() < end and query.exception() is None:
                time.sleep(0.2)
                yield
        def batches():
            return (query.lastProgress or {"batchId": -1})["batchId"]
        for k, _ in enumerate(until(lambda: batches() >= 3)):  # it changes between all looks
            with open(folder / "a.csv", "a") as file:
                file.write(f"line {k}\n")
        assert taken == []
        whole, since = (folder / "a.csv").stat().st_size, batches()
        for _ in until(lambda: batches() >= since + 4):
            pass
        assert [(r.path.rpartition("/")[2], r.size) for r in taken] == [("a.csv", whole)]
    finally:
        query.stop()


def test_contents_are_forgotten_behind_the_watermark(timers, tmp_path):
    spark = timers
    schema, at = "hash string, ts timestamp", lambda d: datetime.datetime(2026, 1, d)
    for rows in ([("a", at(1)), ("a", at(1)), ("b", at(1))], [("a", at(2)), ("c", at(9))], [("d", at(20))], [("a", at(20)), ("e", at(20))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream, seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), []
    query = intake.first_of_content(stream, "hash", "ts", "2 days").writeStream.foreachBatch(lambda b, k: seen.extend(r.hash for r in b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(180) and query.exception() is None
    assert sorted(seen) == ["a", "a", "b", "c", "d", "e"]  # a again, once its first sight is forgotten
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_projection_as_a_table_function(spark):
    forecast.register_table_functions(spark)
    scenarios = spark.createDataFrame([(k, 100000 * k, 300000, 100 * k, 200, 24, [("groceries", 200000)], [("loan", 1_000_000, 600, 50_000)], [("groceries", -1000)]) for k in (1, 2)], "scenario_id long, cash long, monthly_income long, income_growth_bp long, inflation_bp long, months int, spending array<struct<category:string,amount:long>>, assets array<struct<kind:string,value_minor:long,annual_rate_bp:long,monthly_payment_minor:long>>, spending_changes array<struct<category:string,percent_bp:long>>")
    told = spark.sql("select scenario_id, p.* from (select scenario_id, struct(*) as scenario from {scenarios}) s, lateral project(scenario) p", scenarios=scenarios)
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, forecast.project(scenarios).collect())) and told.count() == 48
    golden = {"cash": 0, "monthly_income": 0, "income_growth_bp": 0, "inflation_bp": 0, "months": 12, "assets": [{"kind": "loan", "value_minor": 1_000_000, "annual_rate_bp": 600, "monthly_payment_minor": 50_000}]}
    assert list(forecast.project_one(golden))[0][7] == 955000
    with pytest.raises(ValueError, match="1200 months"):
        list(forecast.project_one({**golden, "months": 1201}))
    assert sum(1 for _ in forecast.project_one({**golden, "months": 1200})) == 1200


RECEIPTS = "receipt_id long, merchant string, purchase_date date, currency string, total_minor long, review_status string"
POSTINGS = "posting_id long, posted_date date, description_raw string, currency string, amount_minor long, review_status string"


def greedy(receipts, postings):
    """Links one receipt after another, by id, over all rows."""
    taken, links = set(), set()
    for rid, merchant, bought, currency, total, _ in sorted(receipts):
        ways = []
        for pid, posted, text, their, amount, _ in postings:
            lag = (posted - bought).days
            if their == currency and amount == -total and 0 <= lag <= 5 and pid not in taken:
                named = bool({w for w in merchant.split() if len(w) > 2} & {w for w in text.split() if len(w) > 2})
                ways.append((60 + (20 if lag == 0 else 10 if lag <= 2 else 0) + 20 * named, -pid))
        ways.sort(reverse=True)
        if len(ways) == 1 or (ways and ways[0][0] >= 80 and ways[0][0] - ways[1][0] >= 20):
            taken.add(-ways[0][1])
            links.add((rid, -ways[0][1]))
    return links


@pytest.mark.parametrize("days", [40, 400, 4000])
def test_islands_keep_the_links_of_the_sequential_rule(spark, days):
    draw, start = random.Random(days), D("2020-01-01")
    day = lambda: start + datetime.timedelta(days=draw.randrange(days))
    amount = lambda: 500 if draw.random() < 0.9 else draw.choice([700, 900])
    receipts = [(k, draw.choice(["RED SHOP", "BLUE CAFE"]), day(), "USD", amount(), "proposed") for k in range(300)]
    postings = [(k, day(), draw.choice(["RED SHOP", "BLUE CAFE", "OTHER"]), "USD", -amount(), "proposed") for k in range(400)]
    r, p = spark.createDataFrame(receipts, RECEIPTS), spark.createDataFrame(postings, POSTINGS)
    got = {(x.receipt_id, x.posting_id) for x in reconcile.link_receipts(r, p).where("status = 'link'").collect()}
    assert got == greedy(receipts, postings)


def test_one_amount_is_many_islands(spark):
    start = D("2000-01-01")
    pairs = spark.createDataFrame([("USD", 500, k, start + datetime.timedelta(days=10 * (k // 3) + k % 3)) for k in range(3000)], "currency string, amount_minor long, receipt_id long, since date").withColumn("until", F.date_add("since", 5))
    each = reconcile.with_islands(pairs, "since", "until").groupBy("island").count().collect()
    assert len(each) == 1000 and {r["count"] for r in each} == {3}


def test_a_choice_looks_at_every_other_holder(spark):
    issues = spark.createDataFrame([("ambiguous_receipt_match", k, [10, 11], "open") for k in (1, 2, 3, 4)], "issue_type string, record_id long, candidates array<long>, status string")
    choices = spark.createDataFrame([("ambiguous_receipt_match", k, 1, 10 if k < 4 else 11) for k in (1, 2, 3, 4)], "issue_type string, record_id long, seq int, chosen long")
    rows = spark.createDataFrame([(10, "proposed"), (11, "proposed")], "posting_id long, review_status string")

    def outcomes(*taken):
        held = spark.createDataFrame(list(taken), "posting_id long, receipt_id long")
        return {r.record_id: r.outcome for r in reconcile.resolve_issues(issues, choices, rows, held).collect()}

    assert outcomes((10, 1), (10, 2)) == {1: "refused", 2: "refused", 3: "refused", 4: "linked"}
    assert outcomes((10, 2), (11, 4)) == {1: "refused", 2: "linked", 3: "refused", 4: "linked"}
    assert outcomes() == dict.fromkeys((1, 2, 3, 4), "linked")


def plain_similar(lines, known, count):
    words = lambda text: {w for w in text.split() if len(w) > 2}
    out = {}
    for line, merchant, text in lines:
        ranked = sorted((-len(words(text) & words(other)), merchant != theirs or merchant is None, k) for k, theirs, other in known if words(text) & words(other))
        out |= {(line, k): (-shared, place) for place, (shared, _, k) in enumerate(ranked[:count], 1)}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_similar_lines_match_brute_force(spark, seed):
    draw = random.Random(seed)
    vocabulary = [f"W{''.join(draw.choice('ABCDEFGH') for _ in range(3))}" for _ in range(draw.choice([12, 60]))]
    describe = lambda: " ".join(["ITEM", *(draw.choice(vocabulary) for _ in range(draw.choice([0, 1, 2, 4, 7])))])
    merchant = lambda: draw.choice(["M", "N", None])
    lines, known = [(k, merchant(), draw.choice([describe(), "NOTHING ELSE", ""])) for k in range(40)], [(k, merchant(), describe()) for k in range(150)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, merchant string, description string")
    got = {(r.line_id, r.known_id): (r.shared, r.k) for r in rules.similar(frame(lines, "line_id"), frame(known, "known_id"), 5).collect()}
    assert got == plain_similar(lines, known, 5)
    assert rules.similar(frame(lines, "line_id"), frame([], "known_id")).count() == 0 and rules.similar(frame([], "line_id"), frame(known, "known_id")).count() == 0


def test_copies_of_lines_are_sorted_and_ranked_once(spark, monkeypatch):
    """All known rows went on to each later step, in as many tasks as their file had, and each line ranked what it met by itself."""
    draw, written, sorted_ = random.Random(3), [], []
    texts, merchant = ["ITEM RED BOLT LARGE", "ITEM RED RING", "ITEM OLD RING SMALL"], lambda: draw.choice(["M", "N", None])
    lines, known = [(k, merchant(), draw.choice([*texts, "ITEM BOLT", ""])) for k in range(300)], [(k, merchant(), draw.choice(texts)) for k in range(1500)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, merchant string, description string").coalesce(1)
    kept, least = rules.kept, rules._least_ids
    monkeypatch.setattr(rules, "kept", lambda f: written.append(kept(f)) or written[-1])
    monkeypatch.setattr(rules, "_least_ids", lambda rows, *a: sorted_.append(rows) or least(rows, *a))
    got = {(r.line_id, r.known_id): (r.shared, r.k) for r in rules.similar(frame(lines, "line_id"), frame(known, "known_id"), 5).collect()}
    assert got == plain_similar(lines, known, 5)
    assert [f.count() for f in written if "known_id" in f.columns or "id" in f.columns and f is not written[0]] == [len(texts) * 3 * 10]
    large = [f for f in sorted_ if f.count() > 500]
    assert len(large) == 1 and large[0].selectExpr("spark_partition_id() as task").distinct().count() >= 4


def test_a_line_given_twice_is_one(spark):
    known = spark.createDataFrame([(k, "M", "ITEM RED") for k in range(8)], "known_id long, merchant string, description string")
    lines = spark.createDataFrame([(1, None, "ITEM RED"), (1, None, "ITEM RED")], "line_id long, merchant string, description string")
    assert sorted((r.known_id, r.shared, r.k) for r in rules.similar(lines, known).collect()) == [(k, 2, k + 1) for k in range(5)]


def test_search_by_postings(spark, tmp_path):
    target = str(tmp_path / "index")
    texts = spark.createDataFrame([(1, "Red milk", None), (2, "Shredded RED cheese", "x"), (3, None, None), (4, "blue", "milk red")], "id long, a string, b string")
    search.insert(target, "product", texts.where("id < 4"), "id", "a", "b")
    search.insert(target, "product", texts.where("id = 4"), "id", "a", "b")
    search.insert(target, "note", spark.createDataFrame([("n", "milky way")], "id string, t string"), "id", "t")
    find = lambda q: sorted(map(tuple, search.find(spark, target, q).collect()))
    assert find("red") == [("product", "1"), ("product", "2"), ("product", "4")] and find("RED milk") == [("product", "1"), ("product", "4")]
    assert find("milk") == [("note", "n"), ("product", "1"), ("product", "4")] and find("") == find("nowhere") == []
    plan = search.find(spark, target, "cheese")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)
    assert spark.read.parquet(f"{target}/vocabulary").groupBy("word").count().where("count > 1").isEmpty()


def test_versions_of_files(spark):
    rows = [("f", "A", 1, 1), ("f", "B", 2, 2), ("f", "A", 3, 3), ("g", "A", 4, 4), ("f", "A", 5, 5), ("f", "B", 6, 2), ("f", "A", 7, 6), ("g", "C", 8, 7), ("h", "D", 9, 8)]
    frame = spark.createDataFrame(rows, "file string, bytes string, seq long, job long")
    got = [r.status for r in merge.versions(frame, ["file"], "bytes", "seq", "job").orderBy("seq").collect()]
    assert got == ["captured", "new_version", "new_version", "duplicate", "unchanged", "recovered_version", "unchanged", "new_version", "captured"]


def test_asked_words_are_normalised(spark):
    rows = spark.createDataFrame([(1, "7-Up Zero", "Keurig", "beverages", 100, "USD", "in_stock", D("2026-01-01")), (2, "Milk", "A&W", "dairy & eggs", 100, "USD", "in_stock", D("2026-01-01"))], "lot_id long, name string, brand string, category string, cost_minor long, currency string, status string, bought_on date")
    found = lambda q: [r.lot_id for r in items.matching(rows, q).collect()]
    assert found("7-up") == found("7 UP") == found("up/zero!") == [1] and found("a&w") == [2] and found("eggs, dairy") == [2] and found("milk zero") == []
    assert [r.lot_id for r in items.inventory(rows, "7-up").collect()] == [1] and items.asked_words(None) == [] and len(items.asked_words("a b c d e f g h i j")) == 8


def test_rules_meet_on_their_rarest_word(spark):
    rows = spark.createDataFrame([(k, 1, f"THE SHOP {'MILK' if k == 3 else 'X'}") for k in range(6)], "transaction_id long, account_id long, description_raw string")
    rule = spark.createDataFrame([(1, "THE MILK", "dairy", None), (2, "SHOP", "shops", 1), (3, "THE NOTHING", "none", None)], "rule_id long, pattern string, category string, account_id long")
    assert {r.transaction_id: r.rule_id for r in rules.apply_rules(rows, rule).collect()} == {k: 1 if k == 3 else 2 for k in range(6)}
