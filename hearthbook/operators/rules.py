"""Category rules: a rule fits where all its words stand in the description."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearthbook.functions.text import normalize_name
from hearthbook.operators.written import kept


def apply_rules(rows: DataFrame, rules: DataFrame, id_column: str = "transaction_id") -> DataFrame:
    """rows' ids with rule_id and category of the fitting rule with most words, the newest of equals; rows without one are left out.

    rules (rule_id, pattern, category, account_id or null).  A rule meets rows on
    that of its words which the fewest descriptions hold, so a word that stands
    everywhere pairs nothing.  Descriptions that normalise alike are matched once.
    """
    named = rows.select(id_column, F.col("account_id").alias("of_account"), normalize_name(F.col("description_raw"), ascii_only=True).alias("name"))
    said = named.select("name").distinct().withColumn("said", F.split("name", " "))
    each = said.select("name", "said", F.explode(F.array_distinct("said")).alias("word"))
    spelled = rules.withColumn("words", F.split("pattern", " "))
    asked = spelled.select("rule_id", F.explode(F.array_distinct("words")).alias("word"))
    often = each.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("often"))
    rarest = asked.join(often, "word", "left").groupBy("rule_id").agg(F.min_by("word", F.struct(F.coalesce("often", F.lit(0)), "word")).alias("word"))
    split = spelled.join(rarest, "rule_id")
    fits = each.join(split, "word").where("size(array_except(words, said)) = 0")
    rank = F.struct(F.size("words").alias("size"), "rule_id", "category")
    anyone = fits.where("account_id is null").groupBy("name").agg(F.max(rank).alias("anyone"))
    own = fits.where("account_id is not null").groupBy("name", F.col("account_id").alias("of_account")).agg(F.max(rank).alias("own"))
    best = named.join(anyone, "name", "left").join(own, ["name", "of_account"], "left").select(id_column, F.array_max(F.array("anyone", "own")).alias("best"))
    return best.where("best is not null").select(id_column, "best.rule_id", "best.category")


def _word_sets(rows: DataFrame, id_column: str) -> DataFrame:
    """rows' id and merchant with the sorted set of their words of more than two letters, and its key; rows without words are left out."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(normalize_name(F.col("description"), True), " "), lambda t: F.length(t) > 2)))
    return rows.select(F.col(id_column).alias("id"), "merchant", words.alias("words")).where("size(words) > 0").withColumn("set", F.md5(F.array_join("words", " ")))


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out evenly by a key of each: a small file of them is many words to read and sort, and would be one task."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def _least_ids(rows: DataFrame, group: list[str], count: int) -> DataFrame:
    """The rows of the least ids of each group; all with the same key are one after another, and only so many leave a task."""
    w = W.partitionBy(*group).orderBy("known_id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= count).drop("n")


def similar(lines: DataFrame, known: DataFrame, count: int = 5) -> DataFrame:
    """(line_id, known_id, shared, k): known lines that share most words of more than two letters, the same merchant first, then the least id.

    A set join by prefixes: lines with equal words are one set, of a known set only the
    least ids of each merchant can be wanted and go on, lines of one set and merchant ask
    once, and a set's words meet others rarest first.  Once
    ``count`` rows found share more words than are still unread, the rest cannot matter,
    so words that stand nearly everywhere are joined for no line that has better ones.
    The commonest word of a set is never joined: for those that share only it, the
    least ids of that word are enough.
    """
    a = kept(_word_sets(_dealt(lines, "line_id"), "line_id").withColumnRenamed("id", "line_id").withColumnRenamed("merchant", "here").distinct())  # a line given twice is one; they are dealt by id already
    b = kept(_least_ids(_word_sets(_dealt(known, "known_id"), "known_id").withColumnRenamed("id", "known_id"), ["set", "merchant"], 2 * count))
    held = kept(b.groupBy("set").agg(F.first("words").alias("words")))
    posted = held.select(F.col("set").alias("other"), F.explode("words").alias("word"))
    often = posted.groupBy("word").agg(F.count("*").alias("often"))
    asked = a.groupBy("set").agg(F.first("words").alias("words")).select("set", "words", F.explode("words").alias("word")).join(often, "word")  # words that no known line has match nothing
    rare = asked.groupBy("set", "words").agg(F.array_sort(F.collect_list(F.struct("often", "word"))).alias("ranked"))
    open_ = kept(rare.select("set", "words", F.transform("ranked", lambda r: r["word"]).alias("ranked")))
    counts = b.groupBy(F.col("set").alias("other")).agg(F.least(F.count("*"), F.lit(count)).alias("rows"))
    read, upto, found, width = 0, 1, None, (open_.agg(F.max(F.size("ranked"))).first()[0] or 0)
    while read < width - 1:
        prefix = open_.select("set", "words", F.explode(F.slice("ranked", read + 1, F.least(F.lit(upto - read), F.greatest(F.lit(0), F.size("ranked") - 1 - read)))).alias("word"))
        pairs = prefix.join(posted, "word").select("set", "words", "other").distinct().join(held.select(F.col("set").alias("other"), F.col("words").alias("theirs")), "other")
        pairs = pairs.select("set", "other", F.size(F.array_intersect("words", "theirs")).alias("shared"))
        found = kept(pairs if found is None else found.unionAll(pairs).distinct())
        # shared of the row that is count-th best so far, a known set counting for as many rows as can be wanted
        w = W.partitionBy("set").orderBy(F.desc("shared"), "other").rowsBetween(W.unboundedPreceding, W.currentRow)
        sure = found.join(counts, "other").withColumn("so_far", F.sum("rows").over(w)).where(F.col("so_far") >= count).groupBy("set").agg(F.max("shared").alias("sure"))
        rest = open_.join(sure, "set", "left").where(F.coalesce(F.col("sure"), F.lit(0)) <= F.greatest(F.size("ranked") - upto, F.lit(1)))
        open_, read, upto = kept(rest.select("set", "words", "ranked")), upto, min(2 * upto, max(width - 1, 1))
        if open_.isEmpty():
            break
    line = kept(a.select("set", "here").distinct())
    member = b.select(F.col("set").alias("other"), "merchant", "known_id")

    def rows_of(met: DataFrame, group: str, listed: DataFrame, most: int) -> DataFrame:
        """Known rows of what lines of a set and merchant have met: the least ids of the group, and of their own merchant in it."""
        own = met.join(_least_ids(listed, [group, "merchant"], most).withColumnRenamed("merchant", "here"), [group, "here"]).select("set", "here", "known_id", "shared", F.lit(True).alias("same"))
        anyone = met.join(_least_ids(listed, [group], most), group)
        return own.unionAll(anyone.select("set", "here", "known_id", "shared", F.coalesce(F.col("here") == F.col("merchant"), F.lit(False)).alias("same")))

    # sets that are still open may want rows that share their commonest word only; fewer than count of those of that word were met before
    tails = line.join(open_.select("set", F.element_at("ranked", -1).alias("word")), "set").withColumn("shared", F.lit(1))
    listed = b.select("merchant", "known_id", F.explode("words").alias("word")).join(tails.select("word").distinct(), "word", "left_semi")
    rows = rows_of(tails, "word", listed, 2 * count)
    if found is not None:
        rows = rows.unionAll(rows_of(line.join(found, "set"), "other", member, count))
    pairs = rows.groupBy("set", "here", "known_id").agg(F.max("shared").cast("long").alias("shared"), F.max("same").alias("same"))
    place = F.row_number().over(W.partitionBy("set", "here").orderBy(F.desc("shared"), F.desc("same"), "known_id"))
    best = pairs.withColumn("k", place).where(F.col("k") <= count).groupBy(F.col("set").alias("of"), F.col("here").alias("at")).agg(F.collect_list(F.struct("known_id", "shared", "k")).alias("best"))
    return a.join(best, (F.col("set") == F.col("of")) & F.col("here").eqNullSafe(F.col("at"))).select("line_id", F.inline("best"))
