"""Metrics of predicted identifiers: greedy, beam, catalogue, head and tail, diversity and errors.

Predictions are rows (task, sample_id, gold, beams): gold a struct of four level texts or null, beams a list of such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sidera.operators.semantic_ids import LEVELS, depth, token

NAMES = ("A", "AB", "ABC", "ABCD")


def as_token(s: Column) -> Column:
    return F.when(s.isNotNull(), token(*(s[x] for x in LEVELS)))


def first_rank(beams: Column, gold: Column, least: int, k: int = 10) -> Column:
    """The rank of the first of k predictions that agrees with gold to `least` levels, or null."""
    agree = F.transform(F.slice(beams, 1, k), lambda p: F.coalesce(p.isNotNull() & (depth(p, gold) >= least), F.lit(False)))
    return F.nullif(F.array_position(agree, True), F.lit(0))


def beam_metrics(preds: DataFrame) -> DataFrame:
    """(task, sample_id, hit1, hit5, hit10, rr, ndcg): a null gold scores 0."""
    r = first_rank(F.col("beams"), F.col("gold"), 4)
    ranked = preds.select("task", "sample_id", F.explode(F.array(r)).alias("r"))  # one row; found once, not for each metric and filter on it
    at = lambda k: F.coalesce(F.when(F.col("r") <= k, 1.0), F.lit(0.0)).alias(f"hit{k}")
    return ranked.select("task", "sample_id", at(1), at(5), at(10), F.coalesce(1.0 / F.col("r"), F.lit(0.0)).alias("rr"), F.coalesce(1.0 / F.log2(F.col("r") + 1.0), F.lit(0.0)).alias("ndcg"))


def beam_summary(preds: DataFrame) -> DataFrame:
    m = beam_metrics(preds)
    return m.groupBy("task").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit1", "hit5", "hit10", "rr", "ndcg")))


def hierarchical_summary(preds: DataFrame) -> DataFrame:
    """(task, level, hit5, hit10, mrr10) at each depth of agreement."""
    depths = preds.select("task", F.transform(F.slice("beams", 1, 10), lambda p: depth(p, F.col("gold"))).alias("d"))  # once for all levels
    at = lambda k: F.nullif(F.array_position(F.transform("d", lambda d: F.coalesce(d >= k, F.lit(False))), True), F.lit(0))
    counts = depths.groupBy("task", *(at(k + 1).alias(n) for k, n in enumerate(NAMES))).agg(F.count("*").alias("c"))  # 11 ranks of each level at most
    ranks = counts.select("task", "c", F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.col(n).alias("r")) for n in NAMES))).alias("x")).select("task", "c", "x.*")
    mean = lambda v: F.round(F.sum(v * F.col("c")) / F.sum("c"), 6)
    hit = lambda k: mean(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"hit{k}")
    return ranks.groupBy("task", "level").agg(hit(5), hit(10), mean(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("mrr10"))


def greedy_summary(preds: DataFrame) -> DataFrame:
    """(task, n, valid_format, level_a, level_ab, level_abc, exact_match) of the first predictions."""
    p = F.get("beams", F.lit(0))
    both = p.isNotNull() & F.col("gold").isNotNull()
    d = F.when(both, depth(p, F.col("gold"))).otherwise(-1)
    rows = preds.select("task", both.cast("double").alias("v"), d.alias("d"))
    at = lambda k, name: F.round(F.avg((F.col("d") >= k).cast("double")), 6).alias(name)
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("valid_format"), at(1, "level_a"), at(2, "level_ab"), at(3, "level_abc"), at(4, "exact_match"))


def first_wrong_level(preds: DataFrame) -> DataFrame:
    """(verdict, n): invalid_format, the first level that differs, or correct; rows with a null gold and a prediction are none."""
    p, g = F.get("beams", F.lit(0)), F.col("gold")
    d = depth(p, g)
    verdict = F.when(p.isNull(), "invalid_format").when(g.isNull(), F.lit(None)).when(d == 4, "correct").otherwise(F.get(F.array(*map(F.lit, LEVELS)), d))
    return preds.select(verdict.alias("verdict")).where("verdict is not null").groupBy("verdict").agg(F.count("*").alias("n"))


def level_a_confusion(preds: DataFrame, n: int = 20) -> DataFrame:
    """(gold_a, pred_a, n): the commonest confusions of level A."""
    p = F.get("beams", F.lit(0))
    rows = preds.select(F.col("gold.A").alias("gold_a"), p["A"].alias("pred_a")).where("gold_a <> pred_a")
    return rows.groupBy("gold_a", "pred_a").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gold_a", "pred_a").limit(n)


def level_a_distribution(preds: DataFrame, n: int = 10) -> DataFrame:
    """(side, a, n): the commonest level A codes of golds and of predictions with a gold."""
    p = F.get("beams", F.lit(0))
    rows = preds.select(F.explode(F.array(F.struct(F.lit("gold").alias("side"), F.col("gold.A").alias("a")), F.struct(F.lit("pred").alias("side"), F.when(F.col("gold").isNotNull(), p["A"]).alias("a")))).alias("x")).select("x.*")
    counts = rows.where("a is not null").groupBy("side", "a").agg(F.count("*").alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("n"), "a"))).where(F.col("rn") <= n).drop("rn")


def catalog_hit(preds: DataFrame, sids: DataFrame, sid: str = "sid") -> DataFrame:
    """(task, n, n_invalid, hit_rate): first predictions that are in the catalogue."""
    rows = preds.select("task", as_token(F.get("beams", F.lit(0))).alias("t"))
    known = sids.select(F.col(sid).alias("t")).distinct().withColumn("k", F.lit(1.0))
    return rows.join(known, "t", "left").groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("t").isNull()).alias("n_invalid"), F.round(F.avg(F.coalesce("k", F.lit(0.0))), 6).alias("hit_rate"))


def gold_catalog_hit(preds: DataFrame) -> DataFrame:
    """(task, by_beam, by_any): predictions, and samples with one, among the golds of all runs."""
    golds = preds.where("gold is not null").select(as_token(F.col("gold")).alias("t")).distinct().withColumn("k", F.lit(1.0))
    beams = preds.select("task", "sample_id", F.explode("beams").alias("b")).where("b is not null").select("task", "sample_id", as_token(F.col("b")).alias("t"))
    hit = beams.join(golds, "t", "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    by_sample = hit.groupBy("task", "sample_id").agg(F.sum("k").alias("s"), F.count("*").alias("c"), F.max("k").alias("m"))
    return by_sample.groupBy("task").agg(F.round(F.sum("s") / F.sum("c"), 6).alias("by_beam"), F.round(F.avg("m"), 6).alias("by_any"))


def coverage(preds: DataFrame, sids: DataFrame, sid: str = "sid") -> DataFrame:
    """(task, unique_sids, catalog_size, coverage) over ten predictions a sample."""
    size = sids.agg(F.count_distinct(sid).alias("catalog_size"))
    seen = preds.select("task", F.explode(F.slice("beams", 1, 10)).alias("b")).where("b is not null").select("task", as_token(F.col("b")).alias("t"))
    return seen.groupBy("task").agg(F.count_distinct("t").alias("unique_sids")).crossJoin(F.broadcast(size)).withColumn("coverage", F.round(F.col("unique_sids") / F.col("catalog_size"), 6))  # one row


def head_tail(sequences: DataFrame, pct: float = 0.2, col: str = "sid_sequence") -> DataFrame:
    """(sid, n, side): the floor(pct * kinds), 1 at least, commonest identifiers are 'head', the rarest 'tail'; a tie goes by the identifier.

    Head and tail are cut by the counts of each frequency, and only the frequency at a cut is ranked inside.
    """
    counts = sequences.select(F.explode(col).alias("sid")).groupBy("sid").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("n").agg(F.count("*").alias("c"))
    order = Window.orderBy(F.desc("n"))  # one row a frequency
    spans = sizes.withColumn("before", F.sum("c").over(order) - F.col("c")).withColumn("kinds", F.sum("c").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    take = F.greatest(F.floor(F.col("kinds") * pct), F.lit(1))
    ranked = counts.join(spans, "n").withColumn("at", F.col("before") + F.row_number().over(Window.partitionBy("n").orderBy("sid")))
    side = F.when(F.col("at") <= take, "head").when(F.col("at") > F.col("kinds") - take, "tail")
    return ranked.select("sid", "n", side.alias("side")).where("side is not null")


def stratified_recall(preds: DataFrame, sides: DataFrame) -> DataFrame:
    """(task, side, n, recall10) of samples whose gold is in the head, else in the tail."""
    hits = preds.select("task", as_token(F.col("gold")).alias("sid"), F.when(first_rank(F.col("beams"), F.col("gold"), 4) <= 10, 1.0).otherwise(0.0).alias("h")).where("sid is not null")
    return hits.join(sides.select("sid", "side"), "sid").groupBy("task", "side").agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("recall10"))


def recall_by_gold_copies(preds: DataFrame, threshold: int = 2) -> DataFrame:
    """(task, side, n, recall10): head are samples whose gold occurs `threshold` times or more in the task."""
    hits = preds.where("gold is not null").select("task", as_token(F.col("gold")).alias("sid"), F.when(first_rank(F.col("beams"), F.col("gold"), 4) <= 10, 1.0).otherwise(0.0).alias("h"))
    side = F.when(F.count("*").over(Window.partitionBy("task", "sid")) >= threshold, "head").otherwise("tail")
    return hits.withColumn("side", side).groupBy("task", "side").agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("recall10"))


def hallucination(preds: DataFrame, valid: DataFrame, sid: str = "sid") -> DataFrame:
    """(total, invalid_format, hallucinated, hallucination_rate) of first predictions against identifiers seen."""
    rows = preds.select(as_token(F.get("beams", F.lit(0))).alias("t"))
    joined = rows.join(valid.select(F.col(sid).alias("t")).distinct().withColumn("k", F.lit(1)), "t", "left")
    wrong = F.count_if(F.col("t").isNotNull() & F.col("k").isNull())
    right = F.count_if(F.col("t").isNotNull())
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("t").isNull()).alias("invalid_format"), wrong.alias("hallucinated"), F.round(wrong / F.greatest(right, F.lit(1)), 6).alias("hallucination_rate"))


def diversity(preds: DataFrame, sids: DataFrame, sid: str = "sid") -> DataFrame:
    """(total, unique_sids, unique_rate, top5_share, exploration) of first predictions."""
    counts = preds.select(as_token(F.get("beams", F.lit(0))).alias("t")).where("t is not null").groupBy("t").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "t").limit(5).agg(F.sum("n").alias("top5"))
    all_of = counts.agg(F.sum("n").alias("total"), F.count("*").alias("unique_sids"))
    size = sids.agg(F.count_distinct(sid).alias("size"))
    one = all_of.crossJoin(top).crossJoin(size)
    return one.select("total", "unique_sids", F.round(F.col("unique_sids") / F.col("total"), 6).alias("unique_rate"), F.round(F.col("top5") / F.col("total"), 6).alias("top5_share"), F.round(F.col("unique_sids") / F.col("size"), 6).alias("exploration"))


def dominant_intent(items: DataFrame, intents: tuple[tuple[str, str], ...], level: str = "A", title: str = "title", least: int = 3) -> DataFrame:
    """(level, intent, n): the commonest keyword's intent in the titles of a level's items, if it is found `least` times."""
    from sidera.functions.text import keyword_pairs

    found = F.array(*(F.when(F.lower(title).contains(w), F.lit(to)) for w, to in keyword_pairs(intents)))
    rows = items.select(level, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("intent"))
    counts = rows.groupBy(level, "intent").agg(F.count("*").alias("n"))
    return counts.withColumn("rn", F.row_number().over(Window.partitionBy(level).orderBy(F.desc("n"), "intent"))).where((F.col("rn") == 1) & (F.col("n") >= least)).drop("rn")


def intent_match(preds: DataFrame, questions: Column, dominant: DataFrame, intents) -> DataFrame:
    """(n, matched, rate) of first predictions whose level A has the intent that the question's text names."""
    from sidera.functions.text import intent

    asked = preds.select(intent(questions, intents).alias("want"), F.get("beams", F.lit(0))["A"].cast("int").alias("A")).where("want is not null and A is not null")
    joined = asked.join(dominant.select(F.col("A").cast("int").alias("A"), "intent"), "A")
    return joined.agg(F.count("*").alias("n"), F.count_if(F.col("want") == F.col("intent")).alias("matched"), F.round(F.avg((F.col("want") == F.col("intent")).cast("double")), 6).alias("rate"))


def multi_gold(preds: DataFrame, k: int = 10) -> DataFrame:
    """(task, n, hit1, hit5, hit10, mrr10, coverage10) of rows with several golds: (task, sample_id, golds, beams) of tokens.

    A hit is any gold among the first beams; coverage is the share of the golds among the first k. Rows without golds count as misses.
    """
    golds, beams = F.array_distinct(F.coalesce("golds", F.array().cast("array<string>"))), F.slice("beams", 1, k)
    hit = F.transform(beams, lambda x, i: F.when(F.coalesce(F.array_contains(golds, x), F.lit(False)), i + 1))
    rows = preds.select("task", F.array_min(hit).alias("r"), F.coalesce(F.size(F.array_intersect(golds, beams)) / F.nullif(F.size(golds), F.lit(0)), F.lit(0.0)).alias("c"))
    at = lambda n: F.round(F.avg((F.coalesce("r", F.lit(k + 1)) <= n).cast("double")), 6).alias(f"hit{n}")
    return rows.groupBy("task").agg(F.count("*").alias("n"), *map(at, (1, 5, 10)), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr10"), F.round(F.avg("c"), 6).alias("coverage10"))


def multi_gold_greedy(preds: DataFrame) -> DataFrame:
    """(task, n, valid_format, level_a, level_ab, level_abc, exact_match) of a first prediction `pred` against the nearest of several golds (structs)."""
    best = F.when(F.col("pred").isNotNull() & (F.size("golds") > 0), F.array_max(F.transform("golds", lambda g: depth(F.col("pred"), g))))
    rows = preds.select("task", best.alias("d"))
    share = lambda n, name: F.round(F.avg((F.coalesce("d", F.lit(-1)) >= n).cast("double")), 6).alias(name)
    return rows.groupBy("task").agg(F.count("*").alias("n"), *(share(n, name) for n, name in enumerate(("valid_format", "level_a", "level_ab", "level_abc", "exact_match"))))


def examples(preds: DataFrame, most: int = 6) -> DataFrame:
    """(task, sample_id, correct): half of `most` right and half wrong samples of each task, the first by id."""
    right = F.coalesce(depth(F.get("beams", F.lit(0)), F.col("gold")) == 4, F.lit(False)) & F.get("beams", F.lit(0)).isNotNull() & F.col("gold").isNotNull()
    rows = preds.select("task", "sample_id", right.alias("correct"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("task", "correct").orderBy("sample_id"))).where(F.col("rn") <= most // 2).drop("rn")


def weighted(metrics: DataFrame, groups: DataFrame, value: str, size: str = "n") -> DataFrame:
    """(group, n, value): the tasks' values weighed by their sizes."""
    return metrics.join(groups, "task").groupBy("grp").agg(F.sum(size).alias("n"), F.round(F.sum(F.col(value) * F.col(size)) / F.sum(size), 6).alias(value))
