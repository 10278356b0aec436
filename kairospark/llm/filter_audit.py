"""What each filter of a cleaning chain removes in every order of the chain, from difference arrays over the ranks of the orders."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space between words.
_SPACES = " \t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FILTERS = "ABCDE"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The conditions that depend on one text alone: few words, repeated words, many capitals, symbols."""
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * (F.length(text) - F.length(F.translate(text, _CAPITALS, ""))) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part fail which filters, bit k of mask for the kth of FILTERS, by label.

    E, a text that a document with a smaller id has too, needs no row beside another: copies share all other bits, so a text's rows are counted by part and labels, and of a text's documents only those with its least id pass. A hot text or part is counted on the map side first, and only a hash of 256 bits of each text is shuffled.
    Null text: as empty, without words. Null part: as the empty string. A row without an id neither fails E nor makes others fail it, and has no labels. Repeated rows count one each; rows with one id and text alike are no copies of each other. An id with several label rows has a label that any of them gives. Empty table: no rows.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    trimmed = F.btrim(text, F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    own = docs.select(docs[id_col].alias("id"), text.alias("text"), words.alias("words"), F.coalesce(docs[part_col], F.lit("")).alias("part"))
    bits = [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in text_failures(F.col("text"), F.col("words")).items()]
    rows = own.select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"), sum(bits[1:], bits[0]).alias("mask"))
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("key"), F.lit(64))).otherwise(0))  # rows without an id aren't one hot key
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    facts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    each = rows.join(marked, ["id", "salt"], "left").select("id", "salt", "key", "part", "mask", *facts).groupBy("id", "salt", "key", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    kinds = ["key", "part", "mask", "good", "toxic"]
    texts = each.groupBy(*kinds).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("loose"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    least = texts.groupBy("key").agg(F.min("first.id").alias("least"))
    new = F.col("loose") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = texts.join(least, "key").select("part", "good", "toxic", F.explode(F.array(F.struct("mask", new.alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - new).alias("n")))).alias("x"))
    return both.select("part", "good", "toxic", "x.*").where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def lehmer_rank(prefix: tuple[int, ...], k: int) -> int:
    """Rank, among the permutations of range(k), of the first one that begins with prefix."""
    left, rank = list(range(k)), 0
    for place, x in enumerate(prefix, 1):
        rank += left.index(x) * factorial(k - place)
        left.remove(x)
    return rank


def mask_intervals(k: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(mask, step, low, high, kept, removed, redundant): what happens at a step to a document with that mask, for the orders of ranks low to high - 1, which are those with one common beginning of `step` filters."""
    out = []
    for step in range(1, k + 1):
        for prefix in permutations(range(k), step):
            low, last, before = lehmer_rank(prefix, k), 1 << prefix[-1], sum(1 << x for x in prefix[:-1])
            for mask in range(1 << k):
                kept, fails, earlier = not mask & (before | last), bool(mask & last), bool(mask & before)
                if kept or fails:
                    out.append((mask, step, low, low + factorial(k - step), int(kept), int(fails and not earlier), int(fails and earlier)))
    return out


def filter_audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley (what the step's filter removes, over all orders). counts: as of mask_counts().

    The orders that begin alike are an interval of lexicographic ranks, so a mask's count is added at the interval's low end and taken off at its high end; prefix sums over the ranks give every order's totals. The table of intervals depends on the number of filters alone (6,040 rows for five) and is broadcast; a part's arrays have steps times (orders + 1) places, whatever it counts.
    A part with no failing document has rows of zeros, but for kept. Empty table: no rows.
    """
    k, spark = len(filters), counts.sparkSession
    orders = ["".join(p) for p in permutations(filters)]
    spans = spark.createDataFrame(mask_intervals(k), "mask int, step int, low int, high int, stays int, goes int, late int")
    n = F.col("n")
    lone = F.when(F.bit_count("mask") == 1, n * F.col("goes")).otherwise(0)
    sums = {"kept": n * F.col("stays"), "removed": n * F.col("goes"), "redundant": n * F.col("late"), "unique_fails": lone, "good_lost": n * F.col("goes") * F.col("good"), "toxic_lost": n * F.col("goes") * F.col("toxic")}
    changes = counts.join(F.broadcast(spans), "mask").select("part", "step", "low", "high", *(c.cast("long").alias(f) for f, c in sums.items()))
    ends = F.array(*(F.struct(F.col(end).alias("rank"), *((F.col(f) * sign).alias(f) for f in sums)) for end, sign in (("low", 1), ("high", -1))))
    points = changes.groupBy("part", "step", "low", "high").agg(*(F.sum(f).alias(f) for f in sums)).select("part", "step", F.explode(ends).alias("x")).select("part", "step", "x.*").where(F.col("rank") < len(orders))
    places = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"), *(F.lit(0).cast("long").alias(f) for f in sums))
    array = points.unionByName(places).groupBy("part", "step", "rank").agg(*(F.sum(f).alias(f) for f in sums))
    upto = Window.partitionBy("part", "step").orderBy("rank")  # as many rows as orders
    order = F.element_at(F.array(*(F.lit(o) for o in orders)), F.col("rank") + 1)
    totals = array.select("part", "step", order.alias("filter_order"), *(F.sum(f).over(upto).alias(f) for f in sums))
    of = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return totals.select("part", "filter_order", "step", *sums, F.sum("removed").over(of).alias("shapley"))
