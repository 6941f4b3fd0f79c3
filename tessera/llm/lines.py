"""Line dedup by a suffix array over line-ID sequences, with built-in expressions only.

Lines that occur once cannot lie in a repeated run, so the sequences are the stretches of repeated lines between them. Their
suffixes are ranked by prefix doubling: round k ranks by pairs (rank, rank 2**k lines on), each written to the shared
folder. A rank is 1 + the number of smaller suffixes, found by counts of pairs in buckets, so no window holds more than one
bucket or one list of buckets. Doubling ends when the runs in question are covered.

A run counts when it has at least `min_words` words. Suffixes whose shortest prefix of that many words is the same form one
interval of the longest-common-prefix array at that depth; two overlapping ranks of a power of two name that prefix. The
shortest stretches of that many words that end at a line are named and compared the same way, as the last lines of a run
may be too few words for a prefix. Members that do not overlap the first one in (document, position) order are later copies.
Each line of a repeated run lies in a prefix within the run or in the stretch that ends with it, so overlapping later copies
add up to the maximal repeated runs, and their lines are deleted. What overlaps the first member is no copy: of a hundred
equal lines, as many as make one whole run stay.

Defined cases: null texts stay null and empty ones empty; blank lines are not compared and go only with a run they lie in; rows are told apart by (doc_id, number within the id), so that of repeated rows the first stays
whole; a null id sorts first; an empty table stays empty; all columns of docs are kept, n_chars brought up to date if
present.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import discard, stored

END = -1  # rank of what follows a stretch


def line_table(docs: DataFrame) -> DataFrame:
    """row, pos, two 64-bit digests of the line, and its words (blanks + 1) for each line that is not blank."""
    lines = docs.select("row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.trim("line") != "")
    blanks = F.octet_length(F.trim("line")) - F.octet_length(F.replace(F.trim("line"), F.lit(" "), F.lit("")))
    return lines.select("row", "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b"), (blanks + 1).alias("words"))


def _ranked(pairs: DataFrame, size: int) -> DataFrame:
    """(r1, r2, n) with r1 a rank to rank by (r1, r2): r1 plus the members of its class with smaller r2."""
    bucketed = pairs.withColumn("bucket", F.floor(F.col("r2") / size))
    within = Window.partitionBy("r1", "bucket").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("r1").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = bucketed.groupBy("r1", "bucket").agg(F.sum("n").alias("in_bucket")).withColumn("skip", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    local = bucketed.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    joined = local.join(sums.select(F.col("r1").alias("s1"), F.col("bucket").alias("sb"), "skip"), (F.col("r1") == F.col("s1")) & (F.col("bucket") == F.col("sb")))
    return joined.select("r1", "r2", (F.col("r1") + F.col("skip") + F.col("inside")).alias("rank"))


def line_ranks(lines: DataFrame) -> DataFrame:
    """a, b and the rank of each line that occurs more than once, lines standing by digest."""
    repeated = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    ranks = _ranked(repeated.groupBy(F.lit(0).cast("long").alias("r1"), F.col("a").alias("r2")).agg(F.sum("n").alias("n")), 2**50)
    same = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return repeated.join(ranks, F.col("a") == F.col("r2")).select("a", "b", (F.col("rank") + F.coalesce(F.sum("n").over(same), F.lit(0))).alias("rank"))


def suffix_ranks(lines: DataFrame, min_words: int, path: str) -> tuple[DataFrame, int]:
    """The suffixes of stretches of min_words words or more, with ranks lv0, lv1, lv2 ... by their first 1, 2, 4 ... lines."""
    numbered = lines.withColumn("at", F.row_number().over(Window.partitionBy("row").orderBy("pos")))
    ranks = line_ranks(lines).select(F.col("a").alias("a1"), F.col("b").alias("b1"), F.col("rank").alias("lv0"))
    state = numbered.join(ranks, (F.col("a") == F.col("a1")) & (F.col("b") == F.col("b1"))).select("row", "pos", "at", "words", "lv0")
    state = state.withColumn("stretch", F.col("at") - F.row_number().over(Window.partitionBy("row").orderBy("at")))
    whole = Window.partitionBy("row", "stretch")
    state = state.withColumns({"w": F.sum("words").over(whole), "lines": F.count(F.lit(1)).over(whole)}).filter(F.col("w") >= min_words)
    state = stored(state.drop("w"), f"{path}/level0")
    reach = min(state.agg(F.max("lines")).first()[0] or 0, min_words)
    state, levels = state.drop("lines"), 1
    while 2**levels <= reach:
        here, step = f"lv{levels - 1}", 2 ** (levels - 1)
        ahead = F.coalesce(F.lead(here, step).over(whole.orderBy("at")), F.lit(END).cast("long"))
        paired = state.withColumn("ahead", ahead)
        if levels > 1:
            paired = stored(paired, f"{path}/level{levels - 1}")
            if levels > 2:
                discard(paired.sparkSession, f"{path}/level{levels - 2}")
        ranks = _ranked(paired.groupBy(F.col(here).alias("r1"), F.col("ahead").alias("r2")).agg(F.count(F.lit(1)).alias("n")), 1 << 20)
        state = paired.join(ranks, (F.col(here) == F.col("r1")) & (F.col("ahead") == F.col("r2"))).select(*state.columns, F.col("rank").alias(f"lv{levels}"))
        levels += 1
    return (stored(state, f"{path}/suffixes") if levels > 1 else state), levels


def later_copies(suffixes: DataFrame, levels: int, min_words: int) -> DataFrame:
    """row and gone, the sorted disjoint ranges (from, to) of positions to delete."""
    capped = F.least("words", F.lit(min_words))  # a line never adds more than a whole run needs
    stretch = Window.partitionBy("row", "stretch")
    df = suffixes.withColumn("b", F.sum(capped).over(stretch.orderBy("at")) - capped)
    df = df.withColumns({"total": F.sum(capped).over(stretch), "end": F.max("at").over(stretch) + 1})
    stop = F.min("at").over(stretch.orderBy("b").rangeBetween(min_words, 2 * min_words))
    df = df.withColumn("m", F.coalesce(stop, F.when(F.col("total") - F.col("b") >= min_words, F.col("end"))) - F.col("at"))
    df = df.withColumn("e", F.col("b") + capped)
    before = stretch.orderBy("e").rangeBetween(-2 * min_words, -min_words)  # what a stretch that ends here leaves out
    df = df.withColumns({"skip": F.coalesce(F.max("at").over(before), F.min("at").over(stretch) - 1), "skipped": F.coalesce(F.max("e").over(before), F.lit(0))})
    df = df.withColumn("back", F.when(F.col("b") - F.col("skipped") >= min_words, F.col("at") - F.col("skip")))  # others are prefixes
    ranks = F.array(*(f"lv{k}" for k in range(levels)))
    runs = df.groupBy("row", "stretch").agg(F.array_sort(F.collect_list(F.struct("at", "pos", "m", "back", ranks.alias("ranks")))).alias("s"))
    line = lambda x, n: F.get("s", (x["at"] + n - F.get("s", F.lit(0))["at"]).cast("int"))

    def window(first, last, m):
        level = F.length(F.bin(m)) - 1
        inner = line(last, 1 - F.pow(F.lit(2.0), level).cast("int"))
        return F.struct(first["pos"].alias("pos"), (last["pos"] + 1).alias("to"), m.alias("m"), F.get(first["ranks"], level).alias("head"), F.get(inner["ranks"], level).alias("tail"))

    prefixes = F.transform(F.filter("s", lambda x: x["m"].isNotNull()), lambda x: window(x, line(x, x["m"] - 1), x["m"]))
    endings = F.transform(F.filter("s", lambda x: x["back"].isNotNull()), lambda x: window(line(x, 1 - x["back"]), x, x["back"]))
    windows = runs.select("row", F.explode(F.concat(prefixes, endings)).alias("w")).select("row", "w.*")
    firsts = windows.groupBy("m", "head", "tail").agg(F.min(F.struct("row", "pos", "to")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("m").alias("fm"), F.col("head").alias("fh"), F.col("tail").alias("ft"), "first")
    later = windows.join(firsts, (F.col("m") == F.col("fm")) & (F.col("head") == F.col("fh")) & (F.col("tail") == F.col("ft"))).filter((F.col("row") != F.col("first.row")) | (F.col("pos") >= F.col("first.to")))
    before = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    fresh = later.withColumn("from", F.greatest("pos", F.coalesce(F.max("to").over(before), F.lit(0)))).filter(F.col("from") < F.col("to"))
    return fresh.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("gone"))


def dedup(docs: DataFrame, path: str, min_words: int = 50) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from text. path: for tables in the shared folder."""
    kept_columns = docs.columns
    nth = F.lit(1) if _unique(docs) else F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    own = docs.select(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), nth.alias("nth")).alias("row"), F.struct(*(docs[c] for c in kept_columns)).alias("d"))
    suffixes, levels = suffix_ranks(line_table(own.select("row", F.col("d.text").alias("text"))), min_words, path)
    gone = stored(later_copies(suffixes, levels, min_words).withColumnRenamed("row", "gone_row"), f"{path}/gone")
    for name in ("suffixes", *(f"level{k}" for k in range(levels))):
        discard(docs.sparkSession, f"{path}/{name}")
    lines, n = F.split("d.text", "\n", -1), F.size("gone")
    edge = lambda i, field, other: F.coalesce(F.get("gone", i)[field], other)
    between = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, edge(i - 1, "to", F.lit(0)) + 1, edge(i, "from", F.size(lines)) - edge(i - 1, "to", F.lit(0))))
    rest = F.array_join(F.flatten(between), "\n")
    out = own.join(gone.hint("merge"), F.col("row") == F.col("gone_row"), "left").withColumn("rest", F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(rest))
    fresh = {"text": F.col("rest")}
    if "n_chars" in kept_columns:
        fresh["n_chars"] = F.when(F.col("gone").isNull(), F.col("d.n_chars")).otherwise(F.length("rest").cast(docs.schema["n_chars"].dataType))
    return out.select(*(fresh.get(c, F.col("d")[c]).alias(c) for c in kept_columns))


def _unique(docs: DataFrame) -> bool:
    """Whether no id repeats (null included): then rows need no numbers within their ids, which would move the texts."""
    return docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() == 0
