"""Benchmark decontamination through template windows, in Spark SQL functions only.

Numbers, capitalised words and units become typed placeholders, so a question with other figures and names keeps
its template. Windows of LENGTH template words of the documents meet those of the benchmark in a hash join. Where
enough windows of an item are found, the slots behind the placeholders are compared: in a re-parameterised
question each old value stands for one new value throughout, which chance matches do not keep up. Passages of an item
and copies in other case are found by the same windows over texts without case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.store import written

LENGTH = 8  # words of a window; shorter items are one window of their own length
SHORTEST = 4  # words of an item that can be told from chance
PASSAGE = 13  # words in a row as they stand in an item that tell it whatever its length
SHARE = 0.5  # of an item's windows found in a document
AGREEMENT = 0.8  # more than this share of an item's slots keeps to one value for one value; with five slots one that does not is too many
BROADCAST_ROWS = 200_000  # windows of a benchmark up to which it is sent to all tasks, some 20 MB

#: Words that are units after a number, and signs that are units anywhere.
UNIT_WORDS = ("km", "m", "cm", "mm", "miles", "mile", "kg", "g", "mg", "lb", "l", "ml", "s", "min", "h", "hours", "hour", "minutes",
              "minute", "seconds", "second", "days", "day", "weeks", "week", "years", "year", "percent", "dollars", "dollar",
              "euros", "euro", "cents", "cent", "degrees")
UNIT_SIGNS = "%$€£¥°"
WORD = rf"\p{{Nd}}[\p{{Nd}}.,]*|\p{{L}}+|[{UNIT_SIGNS}]"


def template(text: str) -> Column:
    """The template words of a text: P for words with a capital, N for numbers, U for units, all else as it is."""
    t = F.regexp_replace(text, r"\p{Lu}\p{L}*", "P")
    t = F.regexp_replace(t, r"\p{Nd}[\p{Nd}.,]*", " N ")
    t = F.regexp_replace(t, rf"[{UNIT_SIGNS}]", " U ")
    t = F.regexp_replace(t, rf"N +(?:{'|'.join(UNIT_WORDS)})([^\p{{L}}]|$)", "N U$1")
    return F.array_remove(F.split(t, r"[^\p{L}]+"), "")


def originals(text: str) -> Column:
    """The words behind the template words, one for one."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def folded(text: str) -> Column:
    """A text without differences of case; the way by upper case makes ss of a sharp s."""
    return F.lower(F.upper(text))


def _windows(rows: DataFrame, length: int) -> DataFrame:
    """`rows` with (at, h) for every window of `length` words in `words`."""
    last = F.size("words") - length
    placed = rows.withColumn("at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    return placed.withColumn("h", F.xxhash64(*[F.get("words", F.col("at") + k) for k in range(length)]))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, j, h, length, n_windows, slots): every window of every item of at least SHORTEST words."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    items = items.withColumn("words", template("text")).where(F.size("words") >= SHORTEST)
    items = items.withColumn("length", F.least(F.size("words"), F.lit(LENGTH)))
    parts = [_windows(items.where(F.col("length") == n), n) for n in range(SHORTEST, LENGTH + 1)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select("item_id", F.col("at").alias("j"), "h", "length", (F.size("words") - F.col("length") + 1).alias("n_windows"),
                        F.slice("words", F.col("at") + 1, F.col("length")).alias("template"),
                        F.slice(originals("text"), F.col("at") + 1, F.col("length")).alias("item_values"))


def _hits(docs: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, length, j, offset, slots): every window of the rows (doc_id, text_hash, text) that an item has."""
    small = windows.count() <= BROADCAST_ROWS
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # at most LENGTH values
    rows = docs.withColumn("words", template("text"))
    found = []
    for n in lengths or [LENGTH]:
        side = windows.where(F.col("length") == n)
        hits = _windows(rows, n).join(F.broadcast(side) if small else side, "h")
        values = F.slice(originals("text"), F.col("at") + 1, n)
        found.append(hits.select("doc_id", "text_hash", "item_id", "n_windows", "length", "j", (F.col("at") - F.col("j")).alias("offset"),
                                 F.arrays_zip("template", "item_values", values.alias("doc_values")).alias("slots")))
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    return written(hits, name)


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).where("text is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, n_matched, n_windows, share, agreement, verbatim): items of which at least SHARE of the
    windows are in a document, with their slots in agreement.

    text_hash tells rows of one id apart; equal rows are one. verbatim: every slot has the item's own value. Null and empty
    texts hold nothing; items below SHORTEST words are not looked for; items with equal text are each found.
    """
    windows = written(benchmark_windows(benchmark, item_id, item_text), "windows")
    return _by_share(_hits(_texts(docs, doc_id, text), windows, "hits"))


def passages(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
             item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id): items that a document holds in whatever case, in part or in whole.

    Templates and slots are those of the folded texts, so capitals are no placeholders. An item counts by SHARE as in
    `contaminated`, or by a passage of at least PASSAGE of its words in a row, numbers and units as they are, however long it is.
    """
    windows = written(benchmark_windows(benchmark.withColumn(item_text, folded(item_text)), item_id, item_text), "folded_windows")
    hits = _hits(_texts(docs, doc_id, text).withColumn("text", folded("text")), windows, "folded_hits")
    pair = ["doc_id", "text_hash", "item_id"]
    same = F.forall("slots", lambda s: ~s["template"].isin("P", "N", "U") | F.coalesce(s["item_values"] == s["doc_values"], F.lit(False)))
    exact = hits.where((F.col("length") == LENGTH) & same).select(*pair, "offset", "j").distinct()
    turn = F.row_number().over(Window.partitionBy(*pair, "offset").orderBy("j"))
    runs = exact.withColumn("run", F.col("j") - turn).groupBy(*pair, "offset", "run").count()
    runs = runs.where(F.col("count") + LENGTH - 1 >= PASSAGE)
    return _by_share(hits).select(*pair).unionByName(runs.select(*pair)).distinct()


def _by_share(hits: DataFrame) -> DataFrame:
    pair = ["doc_id", "text_hash", "item_id"]
    matched = hits.groupBy(*pair).agg(F.countDistinct("j").alias("n_matched"), F.max("n_windows").alias("n_windows"))
    matched = matched.where(F.col("n_matched") >= SHARE * F.col("n_windows"))
    place = hits.groupBy(*pair, "offset").agg(F.countDistinct("j").alias("n"))
    place = place.groupBy(*pair).agg(F.min_by("offset", F.struct(-F.col("n"), "offset")).alias("offset"))
    slots = hits.select(*pair, "offset", "j", F.posexplode("slots").alias("k", "slot")).select(
        *pair, "offset", (F.col("j") + F.col("k")).alias("p"), "slot.*").distinct()
    slots = slots.where(F.col("template").isin("P", "N", "U")).groupBy(*pair, "offset", "template", "item_values", "doc_values").count()
    forth = slots.groupBy(*pair, "offset", "template", "item_values").agg(F.max("count").alias("kept"), F.sum("count").alias("all"))
    back = slots.groupBy(*pair, "offset", "template", "doc_values").agg(F.max("count").alias("kept"), F.sum("count").alias("all"))
    forth = forth.groupBy(*pair, "offset").agg((F.sum("kept") / F.sum("all")).alias("forth"))
    back = back.groupBy(*pair, "offset").agg((F.sum("kept") / F.sum("all")).alias("back"))
    same = slots.groupBy(*pair, "offset").agg(F.min(F.col("item_values") == F.col("doc_values")).alias("verbatim"))

    def on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
        right = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
        rule = F.lit(True)
        for k in keys:
            rule = rule & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return left.join(right, rule, how).drop(*[f"__{k}" for k in keys])

    out = on(matched, place, pair, "inner")
    for part in (forth, back, same):
        out = on(out, part, [*pair, "offset"], "left")
    agreement = F.least(F.coalesce("forth", F.lit(1.0)), F.coalesce("back", F.lit(1.0)))
    return out.select(*pair, "n_matched", F.col("n_windows").cast("long").alias("n_windows"),
                      (F.col("n_matched") / F.col("n_windows")).alias("share"), agreement.alias("agreement"),
                      F.coalesce("verbatim", F.lit(True)).alias("verbatim")).where(F.col("agreement") > AGREEMENT)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no item is found, by templates or as a passage in whatever case; all their columns stay."""
    pair = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")]
    leaks = contaminated(docs, benchmark, doc_id, text).select(*pair).union(passages(docs, benchmark, doc_id, text).select(*pair)).distinct()
    leaks = written(leaks, "leaks")
    rule = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    return docs.join(leaks, rule, "left_anti")
