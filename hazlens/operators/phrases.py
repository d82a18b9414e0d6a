"""Evidence for very large lexicons of phrases: a positional index of the places where one can begin.

A report is cut at word edges once. Words that begin some phrase are looked up in one
hash set, whatever the number of phrases; each such place then offers the texts of the
phrases' few lengths from there on, and these meet the lexicon in a hash join. So the time
follows the length of the reports and the number of places, not the number of phrases.

What is found is what a search for ``\\b(phrase|phrase|...)\\b`` of each rule finds, ignoring the case
of A to Z: from left to right without overlaps, the least rank first where several phrases
begin at one place. A null or empty text has no evidence; repeated reports have theirs each; an
empty lexicon finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazlens.functions import lexicon as lex
from hazlens.functions import text as words
from hazlens.staging import staged

#: First words up to which they are a set within the plan. Beyond, words are joined with them.
INLINE = 5_000

#: The edge of a word where only A to Z, digits and the underscore are letters, as RE2 and SQL engines on it take it.
ASCII_EDGE = r"(?<=[A-Za-z0-9_])(?=[^A-Za-z0-9_])|(?<=[^A-Za-z0-9_])(?=[A-Za-z0-9_])"


def compiled(lexicon: DataFrame, edge: str = r"\b") -> DataFrame:
    """(rule_id, rank, phrase, size, first) of a table (rule_id, rank, phrase); phrases begin and end with a letter, digit or underscore, others are left out.

    edge: where words begin and end, here and in :func:`evidence`; :data:`ASCII_EDGE` for phrases and searches of engines whose letters are A to Z.
    """
    low = lexicon.select("rule_id", F.col("rank").cast("long").alias("rank"), words.lowered(F.col("phrase")).alias("phrase"))
    low = low.where(F.col("phrase").rlike(r"^\b[\s\S]*\b$") & F.col("phrase").rlike(r"^[\p{L}\p{Nd}_]")).groupBy("rule_id", "phrase").agg(F.min("rank").alias("rank"))
    cut = low.withColumn("__p", F.array_remove(words.pieces(F.col("phrase"), edge), ""))
    return cut.select("rule_id", "rank", "phrase", F.size("__p").alias("size"), F.col("__p")[0].alias("first"))


def table(spark: SparkSession, lexicon: list[lex.Entry]) -> DataFrame:
    """The compiled phrases of a lexicon whose patterns are sets of phrases."""
    return compiled(spark.createDataFrame(lex.phrases(lexicon), "rule_id string, rank long, phrase string"))


def evidence(reports: DataFrame, lexicon: DataFrame, key: str = "report_id", text: str = "narrative", around: int = 20, keep: tuple[str, ...] = (), inline: int = INLINE, edge: str = r"\b") -> DataFrame:
    """(key, rule_id, start, length, snippet, context) of every match and the columns ``keep``, as by tagging.evidence.

    lexicon: phrases compiled with the same edge.
    """
    shape = lexicon.groupBy("size").agg(F.max(F.length("phrase")).alias("longest")).collect()  # as many rows as phrases have lengths
    sizes, longest = sorted(r["size"] for r in shape), max((r["longest"] for r in shape), default=1)
    first = [r["first"] for r in lexicon.select("first").distinct().limit(inline + 1).collect()]
    offer = "array<struct<at:int,start:int,wide:string,offers:array<struct<size:int,phrase:string>>>>"

    def offered(p: Column, i: Column, size: int) -> Column:
        return F.struct(F.lit(size).alias("size"), F.array_join(F.slice(p, i + 1, F.lit(size)), "").alias("phrase"))

    def place(p: Column, i: Column, begin: Column) -> Column:
        # wide enough for the context of any phrase from here
        low = F.greatest(begin - around, F.lit(1))
        wide = F.substring("__text", low, F.lit(longest) + begin - low + around)
        return F.struct(i.alias("at"), begin.alias("start"), wide.alias("wide"), F.array(*(offered(p, i, s) for s in sizes)).alias("offers"))

    def offers(p: Column, places: Column) -> Column:
        """What the phrases' lengths cover from each of the places, the numbers of pieces."""
        if not sizes:
            return F.array().cast(offer)
        every = lambda places: words.bound(words.starts(p), lambda at: F.transform(places, lambda i: place(p, i, F.get(at, i))))
        return words.bound(places, lambda places: F.when(F.size(places) > 0, every(places)).otherwise(F.array().cast(offer)))

    texts = reports.select(F.struct(key, *keep).alias("__keep"), F.col(text).alias("__text")).where("__text is not null")
    cut = words.pieces(words.lowered(F.col("__text")), edge)
    if len(first) <= inline:
        begins = lambda p: F.array_compact(F.transform(p, lambda w, i: F.when(w.isin(first), i)))
        found = words.bound(cut, lambda p: offers(p, begins(p)))
    else:
        # more first words than a plan should hold: words are joined with them, as narrow rows of report, place and word
        texts = staged(texts.withColumn("__id", F.monotonically_increasing_id()), "texts")
        seen = texts.select("__id", F.posexplode(cut).alias("i", "first"))
        at = seen.join(lexicon.select("first").distinct(), "first", "left_semi").groupBy("__id").agg(F.array_sort(F.collect_list("i")).alias("__at"))
        texts = texts.join(at, "__id")
        found = words.bound(cut, lambda p: offers(p, F.col("__at")))
    # with the number of the row in the same step, no filter on what is found moves below it and works it out again
    hits = texts.select(F.monotonically_increasing_id().alias("__row"), "__keep", found.alias("__found"))
    hits = hits.select("__row", "__keep", F.inline("__found"))
    hits = hits.select("__row", "__keep", "at", "start", "wide", F.inline("offers"))
    met = _disjoint(hits.join(lexicon.select("rule_id", "rank", "phrase", "size"), ["phrase", "size"]), sizes)
    before, length = F.col("start") - F.greatest(F.col("start") - around, F.lit(1)), F.length("phrase")
    return met.select("__keep.*", "rule_id", "start", length.alias("length"), F.substring("wide", before + 1, length).alias("snippet"), F.substring("wide", F.lit(1), before + length + around).alias("context"))


def _disjoint(found: DataFrame, sizes: list[int]) -> DataFrame:
    """Of matches of one rule in one report those that a search from left to right takes."""
    if sizes in ([], [1]):
        return found
    # matches in a chain of overlaps are gone through one by one; chains are as short as phrases are
    own = Window.partitionBy("__row", "rule_id").orderBy("at", "rank")
    reached = F.max(F.col("at") + F.col("size")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(F.col("at") >= reached, F.lit(True))
    chained = found.withColumn("__new", first.cast("int")).withColumn("__chain", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = [c for c in found.columns if c not in ("__row", "rule_id")]
    match = F.struct("at", "rank", *(c for c in fixed if c not in ("at", "rank")))
    chains = chained.groupBy("__row", "rule_id", "__chain").agg(F.array_sort(F.collect_list(F.struct("at", "rank", "size", match.alias("m"))), lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise((a["rank"] - b["rank"]).cast("int"))).alias("c"))
    kind = chains.select("c").schema["c"].dataType.simpleString()
    taken = F.aggregate("c", F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out")), lambda d, x: F.when(x["at"] >= d["end"], F.struct((x["at"] + x["size"]).alias("end"), F.concat(d["out"], F.array(x)).alias("out"))).otherwise(d))["out"]
    return chains.select("__row", "rule_id", F.explode(taken).alias("x")).select("__row", "rule_id", "x.m.*")


def tags(reports: DataFrame, lexicon: DataFrame, key: str = "report_id", text: str = "narrative") -> DataFrame:
    """(key, rule_id), one row a tag."""
    return evidence(reports, lexicon, key, text).select(key, "rule_id").distinct()
