"""Tags by life-saving rule, each with the text spans that justify it.

The lexicon is compiled into literal expressions over one scan: no join, and no
pattern that varies by row, so each pattern is compiled once a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazlens.functions.lexicon import Entry, union
from hazlens.functions.text import html_escaped


def rules_of(text: Column, lexicon: list[Entry]) -> Column:
    """The sorted rule ids that apply; empty for none and for null.

    Most texts hold nothing of the lexicon, so all patterns are looked for as one first.
    """
    hits = F.array(*(F.when(text.rlike(e.pattern), F.lit(e.rule_id)) for e in lexicon))
    found = F.array_sort(F.array_distinct(F.array_compact(hits)))
    either = union(lexicon) if len(lexicon) > 1 else None
    return found if either is None else F.when(text.rlike(either), found).otherwise(F.array().cast("array<string>"))


def with_rules(reports: DataFrame, lexicon: list[Entry], text: str = "narrative") -> DataFrame:
    return reports.withColumn("rules", rules_of(F.col(text), lexicon))


def tags(reports: DataFrame, lexicon: list[Entry], key: str = "report_id", text: str = "narrative") -> DataFrame:
    """(key, rule_id), one row a tag."""
    return reports.select(key, F.explode(rules_of(F.col(text), lexicon)).alias("rule_id"))


SPAN = "array<struct<rule_id:string,start:int,length:int,snippet:string>>"


def _spans(rule_id: str, found: Column, between: Column) -> Column:
    """Spans of the matches ``found``, from the texts between them, in one pass from left to right."""
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), m.alias("s")))

    def step(done: Column, x: Column) -> Column:
        at = done["at"] + x["gap"]
        span = F.struct(F.lit(rule_id).alias("rule_id"), at.alias("start"), x["n"].alias("length"), x["s"].alias("snippet"))
        return F.struct((at + x["n"]).alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(1).alias("at"), F.array().cast(SPAN).alias("out")), step)["out"]


def evidence(reports: DataFrame, lexicon: list[Entry], key: str = "report_id", text: str = "narrative", around: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, rule_id, start, length, snippet, context) of every match, and the columns ``keep``; start counts from 1.

    Always substring(text, start, length) = snippet.
    """
    t = F.col(text)
    # what lies between matches gives their places; both lists are columns first, so that they are computed once a row
    lists = {}
    for k, e in enumerate(lexicon):
        lists[f"__m{k}"] = F.regexp_extract_all(t, F.lit(e.pattern), F.lit(1))
        lists[f"__b{k}"] = F.split(t, e.pattern, -1)
    spans = [_spans(e.rule_id, F.col(f"__m{k}"), F.col(f"__b{k}")) for k, e in enumerate(lexicon)]
    hits = reports.where(F.size(rules_of(t, lexicon)) > 0).select(key, *keep, t.alias("__text"), *(c.alias(n) for n, c in lists.items()))
    rows = hits.select(key, *keep, "__text", F.explode(F.flatten(F.array(*spans))).alias("e")).select(key, *keep, "__text", "e.*")
    low = F.greatest(F.col("start") - around, F.lit(1))
    return rows.select(key, *keep, "rule_id", "start", "length", "snippet", F.substring("__text", low, F.col("start") + F.col("length") + around - low).alias("context"))


def highlighted(text: Column, lexicon: list[Entry], mark: str = "mark") -> Column:
    """Text made safe for HTML with every match marked."""
    out = html_escaped(text)
    for e in lexicon:
        out = F.regexp_replace(out, e.pattern, f"<{mark}>$1</{mark}>")
    return out


def untagged(reports: DataFrame, lexicon: list[Entry], text: str = "narrative") -> DataFrame:
    """Reports that no rule applies to, judged in the scan."""
    return reports.where(F.size(rules_of(F.col(text), lexicon)) == 0)


def with_model_only(tagged: DataFrame, scores: DataFrame, threshold: float = 0.5, key: str = "report_id") -> DataFrame:
    """Pattern tags as they are, and in ``model_only`` the rules that only the model gives; those have no span and are no tags.

    tagged: key, rules; scores: key, rule_id, score.
    """
    by_model = scores.where(F.col("score") >= threshold).groupBy(key).agg(F.collect_set("rule_id").alias("__model"))
    out = tagged.join(by_model, key, "left")
    return out.withColumn("model_only", F.array_sort(F.array_except(F.coalesce("__model", F.array().cast("array<string>")), "rules"))).drop("__model")
