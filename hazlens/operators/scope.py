"""Whether evidence is denied: cues like "no" and "without", and how far they reach.

Evidence, cues and the ends of sentences are spans of one report. They are put in order
together, and running windows carry along the sentence and the last cue, so no pairs of spans are
made. A cue reaches to its own side within its sentence, over ``reach`` letters at most,
and no further than a turning word like "but".

Defined results: a span that touches or overlaps a cue isn't reached by it; of several cues the nearest
counts, one before the span rather than one behind it; reports are told apart by ``key``, so it must be theirs alone;
a report without cues has no denied evidence; null texts have none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazlens.functions import lexicon as lex
from hazlens.functions import text as words
from hazlens.operators import phrases
from hazlens.staging import staged

#: Kinds of cues: those that deny what follows, what is before, and words that end their reach.
BEFORE, BEHIND, TURN = "before", "behind", "turn"


@dataclass(frozen=True)
class Cues:
    """Stems of each kind, as in the lexicon."""

    before: tuple[str, ...]
    behind: tuple[str, ...] = ()
    turn: tuple[str, ...] = ()

    def entries(self) -> list[lex.Entry]:
        return [lex.entry(kind, *stems) for kind, stems in ((BEFORE, self.before), (BEHIND, self.behind), (TURN, self.turn)) if stems]


SAFETY = Cues(
    before=("no", "not", "never", "none", "without any", "no signs? of", "no evidence of", "free of", "ruled out", "did not", "does not require", "not required for", "absence of"),
    behind=("not required", "was not required", "not needed", "ruled out", "not found", "not involved", "was avoided"),
    turn=("but", "however", "although", "except", "then", "while"),
)

END = r"(?<=[.!?;\n])"


def ends(reports: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start) of the first letter behind each end of a sentence."""
    cut = words.bound(words.pieces(F.col(text), END), lambda p: F.slice(words.starts(p), F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))
    found = reports.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("__row"), key, cut.alias("__ends"))
    return found.select(key, F.explode("__ends").alias("start"))


def judged(evidence: DataFrame, reports: DataFrame, cues: Cues, key: str = "report_id", text: str = "narrative", reach: int = 40) -> DataFrame:
    """``evidence`` (key, rule_id, start, length and more) with negated, cue and cue_start: the cue that denies a span, or null."""
    spark = reports.sparkSession
    # only reports with evidence are looked through for cues
    evidence = staged(evidence, "evidence")
    reports = reports.select(key, text).join(evidence.select(key).distinct(), key, "left_semi")
    said = phrases.evidence(reports, phrases.table(spark, cues.entries()), key, text)
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.col("length")).alias("end"), F.col("snippet").alias("cue"))
    held = F.struct(*evidence.columns)
    kind = evidence.select(held.alias("e")).schema["e"].dataType
    # order: what ends a sentence is before what begins there, and cues before evidence
    marks = said.select(key, "start", F.when(F.col("rule_id") == TURN, 0).otherwise(1).alias("__rank"), F.col("rule_id").alias("__kind"), span.alias("__cue"), F.lit(None).cast(kind).alias("__e"))
    stops = ends(reports, key, text).select(key, "start", F.lit(0).alias("__rank"), F.lit(TURN).alias("__kind"), F.lit(None).cast(marks.schema["__cue"].dataType).alias("__cue"), F.lit(None).cast(kind).alias("__e"))
    asked = evidence.select(key, "start", F.lit(2).alias("__rank"), F.lit("").alias("__kind"), F.lit(None).cast(marks.schema["__cue"].dataType).alias("__cue"), held.alias("__e"))
    rows = marks.unionByName(stops).unionByName(asked)
    order = Window.partitionBy(key).orderBy("start", "__rank")
    so_far, to_come = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("__part", F.count_if(F.col("__kind") == TURN).over(so_far))
    # a cue carries the part of the text that it stands in
    seen = lambda which: F.when(F.col("__kind") == which, F.struct("__part", "__cue"))
    rows = rows.withColumns({"__l": F.last(seen(BEFORE), ignorenulls=True).over(so_far), "__r": F.first(seen(BEHIND), ignorenulls=True).over(to_come)})
    found = rows.where(F.col("__e").isNotNull())
    begin, end = F.col("__e.start"), F.col("__e.start") + F.col("__e.length")
    gap_l, gap_r = begin - F.col("__l.__cue.end"), F.col("__r.__cue.start") - end
    near = lambda side, gap: F.coalesce((F.col(f"{side}.__part") == F.col("__part")) & gap.between(1, reach), F.lit(False))
    taken = F.when(near("__l", gap_l), F.col("__l.__cue")).when(near("__r", gap_r), F.col("__r.__cue"))
    return found.withColumn("__taken", taken).select("__e.*", F.col("__taken").isNotNull().alias("negated"), F.col("__taken.cue").alias("cue"), F.col("__taken.start").alias("cue_start"))


def asserted(evidence: DataFrame, key: str = "report_id") -> DataFrame:
    """(key, rule_id) of the tags that some evidence backs which isn't denied."""
    return evidence.where("not negated").select(key, "rule_id").distinct()
