"""The life-saving rules and the patterns that tell of them. Patterns are data: every operator takes a lexicon."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# The nine published life-saving rules.
RULES = [
    ("BSC", "Bypassing Safety Controls"),
    ("CSP", "Confined Space"),
    ("DRV", "Driving"),
    ("EIS", "Energy Isolation"),
    ("HTW", "Hot Work"),
    ("LOF", "Line of Fire"),
    ("SML", "Safe Mechanical Lifting"),
    ("WAU", "Work Authorisation"),
    ("WAH", "Working at Height"),
]


@dataclass(frozen=True)
class Entry:
    """A rule's pattern; it has one group around the whole match, and no lookaround, so that it reads alike in all engines."""

    rule_id: str
    pattern: str
    weight: float = 1.0


#: What entries have around their phrases.
_HEAD, _TAIL = r"(?i)\b(", r")\b"


def entry(rule_id: str, *stems: str, weight: float = 1.0) -> Entry:
    return Entry(rule_id, f"{_HEAD}{'|'.join(stems)}{_TAIL}", weight)


def union(lexicon: list[Entry]) -> str | None:
    """One pattern that finds something just where any entry's does; none if one isn't as :func:`entry` makes it."""
    if not all(e.pattern.startswith(_HEAD) and e.pattern.endswith(_TAIL) for e in lexicon):
        return None
    return f"{_HEAD}{'|'.join(f'(?:{e.pattern[len(_HEAD) : -len(_TAIL)]})' for e in lexicon)}{_TAIL}"


SAFETY = [
    entry("BSC", "bypass(?:ed|ing)?", "interlock(?:s)?", "override", "overridden", "disabled (?:alarm|trip|guard)", "defeat(?:ed)?"),
    entry("CSP", "confined space", "vessel entry", "tank entry", "manhole", "oxygen deficien(?:t|cy)", "gas test(?:ing)?"),
    entry("DRV", "seat ?belt", "speeding", "over-?speed(?:ing)?", "driver", "vehicle", "reversing"),
    entry("EIS", "isolat(?:ion|ed|e)", "lock-?out", "tag-?out", "loto", "energi[sz]ed", "stored energy", "live (?:wire|line|circuit)"),
    entry("HTW", "hot work", "weld(?:ing|er)?", "grind(?:ing|er)?", "cutting torch", "sparks?", "fire watch"),
    entry("LOF", "line of fire", "struck by", "pinch point", "dropped object", "caught between", "under (?:a )?suspended load"),
    entry("SML", "crane", "sling", "hoist(?:ing|ed)?", "lift(?:ing)? plan", "suspended load", "rigging"),
    entry("WAU", "permit to work", "work permit", "without (?:a )?permit", "ptw", "toolbox talk", "unauthori[sz]ed"),
    entry("WAH", "scaffold(?:ing)?", "harness", "fall(?:en|ing)? from height", "ladder", "work(?:ing)? at height", "lanyard"),
]

#: High-energy exposure and failed critical controls, for the energy and control rule.
ENERGY = r"(?i)\b(pressure|height|suspended load|energi[sz]ed|live (?:wire|line|circuit)|hydrocarbon|explosi(?:on|ve)|crane|confined space|h2s|vehicle|hot work|fire|electric(?:al)?)\b"
CONTROL_FAILED = r"(?i)\b(without|missing|failed|failure|bypass(?:ed)?|not (?:isolated|worn|used|in place|tested)|no (?:permit|harness|isolation|barrier|gas test)|broken|defective|absent)\b"

#: Groups of the only words in the fixtures that go with a label. They test arithmetic, not judgement.
FIXTURE = [entry("R1", "trash", "scum", weight=0.9), entry("R2", "idiot", "clown", "moron", "loser", weight=0.8), entry("R3", "worthless", "pathetic", "stupid", "disgusting", weight=0.7)]
FIXTURE_ENERGY = r"(?i)\b(trash|scum|idiot|clown|moron)\b"
FIXTURE_CONTROL = r"(?i)\b(loser|worthless|pathetic|stupid|disgusting)\b"


def expanded(pattern: str) -> list[str]:
    """The phrases that a stem stands for, in the order in which a search prefers them.

    Stems hold letters, alternatives in groups, classes of letters and parts that may be missing.
    """

    def alternatives(at: int) -> tuple[list[str], int]:
        found, here = [], [""]
        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            if c == "|":
                found, here, at = found + here, [""], at + 1
                continue
            if c == "(":
                options, at = alternatives(at + (3 if pattern.startswith("(?:", at) else 1))
                at += 1
            elif c == "[":
                end = pattern.index("]", at)
                options, at = list(pattern[at + 1 : end]), end + 1
            elif c in "\\*+{}^$.?":
                raise ValueError(f"{pattern!r} isn't a set of phrases")
            else:
                options, at = [c], at + 1
            if pattern[at : at + 1] == "?":
                options, at = [*options, ""], at + 1
            here = [a + b for a in here for b in options]
        return found + here, at

    return list(dict.fromkeys(alternatives(0)[0]))


def phrases(lexicon: list[Entry]) -> list[tuple[str, int, str]]:
    """(rule_id, rank, phrase) of all that the entries' patterns find; of a rule's phrases at one place the least rank counts."""
    out = []
    for e in lexicon:
        if not e.pattern.startswith(_HEAD) or not e.pattern.endswith(_TAIL):
            raise ValueError(f"{e.pattern!r} isn't a set of phrases")
        out += [(e.rule_id, rank, p) for rank, p in enumerate(expanded(e.pattern[len(_HEAD) : -len(_TAIL)]))]
    return out


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id string, rule_name string")


def table(spark: SparkSession, lexicon: list[Entry]) -> DataFrame:
    return spark.createDataFrame([(e.rule_id, e.pattern, e.weight) for e in lexicon], "rule_id string, pattern string, weight double")


#: Names under which a lexicon file may hold the patterns of the energy and control rule.
RESERVED = ("ENERGY", "CONTROL")


def read(spark: SparkSession, path: str) -> tuple[list[Entry], dict[str, str]]:
    """A lexicon from JSON lines of rule_id, pattern and weight (1 if missing): its entries, and the reserved patterns by name.

    Patterns become expressions of a plan, so they come to the driver; for more than some hundreds of phrases there is the phrase index.
    """
    rows = spark.read.schema("rule_id string, pattern string, weight double").json(path).where("rule_id is not null and pattern is not null").collect()
    entries = [Entry(r.rule_id, r.pattern, 1.0 if r.weight is None else r.weight) for r in rows if r.rule_id not in RESERVED]
    return sorted(entries, key=lambda e: e.rule_id), {r.rule_id: r.pattern for r in rows if r.rule_id in RESERVED}
