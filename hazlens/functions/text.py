"""Text preparation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(text: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of a to z in lower case. Accented letters end a run, in every engine alike."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by spaces; none for fewer words."""

    # shifted copies side by side: a lambda that looked words up by place would compute them anew for each
    def runs(words: Column) -> Column:
        many = F.greatest(F.size(words) - (n - 1), F.lit(0))
        out = F.slice(words, F.lit(1), many)
        for k in range(2, n + 1):
            out = F.zip_with(out, F.slice(words, F.lit(k), many), lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    return bound(words, runs)


def without(words: Column, stop_words: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop_words))


def sentences(text: Column) -> Column:
    """Parts between runs of full stops, exclamation and question marks that hold anything."""
    return F.filter(F.split(text, r"[.!?]+\s*"), lambda s: F.trim(s) != "")


def html_escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def pieces(text: Column, edge: str = r"\b") -> Column:
    """The text cut at every edge of a word: words and what lies between them in turn."""
    return F.split(text, edge, -1)


def bound(value: Column, body) -> Column:
    """``body`` of a variable, so that ``value`` is worked out once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


#: Pieces whose places are summed one by one; blocks of them are moved as a whole, so no list grows with the text.
BLOCK = 64


def starts(parts: Column) -> Column:
    """Where each of the pieces begins in their text, from 1."""
    empty = F.array().cast("array<int>")
    summed = lambda xs: F.aggregate(xs, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda d, x: F.struct((d["at"] + x).alias("at"), F.concat(d["out"], F.array(d["at"])).alias("out")))
    last = F.floor((F.size(parts) - 1) / BLOCK).cast("int")
    cut = lambda lengths: F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda b: summed(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    moved = lambda blocks: F.zip_with(blocks, summed(F.transform(blocks, lambda b: b["at"]))["out"], lambda b, base: F.transform(b["out"], lambda x: x + base + 1))
    return bound(F.transform(parts, lambda p: F.length(p)), lambda lengths: bound(cut(lengths), lambda blocks: F.flatten(moved(blocks))))


LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: Column) -> Column:
    """A to Z in lower case and nothing else, as a pattern that ignores case takes it."""
    return F.translate(text, *LOWER)
