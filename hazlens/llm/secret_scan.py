"""Secrets by patterns, and by character Markov models for what no pattern names.

Three patterns give the base spans (assign, access, hex). Beside them, what base
spans leave of runs of token letters is scored by two first-order Markov
models over character classes of their own alphabets: one trained on labelled
random strings, one on labelled ordinary identifiers. A run is a secret (kind
``random``) if the log-likelihood ratio a character, random against ordinary,
is over a threshold that is set on the labelled samples so that no ordinary one
of them passes. Of a run that isn't, each stretch with windows of ``WINDOW``
characters over the threshold is one: where its ratios have the largest sum,
widened to the next joining characters. So a key counts whatever it is joined to.

The samples are given as parameters. Those by default are made by rule from a
fixed seed: random strings over the alphabets that keys are written in, and
ordinary runs made of the words in ``NAMES``, joined in the usual styles, and of
repeated signs. So training needs no rows and is the same everywhere.

Whole texts are read. Defined results: null text counts as empty and has no
spans; a null doc_id stays null; repeated rows are all scanned; an empty table
gives an empty table; ``found`` ignores other columns; in ``redacted`` all other columns
stay, ``n_chars`` (if there) follows the text, and a null text stays null.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hazlens.llm import runs

# The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Runs of hex digits are maximal, so the least length can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: A run to be scored: 20 to any number of token letters.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
LETTERS = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
#: From here on letters join the names and values of a run.
FIRST_JOIN = LETTERS.index("+")
SAMPLE_SIZE = 4000

# Common words of identifiers, paths and plain text, from which the ordinary samples are made.
NAMES = """
account action address after again alert analysis and archive array author base batch before between binary block
body branch buffer build button cache channel character check client code collection comment company complete
config connection content context control convert count country create customer data database date default delete
department description development device different directory download driver email environment error event example
export factory feature field file filter first folder function general generate government group handler header
height history house image import index information instance interface international invoice javascript language
large length level library license line list local location manager market message method model money month name
national network notification number object office open operation option order output package parameter password path
payment people person place platform position present previous process product profile program project property
und nicht werden zwischen gesellschaft rechnung entwicklung versicherung keit ungen arbeit wirtschaft
recht pflicht kraft fahrt werk zeug haupt dampf schiff schutz wort strasse fleisch gesetz land burg
les pour dans avec entreprise naissance toujours renseignement ment eaux
los para como entre desarrollo educacion siempre ciones mente idad
""".split()


def random_strings(n: int = SAMPLE_SIZE, seed: int = 11) -> list[str]:
    """Labelled random strings over the alphabets of keys."""
    rng = random.Random(seed)
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    both = lower + upper + digits
    alphabets = [both, both + "+/", both + "-_", "0123456789abcdef", upper + digits, lower + digits, lower, upper]
    return ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64))) for _ in range(n)]


def ordinary_identifiers(n: int = SAMPLE_SIZE, seed: int = 12) -> list[str]:
    """Labelled ordinary runs: words joined as in code, paths, file names and compounds, and rulers of repeated signs."""
    rng = random.Random(seed)
    styles = [
        "_".join,
        "-".join,
        "/".join,
        "".join,
        lambda parts: "_".join(parts).upper(),
        lambda parts: "".join(parts).upper(),
        lambda parts: "".join(p.capitalize() for p in parts),
        lambda parts: parts[0] + "".join(p.capitalize() for p in parts[1:]),
        lambda parts: "-".join(p.capitalize() for p in parts),
    ]
    out = []
    for _ in range(n):
        if rng.random() < 0.05:
            out.append((rng.choice("+/_=-") * rng.randint(1, 3) + rng.choice(["", "", "+", "=", "-", "_"])) * rng.randint(20, 40))
            continue
        word = rng.choice(styles)(rng.choices(NAMES, k=rng.randint(3, 8)))
        if rng.random() < 0.3:
            word += rng.choice(["", "_", "-", "/", "="]) + str(rng.choice([rng.randint(0, 99), rng.randint(1990, 2030), rng.randint(0, 999_999)]))
        out.append(word)
    return out


class Markov:
    """Two chains over LETTERS and their ratio."""

    def __init__(self, positive: list[str], negative: list[str], smoothing: float = 0.5) -> None:
        self.code = np.full(128, -1, np.int64)
        for k, c in enumerate(LETTERS):
            self.code[ord(c)] = k
        size = len(LETTERS)
        tables = []
        for sample in (positive, negative):
            count = np.full((size + 1, size), smoothing)
            for s in sample:
                at = self._codes(s)
                np.add.at(count, (np.concatenate([[size], at[:-1]]), at), 1)
            tables.append(np.log(count / count.sum(1, keepdims=True)))
        self.ratio = tables[0] - tables[1]
        if positive and negative:
            high = max(map(self.score, negative))
            low = float(np.quantile([self.score(s) for s in positive], 0.02))
            self.threshold = max(high, (high + low) / 2)
        else:
            self.threshold = float("inf")

    def _codes(self, s: str) -> np.ndarray:
        return self.code[np.frombuffer(s.encode("ascii"), np.uint8)]

    def ratios(self, s: str) -> np.ndarray:
        """Log-likelihood ratio of each character after the one before it."""
        at = self._codes(s)
        return self.ratio[np.concatenate([[len(LETTERS)], at[:-1]]), at]

    def score(self, s: str) -> float:
        """Log-likelihood ratio a character."""
        return float(self.ratios(s).mean())

    def stretches(self, s: str) -> list[tuple[int, int]]:
        """(start, end) of what is random in ``s``: all of it, or the stretches around windows over the threshold."""
        ratios = self.ratios(s)
        if ratios.mean() > self.threshold:
            return [(0, len(s))]
        sums = np.concatenate([[0.0], np.cumsum(ratios)])
        over = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] > WINDOW * self.threshold)
        out: list[tuple[int, int]] = []
        joins = np.flatnonzero(self._codes(s) >= FIRST_JOIN) if len(over) else over
        for windows in np.split(over, np.flatnonzero(np.diff(over) > WINDOW) + 1) if len(over) else []:
            part = sums[windows[0] : windows[-1] + WINDOW + 1]
            end = int(np.argmax(part - np.minimum.accumulate(part)))
            begin = int(windows[0]) + int(np.argmin(part[: end + 1]))
            end += int(windows[0])
            before, after = np.searchsorted(joins, [begin, end])
            begin = int(joins[before - 1]) + 1 if before else 0
            end = int(joins[after]) if after < len(joins) else len(s)
            if out and begin <= out[-1][1]:
                begin = out.pop()[0]
            out.append((begin, end))
        return out


@lru_cache(1)
def default_model() -> Markov:
    return Markov(random_strings(), ordinary_identifiers())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches that are long enough."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], model: Markov) -> list[tuple[int, int, int]]:
    """What the models call random in the runs, outside the base spans."""
    # base spans that overlap are one, so that a run looks at its own alone
    taken: list[list[int]] = []
    for a, _, b in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, k = [], 0
    for m in RUN.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        at, free, j = m.start(), [], k
        while j < len(taken) and taken[j][0] < m.end():
            free.append((at, taken[j][0]))
            at, j = max(at, taken[j][1]), j + 1
        for begin, end in [*free, (at, m.end())]:
            if end - begin >= WINDOW:
                out += [(begin + a, 3, begin + b) for a, b in model.stretches(text[begin:end])]
    return out


def named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def _found(model: Markov):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, base, model)
                kinds = [k for _, k, _ in base]
                out.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(named(base).encode()).hexdigest(), named(sorted(base + more)), len(more)))
            columns = zip(zip(*out) if out else [()] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in columns)], [c.split()[0] for c in SCHEMA.split(", ")])

    return work


def found(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """Counts, a digest of the base spans and all spans of each row."""
    return runs.mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _found(model or default_model()), SCHEMA)


def redact(text: str, model: Markov, mark: str) -> str:
    """The text with each span replaced; overlapping spans are one."""
    base = base_spans(text)
    out, at = [], 0
    for a, _, b in sorted(base + random_spans(text, base, model)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: Markov | None = None, mark: str = "[secret]") -> DataFrame:
    """All rows and columns, with the secrets in ``text`` replaced by ``mark``."""
    model = model or default_model()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            text = pa.array([None if t is None else redact(t, model, mark) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            columns = list(batch.columns)
            columns[at] = text
            if (n := batch.schema.get_field_index("n_chars")) >= 0:
                columns[n] = pc.utf8_length(text).cast(batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return runs.mapped(docs, work, docs.schema)
