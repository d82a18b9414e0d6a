"""Texts without spaces, very long words and runs: the same results as by plain means, in time that follows their length."""

import random
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from hazlens.llm import bpe, secret_scan

CODERS = {"byte_bpe_50k": bpe.ByteCoder, "word_bpe_49k": bpe.WordCoder}


def chinese_like(n, rng):
    return "".join(chr(rng.randint(0x4E00, 0x9FA5)) if rng.random() < 0.93 else rng.choice("，。！\n") for _ in range(n))


@pytest.fixture(scope="module", params=sorted(CODERS))
def both(request):
    path = public_tokenizers.path(f"{request.param}.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return CODERS[request.param](path), library


def test_texts_without_spaces_and_long_words(both):
    ours, library = both
    rng = random.Random(3)
    letters = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    texts = [chinese_like(3_000, rng), letters("abcdefghijklmnopqrstuvwxyz", 70_000), letters("etaoin", 30_001), "ab" * 20_000, "aab" * 9_000, "a" * 33_333, "=" * 5_000, "éé" * 4_000, "\U0001f600" * 3_000]
    texts += [letters("etaoinshrdlu", n) for n in (1, 2, 1023, 1024, 1025, 1026, 1279, 1280, 2047, 2048, 2049, 4096)] + ["", None, "x " * 2_000]
    ids, ends = ours.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, k


def test_pieces_that_disagree_are_gone_through_anew(both, monkeypatch):
    """Short pieces with no lead at all, so that most begin wrong."""
    ours, library = both
    monkeypatch.setattr(bpe, "PIECE", 150)
    redone, plain = [], bpe.Automaton._anew
    monkeypatch.setattr(bpe.Automaton, "_anew", lambda self, *a: (redone.append(a[2]), plain(self, *a))[1])
    rng = random.Random(4)
    for word in ("abc" * 900, "".join(rng.choices("ab", k=3_000)), "=" * 2_000, "aaaaab" * 500):
        ours.words, ours.runs = bpe.runs.Memo(), bpe.runs.Memo()
        ids, _ = ours.encode(pa.array([word]))
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids
    assert redone


def test_long_words_cost_a_few_times_plain_text(both):
    ours, _ = both
    rng = random.Random(5)

    def seconds_a_byte(text):
        ours.words, ours.runs = bpe.runs.Memo(), bpe.runs.Memo()
        began = time.time()
        ours.encode(pa.array([text]))
        return (time.time() - began) / len(text.encode())

    plain = seconds_a_byte(" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(100_000)))
    assert seconds_a_byte(chinese_like(60_000, rng)) < 12 * plain + 2e-6
    assert seconds_a_byte("".join(rng.choices("etaoinshr", k=1_000_000))) < 8 * plain + 2e-6


# ---- secret scan ------------------------------------------------------------------------


def stretches_by_hand(model, s):
    """The stretches with joining letters searched for in the text."""
    joins = re.compile(r"[+/_=-]")
    ratios = model.ratios(s)
    if ratios.mean() > model.threshold:
        return [(0, len(s))]
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    width = secret_scan.WINDOW
    over = np.flatnonzero(sums[width:] - sums[:-width] > width * model.threshold)
    out = []
    for windows in np.split(over, np.flatnonzero(np.diff(over) > width) + 1) if len(over) else []:
        part = sums[windows[0] : windows[-1] + width + 1]
        end = int(np.argmax(part - np.minimum.accumulate(part)))
        begin = int(windows[0]) + int(np.argmin(part[: end + 1]))
        end += int(windows[0])
        begin = max((m.end() for m in joins.finditer(s, 0, begin)), default=0)
        end = m.start() if (m := joins.search(s, end)) else len(s)
        if out and begin <= out[-1][1]:
            begin = out.pop()[0]
        out.append((begin, end))
    return out


def outside_by_hand(text, base, model):
    """The parts of runs that no base span touches, letter by letter."""
    free = np.ones(len(text), bool)
    for a, _, b in base:
        free[a:b] = False
    out = []
    for m in secret_scan.RUN.finditer(text):
        at = m.start()
        while at < m.end():
            if not free[at]:
                at += 1
                continue
            end = at
            while end < m.end() and free[end]:
                end += 1
            if end - at >= secret_scan.WINDOW:
                out += [(at + a, 3, at + b) for a, b in stretches_by_hand(model, text[at:end])]
            at = end
    return out


def test_spans_of_joined_runs_are_those_of_plain_loops():
    model, rng = secret_scan.default_model(), random.Random(6)
    name = lambda: rng.choice(["configuration", "service", "internal", "values", "production", "setting"])
    key = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFXYZ0123456789", k=n))
    found = 0
    for _ in range(300):
        parts = [rng.choice([name(), name(), name(), key(24), f"token={key(8)}.{key(30)}", "0123456789abcdef" * 2, f"secret: {name()}"]) for _ in range(rng.randint(1, 25))]
        text = "".join(p + rng.choice("_/-=. ") for p in parts)
        base = secret_scan.base_spans(text)
        got = secret_scan.random_spans(text, base, model)
        assert got == outside_by_hand(text, base, model)
        found += len(got)
    assert found > 100


def test_long_runs_and_many_spans_take_seconds():
    model, rng = secret_scan.default_model(), random.Random(7)
    words = ["configuration", "service", "internal", "values", "production", "setting"]
    run = "".join((rng.choice(words) if rng.random() < 0.9 else "".join(rng.choices("abcdefXYZ0189qwv", k=24))) + rng.choice("_/-=") for _ in range(100_000))
    many = "token=abcdef12 " * 100_000
    inside = "token=" + ".".join(["0123456789abcdef" * 2] * 20_000)
    for text in (run, many, inside):
        began = time.time()
        base = secret_scan.base_spans(text)
        secret_scan.random_spans(text, base, model)
        assert time.time() - began < 5
