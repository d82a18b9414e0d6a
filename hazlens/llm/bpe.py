"""Byte-pair encoding by a tokenization automaton.

Compilation. The automaton reads tokens. It starts with one state that loops on
every base symbol, and takes the merges in their order, one gadget each. The
gadget of a merge ``u v -> w``

1. gives ``u`` a target state of its own if its target is shared (a copy, with
   all arcs that the shared one has by then),
2. takes the arc ``v`` out of that state, for ``u v`` is no longer a tokenization,
3. adds an arc ``w`` beside every arc ``u``, leading to where ``v`` leads (where
   it led before step 1 if ``u`` is ``v``).

The result is deterministic and accepts exactly the correct tokenizations. Its
arcs are too many to list, so the tables keep what the gadgets did: each
state's origin and birth, the arcs taken out, and each token's parts. Whether a
state has an arc is read from those tables by going back in time.

Encoding. Each prefix of a word has one correct tokenization, so each position
of a word is reached by exactly one arc. Positions are taken from left to
right, for all words of a batch at once: from the state at a position a trie of
the vocabulary gives the tokens that begin there, and the arcs that exist mark
where they end. The work is linear in the length of a word. A word of any length
is cut into pieces that begin a little before their place and are worked on side by side,
as if words began there. What is right at a position follows from the positions of one
longest token before it, so where a piece agrees with the one before it over that
length, all after it is right as well; where it doesn't, the piece is gone through anew, one
position after the other.

Decoding emits the bytes of each arc's label.

Defined results: null text counts as empty and has no tokens; special tokens'
strings in a text become their ids, as the library does by default; a null doc_id
stays null; repeated rows are all encoded; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from hazlens.llm import runs

#: Letters of a piece that a longer word is cut into; and cells (words by letters) worked on at once.
PIECE = 1024
CELLS_AT_ONCE = 3 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Automaton:
    """Tables of a compiled list of merges over symbols 0 to 511 (256 + byte: the last byte of a word, where a word-end mark is in use)."""

    def __init__(self, merges: list[tuple[int, int]], made: list[int], spelled: dict[int, tuple[int, ...]], of_symbol: np.ndarray, ids: int) -> None:
        """``merges`` and ``made``: parts and result of each merge, as ids; ``spelled``: symbols of each token; ``of_symbol``: id of each base symbol or -1."""
        self.of_symbol = of_symbol
        self._gadgets(merges, made, ids)
        self._trie({t: s for t, s in spelled.items()})
        self.size = np.zeros(ids, np.int64)
        for t, s in spelled.items():
            self.size[t] = len(s)

    def _gadgets(self, merges: list[tuple[int, int]], made: list[int], ids: int) -> None:
        target, origin, birth, users = [0] * ids, [0], [0], [ids + 1]  # state 0 is also where words start
        time, left = np.zeros(ids, np.int32), np.zeros(ids, np.int32)
        taken: dict[int, int] = {}
        for k, ((u, v), w) in enumerate(zip(merges, made), 1):
            old = target[u]
            if users[old] > 1 or u == v:
                users[old] -= 1
                target[u] = len(origin)
                origin.append(old)
                birth.append(k)
                users.append(1)
            taken[target[u] << 20 | v] = k
            users[target[w]] -= 1
            target[w] = old if u == v else target[v]
            users[target[w]] += 1
            time[w], left[w] = k, u
        self.target = np.array(target, np.int32)
        self.time, self.left = time, left
        self.states = len(origin)
        # every state's own row: what it took over from its origin at birth, and what it lost itself
        own: list[list[tuple[int, int]]] = [[] for _ in origin]
        for key, k in taken.items():
            own[key >> 20].append((key & 0xFFFFF, k))
        tokens: list[np.ndarray] = [np.zeros(0, np.int64)]
        times: list[np.ndarray] = [np.zeros(0, np.int32)]
        for p in range(1, len(origin)):
            old = times[origin[p]] < birth[p]
            mine = np.array(own[p], np.int64).reshape(-1, 2)
            tokens.append(np.concatenate([tokens[origin[p]][old], mine[:, 0]]))
            times.append(np.concatenate([times[origin[p]][old], mine[:, 1].astype(np.int32)]))
        keys = np.repeat(np.arange(len(origin)) << 20, [len(x) for x in tokens]) | np.concatenate(tokens)
        self._hash(keys, np.concatenate(times))

    def _hash(self, keys: np.ndarray, times: np.ndarray) -> None:
        """An open hash table of the arcs taken out, filled a probe at a time."""
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 2))))
        self.shift = np.uint64(64 - bits)
        self.key_at, self.time_at = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        slot = self._mix(keys)
        while len(keys):
            free = self.key_at[slot] < 0
            self.key_at[slot[free]] = keys[free]
            mine = self.key_at[slot] == keys
            self.time_at[slot[mine]] = times[mine]
            keys, times, slot = keys[~mine], times[~mine], (slot[~mine] + 1) & (len(self.key_at) - 1)

    def _mix(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _taken(self, keys: np.ndarray) -> np.ndarray:
        """When each arc was taken out, or never (a time beyond all)."""
        out, live, slot = np.full(len(keys), 1 << 30, np.int64), np.arange(len(keys)), self._mix(keys)
        while len(live):
            there = self.key_at[slot]
            same = there == keys[live]
            out[live[same]] = self.time_at[slot[same]]
            on = ~same & (there >= 0)
            live, slot = live[on], (slot[on] + 1) & (len(self.key_at) - 1)
        return out

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each state has an arc of each token.

        An arc ``w`` was added beside the arc ``u`` of its left part, so it is missing if it was taken
        out, or if ``u`` was missing when ``w`` was made; and so on down the left parts.
        """
        out = np.ones(len(state), bool)
        live = np.flatnonzero(state != 0)
        base, t = state[live].astype(np.int64) << 20, token[live].astype(np.int64)
        before = np.full(len(live), 1 << 29, np.int64)
        while len(live):
            gone = self._taken(base | t) <= before
            out[live[gone]] = False
            on = np.flatnonzero(~gone & (self.time[t] > 0))
            live, base, t = live[on], base[on], t[on]
            before, t = self.time[t].astype(np.int64), self.left[t].astype(np.int64)
        return out

    def _trie(self, spelled: dict[int, tuple[int, ...]]) -> None:
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for t, symbols in spelled.items():
            node = 0
            for s in symbols:
                after = children[node].get(s)
                if after is None:
                    after = children[node][s] = len(children)
                    children.append({})
                    token.append(-1)
                node = after
            token[node] = t
        # nodes with children come first, so that only they have a row
        order = sorted(range(len(children)), key=lambda n: (not children[n], n))
        place = {n: k for k, n in enumerate(order)}
        self.inner = sum(map(bool, children))
        self.token_at = np.array([token[n] for n in order], np.int32)
        # column 0 leads nowhere; it stands for symbols that no longer token holds
        used = sorted({s for symbols in spelled.values() if len(symbols) > 1 for s in symbols[1:]})
        self.column = np.zeros(512, np.int64)
        self.column[used] = np.arange(1, len(used) + 1)
        self.goto = np.full((self.inner, len(used) + 1), -1, np.int32)
        self.root = np.full(512, -1, np.int32)
        self.root[list(children[0])] = [place[x] for x in children[0].values()]
        for n, c in enumerate(children):
            if c and n:
                self.goto[place[n], self.column[list(c)]] = [place[x] for x in c.values()]

    def encode(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn and the offset of each; a word is symbols[ends[k]:ends[k + 1]]."""
        sizes = ends[1:] - ends[:-1]
        order = np.argsort(sizes, kind="stable")
        many = int(np.searchsorted(sizes[order], PIECE, side="right"))
        ids, owner = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part in _portions(order[:many], sizes):
            found, rows = self._back(self._ends(symbols, ends[:-1][part], sizes[part]), sizes[part])
            ids.append(found)
            owner.append(part[rows])
        for k in order[many:].tolist():
            ids.append(self._long(symbols[ends[k] : ends[k + 1]]))
            owner.append(np.full(len(ids[-1]), k, np.int64))
        whole = np.concatenate(owner)
        back = np.argsort(whole, kind="stable")
        return np.concatenate(ids)[back], np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=len(sizes)))]).astype(np.int64)

    def _ends(self, whole: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The token that ends at each position of each word, for words in order of their sizes."""
        n, longest = len(sizes), int(sizes[-1]) if len(sizes) else 0
        symbols = np.zeros((n, longest + 1), np.int16)
        rows, shift = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
        place = np.arange(len(rows)) - np.repeat(shift, sizes)
        symbols[rows, place] = whole[np.repeat(first, sizes) + place]
        token = np.full((n, longest + 1), -1, np.int32)
        token[:, 0] = 0
        for i in range(longest):
            rows = np.arange(np.searchsorted(sizes, i, side="right"), n)
            state = self.target[token[rows, i]] if i else np.zeros(len(rows), np.int32)
            node, j = self.root[symbols[rows, i]], i + 1
            while len(rows):
                t = self.token_at[node]
                new = np.flatnonzero((t >= 0) & (token[rows, j] < 0))
                if len(new):
                    if i:
                        new = new[self.has_arc(state[new], t[new])]
                    token[rows[new], j] = t[new]
                on = np.flatnonzero((node < self.inner) & (sizes[rows] > j))
                node, rows, state = self.goto[node[on], self.column[symbols[rows[on], j]]], rows[on], state[on]
                on = np.flatnonzero(node >= 0)
                node, rows, state, j = node[on], rows[on], state[on], j + 1
        return token

    def _back(self, token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the word of each, back from the end of each word along the arcs."""
        at, rows, steps = sizes.copy(), np.arange(len(sizes)), []
        while len(rows := rows[at[rows] > 0]):
            t = token[rows, at[rows]]
            steps.append((rows, t))
            at[rows] -= self.size[t]
        if not steps:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        rows, ids = (np.concatenate(x) for x in zip(*steps[::-1]))
        return ids.astype(np.uint32), rows

    def _long(self, word: np.ndarray) -> np.ndarray:
        """One word of any length, in pieces."""
        n, reach = len(word), int(self.size.max())
        # a multiple of any power of two that a token repeats a letter by
        lead = -(-2 * reach // 128) * 128
        cuts = np.arange(0, n, PIECE)
        first = np.maximum(cuts - lead, 0)
        size = np.minimum(cuts + PIECE, n) - first
        token = np.full(n + 1, -1, np.int32)
        token[0] = 0
        order = np.argsort(size, kind="stable")
        place = {}
        for part in _portions(order, size):
            found = self._ends(word, first[part], size[part])
            # a piece knows what ends in its own part and one longest token before it
            place.update({int(k): found[r, max(0, int(cuts[k] - first[k]) - reach) : int(size[k]) + 1].copy() for r, k in enumerate(part)})
        symbols = None
        for k, cut in enumerate(cuts.tolist()):
            end, own = int(first[k] + size[k]), place.pop(k)
            known = len(own) - (end - cut) - 1
            if k == 0:
                token[: end + 1] = own
            elif (own[1 : known + 1] == token[cut - known + 1 : cut + 1]).all():
                token[cut + 1 : end + 1] = own[known + 1 :]
            else:
                symbols = word.tolist() if symbols is None else symbols
                self._anew(symbols, token, cut, end)
        ids, at = [], n
        size, token = self.size, token.tolist()
        while at:
            ids.append(token[at])
            at -= int(size[ids[-1]])
        return np.array(ids[::-1], np.uint32)

    def _anew(self, symbols: list[int], token: np.ndarray, cut: int, end: int) -> None:
        """What ends behind ``cut`` and up to ``end``, one position after the other."""
        low = max(0, cut - int(self.size.max()))
        known = token[low : cut + 1].tolist() + [-1] * (end - cut)
        target, root, goto, token_at, column = (memoryview(np.ascontiguousarray(x)) for x in (self.target, self.root, self.goto.reshape(-1), self.token_at, self.column))
        wide = self.goto.shape[1]
        has = self._scalar()
        for i in range(low, end):
            state, node, j = (target[known[i - low]] if i else 0), root[symbols[i]], i + 1
            while node >= 0:
                t = token_at[node]
                if t >= 0 and known[j - low] < 0 and has(state, t):
                    known[j - low] = t
                if j == end or node >= self.inner:
                    break
                node = goto[node * wide + column[symbols[j]]]
                j += 1
        token[cut + 1 : end + 1] = known[cut + 1 - low :]

    def _scalar(self):
        """:meth:`has_arc` of one state and token."""
        key_at, time_at, time, left = (memoryview(x) for x in (self.key_at, self.time_at, self.time, self.left))
        shift, last, whole = int(self.shift), len(self.key_at) - 1, (1 << 64) - 1

        def has(state: int, t: int) -> bool:
            if not state:
                return True
            before = 1 << 29
            while True:
                key = state << 20 | t
                slot = (key * 0x9E3779B97F4A7C15 & whole) >> shift
                while (there := key_at[slot]) >= 0:
                    if there == key:
                        if time_at[slot] <= before:
                            return False
                        break
                    slot = slot + 1 & last
                before = time[t]
                if before <= 0:
                    return True
                t = left[t]

        return has


def _portions(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Words in order of their sizes, as many at once as cells allow."""
    at = 0
    while at < len(order):
        n = 1
        # the last of a portion is the widest
        while at + n < len(order) and 2 * n * (int(sizes[order[min(at + 2 * n, len(order)) - 1]]) + 1) <= CELLS_AT_ONCE:
            n *= 2
        yield order[at : at + n]
        at += n


def load(path: str) -> tuple[Automaton, dict[str, int], np.ndarray, np.ndarray]:
    """Automaton, special tokens, and the bytes of all labels with the offset of each id, of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, letters = whole["model"], byte_letters()
    mark = model.get("end_of_word_suffix") or ""
    special = {x["content"]: x["id"] for x in whole["added_tokens"]}
    vocab = {t: k for t, k in model["vocab"].items() if t not in special}
    ids = max([*vocab.values(), *special.values()]) + 1

    def symbols(token: str) -> tuple[int, ...]:
        ends = bool(mark) and token.endswith(mark) and token != mark
        body = [letters[c] for c in (token[: -len(mark)] if ends else token)]
        return (*body[:-1], body[-1] + 256) if ends else tuple(body)

    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    spelled = {k: symbols(t) for t, k in vocab.items()}
    of_symbol = np.full(512, -1, np.int64)
    for k, s in spelled.items():
        if len(s) == 1:
            of_symbol[s[0]] = k
    merges = [(vocab[a], vocab[b]) for a, b in pairs]
    made = [vocab[a + b] for a, b in pairs]
    label = {k: bytes(x & 255 for x in s) for k, s in spelled.items()} | {k: t.encode() for t, k in special.items()}
    size = np.array([len(label.get(k, b"")) for k in range(ids)], np.int64)
    data = np.frombuffer(b"".join(label.get(k, b"") for k in range(ids)), np.uint8)
    return Automaton(merges, made, spelled, of_symbol, ids), special, data, np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


class ByteCoder:
    """Encoder and decoder of whole texts for a byte-level vocabulary."""

    #: Added to the last symbol of a word.
    final = 0

    # Fixed value: the pre-tokenizer's pattern, as the vocabulary file's kind defines it.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str) -> None:
        self.automaton, self.special, self.label, self.label_at = load(path)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.runs, self.words = runs.Memo(), runs.Memo()
        self.odd: set[str] = set()

    @staticmethod
    def fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that give the same ids, with fewer distinct runs, and where to cut them as well."""
        return data, edges(data, False)

    def pre_split(self, run: str) -> list[str]:
        if run.isalpha() or run[:1] == " " and run[1:].isalpha():
            return [run]
        if run in self.odd:
            return [w for w, _ in odd_split()(run)]
        return self.SPLIT.findall(run)

    def _words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in new]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        symbols[ends[1:] - 1] += self.final
        return self.automaton.encode(symbols, ends)

    def _runs(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(self.pre_split, new))
        parts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
        values, ends = self.words.take(self.words.codes([w for s in split for w in s], self._words))
        return values, ends[parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn and the offset of each text."""
        data, at = runs.flat(texts)
        if self.cut and (hits := special_texts(data, at, self.special)):
            return self._with_special(texts, hits)
        names, codes, first, self.odd = distinct_whole(data, at, self.fold)
        values, ends = self.runs.take(self.runs.codes(names, self._runs)[codes])
        return values, ends[first]

    def _with_special(self, texts: pa.Array, hits: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts cut at special tokens; their ids go between what the parts give."""
        flat, owner, marks = [], [], []
        for k, text in enumerate(texts.to_pylist()):
            text, at = text or "", 0
            for m in self.cut.finditer(text) if k in hits else ():
                flat.append(text[at : m.start()])
                owner.append(k)
                marks.append(self.special[m[0]])
                at = m.end()
            flat.append(text[at:])
            owner.append(k)
            marks.append(-1)
        values, ends = ByteCoder._plain(self, flat)
        out, count = [], np.zeros(len(texts), np.int64)
        for k, mark, a, b in zip(owner, marks, ends, ends[1:]):
            part = values[a:b] if mark < 0 else np.append(values[a:b], np.uint32(mark))
            out.append(part)
            count[k] += len(part)
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cut, self.cut = self.cut, None
        try:
            return self.encode(pa.array(texts, pa.string()))
        finally:
            self.cut = cut

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The labels' bytes of all texts in turn and the offset of each text."""
        data, at = runs.spread(self.label, self.label_at, ids.astype(np.int64))
        return data.tobytes(), at[ends]


def special_texts(data: np.ndarray, at: np.ndarray, special: dict[str, int]) -> set[int]:
    """Texts that hold the string of a special token."""
    whole, found = data.tobytes(), set()
    for s in special:
        mark, k = s.encode(), -1
        while (k := whole.find(mark, k + 1)) >= 0:
            text = int(np.searchsorted(at, k, side="right")) - 1
            if k + len(mark) <= at[text + 1]:
                found.add(text)
    return found


def exotic(data: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII, or a separator that regex engines class differently, may begin."""
    two = np.zeros(len(data), bool)
    if len(data) > 1:
        lead, after = data[:-1], data[1:]
        two[:-1] |= (lead == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (lead == 0xE1) & (after == 0x9A) | (lead == 0xE3) & (after == 0x80) | (lead == 0xE2) & (after == 0x81)
        quote = np.flatnonzero((lead == 0xE2) & (after == 0x80))
        last = data[np.minimum(quote + 2, len(data) - 1)]
        two[quote] = (last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF)
    return np.flatnonzero(two | (data >= 0x1C) & (data <= 0x1F))


#: Classes of bytes: white space and bytes of other alphabets 0, letters 1, digits 2, other signs 3, the apostrophe 4.
KINDS = np.array([0 if k in b"\t\n\v\f\r \x1c\x1d\x1e\x1f" or k > 127 else 1 if chr(k).isalpha() else 2 if chr(k).isdigit() else 4 if chr(k) == "'" else 3 for k in range(256)], np.uint8)


def edges(data: np.ndarray, each_digit: bool) -> np.ndarray:
    """Where letters, digits and other signs of ASCII meet. No word of a pre-tokenizer used here crosses such a
    place, but for an apostrophe and the letters after it; so the parts are split as the whole is."""
    kind, out = KINDS[data], np.zeros(len(data), bool)
    left, right = kind[:-1], kind[1:]
    out[1:] = (left > 0) & (right > 0) & (left != 4) & ((left != right) & ~((left == 3) & (right == 4)) | each_digit & (left == 2))
    return out


def distinct_whole(data: np.ndarray, at: np.ndarray, fold) -> tuple[list[str], np.ndarray, np.ndarray, set[str]]:
    """:func:`runs.distinct` of folded bytes, but a text with exotic white space is one run; those runs come last."""
    odd = np.unique(np.searchsorted(at, exotic(data), side="right") - 1)

    def distinct(data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        folded, more = fold(data)
        return runs.distinct(folded, at, more)

    if not len(odd):
        return *distinct(data, at), set()
    names: dict[str, int] = {}
    whole: set[str] = set()
    codes, first, k = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0
    for stop in [*odd.tolist(), len(at) - 1]:
        if k < stop:
            n, c, f = distinct(data[at[k] : at[stop]], at[k : stop + 1] - at[k])
            codes.append(np.array([names.setdefault(x, len(names)) for x in n], np.int64)[c] if len(n) else c)
            first.append(f[1:] + first[-1][-1])
        if stop < len(at) - 1:
            text = data[at[stop] : at[stop + 1]].tobytes().decode()
            whole.add(text)
            codes.append(np.array([names.setdefault(text, len(names))], np.int64))
            first.append(first[-1][-1:] + 1)
        k = stop + 1
    return list(names), np.concatenate(codes), np.concatenate(first), whole


@lru_cache(1)
def odd_split():
    """The library's own pre-tokenizer, whose classes of white space hold for the odd texts."""
    from tokenizers import pre_tokenizers

    step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return lambda run: [(run[a:b], (a, b)) for _, (a, b) in step.pre_tokenize_str(run)]


class WordCoder(ByteCoder):
    """Encoder for a vocabulary with word ends: composed, lower-cased words without white space."""

    final = 256
    # Fixed value: likewise.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(path)
        self.library, self.letters = Tokenizer.from_file(path), byte_letters()

    @staticmethod
    def fold(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # letters that nothing can be composed with are lower-cased here
        big = (data >= 65) & (data <= 90)
        big[:-1] &= data[1:] < 128
        return np.where(runs.SPACE[data], np.uint8(32), np.where(big, data | 32, data)), edges(data, True)

    def pre_split(self, run: str) -> list[str]:
        run = run.strip(" \t\n\v\f\r") if run not in self.odd else run
        if not run:
            return []
        # up to this letter, composing changes nothing and each letter has its lower case alone
        if max(run) <= "\u024f" and run not in self.odd:
            low = run.lower()
            return [low] if low.isalpha() else self.SPLIT.findall(low)
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))
        return [bytes(self.letters[c] for c in word).decode() for word, _ in found]


def coder(path: str, kind: type[ByteCoder] = ByteCoder) -> ByteCoder:
    """One coder a worker process."""
    return runs.held(path, lambda: kind(path))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coder(path)
        for batch in runs.pieces(batches):
            ids, ends = by.encode(batch.column("text"))
            text, at = by.decode(ids, ends)
            raw = ids.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(ends[1:] - ends[:-1]),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string()),
                    pa.array([hashlib.sha256(text[a:b].decode(errors="replace").encode()).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist())], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return work


def _encoded(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coder(path)
        for batch in runs.pieces(batches):
            ids, ends = by.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return work


def _decoded(path: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coder(path)
        for batch in batches:
            lists = batch.column("ids")
            ends = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in lists.to_pylist()])]).astype(np.int64)
            text, at = by.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), ends)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([text[a:b].decode(errors="replace") for a, b in zip(at.tolist(), at[1:].tolist())], pa.string())], ["doc_id", "text"])

    return work


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of each whole text."""
    return runs.mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _encoded(path), "doc_id long, ids array<int>", path)


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of each list of ids."""
    return runs.mapped(tokens.select("doc_id", "ids"), _decoded(path), "doc_id long, text string", path)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """What encoding each whole text and decoding it again gives, as counts and hashes."""
    return runs.mapped(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _digests(path), SCHEMA, path)
