"""Secret scans: base patterns, and formats learned from what they find by grammar inference.

All credentials that the base patterns label (an assigned value, an access key, a long hex string) are learned from,
each different one once. Spark counts the steps of each kind's prefix tree over character classes: a prefix that enough
credentials begin with is a state of its own; rarer ones share a state with those of their length (up to 1,024) and
last class, so that the tree has a bounded size while every character of every credential counts in it. States are
then merged where the frequencies of ending and of going on are statistically compatible (Hoeffding bound),
red states against blue ones, which gives a probabilistic automaton per kind. Every run of credential
characters in every text is then scored by its best likelihood under the automata against a background
model, per character. A run has six characters or more, as the shortest assigned value has, may hold single dots
inside, and is what base spans leave of it. The background is counted on the word-like runs of all texts (each part all letters or
all digits), of any length and as often as they occur, so that unlabelled secrets hardly count in it. A run is added as "grammar" if it
scores as high as all but 2 % of all labelled credentials do under automata fitted on the half that they aren't in, and
if it is more likely a credential than not at the odds of labelled credentials to free runs. Neither bounds how many
runs may pass.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
WORD_LIKE = re.compile(r"[+/_=.-]*(?:(?:[A-Za-z]+|[0-9]+)(?:[+/_=.-]+(?:[A-Za-z]+|[0-9]+))*[+/_=.-]*)?")
SHORTEST = 6  # an assigned value has at least as many characters
DEEP = 1024  # from here on, states no longer tell the length
SHORT = 64  # runs up to this length are scored together


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) by start, then kind: the matches of the base patterns that are long enough."""
    found = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]  # runs are maximal: 24 and more of them
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def uncovered(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    """``text`` with spaces in place of ``spans``, which are ordered by their starts."""
    if not spans:
        return text
    parts, at = [], 0
    for _, start, end, _ in spans:
        if start > at:
            parts.append(text[at:start])
        parts.append(" " * max(end - max(start, at), 0))
        at = max(at, end)
    return "".join([*parts, text[at:]])


def symbol(c: str) -> str:
    """The character class: h, H hex letters, l, U other letters, d digits, else the character itself."""
    if "0" <= c <= "9":
        return "d"
    if "a" <= c <= "z":
        return "h" if c <= "f" else "l"
    if "A" <= c <= "Z":
        return "H" if c <= "F" else "U"
    return c


_SIZE = {"d": 10, "h": 6, "H": 6, "l": 20, "U": 20}
SYMBOLS = "dhHlU+/_.=-"
CLASSES = len(SYMBOLS)
_CLASSES_OF = str.maketrans({chr(c): symbol(chr(c)) for c in range(128)})


def _root(into: list[int], x: int) -> int:
    while into[x] != x:
        into[x] = x = into[into[x]]
    return x


@dataclass
class Automaton:
    """States with counts of visits and ends, and counted transitions."""

    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    taken: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def add(self, word: str) -> None:
        state = 0
        self.visits[0] += 1
        for c in word:
            if c not in self.next[state]:
                self.next[state][c] = len(self.visits)
                for column, value in ((self.visits, 0), (self.ends, 0), (self.next, {}), (self.taken, {})):
                    column.append(value)
            self.taken[state][c] = self.taken[state].get(c, 0) + 1
            state = self.next[state][c]
            self.visits[state] += 1
        self.ends[state] += 1

    def compatible(self, a: int, b: int, alpha: float, into: list[int]) -> bool:
        todo, seen = [(a, b)], set()
        width = math.sqrt(0.5 * math.log(2 / alpha))
        while todo:
            a, b = (_root(into, x) for x in todo.pop())
            n, m = self.visits[a], self.visits[b]
            if a == b or (a, b) in seen or not n or not m:
                continue
            seen.add((a, b))
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for c in self.taken[a].keys() | self.taken[b].keys():
                if abs(self.taken[a].get(c, 0) / n - self.taken[b].get(c, 0) / m) > bound:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, a: int, b: int, into: list[int], red: set[int]) -> None:
        """Make ``b`` one with ``a``, and what they go to by the same class; of a red state and another the red one stays."""
        todo = [(a, b)]
        while todo:
            a, b = (_root(into, x) for x in todo.pop())
            if a == b:
                continue
            if b in red and a not in red:
                a, b = b, a
            into[b] = a
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, to in self.next[b].items():
                self.taken[a][c] = self.taken[a].get(c, 0) + self.taken[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def merged(self, alpha: float = 0.05) -> Automaton:
        """Merge compatible states, the most visited blue state first; only reached states stay."""
        into, red = list(range(len(self.visits))), [0]
        while True:
            known = set(red)
            blue = [(self.visits[to], r, c) for r in red for c, to in ((c, _root(into, to)) for c, to in self.next[r].items()) if to not in known]
            if not blue:
                break
            _, source, c = max(blue)
            state = _root(into, self.next[source][c])
            match = next((r for r in red if self.compatible(r, state, alpha, into)), None)
            if match is None:
                red.append(state)
            else:
                self.fold(match, state, into, known)
                red = [r for r in red if into[r] == r]
        number = {r: i for i, r in enumerate(red)}
        steps = [{c: number[_root(into, t)] for c, t in self.next[r].items()} for r in red]
        return Automaton([self.visits[r] for r in red], [self.ends[r] for r in red], steps, [dict(self.taken[r]) for r in red])

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By state and class: the logarithm of a step and the state after it; by state: the logarithm of an end."""
        n = np.array(self.visits) + 0.1 * (CLASSES + 1)
        taken = np.array([[t.get(c, 0) for c in SYMBOLS] for t in self.taken]) + 0.1
        to = np.array([[t.get(c, 0) for c in SYMBOLS] for t in self.next])
        return np.log(taken / n[:, None]), to, np.log((np.array(self.ends) + 0.1) / n)

    def log_likelihood(self, word: str) -> float:
        """Of the class string, smoothed; unseen steps restart at the first state."""
        state, total = 0, 0.0
        for c in word:
            n = self.visits[state] + 0.1 * (CLASSES + 1)
            total += math.log((self.taken[state].get(c, 0) + 0.1) / n)
            state = self.next[state].get(c, 0)
        return total + math.log((self.ends[state] + 0.1) / (self.visits[state] + 0.1 * (CLASSES + 1)))


@dataclass
class Formats:
    """The automata by kind, background frequencies of pairs of characters, and the threshold."""

    automata: dict[str, Automaton]
    pairs: dict[str, float]
    rare: dict[str, float]
    threshold: float = math.inf
    log_odds: float = 0.0

    def score(self, run: str) -> float:
        """The best log-likelihood ratio per character."""
        if not self.automata:
            return -math.inf
        classes = "".join(map(symbol, run))
        letters = -sum(math.log(_SIZE.get(c, 1)) for c in classes)
        plain = sum(self.pairs.get(a + b, self.rare.get(a, -math.log(67))) for a, b in zip("^" + run, run + "$", strict=True))
        return (max(x.log_likelihood(classes) for x in self.automata.values()) + letters - plain) / (len(run) + 1)

    @cached_property
    def by_codes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ASCII codes: the class and the logarithm of its size; of pairs of codes: the background."""
        chars = [chr(i) for i in range(128)]
        classes = [symbol(c) for c in chars]
        pairs = np.array([[self.pairs.get(a + b, self.rare.get(a, -math.log(67))) for b in chars] for a in chars])
        return np.array([max(SYMBOLS.find(c), 0) for c in classes]), np.log([_SIZE.get(c, 1) for c in classes]), pairs

    def scores(self, runs: list[str]) -> np.ndarray:
        """``score`` of each run, all at once: position by position, those up to ``SHORT`` together."""
        out = np.array([self.score(r) if len(r) > SHORT else -math.inf for r in runs])
        if not self.automata:
            return out
        size = np.array([len(r) for r in runs], np.int64)
        order = np.argsort(-size, kind="stable")[(size > SHORT).sum() :]
        n = size[order]
        data = np.frombuffer("".join(runs).encode("ascii"), np.uint8)
        start = (np.cumsum(size) - size)[order]
        classes, sizes, pairs = self.by_codes
        tables = [x.tables for x in self.automata.values()]
        plain, total, state = np.zeros(len(n)), np.zeros((len(tables), len(n))), np.zeros((len(tables), len(n)), np.int64)
        last = np.full(len(n), ord("^"))
        for at in range(int(n.max(initial=0))):
            on = int(np.searchsorted(-n, -at))  # the runs are ordered by length, longest first
            codes = data[start[:on] + at]
            own = classes[codes]
            plain[:on] += pairs[last[:on], codes] + sizes[codes]
            last[:on] = codes
            for k, (step, to, _) in enumerate(tables):
                total[k, :on] += step[state[k, :on], own]
                state[k, :on] = to[state[k, :on], own]
        plain += pairs[last, ord("$")]
        best = np.max([t + end[s] for t, s, (_, _, end) in zip(total, state, tables, strict=True)], axis=0)
        out[order] = (best - plain) / (n + 1)
        return out

    def accepted(self, runs: list[str]) -> np.ndarray:
        score = self.scores(runs)
        return (score >= self.threshold) & (score * (np.array([len(r) for r in runs]) + 1) >= self.log_odds)


def background(pairs: dict[str, int]) -> tuple[dict[str, float], dict[str, float]]:
    """Log-frequencies of pairs of characters, and of the unseen ones by their first, from counts in word-like runs."""
    first: Counter[str] = Counter()
    for k, n in pairs.items():
        first[k[0]] += n
    logs = {k: math.log((n + 0.5) / (first[k[0]] + 0.5 * 67)) for k, n in pairs.items()}
    return logs, {c: math.log(0.5 / (n + 0.5 * 67)) for c, n in first.items()}


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (kind, value, n): what the base patterns label, the runs outside of it, and pairs of characters of the word-like
    ones of these; ^ and $ stand for their ends."""
    words: Counter[str] = Counter()
    for batch in batches:
        base: Counter[tuple[str, str]] = Counter()
        for text in batch.column(0).to_pylist():
            spans = base_spans(text or "")
            base.update((s[0], s[3]) for s in spans)
            words.update(RUN.findall(uncovered(text or "", spans)))
            if len(words) > 100_000:
                yield from _counted(words)
                words.clear()
        yield _rows((kind, value, n) for (kind, value), n in base.items())
    yield from _counted(words)


def _rows(found) -> pa.RecordBatch:
    kinds, values, counts = ([*c] for c in zip(*found, strict=True)) if (found := [*found]) else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], names=["kind", "value", "n"])


def _counted(words: Counter[str]) -> Iterator[pa.RecordBatch]:
    if not words:
        return
    plain = [w for w in words if WORD_LIKE.fullmatch(w)]
    codes = np.frombuffer("".join(f"^{w}$" for w in plain).encode("ascii"), np.uint8).astype(np.int64)
    times = np.repeat(np.array([words[w] for w in plain], np.int64), np.array([len(w) + 2 for w in plain], np.int64))
    within = codes[:-1] != ord("$")
    both, which = np.unique(codes[:-1][within] * 128 + codes[1:][within], return_inverse=True)
    counts = np.zeros(len(both), np.int64)
    np.add.at(counts, which, times[:-1][within])
    runs = ("runs", "", sum(n for w, n in words.items() if len(w) >= SHORTEST))
    yield _rows([runs, *[("pair", chr(k // 128) + chr(k % 128), n) for k, n in zip(both.tolist(), counts.tolist(), strict=True)]])


def _side(value: str) -> int:
    """Which half a credential is in."""
    return zlib.crc32(value.encode()) & 1


def _states(word: str) -> list[int]:
    """Numbers of the prefixes of a class string, up to ``DEEP`` classes; 0 is the empty one."""
    out = [0]
    for c in word[:DEEP]:
        out.append((out[-1] * 1_000_003 + ord(c) + 1) % ((1 << 61) - 1))
    return out


def _flushed(counts: Counter[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*[(*k, n) for k, n in counts.items()], strict=True) if counts else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array([*c], t) for c, t in zip(columns, types, strict=True)], names=names)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many credentials of a kind begin with each prefix."""
    form = ["kind", "prefix", "n"], [pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        counts: Counter[tuple] = Counter()
        for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((kind, p) for p in _states(value.translate(_CLASSES_OF)))
            if len(counts) > 200_000:
                yield _flushed(counts, *form)
                counts.clear()
        yield _flushed(counts, *form)


def _steps(kept: dict[str, set[int]]):
    """How many credentials of a kind and a half take each step; a step to "" is an end."""
    form = ["kind", "side", "state", "c", "to", "n"], [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[tuple] = Counter()
            for kind, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, side, state, word = kept[kind], _side(value), 0, value.translate(_CLASSES_OF)
                prefixes = _states(word)
                for i, c in enumerate(word):
                    to = prefixes[i + 1] if i < DEEP and prefixes[i + 1] in own else -1 - min(i + 1, DEEP) * CLASSES - SYMBOLS.index(c)
                    counts[kind, side, state, c, to] += 1
                    state = to
                counts[kind, side, state, "", state] += 1
                if len(counts) > 200_000:
                    yield _flushed(counts, *form)
                    counts.clear()
            yield _flushed(counts, *form)

    return run


def automaton(steps: list[tuple[int, str, int, int]]) -> Automaton:
    """From (state, class or "", next state, n), beginning at state 0; merged."""
    number = {s: i for i, s in enumerate([0, *sorted({x for s, _, to, _ in steps for x in (s, to)} - {0})])}
    out = Automaton([0] * len(number), [0] * len(number), [{} for _ in number], [{} for _ in number])
    for state, c, to, n in steps:
        i = number[state]
        out.visits[i] += n
        if c:
            out.next[i][c] = number[to]
            out.taken[i][c] = out.taken[i].get(c, 0) + n
        else:
            out.ends[i] += n
    return out.merged()


STEP = 1000  # of a score of one, for the threshold


def _held_out(halves: list[Formats]):
    """Counts of the credentials' scores, in steps, each by what is learned from the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            for side in (0, 1):
                own = [v for v in values if _side(v) == side]
                counts = Counter((int(x),) for x in np.floor(STEP * halves[1 - side].scores(own))) if own else Counter()
                yield _flushed(counts, ["score", "n"], [pa.int64(), pa.int64()])

    return run


def learn(found: DataFrame, most_states: int = 20_000) -> Formats:
    """Fit on all counts (kind, value, n) of ``_extract``; without credentials nothing scores.

    The driver gets counts of pairs of characters, of the steps between states and of scores in thousandths: a kind has
    ``most_states`` prefixes of its own at most (all, if its credentials have no more characters), and 11 shared states a length.
    """
    logs, rare = background({r.value: r.n for r in found.where("kind = 'pair'").collect()})
    labelled = found.where(F.col("kind").isin(*KINDS[:3])).select("kind", "value", "n")
    n_base, chars = 0, {}
    for kind, n, size in labelled.groupBy("kind").agg(F.sum("n"), F.sum(1 + F.least(F.length("value"), F.lit(DEEP)))).collect():
        n_base, chars[kind] = n_base + n, size
    n_free = found.where("kind = 'runs'").agg(F.sum("n")).first()[0] or 0
    odds = math.log(max(n_free / max(n_base, 1), 1.0))
    if not chars:
        return Formats({}, logs, rare, log_odds=odds)
    least = F.coalesce(*[F.when(F.col("kind") == kind, -(-size // most_states)) for kind, size in chars.items()])
    prefixes = labelled.select("kind", "value").mapInArrow(_prefixes, "kind string, prefix long, n long").groupBy("kind", "prefix").agg(F.sum("n").alias("n"))
    kept = {kind: set() for kind in chars}
    for kind, prefix in prefixes.where(F.col("n") >= least).select("kind", "prefix").collect():
        kept[kind].add(prefix)
    steps = labelled.select("kind", "value").mapInArrow(_steps(kept), "kind string, side int, state long, c string, to long, n long")
    steps = steps.groupBy("kind", "side", "state", "c", "to").agg(F.sum("n").alias("n")).orderBy("kind", "state", "c", "to", "side").collect()

    def of(sides: tuple[int, ...]) -> Formats:
        own = {kind: [(r.state, r.c, r.to, r.n) for r in steps if r.kind == kind and r.side in sides] for kind in KINDS[:3]}
        return Formats({kind: automaton(x) for kind, x in own.items() if x}, logs, rare, log_odds=odds)

    out = of((0, 1))
    halves = [half if half.automata else out for half in (of((0,)), of((1,)))]
    scored = labelled.select("value").distinct().mapInArrow(_held_out(halves), "score long, n long").groupBy("score").agg(F.sum("n").alias("n")).orderBy("score").collect()
    fall = int(0.02 * sum(r.n for r in scored))
    for r in scored:
        fall -= r.n
        if fall < 0:
            out.threshold = r.score / STEP
            break
    return out


def _judge(formats: Formats, most_known: int = 200_000, most_chars: int = 1 << 22):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}  # of short runs, which repeat
        line = lambda xs: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(xs))

        def judged(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            base = [base_spans(text) for text in texts]
            free = [uncovered(text, spans) for text, spans in zip(texts, base, strict=True)]
            runs = [set(RUN.findall(text)) for text in free]
            if len(known) > most_known:
                known.clear()
            new = [w for w in set().union(*runs) - known.keys() if len(w) >= SHORTEST]
            verdicts = dict(zip(new, formats.accepted(new).tolist(), strict=True)) if new else {}
            known.update((w, v) for w, v in verdicts.items() if len(w) <= SHORT)
            counts, shas, spans, added = {k: [] for k in KINDS[:3]}, [], [], []
            for own, text, words in zip(base, free, runs, strict=True):
                taken = {w for w in words if known.get(w) or verdicts.get(w)}
                more = [(m.start(), 3, m.end()) for m in RUN.finditer(text) if m[0] in taken] if taken else []
                said = [(s[1], KINDS.index(s[0]), s[2]) for s in own]
                for i, k in enumerate(KINDS[:3]):
                    counts[k].append(sum(s[1] == i for s in said))
                shas.append(hashlib.sha256(line(said).encode()).hexdigest())
                spans.append(line(said + more))
                added.append(len(more))
            columns = [*[pa.array(counts[k], pa.int64()) for k in KINDS[:3]], pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            return pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"])

        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            first, chars = 0, 0
            for i, text in enumerate(texts):
                chars += len(text)
                if chars > most_chars or i + 1 == len(texts):
                    yield judged(batch.column(0).slice(first, i + 1 - first), texts[first : i + 1])
                    first, chars = i + 1, 0

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar.

    The automata, the background, the threshold and the odds come from all documents and all labelled credentials, which
    are learned whole, whatever their length (see ``learn``). Every run of six or more characters of every text is scored whole.
    Spans are kind:start:end in code points. A null or empty text has none; rows that repeat an id are scanned each;
    other columns are not read, so their names don't matter. An empty table gives an empty result.
    Without any labelled credential there are no automata and nothing is added.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = docs.select("text").mapInArrow(_extract, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    formats = learn(cut(found, "spans"))
    return docs.mapInArrow(_judge(formats), f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long")
