"""Secret scans: fixed patterns, and formats learned as probabilistic automata.

A first pass over the texts finds the base spans (key assignments, access key ids,
long hex strings) and ordinary runs. The values of base spans are labelled
credentials; from a bounded sample of them, a prefix tree a kind is built of whole
strings and its statistically compatible states are merged (ALERGIA, Hoeffding
bounds in the red-blue order), as is one automaton of ordinary runs. A second pass
scores every maximal run outside base spans that is as long as the shortest value a
base pattern takes (6), whatever its characters, by the log-likelihood ratio a
character of its best format against ordinary text; those above a threshold become
spans of kind auto_<label>. Merged states forget where a string ends, so the
likelihood is that of the length among the learned strings times that of the
characters given that the string goes on.

Samples are those values that come first by a hash of the value, over all rows, so
they and the automata depend neither on the order of rows nor on partitions. They are bounded
in strings and in characters: of a string, tasks keep the first `longest` characters and its
length; of a label's strings, so many of the first characters are learned from that all together have
`chars` at most (all of them, where the strings are as short as credentials usually are). A string cut off
goes on: its last state neither counts an end nor a next character. Lengths are whole ones.

Cases: a null text is an empty one and has no spans; an empty table gives no
rows and trains nothing; repeated rows and doc_ids stay as they are, as rows are
never joined; null doc_ids pass through; extra columns are ignored; of texts
without labelled credentials anywhere, only base spans (none) come back; a very
long text is scanned whole, in time that grows with its length alone, and one of
its runs is scored whole, however long.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessera.llm._text import bounded_batches, byte_table, run_hash
from tessera.session import materialise, release

KINDS = ("assign", "access", "hex")
#: Base patterns; ASCII rules, so that either case means A-Z and a-z only.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Rows that can hold a base span, by Arrow's linear-time matcher.
MAY_HOLD = {"assign": r"(?i)(passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: Candidates: maximal runs, from the shortest value of a base pattern on.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
#: Ordinary runs are of many kinds, some rare (numbers are two in a thousand distinct ones), so their automaton learns from as many times the sample.
ORDINARY = 16
#: Verdicts on runs that a worker keeps, of runs up to this length.
KEPT_RUNS, KEPT_LENGTH = 200_000, 64
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as HEX with short matches dropped
FOUND = "kind int, place long, value string, length long"


def base_spans(text: str, kinds: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind."""
    out = []
    if kinds[0]:
        out += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if kinds[1]:
        out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if kinds[2]:
        out += [(2, m.start(), m.end(), m[0]) for m in HEX_LONG.finditer(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def _places(values: list[str]) -> np.ndarray:
    """A hash of each value, 0 to 2**63 - 1, that orders samples."""
    size = np.fromiter((len(v.encode()) for v in values), np.int64, len(values))
    ends = np.cumsum(size)
    data = np.frombuffer("".join(values).encode(), np.uint8)
    return (run_hash(byte_table(7)[data], ends - size, ends) >> np.uint64(1)).view(np.int64)


class _Sample:
    """Of all distinct values added, the `most` with the smallest places; of each, the first `longest` characters and its length."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest, self.limit = most, longest, 1 << 63
        #: places by value, of longer ones by what is kept of them
        self.kept: dict[str | tuple[str, int, int], int] = {}

    def add(self, values: set[str]) -> None:
        fresh = [v for v in values if len(v) > self.longest or v not in self.kept]
        for v, p in zip(fresh, _places(fresh).tolist()):
            if p < self.limit:
                self.kept[v if len(v) <= self.longest else (v[: self.longest], len(v), p)] = p
        if len(self.kept) > 2 * self.most:
            self._cut()

    def _cut(self) -> None:
        self.kept = dict(sorted(self.kept.items(), key=lambda x: (x[1], x[0] if isinstance(x[0], str) else x[0][0]))[: self.most])
        if len(self.kept) == self.most:
            self.limit = max(self.kept.values()) + 1

    def rows(self) -> list[tuple[int, str, int]]:
        self._cut()
        return [(p, v, len(v)) if isinstance(v, str) else (p, v[0], v[1]) for v, p in self.kept.items()]


def _spans(text: pa.Array) -> Iterator[tuple[str, list[tuple[int, int, int, str]]]]:
    """Every text with its base spans."""
    may = [pc.match_substring_regex(text, p).to_pylist() for p in MAY_HOLD.values()]
    for t, *kinds in zip(text.to_pylist(), *may):
        yield t, base_spans(t, tuple(kinds)) if any(kinds) else []


def _outside(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[re.Match]:
    """The runs that overlap no base span. Both come by their starts, so one walk over the spans is enough."""
    at, reached = 0, 0
    for m in RUN.finditer(text):
        while at < len(spans) and spans[at][1] < m.end():
            reached = max(reached, spans[at][2])
            at += 1
        if reached <= m.start():
            yield m


def _scan(sample: int, longest: int):
    """kind, place and value of what automata learn from: a partition's `sample` values a kind, and ORDINARY times as many ordinary runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = [*(_Sample(sample, longest) for _ in KINDS), _Sample(ORDINARY * sample, longest)]
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                found: list[set[str]] = [set() for _ in samples]
                for t, spans in _spans(whole.slice(k, 1000).column("text").fill_null("")):
                    for x in spans:
                        found[x[0]].add(x[3])
                    found[-1].update((m[0] for m in _outside(t, spans)) if spans else RUN.findall(t))
                for one, values in zip(samples, found):
                    one.add(values)
        for kind, one in enumerate(samples):
            rows = one.rows()
            columns = [pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), *columns], names=["kind", "place", "value", "length"])

    return run


def symbol(c: str) -> str:
    """The class of a character; classes keep the sizes in CLASS_SIZE, others stand for themselves."""
    if "0" <= c <= "9":
        return "d"
    if "a" <= c <= "z":
        return "h" if c <= "f" else "l"
    if "A" <= c <= "Z":
        return "H" if c <= "F" else "L"
    return c


CLASS_SIZE = {"d": 10, "h": 6, "l": 20, "H": 6, "L": 20}
#: All symbols of candidate runs; smoothing shares its mass over them.
ALPHABET = ["d", "h", "l", "H", "L", *"+/_.=-"]


class Automaton:
    """A probabilistic deterministic automaton inferred from strings by state merging. sizes: their whole lengths, where strings are only the beginnings."""

    def __init__(self, strings: list[str], sizes: list[int] | None = None, alpha: float = 0.05):
        sizes = sizes or list(map(len, strings))
        self.lengths, self.n_strings = Counter(sizes), len(strings)
        self.total, self.final, self.move, self.count = [0], [0], [{}], [{}]
        for s, size in zip(strings, sizes):
            at = 0
            for c in s:
                y = symbol(c)
                if y not in self.move[at]:
                    self.move[at][y] = self._new()
                self.total[at] += 1
                self.count[at][y] = self.count[at].get(y, 0) + 1
                at = self.move[at][y]
            if len(s) == size:
                self.total[at] += 1
                self.final[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.steps: list[dict[tuple[str, float], tuple[float, int]]] = [{} for _ in self.total]

    def _new(self) -> int:
        for x, v in ((self.total, 0), (self.final, 0), (self.move, {}), (self.count, {})):
            x.append(v)
        return len(self.total) - 1

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if not n or not m:
                continue
            if self._differ(self.final[a], n, self.final[b], m):
                return False
            for y in self.count[a].keys() | self.count[b].keys():
                if self._differ(self.count[a].get(y, 0), n, self.count[b].get(y, 0), m):
                    return False
                if y in self.move[a] and y in self.move[b]:
                    todo.append((self.move[a][y], self.move[b][y]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree at b to the state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.total[a] += self.total[b]
            self.final[a] += self.final[b]
            for y, child in self.move[b].items():
                self.count[a][y] = self.count[a].get(y, 0) + self.count[b][y]
                if y in self.move[a]:
                    todo.append((self.move[a][y], child))
                else:
                    self.move[a][y] = child

    def _merge(self) -> None:
        red = [0]
        settled = {0}
        while blue := next(((r, y) for r in red for y in sorted(self.move[r]) if self.move[r][y] not in settled), None):
            parent, y = blue
            state = self.move[parent][y]
            for r in red:
                if self._compatible(r, state):
                    self.move[parent][y] = r
                    self._fold(r, state)
                    break
            else:
                red.append(state)
                settled.add(state)
        name = {s: i for i, s in enumerate(red)}
        self.move = [{y: name[t] for y, t in self.move[s].items()} for s in red]
        self.count = [self.count[s] for s in red]
        self.final = [self.final[s] for s in red]
        self.total = [self.total[s] for s in red]

    def log_likelihood(self, text: str, smooth: float = 0.5) -> float:
        """Of the length and the characters of text; an unseen length L gets 1/L(L+1) of the smoothing mass, unseen symbols get a share of the smoothing mass and stay in the state."""
        n, at = len(text), 0
        out = math.log((self.lengths[n] + smooth / (n * (n + 1) or 1)) / (self.n_strings + smooth))
        for c in text:
            got = self.steps[at].get((c, smooth))
            if got is None:
                got = self.steps[at][c, smooth] = self._step(at, symbol(c), smooth)
            out, at = out + got[0], got[1]
        return out

    def _step(self, at: int, y: str, smooth: float) -> tuple[float, int]:
        """The log-likelihood of a character of class y in a state, and the state after it."""
        n = self.total[at] - self.final[at]
        share = (self.count[at].get(y, 0) + smooth / len(ALPHABET)) / (n + smooth)
        return math.log(share) - math.log(CLASS_SIZE.get(y, 1)), self.move[at].get(y, at)


def _level(sizes: list[int], chars: int) -> int:
    """The greatest length at which strings of these sizes, cut to it, have `chars` characters together at most."""
    left = chars
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= n
    return max(sizes, default=0)


def learn_formats(found: DataFrame, sample: int, chars: int) -> dict[str, Automaton]:
    """An automaton a label of found (kind, place, value, length), from the `sample` distinct values of each with the smallest places; "ordinary" is the background, from ORDINARY times as many. Each holds `chars` states at most before states merge."""
    values = found.distinct()
    out = {}
    for r in sorted(values.groupBy("kind").agg(F.count("*").alias("n")).collect()):
        k, n = r["kind"], r["n"]
        most = min(n, sample if k < len(KINDS) else ORDINARY * sample)
        # places are even over 0 .. 2**63, so a share of them holds the first `most` and a few more; if ever not, they are sorted out of all
        own = values.where(F.col("kind") == k).select("place", "value", "length")
        end = min((1 << 63) - 1, (most + 8 * math.isqrt(most) + 64 << 63) // n)
        near = own.where(F.col("place") <= end).collect()
        if len(near) < most:
            near = own.orderBy("place", "value", "length").limit(most).collect()
        chosen = sorted((x["value"], x["length"]) for x in sorted(near)[:most])
        level = _level([len(v) for v, _ in chosen], chars)
        out[(*KINDS, "ordinary")[k]] = Automaton([v[:level] for v, _ in chosen], [size for _, size in chosen])
    return out


class _Judge:
    """The format that a run follows, or None; verdicts on runs met before are kept."""

    def __init__(self, models: dict[str, Automaton], margin: float):
        self.formats = {k: m for k, m in models.items() if k != "ordinary"}
        self.plain, self.margin = models.get("ordinary"), margin
        self.kept: dict[str, str | None] = {}

    def verdict(self, value: str) -> str | None:
        rest = self.plain.log_likelihood(value)
        best, label = max(((m.log_likelihood(value) - rest) / len(value), k) for k, m in self.formats.items())
        return label if best > self.margin else None

    def following(self, runs: list[list[str]]) -> dict[str, str]:
        """Of all runs, those that follow a format, with its label."""
        if not self.plain or not self.formats:
            return {}
        met = set().union(*runs)
        fresh = {v: self.verdict(v) for v in met.difference(self.kept)}
        labels = {v: fresh[v] if v in fresh else self.kept[v] for v in met}
        if len(self.kept) + len(fresh) > KEPT_RUNS:
            self.kept.clear()
        self.kept.update((v, label) for v, label in fresh.items() if len(v) <= KEPT_LENGTH)
        return {v: label for v, label in labels.items() if label}


#: Of the last formats that a worker scored by, so that its tasks share verdicts.
_JUDGE: dict[str, _Judge] = {}


def _score(models: dict[str, Automaton], margin: float):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _JUDGE:
            _JUDGE.clear()
            _JUDGE[name] = _Judge(models, margin)
        judge = _JUDGE[name]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                counts, sha, spans = [[], [], []], [], []
                texts = list(_spans(b.column("text").fill_null("")))
                runs = [RUN.findall(t) for t, _ in texts]
                follow = judge.following(runs)
                for (t, base), own in zip(texts, runs):
                    for k in range(3):
                        counts[k].append(sum(x[0] == k for x in base))
                    named = [(s, k, f"{KINDS[k]}:{s}:{e}") for k, s, e, _ in base]
                    sha.append(hashlib.sha256(",".join(x[2] for x in named).encode()).hexdigest())
                    # places are wanted only where some run of the text follows a format
                    if not follow.keys().isdisjoint(own):
                        named += [(m.start(), len(KINDS), f"auto_{follow[m[0]]}:{m.start()}:{m.end()}") for m in _outside(t, base) if m[0] in follow]
                    spans.append(",".join(x[2] for x in sorted(named)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")


#: Fit parameters: characters kept of a string, and learned from a label in all.
LONGEST, CHARS = 512, 600_000


def _learn(docs: DataFrame, sample: int, longest: int, chars: int) -> dict[str, Automaton]:
    """Formats of docs. What is written holds samples of credentials in clear, so it goes as soon as they are learned."""
    found = materialise(_rows(docs).mapInArrow(_scan(sample, longest), FOUND), "secrets")
    models = learn_formats(found, sample, chars)
    release(found)
    return models


def scan_secrets(docs: DataFrame, sample: int = 1000, margin: float = 0.5, longest: int = LONGEST, chars: int = CHARS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs (doc_id, text).

    sample bounds the strings a label (of ordinary runs, ORDINARY times as many) that automata are learned from, longest and
    chars their characters (and so what the driver holds: about half a kilobyte for each of chars); margin is the
    log-likelihood ratio a character, in nats. Texts are read twice.
    """
    models = _learn(docs, sample, longest, chars)
    return _rows(docs).mapInArrow(_score(models, margin), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans: str, mark: str = "[SECRET]") -> str:
    """The text with every span replaced by mark; overlapping spans are replaced as one."""
    out, at = [], 0
    for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x):
        if e <= at:
            continue
        out += [text[at:s], mark] if s >= at else []
        at = e
    return "".join([*out, text[at:]])


def _redact_rows(at: int, names: list[str], models: dict[str, Automaton], margin: float):
    score = _score(models, margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                text = b.column(at)
                rows = pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), text], names=["doc_id", "text"])
                spans = [s for r in score(iter([rows])) for s in r.column("spans").to_pylist()]
                clean = [redact(t, s) if s else t for t, s in zip(text.to_pylist(), spans)]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(clean, pa.string()), *b.columns[at + 1 :]], names=names)

    return run


def redact_secrets(docs: DataFrame, sample: int = 1000, margin: float = 0.5, longest: int = LONGEST, chars: int = CHARS) -> DataFrame:
    """docs with all secret spans of the text replaced, other columns as they are; a null text stays null."""
    models = _learn(docs, sample, longest, chars)
    return docs.mapInArrow(_redact_rows(docs.columns.index("text"), docs.columns, models, margin), docs.schema)
