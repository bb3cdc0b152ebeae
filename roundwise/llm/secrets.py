"""Secret scans by combined deterministic automata.

All rules are compiled together: their parsed regular expressions become one
nondeterministic automaton over classes of bytes, which subset construction and
minimisation turn into a table of transitions. One pass over the bytes of a batch
reports on which lines any rule matches. numpy runs the pass in lanes: equal pieces
of the bytes advance together, and a piece whose start state turns out to be
another one is run again from its start until it meets the states it had.

Spans come from two more automata of the same kind, on the lines with a hit: that
of all reversed rules, run backwards, says where a match of which rule starts; each
rule's own, run from the leftmost start after its last match, says where the match
ends. No rule matches a line break, so lines are the same as whole texts. Rules must
be such that the longest match from a start is the one meant.

Spans are kind:start:end in code points, end exclusive. Defined results: null and
empty texts have none; bytes of neighbouring texts can't add or hide a span; other
columns don't matter; one row out for each row in.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from roundwise.llm.common import pieces, table

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """Matches of head and body; one counts if it has at least least characters
    after the longest match of head. detect is what the first pass looks for in
    place of the whole: something that every match that counts contains, which
    keeps the product of the counters and loops of all rules small."""

    kind: str
    body: str
    least: int = 1
    head: str = ""
    flags: int = re.ASCII
    detect: str | None = None
    base: bool = False


RULES = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", 6, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", re.ASCII | re.IGNORECASE, base=True),
    Rule("access", "AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", "[0-9a-f]+", 24, detect="[0-9a-f]{24}", base=True),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", 40, detect="gh[pousr]_[A-Za-z0-9]"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 15, detect="xox[abprs]-[A-Za-z0-9-]"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, detect=r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]"),
    Rule("cloud_key", "AIza[A-Za-z0-9_-]+", 39, detect="AIza[A-Za-z0-9_-]"),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]+", 24, detect="[rs]k_live_[A-Za-z0-9]"),
)


class Nfa:
    """Thompson's construction from parsed patterns, over sets of byte values;
    of reversed patterns, if back."""

    def __init__(self, back: bool = False):
        self.back = back
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def on(self, chars: frozenset[int]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.moves[a] = (chars, b)
        return a, b

    def chain(self, parts: list[tuple[int, int]]) -> tuple[int, int]:
        if not parts:
            a = self.state()
            return a, a
        for (_, x), (y, _) in zip(parts, parts[1:], strict=False):
            self.empty[x].append(y)
        return parts[0][0], parts[-1][1]

    def either(self, parts: list[tuple[int, int]]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        for x, y in parts:
            self.empty[a].append(x)
            self.empty[y].append(b)
        return a, b

    def build(self, items, fold: bool) -> tuple[int, int]:
        parts = [self.one(op, arg, fold) for op, arg in items]
        return self.chain(parts[::-1] if self.back else parts)

    def one(self, op, arg, fold: bool) -> tuple[int, int]:
        if op is sre.LITERAL:
            return self.on(self.cased({arg}, fold))
        if op is sre.IN:
            return self.on(self.cased(self.members(arg), fold))
        if op is sre.SUBPATTERN:
            return self.build(arg[3], fold)
        if op is sre.BRANCH:
            return self.either([self.build(x, fold) for x in arg[1]])
        if op is sre.MAX_REPEAT:
            low, high, body = arg
            parts = [self.build(body, fold) for _ in range(low)]
            if high is sre.MAXREPEAT:
                x, y = self.build(body, fold)
                a, b = self.state(), self.state()
                self.empty[a] += [x, b]
                self.empty[y] += [x, b]
                parts.append((a, b))
            else:
                for _ in range(high - low):
                    x, y = self.build(body, fold)
                    a, b = self.state(), self.state()
                    self.empty[a] += [x, b]
                    self.empty[y].append(b)
                    parts.append((a, b))
            return self.chain(parts)
        raise ValueError(f"{op} is not supported in rules")

    @staticmethod
    def members(arg) -> set[int]:
        out: set[int] = set()
        for op, x in arg:
            if op is sre.LITERAL:
                out.add(x)
            elif op is sre.RANGE:
                out |= set(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"{op} is not supported in a rule's class")
        return out

    @staticmethod
    def cased(chars: set[int], fold: bool) -> frozenset[int]:
        if max(chars) > 127:
            raise ValueError("rules are of ASCII characters")
        if fold:
            chars = {ord(y) for x in chars for y in (chr(x).lower(), chr(x).upper())}
        return frozenset(chars)


class Automaton:
    """Minimal deterministic automaton that says, after each byte, which patterns
    have a match ending there: one that starts anywhere or, if anchored, at the
    first byte. classes: byte to class; steps: flat table of next states, states
    being held as state * number of classes; rules: bits by state; dead: the state
    that no match leaves, or -1."""

    def __init__(self, patterns: list[tuple[str, int]], back: bool = False, anchored: bool = False):
        nfa = Nfa(back)
        root = nfa.state()
        for i, (pattern, flags) in enumerate(patterns):
            a, b = nfa.build(sre_parse.parse(pattern, flags), bool(flags & re.IGNORECASE))
            nfa.empty[root].append(a)
            nfa.accept[b] = i
        sets = sorted({m[0] for m in nfa.moves if m}, key=sorted)
        kinds: dict[tuple[bool, ...], int] = {}
        self.classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
        sample = {k: next(b for b in range(256) if self.classes[b] == k) for k in range(len(kinds))}

        def closed(states: set[int]) -> frozenset[int]:
            todo, seen = list(states), set(states)
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(x for x in seen if nfa.moves[x] or x in nfa.accept)

        start = closed({root})
        number, order, table = {start: 0}, [start], []
        for current in order:
            row = []
            for k in range(len(kinds)):
                byte = sample[k]
                reached = closed({m[1] for x in current if (m := nfa.moves[x]) and byte in m[0]} | (set() if anchored else {root}))
                if reached not in number:
                    number[reached] = len(order)
                    order.append(reached)
                row.append(number[reached])
            table.append(row)
        moves = np.array(table)
        bits = np.array([sum(1 << nfa.accept[x] for x in s if x in nfa.accept) for s in order], np.int64)
        part, n = np.unique(bits, return_inverse=True)[1], 0
        while True:  # refine until states of a part go to the same parts
            part = np.unique(np.column_stack([part, part[moves]]), axis=0, return_inverse=True)[1].ravel()
            if part.max() == n:
                break
            n = part.max()
        first = np.unique(part, return_index=True)[1]
        rank = np.argsort(np.argsort(np.where(part[first] == part[0], -1, first)))  # the start's part is 0
        part, first = rank[part], first[np.argsort(rank)]
        self.width = len(kinds)
        self.steps = (part[moves[first]] * self.width).astype(np.int32).ravel()
        self.rules = bits[first]
        self.bits = np.repeat(self.rules, self.width).astype(np.uint16 if len(patterns) <= 16 else np.int64)
        sinks = [i for i in range(len(first)) if not self.rules[i] and (part[moves[first[i]]] == i).all()]
        self.dead = sinks[0] * self.width if sinks else -1

    def scan(self, data: np.ndarray, chunk: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(place of its first byte, bits after each of its bytes) of each chunk."""
        state = 0
        for at in range(0, len(data), chunk):
            states, state = self._lanes(self.classes[data[at : at + chunk]], state)
            yield at, self.bits[states]

    def longest(self, data: bytes, at: int) -> int:
        """The end of the longest match of an anchored automaton from at; -1: none."""
        state, end = 0, -1
        steps, bits, classes, dead = self.lists
        for i in range(at, len(data)):
            state = steps[state + classes[data[i]]]
            if state == dead:
                break
            if bits[state]:
                end = i + 1
        return end

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int], int]:
        return self.steps.tolist(), self.bits.tolist(), self.classes.tolist(), self.dead

    def _lanes(self, classes: np.ndarray, start: int) -> tuple[np.ndarray, int]:
        """The state after each byte, and the last."""
        n = len(classes)
        lanes = max(1, min(16384, n // 256))
        size = -(-n // lanes)
        full = np.zeros(lanes * size, np.int32)
        full[:n] = classes
        x = np.ascontiguousarray(full.reshape(lanes, size).T)
        seen = np.empty((size, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        state[0] = start
        began = state.copy()
        for t in range(size):
            np.take(self.steps, state + x[t], out=seen[t], mode="clip")
            state = seen[t]
        while True:
            true = np.concatenate([began[:1], seen[-1, :-1]])
            active = np.flatnonzero(true != began)
            if not len(active):
                break
            began[active] = true[active]
            state = true[active]
            for t in range(size):
                state = self.steps[state + x[t, active]]
                other = state != seen[t, active]
                seen[t, active] = state
                active, state = active[other], state[other]
                if not len(active):
                    break
        flat = np.ascontiguousarray(seen.T).reshape(-1)[:n]
        return flat, int(flat[-1])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.lines = Automaton([(r.detect or r.head + r.body, r.flags) for r in rules])
        self.starts = Automaton([(r.head + r.body, r.flags) for r in rules], back=True)
        self.ends = [Automaton([(r.head + r.body, r.flags)], anchored=True) for r in rules]
        self.heads = [Automaton([(r.head, r.flags)], anchored=True) if r.head else None for r in rules]

    def line_spans(self, line: bytes, bits: int) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, of the rules that hit."""
        backwards = np.frombuffer(line, np.uint8)[::-1]
        starts = np.empty(len(line), self.starts.bits.dtype)
        for at, found in self.starts.scan(backwards):
            starts[at : at + len(found)] = found
        starts = starts[::-1]
        out = []
        for k, rule in enumerate(self.rules):
            if not bits >> k & 1:
                continue
            places = np.flatnonzero(starts >> np.array(k, starts.dtype) & 1)
            i = 0
            while i < len(places):
                a = int(places[i])
                b = self.ends[k].longest(line, a)
                body = a if self.heads[k] is None else self.heads[k].longest(line, a)
                if b - body >= rule.least:
                    out.append((a, k, b))
                i = int(np.searchsorted(places, max(b, a + 1)))
        return out

    def spans(self, raw: np.ndarray, lines: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """raw: bytes of a text. lines: (start, end, bits) of those with a hit.
        (start, rule, end) in code points, by start and rule."""
        out = [(low + a, k, low + b) for low, high, bits in lines for a, k, b in self.line_spans(raw[low:high].tobytes(), bits)]
        if not out:
            return []
        inner = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that begin no character
        edges = np.array(out, np.int64)
        edges[:, 0] -= np.searchsorted(inner, edges[:, 0])
        edges[:, 2] -= np.searchsorted(inner, edges[:, 2])
        return sorted(map(tuple, edges.tolist()))

    def batch(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """The spans of each text of an Arrow string array."""
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        if data is None or edges[-1] == edges[0]:
            return out
        whole = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
        starts = edges - edges[0]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for low, high, bits in self.hit_lines(whole, starts):
            row = int(np.searchsorted(starts, low, side="right")) - 1
            found.setdefault(row, []).append((low - int(starts[row]), high - int(starts[row]), bits))
        for row, lines in found.items():
            out[row] = self.spans(whole[starts[row] : starts[row + 1]], lines)
        return out

    def hit_lines(self, whole: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, bits) of each line of any text in which a rule hits."""
        begun, bits = 0, 0  # the line that goes on
        for at, found in self.lines.scan(whole):
            end = at + len(found)
            cuts = np.flatnonzero(whole[at:end] == 10) + at + 1
            inside = starts[np.searchsorted(starts, at, "right") : np.searchsorted(starts, end, "right")]
            cuts = np.unique(np.concatenate([cuts, inside])) if len(inside) else cuts
            cuts = cuts[(cuts > at) & (cuts < end)]
            parts = np.concatenate([[at], cuts])
            ored = np.bitwise_or.reduceat(found, parts - at)
            if len(cuts):
                if bits | int(ored[0]):
                    yield begun, int(cuts[0]), bits | int(ored[0])
                for i in np.flatnonzero(ored[1:-1]).tolist():
                    yield int(cuts[i]), int(cuts[i + 1]), int(ored[i + 1])
                begun, bits = int(cuts[-1]), int(ored[-1])
            else:
                bits |= int(ored[0])
            if end < len(whole) and (whole[end - 1] == 10 or starts[np.searchsorted(starts, end)] == end):
                if bits:  # the line ends with the chunk
                    yield begun, end, bits
                begun, bits = end, 0
        if bits:
            yield begun, len(whole), bits


def joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep's columns, a count n_<kind> for each base rule, base_sha256 (of the
    base rules' joined spans) and spans (all spans, joined)."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Scanner(rules))
    types = dict(docs.dtypes)
    base = [k for k, r in enumerate(rules) if r.base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = sent.value.batch(batch.column(len(keep)))
            counts = [pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in base]
            digest = [hashlib.sha256(joined([s for s in x if s[1] in base], rules).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *counts, pa.array(digest, pa.string()), pa.array([joined(x, rules) for x in found], pa.string())], names=names)

    names = [*keep, *[f"n_{rules[k].kind}" for k in base], "base_sha256", "spans"]
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], *[f"n_{rules[k].kind} long" for k in base], "base_sha256 string", "spans string"])
    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("_text_")).mapInArrow(run, schema)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
