"""Secret scans: all rules as one deterministic automaton, run over the bytes of every text.

The rules' expressions become one non-deterministic automaton, then by subset construction and
minimisation two deterministic ones in transition arrays: a searching one, which may start a match at
every byte, and an anchored one. The searching automaton passes once over the bytes, in many lanes side
by side; the anchored one then finds the exact ends of the few matches in the places that it reported.

A text that is NULL counts as empty. Empty texts have no spans. Offsets are code points. Repeated rows
are scanned each for itself, other columns are not looked at, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.common import blocks, offsets, raw, spans_type


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is how many characters its last group needs; a shorter match is dropped.

    An expression is made of literals, classes, groups, alternatives and greedy repeats, and must not
    begin with an unbounded repeat. Lengths belong in ``least``: a counted repeat after a prefix that can
    occur inside it needs a state for every set of counts. Its matches are the leftmost ones, as long as possible, without overlap.
    """

    kind: str
    pattern: str
    least: int = 0


#: The rules that every scan applies, in their order.
BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
    Rule("access", r"(AKIA[A-Z0-9]+)", 20),
    Rule("hex", r"([0-9a-f]{24,})"),
)
#: Published formats of keys and tokens that are secrets wherever they stand.
MORE = (
    Rule("private_key", r"-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH|ENCRYPTED|PGP) )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("code_host", r"gh[pousr]_([A-Za-z0-9]+)", 36),
    Rule("cloud_key", r"AIza([A-Za-z0-9_-]+)", 35),
    Rule("payment_key", r"[sr]k_(?:live|test)_([A-Za-z0-9]+)", 16),
)
RULES = BASE + MORE

FOLDED = (re.IGNORECASE, K.SRE_FLAG_IGNORECASE)


@dataclass
class Automaton:
    """Transition arrays. States are multiples of ``width``, so that state + class is an index; 0 is the start."""

    classes: np.ndarray  # byte -> class
    width: int
    moves: np.ndarray  # state + class -> state
    accepts: np.ndarray  # state / width -> bit per rule
    leads: np.ndarray  # state / width -> bit per rule that can still be reached


@dataclass
class _Graph:
    """The rules as one non-deterministic automaton. Byte sets are integers of 256 bits."""

    free: list[list[int]] = field(default_factory=list)
    steps: list[list[tuple[int, int]]] = field(default_factory=list)

    def node(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def add(self, tree, start: int, fold: bool) -> int:
        for op, value in tree:
            start = self.one(op, value, start, fold)
        return start

    def one(self, op, value, start: int, fold: bool) -> int:
        if op in (K.LITERAL, K.NOT_LITERAL, K.IN, K.ANY):
            end = self.node()
            self.steps[start].append((_bytes(op, value, fold), end))
            return end
        if op is K.SUBPATTERN:
            return self.add(value[3], start, fold or bool(value[1] & re.IGNORECASE))
        if op is K.BRANCH:
            end = self.node()
            for tree in value[1]:
                begin = self.node()
                self.free[start].append(begin)
                self.free[self.add(tree, begin, fold)].append(end)
            return end
        if op is K.MAX_REPEAT:
            low, high, tree = value
            for _ in range(low):
                start = self.add(tree, start, fold)
            if high == K.MAXREPEAT:
                loop = self.node()
                self.free[start].append(loop)
                self.free[self.add(tree, loop, fold)].append(loop)
                return loop
            end = self.node()
            self.free[start].append(end)
            for _ in range(high - low):
                start = self.add(tree, start, fold)
                self.free[start].append(end)
            return end
        raise ValueError(f"a rule may not use {op}")

    def closure(self, nodes) -> frozenset[int]:
        found, todo = set(nodes), list(nodes)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in found:
                    found.add(n)
                    todo.append(n)
        return frozenset(found)


def _bytes(op, value, fold: bool) -> int:
    if op is K.ANY:
        return sum(1 << b for b in range(1, 256) if b != 10)
    found, negated = set(), op is K.NOT_LITERAL
    for kind, x in value if op is K.IN else [(K.LITERAL, value)]:
        if kind is K.NEGATE:
            negated = True
        elif kind is K.LITERAL:
            found.add(x)
        elif kind is K.RANGE:
            found.update(range(x[0], x[1] + 1))
        else:
            raise ValueError(f"a rule may not use {kind}")
    if fold:
        found |= {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
    if not found or max(found) > 127 or 0 in found:
        raise ValueError("a rule names the ASCII characters from 1 to 127")
    return sum(1 << b for b in (set(range(1, 128)) - found if negated else found))


def _subsets(graph: _Graph, start: int, ends: dict[int, int], search: bool) -> Automaton:
    """The deterministic automaton of all rules; ``search`` may begin a match at every byte."""
    sets = sorted({s for steps in graph.steps for s, _ in steps})
    classes, kinds = np.zeros(256, np.uint8), {}
    for b in range(256):
        classes[b] = kinds.setdefault(tuple(s >> b & 1 for s in sets), len(kinds))
    member = [{s for s, bit in zip(sets, kind) if bit} for kind in kinds]
    first = graph.closure([start])
    states, rows = {first: 0}, []
    for now in iter_growing(states):
        moves = []
        for wanted in member:
            reached = {n for node in now for s, n in graph.steps[node] if s in wanted}
            after = graph.closure(reached | ({start} if search else set()))
            moves.append(states.setdefault(after, len(states)))
        rows.append(moves)
    table = np.array(rows, np.int64)
    accepts = np.array([sum(ends.get(n, 0) for n in {*s}) for s in states], np.int64)
    return _minimal(classes, table, accepts)


def iter_growing(states: dict) -> Iterator:
    """The keys of a dictionary that gets more of them meanwhile."""
    done = 0
    while done < len(states):
        for key in list(states)[done:]:
            done += 1
            yield key


def _minimal(classes: np.ndarray, table: np.ndarray, accepts: np.ndarray) -> Automaton:
    """States that no input tells apart become one: partition refinement until nothing splits."""
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    order = np.full(part.max() + 1, -1)
    order[part[0]] = 0
    rest = [p for p in range(part.max() + 1) if p != part[0]]
    order[rest] = np.arange(1, len(rest) + 1)
    new, width = order[part], table.shape[1]
    moves, bits = np.zeros((part.max() + 1, width), np.int64), np.zeros(part.max() + 1, np.int64)
    moves[new], bits[new] = new[table], accepts
    leads = bits.copy()
    while True:
        wider = leads | np.bitwise_or.reduce(leads[moves], axis=1)
        if (wider == leads).all():
            break
        leads = wider
    return Automaton(classes, width, (moves * width).astype(np.int32).reshape(-1), bits, leads)


@lru_cache(maxsize=8)
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, Automaton]:
    """The searching and the anchored automaton of the rules."""
    graph = _Graph()
    start, ends = graph.node(), {}
    for i, rule in enumerate(rules):
        begin = graph.node()
        graph.free[start].append(begin)
        ends[graph.add(_parser.parse(rule.pattern), begin, False)] = 1 << i
    return _subsets(graph, start, ends, True), _subsets(graph, start, ends, False)


def search(auto: Automaton, data: np.ndarray, lane: int = 512) -> np.ndarray:
    """The state after each byte. The bytes are cut into lanes that step together.

    Each lane begins in the start state; where the lane before it ends in another state it is run
    again from there until it agrees with what is known, which is nearly always a few bytes later.
    """
    lanes = max(1, -(-len(data) // lane))
    grid = np.zeros(lanes * lane, np.uint8)
    grid[: len(data)] = auto.classes[data]
    grid = np.ascontiguousarray(grid.reshape(lanes, lane).T)
    seen = np.empty((lane, lanes), np.int32)
    now = np.zeros(lanes, np.int32)
    for t in range(lane):
        now = auto.moves.take(now + grid[t])
        seen[t] = now
    todo = np.flatnonzero(seen[-1, :-1]) + 1
    while len(todo):
        now, live, ended = seen[-1, todo - 1], todo, []
        for t in range(lane):
            now = auto.moves.take(now + grid[t, live])
            differs = now != seen[t, live]
            now, live = now[differs], live[differs]
            if not len(live):
                break
            seen[t, live] = now
        else:
            ended = live + 1
        todo = np.array([x for x in ended if x < lanes], np.int64)
    return seen.T.reshape(-1)[: len(data)]


def matches(automata: tuple[Automaton, Automaton], data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes of all matches in a stream of texts that zero bytes set apart."""
    finder, anchored = automata
    many = int(anchored.leads[0]).bit_length()
    states = search(finder, data)
    hits = np.flatnonzero((finder.accepts != 0)[states // finder.width])
    moves, leads, accepts, width = anchored.moves.tolist(), anchored.leads.tolist(), anchored.accepts.tolist(), anchored.width
    found, done = [], 0
    for hit in hits.tolist():
        if hit < done:
            continue
        begin = hit
        while begin > done and states[begin - 1]:
            begin -= 1
        end = hit + 1
        while end < len(states) and states[end]:
            end += 1
        done = end
        kinds = anchored.classes[data[begin:end]].tolist()
        free = [0] * many
        for s in range(len(kinds)):
            allowed = sum(1 << r for r, f in enumerate(free) if f <= s)
            state, last = 0, {}
            for t in range(s, len(kinds)):
                state = moves[state + kinds[t]]
                if not leads[state // width] & allowed:
                    break
                if ok := accepts[state // width] & allowed:
                    for r in range(many):
                        if ok >> r & 1:
                            last[r] = t + 1
            for r, e in last.items():
                free[r] = e
                found.append((begin + s, r, begin + e))
    return sorted(found)


def _long_enough(rule: Rule) -> Callable[[bytes], bool]:
    if not rule.least:
        return lambda _: True
    whole = re.compile(rule.pattern.encode())
    return lambda text: len((m := whole.fullmatch(text))[m.re.groups]) >= rule.least


def _scan(rules: tuple[Rule, ...], automata: tuple[Automaton, Automaton], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    checks = [_long_enough(r) for r in rules]
    names = [r.kind for r in rules]
    for batch in blocks(batches, "text"):
        texts = batch.column("text")
        if texts.null_count:
            texts = texts.fill_null("")
        sizes = np.diff(offsets(texts))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.zeros(starts[-1], np.uint8)
        mask = np.ones(len(data), bool)
        mask[starts[1:] - 1] = False
        data[mask] = raw(texts)
        spans: list[list] = [[] for _ in sizes]
        lead = None
        for s, r, e in matches(automata, data):
            if not checks[r](data[s:e].tobytes()):
                continue
            doc = int(np.searchsorted(starts, s, "right")) - 1
            if lead is None or lead[0] != doc:
                own = data[starts[doc] : starts[doc] + sizes[doc]]
                lead = (doc, np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)]))
            points = lead[1]
            spans[doc].append({"kind": names[r], "start": int(points[s - starts[doc]]), "end": int(points[e - starts[doc]])})
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, SPANS)], ["id", "spans"])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns ``key`` and ``spans``, a row per row: the kind, start and end of each secret, by start and rule."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, spans {spans_type()}"
    automata = compiled(rules)  # compiled once, on the driver; a few hundred KB go to the tasks
    return rows.mapInArrow(lambda batches: _scan(rules, automata, batches), schema).withColumnRenamed("id", key)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Columns ``key`` and ``text``, with each secret replaced by its kind in brackets. Keys must be unique."""
    found = find_secrets(docs, key, text, rules).filter(F.size("spans") > 0)
    cut = F.aggregate(
        F.col("spans"),
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(
                F.concat(a["done"], F.substring(F.col("_text"), a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("done"),
                s["end"].alias("at"),
            )
        ),
    )
    joined = docs.select(F.col(key), F.col(text).alias("_text")).join(found, key, "left").withColumn("_cut", F.when(F.col("spans").isNotNull(), cut))
    return joined.select(key, F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(F.concat("_cut.done", F.expr("substring(_text, _cut.at + 1)"))).alias(text))
