"""Secret scan by one combined deterministic automaton over bytes.

All rule expressions become one nondeterministic automaton that may start a match at
every byte; subset construction and partition refinement turn it into a minimal
transition array (state x byte class), whose accepting states carry a bit per rule.
Every text is read once, byte by byte, for all rules together. Many text segments
advance in step, one array gather a byte: a byte after which every state is the same
(white space, say) forgets the past, so texts may be cut behind such bytes without losing
a match. Where a rule's bit shows up, the rule's reversed automaton finds the start
and its forward automaton the end of the match: leftmost, longest, not overlapping
within a rule.

A rule's expression may use literals, escapes, classes, groups, ``|`` and the greedy
quantifiers, and means bytes; with ``ignore_case`` A-Z equal a-z. Within one rule no
match may contain a shorter match that starts later and ends earlier (true of rules
that end in a run of one class). A match's tail is what follows the first place where
it could have ended, that place's byte included. Matches with a tail shorter than
``min_tail`` are dropped, and what they cover stays consumed. Minimum lengths are
lengths of tails rather than ``{n,}`` in the expression: counters of several rules would
multiply the states. ``whole_runs`` says that a rule's matches never share a run of
accepting bytes, so that short runs can be passed over in bulk."""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as X

SEGMENT = 256
FEW = 64           # so few segments are read one at a time


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    ignore_case: bool = False
    min_tail: int = 0
    whole_runs: bool = False


#: Fixed values of the base rules: 6 value characters, 20 and 24 characters in all.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 6),
    Rule("access", r"AKIA[A-Z0-9]+", min_tail=16, whole_runs=True),
    Rule("hex", r"[0-9a-f]+", min_tail=24, whole_runs=True),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", min_tail=36, whole_runs=True),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", min_tail=10, whole_runs=True),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )?PRIVATE KEY( BLOCK)?-----"),
)


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v"}
_ANY = frozenset(range(256))


def parse_rule(regex: str) -> list:
    """A rule's expression as nested lists: byte sets, ``("or", sequences)`` and ``("rep", low,
    high, sequence)`` with high None for no limit. Anything else raises ValueError."""
    at = 0

    def escaped() -> int:
        nonlocal at
        c = regex[at]
        at += 1
        if c == "x":
            at += 2
            return int(regex[at - 2:at], 16)
        if c.isalnum() and c not in _ESCAPES:
            raise ValueError(f"not supported in a rule: \\{c}")
        return ord(_ESCAPES.get(c, c))

    def byte() -> int:
        nonlocal at
        at += 1
        value = escaped() if regex[at - 1] == "\\" else ord(regex[at - 1])
        if value > 255:
            raise ValueError("rules are expressions over bytes")
        return value

    def chars() -> frozenset[int]:
        nonlocal at
        negated = regex[at] == "^"
        at += negated
        found: set[int] = set()
        first = at
        while regex[at] != "]" or at == first:
            low = high = byte()
            if regex[at] == "-" and regex[at + 1] != "]":
                at += 1
                high = byte()
            found |= set(range(low, high + 1))
        at += 1
        return _ANY - found if negated else frozenset(found)

    def sequence() -> list:
        nonlocal at
        options, now = [], []
        while at < len(regex) and regex[at] != ")":
            c = regex[at]
            if c == "|":
                at += 1
                options.append(now)
                now = []
                continue
            if c == "(":
                at += 3 if regex.startswith("(?:", at) else 1
                if regex[at] == "?":
                    raise ValueError("not supported in a rule: (?")
                item = sequence()
                if at >= len(regex):
                    raise ValueError("a group without an end")
                at += 1
            elif c == "[":
                at += 1
                item = [chars()]
            elif c == ".":
                at += 1
                item = [_ANY - {10}]
            elif c in "^$*+?{":
                raise ValueError(f"not supported in a rule: {c} at {at}")
            else:
                item = [frozenset({byte()})]
            if at < len(regex) and regex[at] in "*+?{":
                c, at = regex[at], at + 1
                if c == "{":
                    end = regex.index("}", at)
                    low, comma, high = regex[at:end].partition(",")
                    at = end + 1
                    low, high = int(low or 0), (int(high) if high else None) if comma else int(low)
                else:
                    low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
                if at < len(regex) and regex[at] in "?+":
                    raise ValueError("only greedy quantifiers are supported in a rule")
                item = [("rep", low, high, item)]
            now += item
        return [("or", [*options, now])] if options else now

    tree = sequence()
    if at < len(regex):
        raise ValueError("a group's end without a start")
    return tree


class _Nfa:
    """Fragments with byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def build(self, tree: list, at: int, fold: bool, back: bool) -> int:
        """Add the tree's language from state ``at``; gives the last state."""
        for item in (reversed(tree) if back else tree):
            if isinstance(item, frozenset):
                after = self.state()
                self.edges[at].append((_folded(item) if fold else item, after))
                at = after
            elif item[0] == "or":
                end = self.state()
                for option in item[1]:
                    first = self.state()
                    self.empty[at].append(first)
                    self.empty[self.build(option, first, fold, back)].append(end)
                at = end
            else:
                _, low, high, body = item
                for _ in range(low):
                    at = self.build(body, at, fold, back)
                if high is None:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.build(body, loop, fold, back)].append(loop)
                    at = loop
                else:
                    stops = [at]
                    for _ in range(high - low):
                        at = self.build(body, at, fold, back)
                        stops.append(at)
                    for s in stops[:-1]:
                        self.empty[s].append(at)
        return at


def _folded(chars: frozenset[int]) -> frozenset[int]:
    return chars | {b ^ 32 for b in chars if 65 <= b <= 90 or 97 <= b <= 122}


@dataclass
class Dfa:
    """``table[state, byte]`` and the rule bits of each state; state 0 starts, ``dead`` has
    no way to a match (or is -1)."""
    table: np.ndarray
    accept: np.ndarray
    dead: int

    def rows(self) -> list[list[int]]:
        return self.table.tolist()


def compile_rules(rules: tuple[Rule, ...], anchored: bool = False, back: bool = False) -> Dfa:
    """Subset construction over byte classes, then partition refinement."""
    nfa = _Nfa()
    root = nfa.state()
    final: dict[int, int] = {}
    for bit, rule in enumerate(rules):
        first = nfa.state()
        nfa.empty[root].append(first)
        final[nfa.build(parse_rule(rule.regex), first, rule.ignore_case, back)] = 1 << bit
    if not anchored:
        nfa.edges[root].append((frozenset(range(256)), root))

    # bytes that every edge treats alike form a class
    sets = sorted({s for e in nfa.edges for s, _ in e}, key=sorted)
    sign = [tuple(b in s for s in sets) for b in range(256)]
    classes = {s: i for i, s in enumerate(dict.fromkeys(sign))}
    of_byte = np.array([classes[s] for s in sign])
    sample = [sign.index(s) for s in classes]

    def closure(states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)

    start = closure([root])
    number, order, moves = {start: 0}, [start], []
    for now in order:
        row = []
        for b in sample:
            nxt = closure({t for s in now for chars, t in nfa.edges[s] if b in chars})
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        moves.append(row)
    table = np.array(moves)
    accept = np.array([sum({final[s] for s in now if s in final}) for now in order])

    _, block = np.unique(accept, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)          # one member of each block
    rank = np.empty(len(first), int)
    rank[block[np.sort(first)]] = np.arange(len(first))     # blocks in order of first member: start is 0
    member = np.sort(first)
    table, accept = rank[block[table[member]]], accept[member]
    dead = [s for s in range(len(table)) if (table[s] == s).all() and not accept[s]]
    return Dfa(table[:, of_byte].astype(np.int32), accept.astype(np.int64), dead[0] if dead else -1)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = compile_rules(rules)
        self.rows = self.all.rows()
        self.flat = (self.all.table * 256).astype(np.int32).ravel()       # next state, times 256
        self.resets = (self.all.table == self.all.table[:1]).all(axis=0)   # bytes that forget the past
        self.forgets = self.resets.tolist()
        self.forward = [compile_rules((r,), anchored=True) for r in rules]
        self.backward = [compile_rules((r,), anchored=True, back=True) for r in rules]
        self.fresh = [(d.rows(), d.accept.tolist()) for d in (compile_rules((r,)) for r in rules)]
        self.steps = [(f.rows(), f.accept.tolist(), f.dead) for f in self.forward]
        self.back_steps = [(f.rows(), f.accept.tolist(), f.dead) for f in self.backward]

    def states(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The automaton's state after each byte; it starts anew at each text."""
        n = len(buf)
        out = np.zeros(n, np.int32)
        if not n:
            return out
        cuts = np.flatnonzero(self.resets[buf]) + 1
        cuts = cuts[np.unique(np.minimum(np.searchsorted(cuts, np.arange(0, n, SEGMENT)), max(len(cuts) - 1, 0)))] if len(cuts) else cuts
        begin = np.unique(np.concatenate([off[:-1], cuts]))
        begin = begin[begin < n]
        length = np.diff(np.append(begin, n))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        now = np.where(np.isin(begin, off), 0, self.flat[buf[begin - 1]])  # 0, or the state a reset byte leads to
        active, falling = len(begin), -length
        for i in range(int(length[0])):
            active = int(np.searchsorted(falling, -i, side="left"))
            if active <= FEW:                    # the last long segments, one at a time
                for b, e, s in zip((begin[:active] + i).tolist(), (begin + length)[:active].tolist(), (now[:active] >> 8).tolist()):
                    run = []
                    for c in buf[b:e].tobytes():
                        s = self.rows[s][c]
                        run.append(s)
                    out[b:e] = np.array(run, np.int32) << 8
                break
            at = begin[:active] + i
            now = self.flat[now[:active] + buf[at]]
            out[at] = now
        return out >> 8

    def _start(self, rule: int, data: bytes, last: int, least: int) -> int:
        rows, accept, dead = self.back_steps[rule]
        s, best = 0, -1
        for i in range(last, least - 1, -1):
            s = rows[s][data[i]]
            if s == dead:
                break
            if accept[s]:
                best = i
        return best

    def _end(self, rule: int, data: bytes, first: int) -> int:
        rows, accept, dead = self.steps[rule]
        s, best = 0, -1
        for i in range(first, len(data)):
            s = rows[s][data[i]]
            if s == dead:
                break
            if accept[s]:
                best = i + 1
        return best

    def _fresh(self, rule: int, data: bytes, first: int) -> tuple[int, bool]:
        """Read on from ``first`` as if the text began there: (the first place where a match
        ends, True), or (the place behind a byte that forgets the past, False)."""
        rows, accept = self.fresh[rule]
        s = 0
        for i in range(first, len(data)):
            s = rows[s][data[i]]
            if accept[s]:
                return i, True
            if self.forgets[data[i]]:
                return i + 1, False
        return len(data), False

    def spans(self, buf: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """text -> (start byte, rule, end byte), by start and then rule."""
        bits = self.all.accept.astype(np.uint32)[self.states(buf, off)]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r, rule in enumerate(self.rules):
            at = np.flatnonzero(bits & np.uint32(1 << r))
            if rule.whole_runs and len(at):
                first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | np.isin(at[1:], off)]))
                size = np.diff(np.append(first, len(at)))
                at = at[first[size >= rule.min_tail]]
            owner = np.searchsorted(off, at, side="right") - 1
            edge = (np.flatnonzero(np.diff(owner)) + 1).tolist()
            for lo, hi in zip([0, *edge], [*edge, len(at)]) if len(at) else ():
                d = int(owner[lo])
                data, places = buf[off[d]:off[d + 1]].tobytes(), (at[lo:hi] - off[d]).tolist()
                # places before ``known`` may belong to a match that begins inside the last one:
                # the text is read again from its end ``done`` on, each byte once
                i = done = known = 0
                while i < len(places):
                    end = places[i]
                    if not rule.whole_runs and end < known:
                        end, hit = self._fresh(r, data, done)
                        if not hit:
                            known = end
                            i = bisect_left(places, end, i)
                            continue
                    start = self._start(r, data, end, done)
                    if start < 0:
                        i += 1
                        continue
                    done = self._end(r, data, start)
                    known = len(data)
                    if done - end >= rule.min_tail:
                        found.setdefault(d, []).append((start, r, done))
                    i = bisect_left(places, done, i)
        return {d: sorted(each) for d, each in found.items()}


SPANS = "array<struct<kind:string,start:long,end:long>>"


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte offset of a UTF-8 text."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text_col: str = "text",
         redact: str | None = None, out: str = "spans") -> DataFrame:
    """The input with ``out``: spans (kind, start, end) by start, then rule order; code
    points, end exclusive. With ``redact`` the text is rewritten, each run of overlapping
    spans replaced by that string. Null texts have no spans and stay null; spans are
    empty, never null. A column already named ``out`` is replaced."""
    scanner = Scanner(rules)
    rest = [c for c in docs.columns if c != out]
    d = docs.select(*[F.col(f"`{c}`") for c in rest])
    place = rest.index(text_col)
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(d.schema.fields))
    plain = d.toDF(*[f"c{i}" for i in range(len(rest))])
    col = f"c{place}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch, col):
                texts = part.column(col)
                buf, off = X.text_buffer(texts)
                found = scanner.spans(buf, off)
                spans, new = [[]] * len(texts), None
                changed: dict[int, str] = {}
                for i, each in found.items():
                    data = buf[off[i]:off[i + 1]]
                    cp = _points(data)
                    spans[i] = [{"kind": rules[r].kind, "start": int(cp[s]), "end": int(cp[e])} for s, r, e in each]
                    if redact is not None:
                        raw, pieces, until = data.tobytes(), [], 0
                        for s, _, e in each:
                            if s >= until:
                                pieces += [raw[until:s], redact.encode()]
                            until = max(until, e)
                        changed[i] = b"".join([*pieces, raw[until:]]).decode("utf-8", "replace")
                if changed:
                    new = texts.to_pylist()
                    for i, v in changed.items():
                        new[i] = v
                cols = list(part.columns)
                if new is not None:
                    cols[place] = pa.array(new, texts.type)
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], names=[*part.schema.names, "spans"])

    done = plain.mapInArrow(run, f"{schema}, spans {SPANS}")
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("spans").alias(out))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all rules)."""
    found = scan(docs.select("doc_id", "text"))
    base = [r.kind for r in BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = span_text(F.filter("spans", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *[count(k) for k in base], F.sha2(own.cast("binary"), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))
