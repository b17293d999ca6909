"""Secret scan by one combined deterministic automaton.

Rule regexes are parsed to syntax trees, joined into one NFA with an unanchored start, turned into a DFA
by subset construction over byte classes, minimised by partition refinement, and laid out as one flat
transition list whose accepting states come last. Each text is read once, byte by byte, for all rules.
An accepting step names the rules that may end there; the rule's own small automata then give the span:
backwards to the leftmost start, forwards to the longest end. Per rule, spans are leftmost and do not
overlap; a match that is too short still uses up its text.

Edge cases: null and empty texts have no span; offsets count code points, ends are exclusive; spans are
sorted by start, then by the order of RULES, so ties are stable; repeated rows get equal results; null doc_ids stay
null; texts of any length are scanned whole, in time and memory that grow with them; an empty table gives no rows; other
columns are not read, so names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches

# A private key runs to its END line: base64 lines, PEM headers, line breaks also as written in JSON. Without an END
# line it runs over the full base64 lines. A body has no two hyphens in a row, so it can't go on into the next key.
KEY_BEGIN, KEY_END = r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----END [A-Z ]*PRIVATE KEY-----"
KEY_BODY, KEY_BREAK = r"([A-Za-z0-9+/=:,.\\\x20\x09\x0a\x0d]|-[A-Za-z0-9])", r"(\x0d?\x0a|\\n)"

# (kind, regex, least length of the counted tail, bytes of that tail). The first three kinds are the base.
RULES: list[tuple[str, str, int, str]] = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, "value"),
    ("access", r"AKIA[A-Z0-9]+", 16, ""),
    ("hex", r"[0-9a-f]{32,}", 32, ""),
    ("private_key", KEY_BEGIN + f"({KEY_BODY}*{KEY_END}|({KEY_BREAK}[A-Za-z0-9+/=]{{40,}})*)", 0, ""),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, ""),
    ("forge_token", r"gh[oprsu]_[A-Za-z0-9]+", 40, ""),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 15, ""),
    ("url_login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._~-]+@", 0, ""),
]
BASE = ("assign", "access", "hex")


class Nfa:
    """Thompson construction for literals, classes, groups, alternation, ``? * +`` and ``{m,n}``."""

    def __init__(self) -> None:
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def node(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def build(self, tree: tuple, start: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.node()
            mid = self.node()
            self.eps[start].append(mid)
            self.step[mid] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.build(part, start)
            return start
        if kind == "alt":
            end = self.node()
            for part in tree[1]:
                at = self.node()
                self.eps[start].append(at)
                self.eps[self.build(part, at)].append(end)
            return end
        _, inner, low, high = tree
        for _ in range(low):
            start = self.build(inner, start)
        end = self.node()
        if high is None:
            loop = self.node()
            self.eps[start].append(loop)
            self.eps[self.build(inner, loop)].append(loop)
            self.eps[loop].append(end)
        else:
            for _ in range(high - low):
                self.eps[start].append(end)
                start = self.build(inner, start)
            self.eps[start].append(end)
        return end

    def closure(self, nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.eps[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(n for n in seen if self.step[n] or not self.eps[n])


def parse(pattern: str) -> tuple:
    """The syntax tree of a byte regex."""
    at = 0

    def escape() -> int:
        nonlocal at
        at += 1
        if pattern[at] == "x":
            at += 3
            return int(pattern[at - 2 : at], 16)
        at += 1
        return ord(pattern[at - 1])

    def one() -> int:
        nonlocal at
        if pattern[at] == "\\":
            return escape()
        at += 1
        return ord(pattern[at - 1])

    def atom() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inner = alt()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            found: set[int] = set()
            while pattern[at] != "]":
                low = one()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    found |= set(range(low, one() + 1))
                else:
                    found.add(low)
            at += 1
            return ("set", frozenset(found))
        return ("set", frozenset([one()]))

    def repeat() -> tuple:
        nonlocal at
        tree = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            if pattern[at] == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at + 1 : end].partition(",")
                tree = ("rep", tree, int(low), int(high) if high else None if comma else int(low))
                at = end + 1
            else:
                tree = ("rep", tree, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]])
                at += 1
        return tree

    def cat() -> tuple:
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeat())
        return ("cat", parts)

    def alt() -> tuple:
        nonlocal at
        parts = [cat()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(cat())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    return alt()


def turned(tree: tuple) -> tuple:
    """The tree of the reversed language."""
    if tree[0] == "cat":
        return ("cat", [turned(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [turned(x) for x in tree[1]])
    return tree if tree[0] == "set" else ("rep", turned(tree[1]), *tree[2:])


def _subsets(begin: list[int], moves: list[list], accept: dict[int, int], always: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction and minimisation. ``moves[node][class]`` are nodes; ``accept[node]`` is a rule.

    The result's state 0 is the start and its accepting states come last.
    """
    start = frozenset(begin)
    again = start if always else frozenset()
    index, todo, rows = {start: 0}, [start], []
    for state in todo:  # grows while it is read
        row = []
        for c in range(len(moves[0])):
            new = again.union(*(moves[n][c] for n in state))
            if new not in index:
                index[new] = len(index)
                todo.append(new)
            row.append(index[new])
        rows.append(row)
    table = np.array(rows)
    masks = np.array([sum({1 << accept[n] for n in s if n in accept}) for s in index])
    part = np.unique(masks, return_inverse=True)[1].ravel()
    while True:  # split blocks until the states of each go to the same blocks
        new = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    first = np.array([int(np.flatnonzero(part == p)[0]) for p in range(part.max() + 1)])
    order = sorted(range(len(first)), key=lambda p: (masks[first[p]] != 0, p != part[0], p))
    where = np.empty(len(order), int)
    where[order] = np.arange(len(order))
    return where[part[table[first[order]]]], masks[first[order]]


def automaton(tree: tuple) -> tuple[np.ndarray, list[bool]]:
    """The minimal anchored automaton of one rule over bytes, and which of its states accept."""
    nfa = Nfa()
    root = nfa.node()
    end = nfa.build(tree, root)
    sets = list({s[0] for s in nfa.step if s})
    kinds: dict[tuple, int] = {}  # bytes that no set tells apart are one class
    cls = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
    member = [cls.index(c) for c in range(len(kinds))]
    moves = [[nfa.closure([s[1]]) if s and b in s[0] else () for b in member] for s in nfa.step]
    table, masks = _subsets(list(nfa.closure([root])), moves, {end: 0}, False)
    return table[:, cls], [bool(m) for m in masks]


def combined(rules: list[tuple[np.ndarray, list[bool]]]) -> tuple[np.ndarray, np.ndarray]:
    """One automaton that finds where the shortest match of any rule ends, begun at any byte.

    A rule's own automaton stops at its first accepting state here; how far a match goes on is asked of
    the rule alone, so that repeats at the ends of rules don't multiply each other's states.
    """
    begins = np.cumsum([0, *(len(t) for t, _ in rules)])
    columns = np.concatenate([t for t, _ in rules])
    cls, member = {}, []
    for b in range(256):
        key = columns[:, b].tobytes()
        if key not in cls:
            cls[key] = len(member)
            member.append(b)
    of = [cls[columns[:, b].tobytes()] for b in range(256)]
    moves: list[list] = []
    accept: dict[int, int] = {}
    for r, (table, good) in enumerate(rules):
        dead = _dead(table.tolist(), good)
        for s in range(len(table)):
            if good[s]:
                accept[int(begins[r]) + s] = r
            moves.append([() if good[s] or table[s, b] == dead else (int(begins[r] + table[s, b]),) for b in member])
    table, masks = _subsets([int(x) for x in begins[:-1]], moves, accept, True)
    return table[:, of], masks


def compiled(rules: list[tuple[str, str, int, str]] = RULES) -> dict:
    """Everything a scan needs, as plain lists."""
    trees = [parse(r[1]) for r in rules]
    ahead = [automaton(t) for t in trees]
    back = [automaton(turned(t)) for t in trees]
    table, masks = combined(ahead)
    first = int(np.argmax(masks != 0))
    own = [(a.tolist(), good, b.tolist(), ready) for (a, good), (b, ready) in zip(ahead, back, strict=True)]
    rules_of = [[i for i in range(len(rules)) if m >> i & 1] for m in masks]
    return {"flat": (table * 256).ravel().tolist(), "limit": first * 256, "rules_of": rules_of, "own": own, "rules": [(r[0], r[2], r[3]) for r in rules], "states": len(masks)}


def _longest(data: bytes, at: int, stop: int, step: int, table: list, good: list) -> int | None:
    """Walk an anchored automaton from ``at`` while it can go on; the last accepting place."""
    state, found, dead = 0, None, _dead(table, good)
    while at != stop:
        state = table[state][data[at if step > 0 else at - 1]]
        if state == dead:
            break
        at += step
        if good[state]:
            found = at
    return found


def _dead(table: list, good: list) -> int:
    return next((s for s, row in enumerate(table) if not good[s] and row.count(s) == 256), -1)


def scan(data: bytes, c: dict) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, sorted."""
    flat, limit, found, free = c["flat"], c["limit"], [], {}
    s = 0
    for i, b in enumerate(data):
        s = flat[s + b]
        if s >= limit:
            for r in c["rules_of"][s >> 8]:
                after = free.get(r, 0)
                if i < after:
                    continue
                ahead, good, back, ready = c["own"][r]
                start = _longest(data, i + 1, after, -1, back, ready)
                if start is None:
                    continue
                end = _longest(data, start, len(data), 1, ahead, good)
                free[r] = end
                _, least, tail = c["rules"][r]
                size = end - start
                if tail:  # the value is the last run after the first separator
                    k = start
                    while data[k] not in b":=":
                        k += 1
                    k += 1
                    while data[k] == 32:
                        k += 1
                    size = end - k - (data[k] in b"\"'")
                if size >= least:
                    found.append((start, r, end))
    return sorted(found)


def code_points(data: bytes, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if len(data) == len(text):
        return spans
    return [(len(data[:s].decode("utf-8", "replace")), r, len(data[:e].decode("utf-8", "replace"))) for s, r, e in spans]


def spans_of(text: str | None, c: dict) -> list[tuple[int, int, int]]:
    """(start, rule index, end) of a text, in code points."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return code_points(data, text or "", scan(data, c))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> and base digests for every row of ``docs``."""
    made = compiled()

    def make():
        kinds = [r[0] for r in made["rules"]]
        base = [k in BASE for k in kinds]

        def work(x: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_extra")}
            for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
                spans = spans_of(text, made)
                n = [0] * len(kinds)
                for _, r, _ in spans:
                    n[r] += 1
                said = [f"{kinds[r]}:{s}:{e}" for s, r, e in spans]
                out["doc_id"].append(doc_id)
                for k in range(3):
                    out[("n_assign", "n_access", "n_hex")[k]].append(n[k])
                out["base_sha256"].append(hashlib.sha256(",".join(t for t, sp in zip(said, spans, strict=True) if base[sp[1]]).encode()).hexdigest())
                out["spans"].append(",".join(said))
                out["n_extra"].append(sum(n[3:]))
            return out

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_extra long")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]`` (overlaps merged, first kind named) and n_chars kept true."""
    made = compiled()
    cols = ["doc_id", "text", "lang", "source", "n_chars"]

    def make():
        kinds = [r[0] for r in made["rules"]]

        def work(x: dict) -> dict:
            texts = []
            for text in x["text"]:
                merged: list[list] = []
                for s, r, e in spans_of(text, made):
                    if merged and s < merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e, kinds[r]])
                if merged:
                    at, parts = 0, []
                    for s, e, kind in merged:
                        parts += [text[at:s], f"[{kind}]"]
                        at = e
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            return x | {"text": texts, "n_chars": [n if t is None else len(t) for t, n in zip(texts, x["n_chars"], strict=True)]}

        return work

    return map_batches(docs.select(*cols), make, "doc_id long, text string, lang string, source string, n_chars long")
