"""Operator 8: secret scans with assignment-aware lexing.

Three base patterns mark assignments to fixed names, access key ids and hex runs.
Beyond them, a small lexer reads source and configuration syntax (``name = value``, ``name: value``,
``"name" => value``, typed declarations, ``+`` between parts) into pairs of a target name and
literals.  A target may be subscripted (``env["NAME"] =``, ``char name[] =``).  A value may stand in brackets, carry a
prefix (``b"..."``), be a list, a string or block of several lines, and go on over line ends after a sign, an opening
bracket, an operator or a backslash.  A value that is a name stands for the literals assigned to that name, so constants
propagate, forwards and backwards, to every name that ends up holding them.  A literal scores by
how sensitive its most sensitive target name is and by how much it looks like a secret.

A text is read by the lexer only if it holds both an assignment sign and part of a sensitive name;
no other text can yield a pair that scores.  Such a text is lexed as a whole, once.  What a multi-line string holds is
lexed like any other text too, so its inner pairs are found besides the string itself.

Limits: an unquoted value ends at white space; without a digit it counts only where it is no plain name (symbols inside,
letter case that changes like a random string's) or is the whole of a ``NAME=value`` line; arguments of calls are not values.

Edge cases: NULL text is empty and has no secrets (its redacted text stays NULL); repeated rows are scanned separately; an
empty table gives an empty result; other columns stay as they are.  Lexing is linear in a text's length.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwise.llm.common import id_text, ids_back, table
from pathwise.llm.registry import register

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
# maximal runs of at least the wanted length: the same matches as the plain runs, filtered
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
HEX_RUN = bytes(ord("x") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))

# How sensitive a part of a target name is (1: names a secret).
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 1.0, "pass": 0.9, "secret": 1.0,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "cred": 0.8, "creds": 0.8, "privatekey": 1.0,
    "accesskey": 0.9, "auth": 0.7, "bearer": 0.8, "key": 0.6,
}
FRAGMENTS = tuple(w.encode() for w in ("pass", "pwd", "secret", "token", "cred", "auth", "bearer", "key"))
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|<.*>|\$\{.*\}|\$\w+|%.*%|\{\{.*\}\}|(your|my|some|the)[-_ ].*|.*example.*|"
                         r"change-?me|none|null|true|false|undefined|placeholder|todo|required|optional|string)$")
MIN_LITERAL = 6
MIN_SCORE = 0.5

#: Tokens but strings; three quotes are one token, so that strings of several lines never hide what follows.
TOKEN = re.compile(r"""(?P<fence>\"{3}|'{3}|`{3})|(?P<newline>\n)"""
                   r"""|(?P<sign>=>|:=|==+|!=|<=|>=|=|:)|(?P<plus>\+)"""
                   r"""|(?P<bare>[A-Za-z0-9_$@%^&*!?~#/|+.-]+)|(?P<space>[ \t\r]+)|(?P<other>.)""", re.DOTALL)
INSIDE = {q: re.compile(rf"[^{q}\\\n]*(?:\\.[^{q}\\\n]*)*", re.DOTALL) for q in "\"'`"}
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*\Z")
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
ASSIGNS = {"=", ":=", "=>", ":"}
#: Operators between parts of a value, letters right before a quote, heads of YAML blocks, NAME=value lines.
JOINS = {"+", ".", "..", "&", "||", "??", "or"}
PREFIX = re.compile(r"[A-Za-z@$]{0,2}8?#*\Z")
BLOCK = re.compile(r"[ \t]*[|>][-+0-9]{0,2}[ \t]*(?:#[^\n]*)?\r?\n")
SETTING = re.compile(r"(?:export[ \t]+)?[A-Z][A-Z0-9_]*=\Z")
OPENING, CLOSING = set("([{"), set(")]}")


def name_weight(name: str) -> float:
    """Sensitivity of a target name: its heaviest part, or pair of neighbouring parts."""
    parts = [p.lower() for p in PART.findall(name)]
    pairs = [a + b for a, b in zip(parts, parts[1:])]
    return max((NAME_WEIGHTS.get(p, 0.0) for p in parts + pairs), default=0.0)


def looks_random(value: str) -> bool:
    """Whether an unquoted value is no plain name: it holds a digit, a symbol inside, or changes case like a random string."""
    if any(c.isdigit() for c in value) or any(c in "@%^&*!?~#|+" for c in value[1:-1].rstrip("?!")):
        return True
    parts = PART.findall(value)
    return len(parts) >= 4 and len(value) < 3 * len(parts)


def literal_weight(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret, 0 to 1: its bits of entropy against 48.

    One with white space weighs 0.8 at most: under a name that only may be a secret's (``key``) it is taken for prose.
    """
    if len(value) < MIN_LITERAL or PLACEHOLDER.match(value) or not quoted and not looks_random(value):
        return 0.0
    n = len(value)
    bits = -sum(c * math.log2(c / n) for c in Counter(value).values())
    return min(0.8 if any(c.isspace() for c in value) else 1.0, bits / 48 + 0.25)


def lex(text: str) -> list[tuple[str, str, int]]:
    """``(kind, text, start)`` of all tokens but spaces.  A quote that its line does not close is a token of its own."""
    tokens, at, dead = [], 0, dict.fromkeys(INSIDE, -1)  # no string of a quote closes before dead[quote]
    while at < len(text):
        c = text[at]
        if c in INSIDE and at >= dead[c] and not text.startswith(c * 3, at):
            end = INSIDE[c].match(text, at + 1).end()
            if end < len(text) and text[end] == c:
                tokens.append(("string", text[at:end + 1], at))
                at = end + 1
                continue
            dead[c] = end
        m = TOKEN.match(text, at)
        if m.lastgroup != "space":
            tokens.append((m.lastgroup, m[0], at))
        at = m.end()
    return tokens


class Pairs:
    """Reads a text's pairs ``(name, values)``; a value is ``(text, start, end, kind)``: quoted, bare (it may be a
    reference), plain (unquoted, all of a setting) or apart (unquoted, all of the line after its name or one of a list)."""

    def __init__(self, text: str):
        self.text, self.tokens, self.pairs = text, lex(text), []
        self.unclosed, self.block_end = set(), 0
        i = 0
        while i < len(self.tokens):
            i = self.read(i)

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if i < len(self.tokens) else ""

    def word(self, i: int) -> str:
        return self.tokens[i][1] if i < len(self.tokens) else ""

    def name(self, i: int) -> str:
        name = self.word(i)[1:-1] if self.kind(i) == "string" else self.word(i)
        return name if self.kind(i) in ("string", "bare") and NAME.match(name) else ""

    def sign(self, i: int) -> int:
        """The place of the assignment sign of a target at ``i``, else 0: ``name =``, ``name[] =``, ``name[x] =``, ``name] =``."""
        if not self.name(i):
            return 0
        for shape in ("", "]", "[]", "[x]"):
            if (all(x == "x" and self.kind(j) in ("string", "bare") or x == self.word(j) for j, x in enumerate(shape, i + 1))
                    and self.word(i + 1 + len(shape)) in ASSIGNS):
                return i + 1 + len(shape)
        return 0

    def prefix(self, i: int) -> bool:
        """Whether a string's prefix stands at ``i``."""
        return bool(PREFIX.match(self.word(i))) and self.kind(i + 1) in ("string", "fence") and (
            self.tokens[i + 1][2] == self.tokens[i][2] + len(self.word(i)))

    def skip(self, i: int) -> int:
        while self.kind(i) == "newline":
            i += 1
        return i

    def read(self, i: int) -> int:
        """Take the pair that starts at token ``i``, if any, and give the place to go on."""
        sign = self.sign(i)
        if not sign:
            return i + 1
        names, j = [self.name(i)], sign + 1
        if sign == i + 4 and self.name(i + 2):  # config["name"] = value: either name may be the telling one
            names.append(self.name(i + 2))
        if self.word(sign) == ":" and self.kind(j) == "bare" and self.word(j + 1) == "=":  # name: type = value
            sign, j = j + 1, j + 2
        values, j = self.block(i, sign) or self.values(i, sign, j)
        self.pairs += [(n, values) for n in names if values]
        # a bare value may itself be the next target: name = other = "x"
        return j - 1 if values and values[-1][2] > self.tokens[sign][2] and self.word(j) in ASSIGNS else max(j, sign + 1)

    def block(self, i: int, sign: int):
        """A YAML block: the deeper lines after ``name: |``.  Its inside is lexed as well."""
        start = self.tokens[sign][2] + 1
        head = BLOCK.match(self.text, start) if self.word(sign) == ":" and start >= self.block_end else None
        if not head:
            return None
        indent = lambda line: len(line) - len(line.lstrip(" \t"))
        first = self.text.rfind("\n", 0, self.tokens[i][2]) + 1
        outer, at = indent(self.text[first:self.tokens[i][2] + 1]), head.end()
        while at < len(self.text):
            stop = (self.text.find("\n", at) + 1) or len(self.text)
            line = self.text[at:stop]
            if line.strip() and indent(line) <= outer:
                break
            at = stop
        self.block_end = at
        return self.whole(head.end(), at), sign + 1

    def whole(self, start: int, end: int) -> list:
        """The text from ``start`` to ``end`` without outer white space as one quoted value."""
        inside = self.text[start:end]
        start += len(inside) - len(inside.lstrip())
        inside = inside.strip()
        return [(inside, start, start + len(inside), "quoted")] if inside else []

    def closed(self, quote: str, start: int) -> int:
        """Where the quote that opened before ``start`` closes, -1 if nowhere."""
        end = -1 if quote in self.unclosed else self.text.find(quote, start)
        while end > 0 and self.text[end - 1] == "\\" and (end - len(self.text[start:end].rstrip("\\")) - start) % 2:
            end = self.text.find(quote, end + 1)
        if end < 0:
            self.unclosed.add(quote)
        return end

    def values(self, i: int, sign: int, j: int) -> tuple[list, int]:
        """The values from token ``j`` on, and the place after them."""
        values, depth, listed, wanted = [], 0, False, True  # wanted: a value may come; else only what joins or closes
        while j < len(self.tokens):
            kind, text, at = self.tokens[j]
            if kind == "newline":
                after = self.skip(j)
                if not (wanted or depth or self.word(after) == "+"):
                    break
                if not depth and (self.sign(after) or self.kind(after) == "fence" and self.word(sign) == ":"):
                    break  # a target, or the description of what the line before begins
                if not depth and not values and self.kind(after) == "bare" and self.kind(after + 1) in ("newline", ""):
                    _, text, at = self.tokens[after]
                    if at > self.tokens[after - 1][2] + 1:  # indented, as in YAML
                        values.append((text, at, at + len(text), "apart"))
                    return values, after
                if not depth and not values and self.kind(after) == "bare" and not self.prefix(after):
                    break
                j = after
            elif text == "\\" and self.kind(j + 1) == "newline":
                j += 2
            elif kind == "fence" or text == "`":  # a string of several lines: taken whole, its inside is lexed as well
                end = self.closed(text, at + len(text)) if wanted else -1
                return values + (self.whole(at + len(text), end) if end >= 0 else []), j + 1
            elif kind == "string":
                if depth and (self.word(j + 1) in ASSIGNS) or not (wanted or self.kind(j - 1) in ("string", "newline")):
                    break
                values.append((text[1:-1], at + 1, at + len(text) - 1, "quoted"))
                wanted, j = False, j + 1
            elif text in JOINS and values and not wanted:
                wanted, j = True, j + 1
            elif kind == "bare" and wanted:
                if self.prefix(j):
                    j += 1
                    continue
                if depth and (self.word(j + 1) in ASSIGNS):
                    break
                values.append((text, at, at + len(text), "plain" if self.setting(i, sign, j) else "bare"))
                wanted, j = False, j + 1
            elif text in OPENING and wanted:
                depth, j = depth + 1, j + 1
            elif text in CLOSING and depth:
                depth, wanted, j = depth - 1, False, j + 1
            elif text in (",", ";") and depth and not wanted:
                wanted, listed, j = True, True, j + 1
            else:
                break
        if listed or depth:  # a list, or an expression that goes on
            values = [(*v, "apart" if kind == "bare" else kind) for *v, kind in values]
        return values, j

    def setting(self, i: int, sign: int, j: int) -> bool:
        """Whether ``NAME=value`` at token ``j`` fills its line, as in environment files."""
        _, text, at = self.tokens[j]
        if sign != i + 1 or j != sign + 1 or self.kind(j + 1) not in ("newline", "") or at != self.tokens[sign][2] + 1:
            return False
        k = i - 1 if self.word(i - 1) == "export" and i else i
        return (not k or self.kind(k - 1) == "newline") and bool(SETTING.match(self.text, self.tokens[k][2], at))


def literal_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive target name."""
    pairs = Pairs(text).pairs
    takes: dict[str, list[str]] = {}  # a target name -> the names it takes its value from
    for name, values in pairs:
        takes.setdefault(name, []).extend(v for v, _, _, kind in values if kind in ("bare", "plain"))
    # a constant weighs as much as the most sensitive name that it flows to: heaviest names first, each name is
    # reached once
    weights: dict[str, float] = {}
    for target in sorted(takes, key=name_weight, reverse=True):
        todo, weight = [target], name_weight(target)
        while todo:
            name = todo.pop()
            if name in takes and name not in weights:
                weights[name] = weight
                todo.extend(takes[name])
    spans = []
    for name, values in pairs:
        for value, start, end, kind in values:
            if kind in ("bare", "plain") and value in takes:
                continue  # a reference: its literals carry the names
            if weights[name] * literal_weight(value, kind in ("quoted", "plain")) >= MIN_SCORE:
                spans.append((start, end))
    return spans


def find_secrets(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, end, kind, value start)`` of all secrets, in code points, by start, then kind."""
    raw = text.encode()
    low = raw.lower()
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text)]
    if b"x" * 24 in raw.translate(HEX_RUN):
        found += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    if (b"=" in raw or b":" in raw) and any(w in low for w in FRAGMENTS):
        starts, reach = [], []  # base spans by start, with the furthest end so far
        for s, e in sorted((s, e) for s, e, _, _ in found):
            starts.append(s)
            reach.append(max(e, reach[-1] if reach else 0))
        for s, e in literal_spans(text):
            before = bisect_right(starts, s)
            if not before or reach[before - 1] < e:  # not inside a base span
                found.append((s, e, "literal", s))
    return sorted(set(found), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every secret value replaced by ``mark``."""
    out, at = [], 0
    for start, end in sorted((v, e) for _, e, _, v in find_secrets(text)):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_literal, base_sha256, spans`` of every document."""

    def run(frames):
        for frame in frames:
            rows = []
            for text in frame["text"]:
                found = find_secrets(text)
                n = Counter(k for _, _, k, _ in found)
                base = ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found if k != "literal")
                rows.append((n["assign"], n["access"], n["hex"], n["literal"], hashlib.sha256(base.encode()).hexdigest(),
                             ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"])
            out.insert(0, "doc_id", frame["doc_id"].values)
            yield out

    rows = docs.select(id_text("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ids_back(rows.mapInPandas(run, "doc_id string, n_assign long, n_access long, n_hex long, n_literal long, "
                                          "base_sha256 string, spans string"), "doc_id")


def redacted(text):
    """Column: the text with its secret values masked."""
    mask = F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else redact(t)), "string")
    return mask(text)


@register("op8_secret_scan")
def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Operator 8 over all documents."""
    return scan(table(spark, sf_dir, "documents"))
