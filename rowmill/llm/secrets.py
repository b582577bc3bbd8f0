"""Secrets: patterns, and assignment-aware lexing of source and configuration text.

A lexer knows strings with escapes, triple quotes, backticks, YAML blocks, tags, names and signs. Assignments of many syntaxes become
name-literal pairs, parts of sums of strings and names together. Constants are propagated in the order of the text: a name that is assigned
another name stands for the literal that this one was last assigned before, however long the chain. A literal is scored by the most
sensitive name that reaches it and by how random it looks.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.frames import text_of
from rowmill.llm.spans import Span, joined

KINDS = ("assign", "access", "hex", "literal")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Parts of which a text that _ASSIGN matches has one, in lower case.
_PARTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Name parts, or runs of them, and how sensitive they are.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0,
    "privatekey": 1.0, "secretkey": 1.0, "encryptionkey": 0.9, "credential": 0.9, "bearer": 0.8, "authorization": 0.7, "auth": 0.5, "signature": 0.4,
}
#: Parts of which every text with a sensitive name has one, in any case.
_ROOTS = re.compile("pass|pwd|secret|token|key|credential|bearer|auth|signature", re.IGNORECASE | re.ASCII)
#: Names so sensitive that a quoted literal need not look random.
SURE = 0.9
_PLACEHOLDER = re.compile(r"(?:(.)\1*|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%|\[.*\]|your.*|change.?me.*|example.*|none|null|true|false|undefined|todo.*|placeholder.*|redacted.*|required|optional|string|password|passwd|secret|token)", re.IGNORECASE | re.DOTALL)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
_REFERENCE = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$-]*")

#: Tokens of source and configuration text. A quote behind a letter is an apostrophe; a quote without its partner is no token.
_TOKEN = re.compile(
    r"""
    (?P<define>\#[\x20\t]*define[\x20\t]+(?P<defined>[A-Za-z_][A-Za-z0-9_]*)[\x20\t]+)
    |(?P<block>(?<=[:\x20])[|>][+-]?[\x20\t]*\n(?P<indent>[\x20\t]+)[^\n]*(?:\n(?:(?P=indent)[^\n]*|[\x20\t]*(?=\n)))*)
    |(?P<string>(?:(?<![A-Za-z0-9_])[rRbBfFuU]{1,2})?(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|(?<![^\W\d_])\'\'\'(?:\\.|[^\\])*?\'\'\'|"(?:\\.|[^"\\\n])*"|(?:(?<![A-Za-z0-9_])(?<![^\x00-\x7F])|(?<=(?<![A-Za-z0-9_])[rRbBfFuU]))\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`))
    |(?P<tag></?[A-Za-z_][A-Za-z0-9_.:-]*|/?>)
    |(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*)
    |(?P<sign>:=|=>|[:=](?![:=>])|[+,;(){}\[\]\n])
    |(?P<number>[0-9][A-Za-z0-9_.+/=-]*)
    """,
    re.VERBOSE | re.DOTALL,
)
#: An unquoted value, as in properties, environment files and YAML.
_BARE = re.compile(r"[A-Za-z0-9_$+/.=~!@%^*-]+")
_OPEN = re.compile(r"[rRbBfFuU]{0,2}(?P<q>\"\"\"|\'\'\'|[\"\'`])")
#: What may stand between the parts of a value: a plus sign, a continued line, or nothing between strings.
_MORE = re.compile(r"[\x20\t]*(?:\+[\x20\t]*\n?[\x20\t]*|\\\n[\x20\t]*|(?=[\x20\t][\"']))")
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: Lists of values: how they open and close, and what stands between values; items of YAML, and what may stand behind one.
_CLOSING = {"[": "]", "(": ")", "{": "}"}
_OPENED = re.compile(r"[\x20\t]*(?P<sign>[\[({])\s*")
_BETWEEN = re.compile(r"[\x20\t]*,\s*")
_ITEM = re.compile(r"[\x20\t]*\n[\x20\t]*-[\x20\t]+")
_LINE_END = re.compile(r"[\x20\t]*(?:\#[^\n]*)?(?=\n|\Z)")
_ENDED = re.compile(r"[\x20\t]*(?:[;\#\n]|\Z)")
_BLANKS = re.compile(r"\s*")
#: Words before the names of a declaration, and the name of an environment variable.
_DECLARING = {"var", "let", "const", "local", "my"}
_VARIABLE = re.compile(r"[A-Z][A-Z0-9_]*")
#: The value of a variable, as shells write it, and where it is assigned if nowhere in the text.
_VARIABLE_USE = re.compile(r"\$[A-Za-z_][A-Za-z0-9_]*")
UNKNOWN = -1


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(p in low for p in _PARTS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def sensitivity(name: str) -> float:
    """By the name's parts (camelCase, snake_case, dots, dashes): a part or two or three in a row make a sensitive one. Long ones may also end a part."""
    parts = [p.lower() for p in _PART.findall(name)]
    best = 0.0
    for i in range(len(parts)):
        for n in (1, 2, 3):
            word = "".join(parts[i : i + n])
            best = max(best, SENSITIVE.get(word, 0.0), SENSITIVE.get(word.removesuffix("s"), 0.0))
        best = max([best, *(v for k, v in SENSITIVE.items() if len(k) > 5 and parts[i].endswith(k))])
    return best


def randomness(literal: str) -> float:
    """Entropy of the characters, as a part of what 32 random alphanumeric ones have; 0 for words and numbers."""
    if len(literal) < 8 or literal.isalpha() or literal.isdigit() or re.search(r"\s", literal):
        return 0.0
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, bits / 4.5)


@dataclass
class Assignment:
    """A name and the parts of what is assigned to it: literals (value, start, end, quoted) and names of constants."""

    name: str
    parts: list[tuple[str, int, int, bool] | str]


def _literal(token: re.Match) -> tuple[str, int, int, bool]:
    """Value and span of a string or block token, without its quotes."""
    if token["block"]:
        start = token.start("indent")
        lines = token["block"].split("\n")[1:]
        return "\n".join(x.strip() for x in lines).strip(), start + len(token["indent"]), token.end(), True
    opened = _OPEN.match(token[0])
    start, end = token.start() + opened.end(), token.end() - len(opened["q"])
    return _ESCAPE.sub(r"\1", token[0][opened.end() : len(token[0]) - len(opened["q"])]), start, end, True


def assignments(text: str) -> list[Assignment]:
    """Name-literal pairs of a text, in its order: `name = "x"`, `name: x`, `"name": "x"`, `at["name"] = x`, `name: Type = x`, `name := x`, `NAME=x`,
    `a = name = x`, `a, name = x, y`, `names = [x, y]`, `#define NAME x`, `<name>x</name>`, `<t name="x">`, blocks and lists of YAML, and sums of strings and names."""
    out: list[Assignment] = []
    name: str | None = None  # what a sign may follow
    where = (0, 0)  # its place
    before: list[str] = []  # names with commas in front of it, of a statement that starts with them
    starts = in_list = comma = True  # whether a statement may start here, the names do start one, a comma was last
    tag: tuple[str, int] | None = None  # an element that has just been opened, and where its text starts
    at = 0
    while True:
        token = _TOKEN.search(text, at)
        if token is None:
            return out
        at = token.end()
        after_comma, comma = comma, False
        if token["name"]:
            if not after_comma:
                before, in_list = [], starts
            name, where = token["name"], token.span()
            starts = starts and name in _DECLARING
            continue
        statement, starts = starts, token["sign"] in ("\n", ";")
        if token["define"]:
            at = _assigned(text, at, [token["defined"]], False, out)
            name = None
        elif token["tag"]:
            if token["tag"].startswith("</") and tag and token["tag"][2:] == tag[0]:
                value = text[tag[1] : token.start()]
                if "<" not in value and value.strip():
                    start = tag[1] + len(value) - len(value.lstrip())
                    out.append(Assignment(tag[0], [(value.strip(), start, start + len(value.strip()), True)]))
            if token["tag"] == ">" and tag:
                tag = (tag[0], at)
            elif not token["tag"].endswith(">"):
                tag = None if token["tag"].startswith("</") else (token["tag"][1:], at)
            name = None
        elif token["string"]:
            inner = _literal(token)[0]
            name = inner if _REFERENCE.fullmatch(inner) else None
            before, in_list, where = [], False, token.span()
        elif token["sign"] in (":", "=", ":=", "=>") and name is not None:
            line = token["sign"] == "=" and where[1] == token.start() and (where[0] == 0 or text[where[0] - 1] == "\n" or text.endswith("export ", 0, where[0])) and _VARIABLE.fullmatch(name)
            if line and (bare := _BARE.match(text, at)) and not bare[0].startswith("$") and (bare.end() == len(text) or text[bare.end()] == "\n"):
                # a line of an environment file: what stands there is a literal
                out.append(Assignment(name, [(bare[0], *bare.span(), True)]))
                at = bare.end()
            else:
                at = _assigned(text, at, [*(before if token["sign"] in ("=", ":=") else ()), name], token["sign"] == ":", out)
            name, before = None, []
        elif token["sign"] == "," and name is not None and in_list:
            before.append(name)
            name, comma = None, True
        elif token["sign"] != "]" or name is None:
            name, before = None, []
            starts = starts or statement and token["sign"] is None and not token["number"]


def _assigned(text: str, at: int, names: list[str], typed: bool, out: list[Assignment]) -> int:
    """Adds what is assigned to names at a place (to the last, or to each its own if there are as many values), and returns where to go on.

    typed: a name in front of an equals sign would be a type; else it is assigned the same value.
    """
    same: list[str] = []  # names that are assigned what the last one is
    while True:
        opened = _OPENED.match(text, at)
        if opened:
            items, end = _items(text, opened.end(), _CLOSING[opened["sign"]])
            if len(names) > 1 and len(items) == len(names):
                out += [Assignment(n, parts) for n, parts in zip(names, items)]
            else:
                out += [Assignment(n, parts) for n in (names[-1], *same) for parts in items]
            return end if items else opened.end()
        parts, at, more = _value(text, at)
        if more is None:
            break
        if not typed:
            same.append(more)
        typed = False
    if not parts and typed:
        while (item := _ITEM.match(text, at)) is not None:
            parts, end, more = _value(text, item.end())
            if not parts or more is not None or not _LINE_END.match(text, end):
                break
            out.append(Assignment(names[-1], parts))
            at = _LINE_END.match(text, end).end()
        return at
    values, end = [parts], at
    while parts and len(values) < len(names) and (between := _BETWEEN.match(text, end)) is not None:
        value, behind, more = _value(text, between.end())
        if not value or more is not None:
            break
        values.append(value)
        end = behind
    if len(values) == len(names) > 1 and not same and _ENDED.match(text, end):
        out += [Assignment(n, value) for n, value in zip(names, values)]
        return end
    if parts:
        out += [Assignment(n, parts) for n in (names[-1], *same)]
    return at


def _items(text: str, at: int, closing: str) -> tuple[list[list], int]:
    """The values of a list up to its end, and the place behind it; no values if it holds anything else."""
    items: list[list] = []
    while True:
        at = _BLANKS.match(text, at).end()
        if text.startswith(closing, at):
            return items, at + 1
        parts, at, more = _value(text, at)
        if not parts or more is not None:
            return [], at
        items.append(parts)
        at = _BLANKS.match(text, at).end()
        if text.startswith(",", at):
            at += 1
        elif not text.startswith(closing, at):
            return [], at


def _value(text: str, at: int) -> tuple[list, int, str | None]:
    """Parts of the value that starts at a place, where it ends, and the name that stands there instead with an equals sign behind it."""
    parts: list = []
    while True:
        while at < len(text) and text[at] in " \t":
            at += 1
        token = _TOKEN.match(text, at)
        if token and (token["string"] or token["block"]):
            parts.append(_literal(token))
            at = token.end()
        else:
            bare = _BARE.match(text, at)
            if bare is None:
                return parts, at, None
            if not parts and bare[0].endswith("=") and _REFERENCE.fullmatch(bare[0][:-1]) and text[bare.end() : bare.end() + 1] in ('"', "'", "`"):
                return [], bare.end(), bare[0][:-1]
            value = bare[0].rstrip(".") if not bare[0].endswith("=") else bare[0]
            behind = text[bare.end() : bare.end() + 3].lstrip(" \t")
            after = behind[:1]
            if _REFERENCE.fullmatch(value) and after == "=" and behind[1:2] not in ("=", ">"):
                return (parts, at, None) if parts else ([], text.index("=", bare.end()) + 1, value)
            if value:
                parts.append((value, at, at + len(value), False))
            at = bare.end()
            if after == "(":  # a call: its arguments are no value of the name
                return parts[:-1], at, None
        rest = _MORE.match(text, at)
        if rest is None or (rest.end() == at and text[at : at + 1] not in "\"'") or not parts[-1][3] and "+" not in rest[0]:
            return parts, at, None
        at = rest.end()


#: Values of constants are put together up to this length: names that are doubled again and again would outgrow memory. Longer ones add nothing to a sum's score.
LONGEST = 65_536


def lexed_spans(text: str, base: list[Span], least: float = 1.2) -> list[Span]:
    """Literals that sensitive names reach, apart from those that the patterns found.

    A name that is assigned another name stands for what that one was last assigned before (or, if never, is first assigned behind), however long the
    chain. Quoted literals and whole lines NAME=value of six characters or more under the most sensitive names count unless they are placeholders; others need a
    score (sensitivity of the most sensitive name that reaches them, plus randomness of the whole value) of `least` or more. The parts of a sum are one span.
    """
    found = assignments(text)
    first: dict[str, int] = {}
    for i, x in enumerate(found):
        first.setdefault(x.name, i)
    latest: dict[str, int] = {}
    uses: list[list[int]] = []  # of each assignment, those whose values it takes
    values: list[str] = []
    own: list[tuple[int, int, int, bool]] = []
    for i, x in enumerate(found):
        named = [None if p[3] else p[0] if p[0] in first else p[0][1:] if _VARIABLE_USE.fullmatch(p[0]) else None for p in x.parts]
        taken_from = [None if n is None else latest.get(n, first.get(n, UNKNOWN)) for n in named]
        uses.append([j for j in taken_from if j not in (None, UNKNOWN)])
        known = [p[0] if j is None else values[j] if UNKNOWN < j < i and len(values[j]) <= LONGEST else "" for p, j in zip(x.parts, taken_from)]
        values.append("".join(known))
        literals = [p for p, j in zip(x.parts, taken_from) if j is None]
        if literals:
            own.append((i, literals[0][1], literals[-1][2], any(p[3] for p in literals)))
        latest[x.name] = i
    by_name = {n: sensitivity(n) for n in first}
    reach = [by_name[x.name] for x in found]
    # most sensitive names first: each assignment is settled once
    settled: set[int] = set()
    for top in sorted(range(len(found)), key=lambda i: -reach[i]):
        stack = [top]
        while stack:
            i = stack.pop()
            if i not in settled:
                settled.add(i)
                reach[i] = max(reach[i], reach[top])
                stack += uses[i]
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    furthest = list(itertools.accumulate((e for _, e in taken), max))
    out: set[tuple[int, int]] = set()
    for i, start, end, is_quoted in own:
        random = randomness(values[i])
        sure = reach[i] >= SURE and is_quoted and len(values[i]) >= 6
        if not (sure or reach[i] > 0 < random and reach[i] + random >= least) or _PLACEHOLDER.fullmatch(values[i]):
            continue
        k = bisect.bisect_left(starts, end)  # those that start before the end
        if k == 0 or furthest[k - 1] <= start:
            out.add((start, end))
    return [("literal", s, e) for s, e in sorted(out)]


def secrets(docs: DataFrame) -> DataFrame:
    """Finds secrets in every whole text.

    Returns doc_id, n_assign, n_access, n_hex (of the patterns), base (their spans), spans (with the literals that the lexer
    adds), as kind:start:end joined by commas, in code points. A null text is empty; very long texts are read whole. Repeated rows are
    judged each; other columns are ignored. An empty table gives an empty one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [base_spans(t) for t in batch["text"]]
            more = [lexed_spans(t, b) if _ROOTS.search(t) else [] for t, b in zip(batch["text"], found)]
            counts = {f"n_{k}": [sum(s[0] == k for s in b) for b in found] for k in BASE_KINDS}
            yield pd.DataFrame({"doc_id": batch["doc_id"], **counts, "base": [joined(b, KINDS) for b in found], "spans": [joined(b + m, KINDS) for b, m in zip(found, more)]})

    return text_of(docs).mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns."""
    return result.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_spans"))
