"""License scan: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

One automaton over words holds the notice phrases and the tag that introduces an expression; what follows a tag on its
line is parsed. An expression such as `(MIT OR Apache-2.0) AND BSD-3-Clause WITH x` is turned into postfix form and
evaluated to the licenses that satisfy it: `or` joins alternatives, `and` combines them, `with` binds an exception to
its license. Alternatives within a combination stay factored, so a label is as long as its expression at most.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table

#: The phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notice phrases beyond the contract's, as words, and their labels.
MORE = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "apache license 2 0": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: What follows a tag on its line and can be part of an expression.
EXPRESSION = re.compile(rb":?[ \t]*([a-z0-9.+() \t-]*)")

_SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS = bytes(
    ord(chr(b).lower()) if 0x41 <= b <= 0x5A else 0x20 if b in _SEPARATORS else b for b in range(256)
)
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass
class Automaton:
    """Aho-Corasick over words: states are the beginnings of phrases; 0 is the empty one."""

    go: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    fail: list[int] = field(default_factory=lambda: [0])
    ends: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    known: set[bytes] = field(default_factory=set)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, str]]:
        """(place of the last word, phrase) of every place where a phrase's words stand, ends in order."""
        known, go, fail, ends = self.known, self.go, self.fail, self.ends
        state, last = 0, -1
        for at in [i for i, w in enumerate(words) if w in known]:
            if at != last + 1:  # a word of no phrase lies between
                state = 0
            last, word = at, words[at]
            while state and word not in go[state]:
                state = fail[state]
            state = go[state].get(word, 0)
            for phrase in ends[state]:
                yield at, phrase


def automaton(phrases: dict[str, str]) -> Automaton:
    out = Automaton()
    for phrase in [*phrases, TAG]:
        state = 0
        for word in phrase.encode().split():
            out.known.add(word)
            if word not in out.go[state]:
                out.go[state][word] = len(out.go)
                out.go.append({})
                out.fail.append(0)
                out.ends.append(())
            state = out.go[state][word]
        out.ends[state] += (phrase,)
    queue = deque(out.go[0].values())
    while queue:
        state = queue.popleft()
        for word, child in out.go[state].items():
            back = out.fail[state]
            while back and word not in out.go[back]:
                back = out.fail[back]
            out.fail[child] = out.go[back].get(word, 0)
            out.ends[child] += out.ends[out.fail[child]]
            queue.append(child)
    return out


def postfix(tokens: list[str]) -> list[str]:
    """The longest leading part of the tokens that is an expression, in postfix order; one pass."""
    out: list[str] = []
    stack: list[str] = []
    whole: tuple[int, list[str]] = (0, [])  # so many of out, and what was on the stack, when an expression last ended
    operand, open_ = True, 0  # whether an operand must come next; brackets that are open
    for token in tokens:
        if token == "(" or token not in _BINDS and token != ")":
            if not operand:
                break
            if token == "(":
                stack.append(token)
                open_ += 1
                continue
            out.append(token)
            operand = False
        elif operand:
            break
        elif token == ")":
            if not open_:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            open_ -= 1
        else:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        if not operand and not open_:
            whole = len(out), stack[::-1]  # at most one operator of each kind
    return out[: whole[0]] + whole[1]


@dataclass
class Terms:
    """An expression: the operator that joins its parts (none for a single license), and the parts, each once, with whether brackets stand around it among others."""

    kind: str
    parts: dict[str, bool]

    def text(self) -> str:
        if len(self.parts) == 1:
            return next(iter(self.parts))
        return ("|" if self.kind == "or" else "+").join(sorted(f"({p})" if wide else p for p, wide in self.parts.items()))

    def part(self) -> tuple[str, bool]:
        return self.text(), len(self.parts) > 1 or any(self.parts.values())


def _joined(left: Terms, right: Terms, kind: str) -> Terms:
    if kind == "with":
        return Terms("", {" with ".join(f"({text})" if wide else text for text, wide in (left.part(), right.part())): False})
    if left.kind not in (kind, ""):
        left = Terms(kind, dict([left.part()]))
    left.kind = kind  # a chain of one operator grows in place
    left.parts.update(right.parts if right.kind in (kind, "") else dict([right.part()]))
    return left


def evaluated(expression: str) -> Terms | None:
    """The expression; of a text that stops being one the longest leading part that is one counts, and without any there is none."""
    stack: list[Terms] = []
    for token in postfix(re.findall(r"[()]|[a-z0-9.+-]+", expression.lower())):
        if token in _BINDS:
            right = stack.pop()
            stack.append(_joined(stack.pop(), right, token))
        else:
            stack.append(Terms("", {token: False}))
    return stack[0] if stack else None


def labels_of(expression: str) -> list[str]:
    """One label for each part that the outermost `or` joins, whatever their number.

    Licenses that hold together are joined by a plus sign, and alternatives within them stay factored: `(a|b)+c`.
    """
    found = evaluated(expression)
    if found is None:
        return []
    return list(found.parts) if found.kind == "or" else [found.text()]


def scan(text: bytes, machine: Automaton, phrases: dict[str, str]) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, all labels, score) of one text."""
    line = text.translate(_WORDS)
    words = line.split()
    starts, base, labels, tags = [], set(), set(), []
    for end, phrase in machine.find(words):
        if phrase == TAG:
            tags.append(end)
            continue
        labels.add(phrases[phrase])
        if phrase in BASE:
            starts.append(end - phrase.count(" "))
            base.add(BASE[phrase])
    found = False
    if tags:
        lower, wanted = text.translate(_LOWER), set(tags)
        for at, word in enumerate(re.finditer(rb"[^ ]+", line)):
            if at in wanted:
                named = labels_of(EXPRESSION.match(lower, word.end())[1].decode())
                found |= bool(named)
                labels.update(named)
    score = 1.0 if starts or found else 0.5 if labels else 0.0
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def license_scan(docs: DataFrame, more: dict[str, str] | None = None) -> DataFrame:
    """One row per row of docs, by the contract of op10; more: phrases (as lower-case words) and labels beside the base ones.

    score: 1 for a base phrase or an expression after a tag, 0.5 for other notices only, else 0. A null or empty text
    has no words and no labels; of a long text one task holds its words; phrases that end at one place (a tie) all count;
    repeated rows and null ids keep their rows; an empty table gives an empty result; further columns are ignored.
    """
    phrases = {**(MORE if more is None else more), **BASE}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(phrases)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [scan(t or b"", machine, phrases) for t in texts]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [f.split()[0] for f in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
