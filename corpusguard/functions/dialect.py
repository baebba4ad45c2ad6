"""One way to write the text expressions for Spark SQL and for the SQL that checks them.

Rules are regular expressions with Unicode classes; Spark's flags give them the
meaning they have elsewhere, in one place.
"""

from __future__ import annotations

import functools
import re
from re import _constants as _c
from re import _parser

#: White space by Unicode, as escapes of a string literal.
_SPACES = "".join(f"\\u{c:04X}" for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_HANGUL = re.compile(r"[가-힣]|\\u[b-dB-D][0-9A-Fa-f]{3}")


def _branches(pattern: str) -> list[str]:
    """The alternatives of a pattern outside all groups, each without its optional and inner alternative parts."""
    out, depth, at = [""], 0, 0
    while at < len(pattern):
        c = pattern[at]
        step = 2 if c == "\\" else 1
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        elif not depth or step == 2:
            out[-1] += pattern[at : at + step] if not depth else ""
        at += step
    return out


def _weight(word: str) -> float:
    return sum(1.0 if c < "가" else 2.5 for c in word)


def _needed(seq) -> list[frozenset[str]]:
    """Sets of words of which every match of a parsed pattern holds one each: runs of lower-case letters, digits and Hangul."""
    out, run = [], ""
    for op, arg in [*seq, (None, None)]:
        c = chr(arg).lower() if op is _c.LITERAL else ""
        if re.fullmatch("[a-z0-9가-힣]", c):
            run += c
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if op is _c.SUBPATTERN:
            out += _needed(arg[-1])
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and arg[0]:
            out += _needed(arg[2])
        elif op is _c.BRANCH:
            parts = [_best(_needed(x)) for x in arg[1]]
            if all(parts):
                out.append(frozenset().union(*parts))
    return out


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    return max(sets, key=lambda s: (min(map(_weight, s)), -len(s)), default=frozenset())


@functools.cache
def needed(pattern: str) -> tuple[str, ...]:
    """Lower-case words of which any match of the pattern, case ignored, holds one; none if that is not known."""
    return tuple(sorted(_best(_needed(_parser.parse(pattern)))))


def main_word(term: str) -> str:
    return max(re.findall("[a-z0-9가-힣]+", term), key=_weight)


class Dialect:
    flags = "(?imdU)"

    def lit(self, s: str) -> str:
        return f"r'{s}'" if "'" not in s else f'r"{s}"'

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rule(self, pattern: str, dotall: bool = False) -> str:
        return self.lit(("(?s)" if dotall else "") + self.flags + pattern)

    def words_held(self, text: str, lowered: str, patterns: list[str], terms: tuple[str, ...] = ()) -> str:
        """Those words of which matches of the patterns hold one (see needed), and main words of the terms, that the text holds: the argument hits of count, has and occurrences.

        Letters whose lower case is not the one that rules match them with put in all words.
        """
        words = sorted(set(map(main_word, terms)).union(*map(needed, patterns)))
        ko = [w for w in words if _HANGUL.search(w)]
        held = lambda ws: f"filter(array({', '.join(map(self.text, ws))}), w -> contains({lowered}, w))"
        odd = " OR ".join(f"contains({text}, '{c}')" for c in "İıſ")
        return f"CASE WHEN {odd} THEN array({', '.join(map(self.text, words))}) WHEN {lowered} RLIKE '[가-힣]' THEN {held(words)} ELSE {held([w for w in words if w not in ko])} END"

    def when_held(self, hits: str, e: str, none: str) -> str:
        """e, which is none where a text holds no word of a rule."""
        return f"CASE WHEN size({hits}) > 0 THEN {e} ELSE {none} END"

    def _gate(self, hits: str, pattern: str) -> str:
        return f"arrays_overlap({hits}, array({', '.join(map(self.text, needed(pattern)))}))"

    def count(self, x: str, pattern: str, dotall: bool = False, hits: str = "") -> str:
        """Matches of a rule, tried only on text that has a word of it, if hits has the words of the text; one that needs Hangul is tried only on text that has some."""
        n = f"regexp_count({x}, {self.rule(pattern, dotall)})"
        if hits and needed(pattern):
            return f"CASE WHEN {self._gate(hits, pattern)} THEN {n} ELSE 0 END"
        return f"CASE WHEN {x} RLIKE '[가-힣]' THEN {n} ELSE 0 END" if all(map(_HANGUL.search, _branches(pattern))) else n

    def has(self, x: str, pattern: str, dotall: bool = False, hits: str = "") -> str:
        found = f"({x} RLIKE {self.rule(pattern, dotall)})"
        return f"({self._gate(hits, pattern)} AND {found})" if hits and needed(pattern) else found

    def every(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, {group})"

    def replace(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {by})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.lit(pattern)})"

    def filter(self, a: str, v: str, cond: str) -> str:
        return f"filter({a}, {v} -> {cond})"

    def transform(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def distinct(self, a: str) -> str:
        return f"size(array_distinct({a}))"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def at(self, a: str, i: int) -> str:
        return f"{a}[{i}]"

    def join(self, a: str, by: str) -> str:
        return f"array_join({a}, {by})"

    def part(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, {start}, {n})"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def pairs(self, a: str) -> str:
        """Neighbouring elements of an array of strings, joined by a space."""
        return f"zip_with(slice({a}, 1, greatest(size({a}) - 1, 0)), slice({a}, 2, size({a})), (x, y) -> concat(x, ' ', y))"

    def explode(self, a: str, column: str, alias: str, source: str, keep: str = "*") -> str:
        return f"SELECT {keep}, explode({a}) AS {alias} FROM {source}"

    def strip(self, x: str) -> str:
        return f"trim(BOTH '{_SPACES}' FROM {x})"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) DIV ({b}))"

    def dot(self, column: str, weights: list[float]) -> str:
        """Sum of the weights times the counts of an array, two at most each."""
        return f"aggregate(zip_with({column}, array({', '.join(f'{w}E0' for w in weights)}), (n, w) -> least(n, 2) * w), 0.0E0, (s, x) -> s + x)"

    def positive(self, column: str, only: list[int], n: int) -> str:
        """How many of the counts at the places only are above zero."""
        return f"size(filter({column}, (x, i) -> x > 0{'' if len(only) == n else f' AND i IN ({str(only)[1:-1]})'}))"

    def occurrences(self, x: str, words: tuple[str, ...], hits: str = "") -> str:
        """Sum of the substring counts of all words, overlapping ones counted each."""
        if hits:
            return f"CASE WHEN arrays_overlap({hits}, array({', '.join(self.text(w) for w in sorted(set(map(main_word, words))))})) THEN {self.occurrences(x, words)} ELSE 0L END"
        return f"aggregate(filter(array({', '.join(self.text(w) for w in words)}), w -> contains({x}, w)), 0L, (s, w) -> s + (length({x}) - length(replace({x}, w, ''))) DIV length(w))"
    string = "STRING"


class Check(Dialect):
    """DuckDB, for the checks."""

    flags = "(?im)"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    text = lit

    def rule(self, pattern: str, dotall: bool = False) -> str:
        return self.lit(("(?ims)" if dotall else "(?im)") + re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", pattern))

    def when_held(self, hits, e, none):
        return e

    def count(self, x, pattern, dotall=False, hits=""):
        return f"len(regexp_extract_all({x}, {self.rule(pattern, dotall)}))"

    def has(self, x, pattern, dotall=False, hits=""):
        return f"regexp_matches({x}, {self.rule(pattern, dotall)})"

    def replace(self, x, pattern, by):
        return f"regexp_replace({x}, {self.lit(pattern)}, {by}, 'g')"

    def split(self, x, pattern):
        return f"regexp_split_to_array({x}, {self.lit(pattern)})"

    def filter(self, a, v, cond):
        return f"list_filter({a}, lambda {v}: {cond})"

    def transform(self, a, v, e):
        return f"list_transform({a}, lambda {v}: {e})"

    def size(self, a):
        return f"CAST(len({a}) AS BIGINT)"

    def distinct(self, a):
        return f"len(list_distinct({a}))"

    def array(self, *items):
        return f"[{', '.join(items)}]"

    def at(self, a, i):
        return f"{a}[{i + 1}]"

    def join(self, a, by):
        return f"array_to_string({a}, {by})"

    def part(self, a, start, n):
        return f"list_slice({a}, {start}, {start} + {n} - 1)"

    def struct(self, **fields):
        return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"

    def pairs(self, a):
        return f"list_transform(range(1, len({a})), lambda i: concat({a}[i], ' ', {a}[i + 1]))"

    def explode(self, a, column, alias, source, keep="*"):
        return f"SELECT {keep}, unnest({a}) AS {alias} FROM {source}"

    def strip(self, x):
        return f"trim({x}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"

    def div(self, a, b):
        return f"(({a}) // ({b}))"

    def dot(self, column, weights):
        return "(" + " + ".join(f"{w}E0 * least({column}[{i}], 2)" for i, w in enumerate(weights, 1)) + ")"

    def positive(self, column, only, n):
        return "(" + " + ".join(f"CASE WHEN {column}[{i + 1}] > 0 THEN 1 ELSE 0 END" for i in only) + ")"

    def occurrences(self, x, words, hits=""):
        return "(" + " + ".join(f"(length({x}) - length(replace({x}, {self.text(w)}, ''))) // {len(w)}" for w in words) + ")"

    string = "VARCHAR"


SPARK, CHECK = Dialect(), Check()
