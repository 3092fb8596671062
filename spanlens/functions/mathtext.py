"""Mathematical answers and arithmetic claims: row logic without built-in equivalents, in Arrow batches.

Expressions are read by a small recursive parser of numbers, + - * / ^, brackets,
fractions, percents, roots, pi and single-letter symbols; nothing is ever
evaluated as code. Expressions with symbols are equal if they have the same
value at several points.
"""

import math
import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest expression that is parsed, largest exponent.
LONGEST, LARGEST_POWER = 200, 64
#: Values that a symbol takes, shifted by its place in the alphabet, when expressions with symbols are compared.
POINTS = (Fraction(7, 5), Fraction(-23, 9), Fraction(41, 3), Fraction(3, 17))


def boxed(text: str | None) -> str | None:
    """The content of the last \\boxed{...} with balanced braces, or what follows a \\boxed without braces up to a blank or a dollar sign."""
    at = (text or "").rfind("\\boxed")
    if at < 0:
        return None
    brace = re.compile(r"\\boxed\s*\{").match(text, at)
    if not brace:
        bare = re.compile(r"\\boxed\s+([^\s$]+)").match(text, at)
        return bare[1] if bare else None
    depth, start = 0, brace.end()
    for i in range(start - 1, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start:i]
    return None


def normalise(answer: str | None) -> str:
    t = (answer or "").strip().strip("$").rstrip(".")
    t = re.sub(r"\\(?:left|right|,|!|;|:|quad)\b|\\[,!;: ]", "", t)
    t = re.sub(r"\\(?:text|mathrm|mbox)\{[^{}]*\}", "", t)
    t = re.sub(r"\\[dt]?frac\s*(\d)\s*(\d)", r"((\1)/(\2))", t)
    while (new := re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"((\1)/(\2))", t)) != t:
        t = new
    while (new := re.sub(r"\\sqrt(?:\[(\d+)\])?\{([^{}]*)\}", lambda m: f"(({m[2]})^(1/{m[1] or 2}))", t)) != t:
        t = new
    t = re.sub(r"\\sqrt\s*(\d)", r"((\1)^(1/2))", t).replace("\\pi", "pi")
    t = t.replace("\\cdot", "*").replace("\\times", "*").replace("\\div", "/").replace("\\%", "%").replace("^\\circ", "").replace("\\$", "")
    t = re.sub(r"(?<=\d),(?=\d{3}\b)", "", t)
    return re.sub(r"\s+", "", t.replace("{", "(").replace("}", ")"))


class Reader:
    """Value of an expression; ValueError if it is none."""

    def __init__(self, text: str, in_order: bool = False, point: Fraction | None = None):
        self.tokens = re.findall(r"\d+\.?\d*|\.\d+|pi|[-+*/^()%]|\S", text)
        self.at, self.in_order, self.point = 0, in_order, point

    def value(self) -> Fraction:
        if len(self.tokens) > LONGEST:
            raise ValueError("too long")
        v = self.chain() if self.in_order else self.total()
        if self.at != len(self.tokens):
            raise ValueError("rest")
        return v

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def chain(self) -> Fraction:
        """Left to right, without precedence."""
        v = self.power()
        while self.peek() and self.peek() in "+-*/":
            v = self.apply(self.take(), v, self.power())
        return v

    def total(self) -> Fraction:
        v = self.product()
        while self.peek() and self.peek() in "+-":
            v = self.apply(self.take(), v, self.product())
        return v

    def product(self) -> Fraction:
        v = self.power()
        while (t := self.peek()) and (t in "*/" or self.begins(t)):
            v = self.apply(self.take() if t in "*/" else "*", v, self.power())
        return v

    def begins(self, t: str) -> bool:
        """A factor without a sign before it: 2pi, 3(4), 2x."""
        return t == "pi" or t == "(" or (len(t) == 1 and t.isascii() and t.isalpha() and self.point is not None)

    @staticmethod
    def apply(op: str, a: Fraction, b: Fraction) -> Fraction:
        if op == "/" and b == 0:
            raise ValueError("division by zero")
        return a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b

    def power(self) -> Fraction:
        v = self.atom()
        if self.peek() == "^":
            self.take()
            e = self.power()
            if abs(e) > LARGEST_POWER or (v == 0 and e < 0) or (e.denominator != 1 and v < 0):
                raise ValueError("power")
            if e.denominator == 1:
                v = v ** int(e)
            else:
                root = Fraction(math.isqrt(v.numerator), math.isqrt(v.denominator)) if e.denominator == 2 else Fraction(0)
                v = root ** e.numerator if e.denominator == 2 and root * root == v else Fraction(float(v) ** float(e))
        return v

    def atom(self) -> Fraction:
        t = self.peek()
        if not t:
            raise ValueError("end")
        self.take()
        if t in "+-":
            v = self.power()
            return -v if t == "-" else v
        if t == "(":
            v = self.total()
            if self.peek() != ")":
                raise ValueError("bracket")
            self.take()
        elif t[0].isdigit() or t[0] == "." and len(t) > 1:
            v = Fraction(t)
        elif t == "pi":
            v = Fraction(math.pi)
        elif self.point is not None and len(t) == 1 and t.isascii() and t.isalpha():
            v = self.point + ord(t)
        else:
            raise ValueError(t)
        while self.peek() == "%":
            self.take()
            v /= 100
        return v


def number(text: str, in_order: bool = False, point: Fraction | None = None) -> Fraction | None:
    try:
        return Reader(text, in_order, point).value()
    except (ValueError, ZeroDivisionError, RecursionError, OverflowError):
        return None


def symbols(text: str) -> set[str]:
    """Single letters that stand for numbers; none where letters make words."""
    bare = text.replace("pi", "")
    return set() if re.search(r"[A-Za-z]{2}", bare) else set(re.findall(r"[A-Za-z]", bare))


def close_numbers(u: Fraction | None, v: Fraction | None, tolerance: float) -> bool:
    return u is not None and v is not None and abs(u - v) <= Fraction(tolerance) * max(1, abs(u), abs(v))


def same_answer(a: str | None, b: str | None, tolerance: float = 1e-6) -> bool:
    """Equal as normalised text, as numbers within the tolerance, or as expressions of the same symbols at all points."""
    x, y = normalise(boxed(a) or a), normalise(boxed(b) or b)
    if x == y:
        return True
    if close_numbers(number(x), number(y), tolerance):
        return True
    return bool(symbols(x)) and symbols(x) == symbols(y) and all(close_numbers(number(x, point=p), number(y, point=p), tolerance) for p in POINTS)


_SIDE = r"[-+]?[\d(][\d\s.,+\-*/^()%$x×÷]*"
_CLAIM = re.compile(rf"({_SIDE})((?:=\s*{_SIDE})+)")


def arithmetic_false(text: str | None) -> bool | None:
    """Whether an equation of the text, chains included, is false; null if there is none.

    A side holds in standard or in left-to-right order, and to the precision that the right side shows.
    """
    met = False
    for m in _CLAIM.finditer(text or ""):
        sides = [s.strip().rstrip(".,").replace("$", "").replace(",", "").replace("×", "*").replace("x", "*").replace("÷", "/") for s in (m[1] + m[2]).split("=")]
        for left, right in zip(sides[:-1], sides[1:], strict=True):
            r = number(right)
            values = [v for v in (number(left), number(left, True)) if v is not None]
            if r is None or not values or not re.search(r"[-+*/^%]", left.lstrip("-+")):
                continue
            met = True
            shown = re.fullmatch(r"[-+]?\d*\.?(\d*)%?", right.strip())
            slack = Fraction(1, 2 * 10 ** len(shown[1])) if shown and shown[1] else Fraction(1, 10**9)
            if all(abs(v - r) > slack for v in values):
                return True
    return False if met else None


#: Texts, and characters of them, whose judgements a task keeps.
KEPT_TEXTS, KEPT_CHARS = 10_000, 1 << 22


def judged_once(judge: Callable[..., bool | None]) -> Callable[[Iterator[tuple[pd.Series, ...]]], Iterator[pd.Series]]:
    """Over batches of a task: texts that it has met take the judgement given then; what it keeps is bounded and goes with the task."""

    def judgements(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        known: dict = {}
        chars = 0
        for columns in batches:
            out = []
            for texts in zip(*columns, strict=True):
                if texts not in known:
                    chars += sum(len(t) for t in texts if t is not None)
                    if len(known) >= KEPT_TEXTS or chars > KEPT_CHARS:
                        known, chars = {}, 0
                    known[texts] = judge(*texts)
                out.append(known[texts])
            yield pd.Series(out, dtype="boolean")

    return judgements


def math_equal(a: Column, b: Column) -> Column:
    @F.pandas_udf("boolean")
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return judged_once(same_answer)(batches)

    return udf(a, b)


def arithmetic_claim_false(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return judged_once(arithmetic_false)((x,) for x in batches)

    return udf(text)
