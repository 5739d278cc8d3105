"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Base spans come from fixed patterns with checks. Beyond them, generators of high recall propose spans that may overlap; boosted
trees score each from its format and context, and calibrated thresholds say which are taken. The trees are fitted at the driver on
sentences written here, and compiled into expressions.
"""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back

#: Kinds with base patterns, and all kinds.
KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")

#: The base patterns. A search can only start where the last match ended or where a run of such characters begins;
#: starts within a run cannot do better than its begin, so matches are those of the plain pattern without its quadratic search.
#: Possessive groups are loops, not recursion, so that a text of any length fits the stack. Of digits the pattern takes maximal runs of single separators; only runs of 16 to 19 digits can pass.
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a base pattern to be tried; cheap tests first.
NEEDS = {"email": "@", "ip": None, "card": None, "phone": "+"}
#: Generators: obfuscated addresses, defanged and long IP addresses, cards inside longer runs or with other separators, phone
#: numbers without + or followed by more digits, and runs of letters and digits as keys and tokens have them.
PROPOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\((?:at|AT)\)|\[(?:at|AT)\]|\{at\}| at |@) ?[A-Za-z0-9-]{1,63}(?:(?: ?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\[\.\]) ?| dot |\.)[A-Za-z]{2,24}){1,3}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ .-][0-9]{4}){3}|[0-9]{4}[ .-][0-9]{6}[ .-][0-9]{5}|[0-9]{15,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3,4}[ .-][0-9]{4}|0[0-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4}[ /-][0-9]{5,8})(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9_+/=-]{16})(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]++",
}
#: Words before a span that speak for each kind.
HINTS = {"email": r"(?i)(mail|contact|write|reach|address)\W*\w*\W*$", "ip": r"(?i)(ip|host|server|address|from)\W*\w*\W*$", "card": r"(?i)(card|visa|master|amex|credit|pay)\w*\W*\w*\W*$", "phone": r"(?i)(phone|tel|call|mobile|fax|cell|dial)\w*\W*\w*\W*$", "secret": r"(?i)(token|secret|key|passw(?:or)?d|pwd|bearer|auth\w*|credentials?)\W*$"}
#: What speaks against personal data before a span.
AGAINST = r"(?i)(order|version|part|ref|isbn|invoice|serial|build|sku|item|no|number|id|commit|sha[0-9]*|hash|digest|uuid|checksum|file|image|page)\W*\w*\W*$"
ENDINGS = r"(?i)(com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$"
FEATURES = (*(f"is_{k}" for k in ALL), "luhn", "digits", "separators", "bracket", "hint", "against", "ending", "word_at", "prefixed", "mixed", "local_mark", "assigned", "known", "hexadecimal")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits' check sum is right; doubled are every second from the right."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return (F.length(digits) > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0)


#: Spans whose places are summed up at a time; a text with very many spans costs little more than in proportion.
CHUNK = 256


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each number, those before it put together by op (a sum or a maximum, from 0 on)."""

    def before(part: Column) -> Column:
        step = lambda a, x: F.struct(op(a["n"], x).alias("n"), F.concat(a["out"], F.array(a["n"])).alias("out"))
        return F.aggregate(part, F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])

    total = lambda part: F.aggregate(part, F.lit(0), op)
    n = F.ceil(F.size(values) / CHUNK).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK)))
    return let(parts, lambda ps: let(before(F.transform(ps, total)), lambda starts: F.flatten(F.zip_with(ps, starts, lambda p, s: F.transform(before(p), lambda x: op(s, x))))))


def _sums(sizes: Column) -> Column:
    return _before(sizes, lambda a, x: a + x)


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost matches in order, as (start, end, hit); places count code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(pair: Column) -> Column:
        both = F.zip_with(F.slice(pair["gaps"], F.lit(1), F.size(pair["hits"])), pair["hits"], lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), h.alias("hit")))
        return let(both, lambda b: let(_sums(F.transform(b, lambda x: x["gap"] + x["len"])), lambda s: F.zip_with(b, s, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["len"]).alias("end"), x["hit"].alias("hit")))))

    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits")), lambda p: F.when(F.size(p["hits"]) == 0, none).otherwise(spans(p)))


def base_spans(text: Column, kind: str) -> Column:
    """The kind's base spans: matches that pass its check; failing ones are dropped without another try."""
    check = {
        "email": lambda h: F.lit(True),
        "ip": lambda h: h.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda h: luhn(digits_of(h)),
        "phone": lambda h: F.length(digits_of(h)).between(8, 15),
    }[kind]
    need = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike(BASE[kind])
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return F.when(need, F.filter(_matches(text, BASE[kind]), lambda m: check(m["hit"]))).otherwise(none)


def _masked(text: Column, spans: Column) -> Column:
    """text with a sign for each code point of the spans (in order, without overlaps), so that no candidate overlaps them."""
    return _rebuilt(text, spans, lambda m: F.call_function("repeat", F.lit("␟"), m["end"] - m["start"]))


def _rebuilt(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """text with each span replaced by put(span). spans: in order, without overlaps."""

    def build(x: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(x, lambda m: m["end"]))
        pieces = F.zip_with(F.slice(ends, F.lit(1), F.size(x)), x, lambda at, m: F.concat(F.substr(text, at + 1, m["start"] - at), put(m)))
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.element_at(ends, -1) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, build))


def _features(kind: str, hit: Column, before: Column) -> dict[str, Column]:
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    count = lambda pattern: F.length(F.regexp_replace(hit, f"[^{pattern}]", "")).cast("double")
    return {f"is_{k}": F.lit(float(k == kind)) for k in ALL} | {
        "luhn": flag(luhn(digits_of(hit))) if kind == "card" else F.lit(0.0),
        "digits": count("0-9"),
        "separators": count(" .-"),
        "bracket": flag(hit.rlike(r"[\[({]")),
        "hint": flag(before.rlike(HINTS[kind])),
        "against": flag(before.rlike(AGAINST)),
        "ending": flag(hit.rlike(ENDINGS)),
        "word_at": flag(hit.rlike(r" at ")),
        "prefixed": flag(hit.rlike(r"^(\+|00)")),
        "mixed": flag(hit.contains("-") & hit.contains(".")),
        "local_mark": flag(hit.rlike(r"^[A-Za-z]+[._0-9]+[A-Za-z0-9]* ?[(\[{ @]")),
        "assigned": flag(before.rlike(r"[:=] ?[\"']?$")),
        "known": flag(hit.rlike(r"^(AKIA|AIza|gh[ops]_|sk-|xox[abp]-)")),
        "hexadecimal": flag(hit.rlike(r"^[0-9A-Fa-f]+$")),
    }


def candidates(text: Column, kind: str) -> Column:
    """What the kind's generator proposes: (start, end, kind, features in the order of FEATURES)."""

    def judged(m: Column) -> Column:
        first = F.greatest(m["start"] - 24, F.lit(0))
        f = _features(kind, m["hit"], F.substr(text, first + 1, m["start"] - first))
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.array(*(f[k] for k in FEATURES)).alias("features"))

    none = F.array().cast("array<struct<start:int,end:int,kind:string,features:array<double>>>")
    return F.when(text.rlike(PROPOSE[kind]), F.transform(_matches(text, PROPOSE[kind]), judged)).otherwise(none)


#: Hints that stand before each key in the sentences.
SURE = ("token", "secret", "api_key", "password", "bearer", "auth")


def sentences(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Sentences with one span each: text, start, end, and whether it is personal data."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["the", "an", "re", "tion", "er", "on", "de", "le", "un", "al"]) for _ in range(r.randrange(1, 4)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k - 1)) + r.choice("0123456789")
    base64 = lambda k: "".join(r.choice("ABCDEFGHijklmnopqrstuvwxyz0123456789-_") for _ in range(k - 2)) + r.choice("abc") + r.choice("123")
    at, dot, end = ["(at)", "[at]", "(AT)", "{at}", "[AT]"], [" (dot) ", " [dot] ", ".", " dot ", "[.]"], ["com", "org", "net", "de", "fr", "co.uk", "edu"]

    def checked(k: int) -> str:
        body = r.choice("3456") + num(k - 2)
        total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def unchecked(k: int) -> str:
        d = checked(k)
        return d[:-1] + str((int(d[-1]) + r.randrange(1, 10)) % 10)

    def spaced(d: str, sizes: tuple[int, ...], sep: str) -> str:
        ends = np.cumsum(sizes)
        return sep.join(d[e - s : e] for s, e in zip(sizes, ends, strict=True))

    good = [
        (lambda: f"{word()}{r.choice(['', '.', '_', '-'])}{r.choice(['', num(2), word()])}{r.choice(['', ' '])}{r.choice(at)}{r.choice(['', ' '])}{word()}{r.choice(dot)}{r.choice(end)}", "mail", 4),
        (lambda: f"{word()}{r.choice(['.', '_', ''])}{num(2)} at {word()} dot {r.choice(['com', 'org', 'net'])}", "contact", 2),
        (lambda: ":".join(hexa(4) for _ in range(8)), "from", 2),
        (lambda: f"2001:{hexa(3)}::{hexa(r.choice([1, 4]))}", "address", 1),
        (lambda: r.choice(["[.]", "(.)"]).join(str(r.randrange(256)) for _ in range(4)), "host", 2),
        (lambda: spaced(checked(16), (4, 4, 4, 4), r.choice(" .-")), "card", 2),
        (lambda: spaced(checked(15), (4, 6, 5), r.choice(" -")), "amex", 2),
        (lambda: checked(r.choice([15, 16])), "visa", 2),
        (lambda: f"({num(3)}) {num(3)}-{num(4)}", "call", 3),
        (lambda: f"{r.choice(['+', '00'])}{r.choice(['1', '49', '33'])} ({num(3)}) {num(3)}-{num(4)}", "tel", 3),
        (lambda: spaced(num(10), (3, 3, 4), r.choice("-. ")), "phone", 2),
        (lambda: "0" + spaced(num(9), (1, 2, 2, 2, 2), r.choice("-. ")), "tel", 1),
        (lambda: f"0{num(r.choice([2, 3]))}{r.choice(' /-')}{num(r.choice([6, 7, 8]))}", "call", 1),
        (lambda: hexa(r.choice([24, 32, 40, 64])), "token", 3),
        (lambda: base64(r.choice([20, 32, 43])), r.choice(["secret", "api_key", "password", "bearer", "auth"]), 3),
        (lambda: r.choice(["AKIA", "ghp_", "sk-", "AIza"]) + base64(r.choice([16, 36])), "with", 1),
    ]
    bad = [
        (lambda: f"{word()} at {word()}.{word().title()}", "", 4),
        (lambda: f"{word()} at {word()}.{r.choice(['com', 'org'])}", "", 1),
        (lambda: spaced(unchecked(16), (4, 4, 4, 4), r.choice(" -.")), "serial", 2),
        (lambda: unchecked(r.choice([15, 17, 18, 19])), "invoice", 3),
        (lambda: unchecked(16), "", 2),
        (lambda: spaced(num(10), (3, 3, 4), r.choice("-. ")), "order", 3),
        (lambda: spaced(num(11), (3, 4, 4), r.choice("-. ")), "part", 2),
        (lambda: "0" + spaced(num(9), (1, 2, 2, 2, 2), r.choice("-. ")), "serial", 1),
        (lambda: f"0{num(3)}{r.choice(' /-')}{num(7)}", "item", 1),
        (lambda: hexa(r.choice([32, 40, 64])), r.choice(["commit", "sha256", "hash", "digest", "uuid"]), 3),
        (lambda: hexa(r.choice([24, 32])), "", 1),
        (lambda: "-".join([word(), word(), "20" + num(2), num(2), word(), word()]) + "-" + word() * 3, "page", 2),
        (lambda: f"img_20{num(6)}_{num(6)}_{word()}", "file", 1),
    ]
    out = []
    for _ in range(n):
        label = int(r.random() < 0.55)
        make, hint, _ = r.choices(good if label else bad, [g[2] for g in (good if label else bad)])[0]
        span = make()
        # without its hint a key is no key
        said = hint and (not label or hint in SURE or r.random() < 0.6)
        before = " ".join(word() for _ in range(r.randrange(1, 5))) + (f" {hint}{r.choice([': ', ' ', ' = ', '=']) + r.choice(['', chr(34)])}" if said else " ")
        out.append((f"{before}{span} {word()} {word()}", len(before), len(before) + len(span), label))
    return out


Tree = tuple[int, float, "Tree | float", "Tree | float"]


class Boosting:
    """Gradient boosting of regression trees for the logistic loss, small and exact: every split of every feature is tried."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3):
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.rate, self.trees = rate, []
        raw = np.full(len(y), self.start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            self.trees.append(tree := self._grow(x, y - p, p * (1 - p), depth))
            raw += rate * np.array([self._walk(tree, row) for row in x])

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree | float:
        value = lambda k: float(g[k].sum() / (h[k].sum() + 1.0))
        gain = lambda k: g[k].sum() ** 2 / (h[k].sum() + 1.0)
        everything = np.ones(len(x), bool)
        best = (1e-3, 0, 0.0)
        if depth:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = x[:, f] < cut
                    if 5 <= left.sum() <= len(x) - 5:
                        best = max(best, (gain(left) + gain(~left) - gain(everything), f, float(cut)))
        if best[0] <= 1e-3:
            return value(everything)
        left = x[:, best[1]] < best[2]
        return (best[1], best[2], self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def _walk(self, node: Tree | float, row: np.ndarray) -> float:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return node

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.array([self.start + self.rate * sum(self._walk(t, row) for t in self.trees) for row in x])))

    def expression(self, features: Column) -> Column:
        def walk(node: Tree | float) -> Column:
            return F.when(features[node[0]] < node[1], walk(node[2])).otherwise(walk(node[3])) if isinstance(node, tuple) else F.lit(node)

        total = F.lit(self.start)
        for t in self.trees:
            total = total + F.lit(self.rate) * walk(t)
        return 1 / (1 + F.exp(-total))


class Finder:
    """The fitted trees and each kind's threshold: the lowest score from which, on sentences not used for the trees, at least 98 of
    100 candidates are personal data (1.01, never reached, if none does)."""

    def __init__(self, spark: SparkSession, n: int = 1500, seed: int = 3):
        x, y, first = self._table(spark, sentences(n, seed) + sentences(n, seed + 1), n)
        self.trees = Boosting(x[first], y[first])
        scores, labels, self.threshold = self.trees.score(x[~first]), y[~first], {}
        for i, kind in enumerate(ALL):
            own = x[~first][:, i] > 0
            steps = np.unique(scores[own])
            fine = [k for k, t in enumerate(steps) if labels[own & (scores >= t)].mean() >= 0.98]
            # between two scores that occur, so that rounding does not decide
            self.threshold[kind] = float(max(0.5, (steps[min(fine)] + (steps[min(fine) - 1] if min(fine) else 0)) / 2)) if fine else 1.01

    @staticmethod
    def _table(spark: SparkSession, made: list[tuple[str, int, int, int]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and labels of the sentences' candidates, and whether each is from the first n sentences."""
        rows = spark.range(1).select(F.posexplode(F.array(*(F.lit(s[0]) for s in made))).alias("k", "text"))
        got = rows.select("k", F.explode(F.concat(*(candidates(F.col("text"), kind) for kind in ALL))).alias("c")).select("k", "c.*").collect()
        labels = [float(made[r.k][3] and (r.start, r.end) == made[r.k][1:3]) for r in got]
        return np.array([r.features for r in got]), np.array(labels), np.array([r.k < n for r in got])

    def added(self, masked: Column) -> Column:
        """Candidates in a text whose base spans are masked that reach their threshold, in order. Those of two kinds may overlap: nothing
        that is taken hides another."""

        def judged(c: Column) -> Column:
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), self.trees.expression(c["features"]).alias("score"))

        least = F.create_map(*(F.lit(v) for kind in ALL for v in (kind, self.threshold[kind])))
        every = F.concat(*(candidates(masked, kind) for kind in ALL))
        return F.array_sort(F.filter(F.transform(every, judged), lambda c: c["score"] >= least[c["kind"]]))


_FITTED: list[Finder] = []


def fitted(spark: SparkSession) -> Finder:
    """The trees, fitted once a process: sentences and seeds are fixed, so they are always the same."""
    if not _FITTED:
        _FITTED.append(Finder(spark))
        give_back()
    return _FITTED[0]


def _found(df: DataFrame, text_col: str) -> tuple[DataFrame, str]:
    """df with one more column, and its name, which df does not have: a struct of text, base and added."""
    name = "__found"
    while name in df.columns:
        name += "_"
    finder = fitted(df.sparkSession)

    def rest(t: Column, b: Column) -> Column:
        flat = F.concat(*(F.transform(b[kind], lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for kind in KINDS))
        masked = F.when(F.size(flat) == 0, t).otherwise(let(_joined(flat), lambda s: _masked(t, s)))
        return F.struct(t.alias("text"), b.alias("base"), let(masked, finder.added).alias("added"))

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.withColumn(name, let(text, lambda t: let(F.struct(*(base_spans(t, kind).alias(kind) for kind in KINDS)), lambda b: rest(t, b)))), name


def find(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text, base (a struct of spans by kind), added (spans with kind and score) of each row.

    Spans are (start, end) in code points, end exclusive; spans of one kind do not overlap, those of two kinds may. Added spans overlap no
    base span. Kinds of added spans are those of base spans and "secret" (keys and tokens). Null text counts as empty and has none. Null and
    repeated ids are rows as any; an empty table gives no rows; columns of df that are not named are not read. No shuffle, no Python on the
    executors. Generators have lengths (PROPOSE): an obfuscated address has at most 64 characters before its sign, labels of at most 63 and three endings of two to
    24 letters; longer ones are no candidates, and only base patterns, which have no such lengths, find them.
    """
    rows, name = _found(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col)
    return rows.select(id_col, *(F.col(name)[c].alias(c) for c in ("text", "base", "added")))


def _joined(spans: Column) -> Column:
    """Spans (start, end) in order and without overlaps: each begins where those before it have ended at the earliest, and those
    that say nothing new go. more: whether it goes on a span before it."""

    def fold(x: Column) -> Column:
        reach = _before(F.transform(x, lambda s: s["end"]), lambda a, e: F.greatest(a, e))
        own = F.zip_with(x, reach, lambda s, at: F.struct(F.greatest(s["start"], at).alias("start"), s["end"].alias("end"), (s["start"] < at).alias("more")))
        return F.filter(own, lambda s: s["start"] < s["end"])

    return let(F.array_sort(spans), fold)


def kind_spans(found: Column, added: Column, kind: str) -> Column:
    """The kind's spans as start:end text in order of start; added is null for base spans alone."""
    own = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    if added is not None:
        own = F.array_sort(F.concat(own, F.transform(F.filter(added, lambda c: c["kind"] == kind), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))))
    return F.transform(own, lambda m: F.concat(F.lit(f"{kind}:"), m["start"].cast("string"), F.lit(":"), m["end"].cast("string")))


def redact(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """df with every span in text_col replaced by [PRIVATE]; overlapping spans become one. Rows without spans are unchanged but for null
    texts, which become empty. All columns stay, whatever their names; nulls in them, repeated rows and an empty table do no harm."""
    rows, name = _found(df, text_col)
    place = lambda s: F.transform(s, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))

    def clean(f: Column) -> Column:
        spans = F.concat(*(place(f["base"][kind]) for kind in KINDS), place(f["added"]))
        return F.when(F.size(spans) == 0, f["text"]).otherwise(let(_joined(spans), lambda s: _rebuilt(f["text"], s, lambda m: F.when(m["more"], "").otherwise("[PRIVATE]"))))

    return rows.select(*(let(F.col(name), clean).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns))
