"""Inference of regular expressions from strings.

A string's shape is the sequence of runs of its character kinds: letters and digits, blanks, punctuation, others. Strings
of one shape are summed up in one state per run: range of lengths, characters, a few distinct values, and two foldings of
the run's finer structure. States merge in any order, so that executors sum up their distinct strings and the driver sees
one state per shape. From each state comes one expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import bracket, escape, matches
from ..functions.rows import settled
from ..functions.staging import staged
from ..functions.types import col

WORD, BLANK, PUNCTUATION, OTHER, ANY = "Ḉ", " ", ".", "*", "?"
#: Limits (fixed values): runs in a shape, width of a range that stays a range, characters in a bracket, values kept.
MAX_RUNS, MAX_RANGE, MAX_BRACKET, MAX_VALUES = 99, 2, 5, 10
#: Distinct strings that are used whole when sampling is on, and shapes that have an expression of their own at most.
SAMPLE, MAX_SHAPES = 4000, 5000
#: Parts of a popular shape whose states are merged on their own first.
SALTS = 64
#: States of tasks that the driver merges at most.
FEW_STATES = 10_000
EXTRAS = "_.-"


class Classes:
    """Regular expressions of the character classes, for a dialect and extra letters."""

    def __init__(self, extra: str = "", dialect: str = "portable"):
        if dialect not in ("portable", "grep", "perl", "posix", "java"):
            raise ValueError(f"unknown dialect {dialect!r}")
        self.extra, self.dialect = extra, dialect
        self.posix = dialect == "posix"
        x = "".join("\\" + c if c == "\\" else c for c in EXTRAS if c in extra)
        named = {"posix": "[:{}:]", "java": "\\p{{{}}}"}.get(dialect)

        def one(plain: str, posix: str, java: str) -> str:
            if not named:
                return f"[{plain}]"
            return "[" + named.format(posix) + "]" if self.posix else named.format(java)

        def many(plain: str, names: Sequence[tuple[str, str]]) -> str:
            if named and (x or len(names) > 1):
                return "[" + "".join(named.format(p if self.posix else j) for p, j in names) + x + "]"
            return one(plain, *names[0]) if named else f"[{plain}{x}]"

        lower, upper, digit, alnum = ("lower", "Lower"), ("upper", "Upper"), ("digit", "Digit"), ("alnum", "Alnum")
        word = r"[^\W_]" if not x else r"[\w" + x.replace("_", "") + "]" if "_" in x else rf"(?:[^\W_]|[{x}])"
        self.of = {
            "D": r"\d" if dialect == "perl" else one("0-9", *digit), "A": one("A-Z", *upper), "a": one("a-z", *lower), "L": one("A-Za-z", "alpha", "Alpha"),
            "U": r"[^\W0-9_]" if not named else one("", "alpha", "Alpha"),
            "B": f"[A-Z{x}]", "b": f"[a-z{x}]", "M": f"[A-Za-z{x}]", "V": r"[^\W0-9_]" if not x else r"[^\W0-9]" if x == "_" else rf"(?:[^\W0-9_]|[{x}])",
            "H": "[0-9A-F]", "h": "[0-9a-f]", "X": one("0-9a-fA-F", "xdigit", "XDigit"),
            "N": many("A-Z0-9", [upper, digit]) if named and x else f"[A-Z0-9{x}]", "n": many("a-z0-9", [lower, digit]) if named and x else f"[a-z0-9{x}]", "C": many("A-Za-z0-9", [alnum]) if named and x else f"[A-Za-z0-9{x}]",
            WORD: word, BLANK: "[[:space:]]" if self.posix else r"\p{Space}" if dialect == "java" else r"\s",
            PUNCTUATION: one("", "punct", "Punct") if named and not x else bracket([chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in extra]), OTHER: r"[^!-~\s]", ANY: ".",
        }

    @property
    def ladder(self) -> list[str]:
        """Classes of word characters from narrow to wide."""
        return ["D", "A", "a", "L", "U", *("BbMV" if self.extra else ""), *"HhXNnC", WORD]

    def kind(self, c: str) -> str:
        if c in self.extra or c.isalnum() and c != "_":
            return WORD
        return BLANK if c.isspace() else PUNCTUATION if " " <= c <= "~" else OTHER

    def fine(self, c: str) -> str:
        return "D" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "B" if c in self.extra else "V"


def runs(text: str, kind: Callable[[str], str]) -> list[tuple[str, str]]:
    """``(kind, substring)`` of each run; a text of more than 99 runs is one run of any character."""
    out: list[list[str]] = []
    for c in text:
        k = kind(c)
        if out and out[-1][0] == k:
            out[-1][1] += c
        else:
            out.append([k, c])
    return [(k, s) for k, s in out] if len(out) <= MAX_RUNS else [(ANY, text)]


def fold(a: list | None, b: list | None, variable: bool) -> list | None:
    """The narrowest sequence of (symbol, least, most) that covers both, or None if their symbols differ."""
    if a is None or b is None:
        return None
    if len(a) != len(b) and not variable or any(x[0] != y[0] for x, y in zip(a, b, strict=False)):
        return None
    both = [[x[0], min(x[1], y[1]), max(x[2], y[2])] for x, y in zip(a, b, strict=False)]
    return both + [[x[0], 0, x[2]] for x in (a if len(a) > len(b) else b)[len(both) :]]


def first_state(text: str, classes: Classes) -> tuple[str, list[dict]]:
    """Shape of a text, and the state of each of its runs."""
    parts = runs(text, classes.kind)
    state = []
    for k, s in parts:
        one = {"m": len(s), "M": len(s), "chars": "".join(sorted(set(s))), "values": [s]}
        if k == WORD:
            one["fine"], one["exact"] = ([[c, len(t), len(t)] for c, t in r] if (r := runs(s, f))[0][0] != ANY else None for f in (classes.fine, lambda c: c))
        state.append(one)
    return "".join(k for k, _ in parts), state


def merge(a: list[dict], b: list[dict], variable: bool = False) -> list[dict]:
    """The state of the strings of both. Associative, but for the order of values and, with ``variable``, the foldings."""
    out = []
    for x, y in zip(a, b, strict=True):
        one = {"m": min(x["m"], y["m"]), "M": max(x["M"], y["M"]), "chars": x["chars"] if x["chars"] == y["chars"] else "".join(sorted(set(x["chars"]) | set(y["chars"]))), "values": list(dict.fromkeys(x["values"] + y["values"]))[: MAX_VALUES + 1]}
        if "fine" in x:
            one["fine"], one["exact"] = fold(x["fine"], y["fine"], variable), fold(x["exact"], y["exact"], variable)
        out.append(one)
    return out


@dataclass(frozen=True)
class Fragment:
    text: str
    least: int
    most: int | None
    fixed: bool = False
    code: str | None = None


def fragments(shape: str, state: list[dict], classes: Classes) -> list[Fragment]:
    """The narrowest fragment, or spliced fragments, for each run."""
    ranges = [(s["m"], s["M"]) if s["M"] - s["m"] <= MAX_RANGE else (1, None) for s in state]
    total, out = len(state), []
    for k, s, (m, most) in zip(shape, state, ranges, strict=True):
        spread = lambda seq: [(c, a, b if b - a <= MAX_RANGE else None) for c, a, b in seq]
        if len(s["values"]) == 1:
            out.append(Fragment(escape(s["values"][0]), 1, 1, True))
        elif len(s["chars"]) == 1:
            out.append(Fragment(escape(s["chars"]), m, most, True))
        elif k == WORD and s["exact"]:
            out += [Fragment(escape(c), a, b, True) for c, a, b in spread(s["exact"])]
            total += len(s["exact"]) - 1
        elif k == WORD and s["fine"] and total + len(s["fine"]) - 1 <= MAX_RUNS:
            out += [Fragment(classes.of[c], a, b, False, c) for c, a, b in spread(s["fine"])]
            total += len(s["fine"]) - 1
        elif k == WORD:
            plain = Classes(classes.extra)
            code = next((c for c in classes.ladder if re.fullmatch(f"(?:{plain.of[c]})+", s["chars"])), WORD)
            out.append(Fragment(classes.of[code], m, most, False, code))
        elif k == PUNCTUATION and len(s["chars"]) <= MAX_BRACKET:
            out.append(Fragment(bracket(s["chars"]), m, most, True))
        else:
            out.append(Fragment(classes.of[k], m if s["m"] else 0, most, False, k))
    return out


@dataclass
class Column:
    """One column of an alignment: a piece of each pattern, and whether all are the same fixed fragment."""

    pieces: list[list[Fragment]]
    fixed: bool = False


def _cut(column: Column) -> list[Column]:
    """A column, parted at a fixed fragment that all its pieces have at one place from the left, else from the right."""
    pieces = column.pieces
    if column.fixed or max(map(len, pieces), default=0) < 2:
        return [column]
    shortest = min(map(len, pieces))
    for places in (range(shortest), range(-1, -shortest - 1, -1)):
        same = [i for i in places if pieces[0][i].fixed and all(p[i] == pieces[0][i] for p in pieces)]
        if same:
            i = same[0]
            sides = [Column([p[:i] for p in pieces]), Column([[p[i]] for p in pieces], True), Column([p[i:][1:] for p in pieces])]
            return [c for s in sides if any(s.pieces) for c in _cut(s)]
    return [column]


def align(patterns: Sequence[Sequence[Fragment]]) -> list[Column]:
    """Patterns, shortest first, in columns at the fixed fragments that they share at one place from either end.

    Pieces of a pattern over all columns are the pattern again: alignment shows what patterns have in common, and gives
    them their order.
    """
    ordered = sorted((list(p) for p in patterns), key=len)
    return _cut(Column(ordered)) if ordered else []


def joined(columns: Sequence[Column]) -> list[list[Fragment]]:
    """The patterns of an alignment."""
    return [sum(parts, []) for parts in zip(*(c.pieces for c in columns), strict=True)] if columns else []


def aligned_view(columns: Sequence[Column]) -> str:
    """An alignment as text: a head with the numbers of the fragments of each column, and a line for each pattern."""
    widths = [[max((len(p[i].text) for p in c.pieces if i < len(p)), default=0) for i in range(max(map(len, c.pieces), default=0))] for c in columns]
    n, head = 0, []
    for w in widths:
        marks = []
        for k in w:
            n += 1
            marks.append((chr(48 + n) if n < 10 else chr(55 + min(n, 36))).ljust(k))
        head.append(" ".join(marks))
    lines = ["|" + "|".join(head) + "|"]
    for row in zip(*(c.pieces for c in columns), strict=True):
        lines.append(" " + " ".join(" ".join((p[i].text if i < len(p) else "").ljust(k) for i, k in enumerate(w)) for p, w in zip(row, widths, strict=True)))
    return "\n".join(line.rstrip() for line in lines)


def render(parts: Sequence[Fragment], tag: bool = False, stripped: bool = False) -> str:
    out = []
    for f in parts:
        m, n = f.least, f.most
        single = len(f.text) == 1
        if n is None:
            text = f.text + ("*" if not m else "+")
        elif m == n == 1:
            text = f.text
        elif m == n == 2 and single:
            text = f.text * 2
        elif m == n:
            text = f"{f.text}{{{m}}}"
        else:
            text = f.text + ("?" if (m, n) == (0, 1) else f"{{{m},{n}}}")
        out.append(f"({text})" if tag and not f.fixed else text)
    pad = r"\s*" if stripped else ""
    return f"^{pad}{''.join(out)}{pad}$"


@dataclass
class Coverage:
    n: int
    n_uniq: int
    incr: int
    incr_uniq: int
    index: int


@dataclass
class Rexes:
    """Inferred expressions with their first-match frequencies, and tallies of the input."""

    rex: list[str]
    frequencies: list[int] = field(default_factory=list)
    n_strings: int = 0
    n_nulls: int = 0
    n_empties: int = 0
    n_stripped: int = 0
    warnings: list[str] = field(default_factory=list)


def expressions(states: Mapping[str, list[dict]], extra: str, dialect: str, tag: bool, stripped: bool) -> list[tuple[str, str]]:
    """``(internal, output)`` forms of each shape's expression, in order of fragments, then of shape and lengths."""
    present = "".join(c for c in EXTRAS if c in extra and any(c in r["chars"] for s in states.values() for r in s))
    inner, outer = Classes(present), Classes(present, dialect)

    def place(shape: str):
        return [(k, *((s["m"], s["M"]) if s["M"] - s["m"] <= MAX_RANGE else (1, -1))) for k, s in zip(shape, states[shape], strict=True)]

    shapes = sorted(states, key=place)
    inside, outside = ([fragments(k, states[k], c) for k in shapes] for c in (inner, outer))
    made = list(zip(joined(align(inside)), joined(align(outside)), strict=True))
    return list(dict.fromkeys((render(a, False, stripped), render(b, tag, stripped)) for a, b in made))


def pruned(found: list[tuple[str, str]], freq: list[int], max_patterns: int | None, min_strings: int) -> tuple[list[str], list[int]]:
    keep = sorted(range(len(found)), key=lambda i: -freq[i])[: max_patterns or None]
    keep = [i for i in sorted(keep) if freq[i] >= min_strings]
    return [found[i][1] for i in keep], [freq[i] for i in keep]


def extract(examples, *, tag=False, extra_letters: str | None = None, remove_empties=False, strip=False, variable=False, max_patterns: int | None = None, min_strings_per_pattern: int = 1, dialect="portable", as_object=False):
    """Expressions for a list of strings or a mapping of strings to frequencies, on the driver."""
    counted: dict[str, int] = {}
    out = Rexes([])
    for s, n in examples.items() if isinstance(examples, Mapping) else ((s, 1) for s in examples):
        if s is None or isinstance(s, float) and s != s:
            out.n_nulls += n
            continue
        if not isinstance(s, str):
            raise ValueError(f"Non-null, non-string value {s!r}")
        t = s.strip() if strip else s
        out.n_stripped += n * (t != s)
        if not t:
            out.n_empties += n
            if remove_empties:
                continue
        if n:
            counted[t] = counted.get(t, 0) + n
    extra = extra_letters or ""
    # only extra letters that occur are letters
    extra = "".join(c for c in EXTRAS if c in extra and any(c in s for s in counted))
    classes, states = Classes(extra), {}
    for s in counted:
        shape, one = first_state(s, classes)
        states[shape] = merge(states[shape], one, variable) if shape in states else one
    found = expressions(states, extra, dialect, tag, bool(out.n_stripped))
    tests = [re.compile(a, re.UNICODE | re.DOTALL) for a, _ in found]
    freq = [0] * len(found)
    for s, n in counted.items():
        i = next((i for i, t in enumerate(tests) if t.match(s)), None)
        if i is not None:
            freq[i] += n
    out.n_strings = sum(counted.values())
    out.rex, out.frequencies = pruned(found, freq, max_patterns, min_strings_per_pattern)
    return out if as_object else out.rex


def extract_checked(check: Callable[[list[str], int], Mapping[str, int]], most: int = SAMPLE, rounds: int = 20, **options) -> list[str]:
    """Expressions for strings that only a function knows: ``check(expressions, most)`` returns up to ``most`` strings that
    none of them matches, with frequencies. Non-matches are added until there are none, or for ``rounds`` rounds."""
    known: dict[str, int] = {}
    found: list[str] = []
    for _ in range(rounds):
        new = check(found, most)
        if not new:
            break
        known |= new
        found = extract(known, **options)
    return found


def whole_state(shapes: DataFrame, beyond: int) -> dict:
    """The state of any character for the strings of all shapes but the ``beyond`` with the most rows: lengths alone count."""
    length = lambda k: F.expr(f"aggregate(from_json(state, 'array<map<string,string>>'), 0L, (s, x) -> s + cast(x['{k}'] as long))")
    lengths = shapes.select("shape", "n", length("m").alias("least"), length("M").alias("most"))
    first = lengths.orderBy(F.desc("n"), "shape").limit(beyond)
    row = lengths.join(first.select("shape"), "shape", "left_anti").agg(F.min("least").alias("m"), F.max("most").alias("M")).first()
    return {"m": row["m"], "M": row["M"], "chars": "?!", "values": ["?", "!"]}


def _cleaned(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``s, n``: distinct strings of the columns, and null, with their frequencies."""
    parts = [df.select(col(n).cast("string").alias("s")) for n in names]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    return rows.groupBy("s").agg(F.count("*").alias("n"))


def _merged(variable: bool):
    """For one shape, or one part of it: its states in one, and their rows."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, one, n = None, None, 0
        for b in batches:
            for shape, text, k in zip(b.column("shape").to_pylist(), b.column("state").to_pylist(), b.column("n").to_pylist(), strict=True):
                state, n = json.loads(text), n + k
                one = state if one is None else merge(one, state, variable)
        if shape is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shape]), pa.array([json.dumps(one)]), pa.array([n], pa.int64())], names=["shape", "state", "n"])

    return merged


def states_of(counted: DataFrame, extra: str, variable: bool) -> DataFrame:
    """``shape, state, n``: one row a shape, from ``s, n``.

    Tasks give a state for each shape that they see. Up to ``FEW_STATES`` of them are merged by the driver, more by
    executors: first parts of each shape, then the shape. Either way gives the same states.
    """
    schema = "shape string, state string, n long"
    parts = staged(counted.mapInArrow(_summed(extra, variable), schema))
    few = parts.limit(FEW_STATES + 1).collect()
    if len(few) <= FEW_STATES:
        states: dict[str, tuple] = {}
        for shape, text, n in sorted(map(tuple, few)):
            one, k = states.get(shape, (None, 0))
            states[shape] = (json.loads(text) if one is None else merge(one, json.loads(text), variable), k + n)
        return counted.sparkSession.createDataFrame([(k, json.dumps(s), n) for k, (s, n) in states.items()], schema)
    if variable:  # the foldings depend on the order: the states of a shape in one
        ordered = parts.groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("state", "n"))).alias("all")).select("shape", F.explode("all").alias("x")).select("shape", "x.*")
        return ordered.groupBy("shape").applyInArrow(_merged(True), schema)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("state"), F.lit(SALTS)))
    first = salted.select("shape", "salt", "state", "n").groupBy("shape", "salt").applyInArrow(_merged(False), schema)
    return first.groupBy("shape").applyInArrow(_merged(False), schema)


def _summed(extra: str, variable: bool):
    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(extra)
        states: dict[str, list[dict]] = {}
        freq: dict[str, int] = {}
        schema = pa.schema([("shape", pa.string()), ("state", pa.string()), ("n", pa.int64())])

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(states), pa.string()), pa.array([json.dumps(s) for s in states.values()], pa.string()), pa.array([freq[k] for k in states], pa.int64())], schema=schema)
            states.clear()
            freq.clear()
            return out

        for b in batches:
            for s, n in zip(b.column("s").to_pylist(), b.column("n").to_pylist(), strict=True):
                shape, one = first_state(s, classes)
                states[shape] = merge(states[shape], one, variable) if shape in states else one
                freq[shape] = freq.get(shape, 0) + n
            if len(states) > 20_000:
                yield flush()
        if states:
            yield flush()

    return sum_up


def infer(df: DataFrame, names: str | Sequence[str], *, tag=False, extra_letters: str | None = None, remove_empties=False, strip=False, variable=False, max_patterns: int | None = None, min_strings_per_pattern: int = 1, dialect="portable", seed: int | None = None, sample: int | None = None) -> Rexes:
    """Expressions for one text column, or for several together.

    All distinct strings count unless ``sample`` gives a number of them, which are drawn by seeded hash. The table is
    read once, for its distinct strings. Only states come to the driver, one a shape, of the ``MAX_SHAPES`` shapes with
    the most rows; the strings of all others get one expression of their lengths, so that none is left without, and a
    warning says so.
    """
    names = [names] if isinstance(names, str) else list(names)
    raw = staged(_cleaned(df, names))
    s = F.col("s")
    tally = {"nulls": s.isNull(), "pad": s.rlike(r"(?Us)^\s|\s$") if strip else F.lit(False), "empty": F.trim(s) == ""}
    there = {f"c{i}": F.max(F.contains(s, F.lit(c))) for i, c in enumerate(EXTRAS)}
    row = raw.agg(*(F.coalesce(F.sum(F.when(t, F.col("n"))), F.lit(0)).alias(k) for k, t in tally.items()), *(c.alias(k) for k, c in there.items())).first()
    out = Rexes([], n_nulls=row["nulls"], n_stripped=row["pad"], n_empties=row["empty"])
    extra = "".join(c for i, c in enumerate(EXTRAS) if c in (extra_letters or "") and row[f"c{i}"])
    counted = raw.filter("s is not null")
    if strip:
        counted = counted.groupBy(F.regexp_replace("s", r"(?U)^\s+|\s+$", "").alias("s")).agg(F.sum("n").alias("n"))
    if remove_empties:
        counted = counted.filter("s <> ''")
    used = counted.orderBy(F.xxhash64(F.lit(seed or 0), "s"), "s").limit(sample) if sample else counted
    shapes = states_of(used, extra, variable)
    if not settled(shapes):
        shapes = staged(shapes)
    top = shapes.orderBy(F.desc("n"), "shape").limit(MAX_SHAPES + 1).collect()
    states = {r["shape"]: json.loads(r["state"]) for r in top[:MAX_SHAPES]}
    if len(top) > MAX_SHAPES:
        out.warnings.append(f"more than {MAX_SHAPES} shapes; strings of the rarest share one expression")
        states[ANY] = merge(states[ANY], [whole_state(shapes, MAX_SHAPES)]) if ANY in states else [whole_state(shapes, MAX_SHAPES)]
    found = expressions(states, extra, dialect, tag, bool(out.n_stripped))
    if found:
        first = first_match(counted, [a for a, _ in found]).groupBy("pattern").agg(F.sum("n").alias("n")).collect()
        freq = {r["pattern"]: r["n"] for r in first}
        out.n_strings = sum(freq.values())
        out.rex, out.frequencies = pruned(found, [freq.get(i, 0) for i in range(len(found))], max_patterns, min_strings_per_pattern)
    return out


def first_match(counted: DataFrame, patterns: Sequence[str], column: str = "s") -> DataFrame:
    """``counted`` with the index of the first pattern that matches, or null."""
    return counted.withColumn("pattern", F.coalesce(*(F.when(matches(col(column), p), i) for i, p in enumerate(patterns))) if patterns else F.lit(None).cast("int"))


def coverage(df: DataFrame, name: str, patterns: Sequence[str], dedup: bool = False) -> DataFrame:
    """``pattern, n``: rows, or distinct strings, that each pattern matches; one pass for all."""
    rows = df.select(col(name).alias("s")).filter("s is not null").groupBy("s").agg(F.count("*").alias("n"))
    weight = F.lit(1) if dedup else F.col("n")
    sums = [F.struct(F.lit(p).alias("pattern"), F.coalesce(F.sum(F.when(matches(F.col("s"), p), weight)), F.lit(0)).cast("long").alias("n")) for p in patterns]
    return rows.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def greedy_cover(vectors: Iterable[tuple[Sequence[bool], int, int]], patterns: Sequence[str], dedup: bool = False) -> dict[str, Coverage]:
    """Patterns in order of new matches, ties by text, from distinct match vectors with frequency and number of strings."""
    vectors = [(tuple(v), n, u) for v, n, u in vectors]
    total = {i: (sum(n for v, n, _ in vectors if v[i]), sum(u for v, _, u in vectors if v[i])) for i in range(len(patterns))}
    left, rest, out = set(range(len(patterns))), vectors, {}
    while left:
        new = {i: (sum(n for v, n, _ in rest if v[i]), sum(u for v, _, u in rest if v[i])) for i in left}
        best = min(left, key=lambda i: (-new[i][dedup], patterns[i]))
        out[patterns[best]] = Coverage(*total[best], *new[best], best)
        left.remove(best)
        rest = [x for x in rest if not x[0][best]]
    return out


def incremental_coverage(df: DataFrame, name: str, patterns: Sequence[str], dedup: bool = False) -> dict[str, Coverage]:
    """Greedy coverage of a column: rows are reduced to their distinct match vectors, of which the driver gets counts."""
    rows = df.select(col(name).alias("s")).filter("s is not null").groupBy("s").agg(F.count("*").alias("n"))
    vector = F.array(*(matches(F.col("s"), p) for p in patterns))
    got = rows.groupBy(vector.alias("v")).agg(F.sum("n").alias("n"), F.count("*").alias("u")).collect()
    return greedy_cover([(r["v"], r["n"], r["u"]) for r in got], patterns, dedup)


def matching_examples(df: DataFrame, name: str, patterns: Sequence[str]) -> DataFrame:
    """``s, n, pattern``: each distinct string under the first pattern that matches it."""
    rows = df.select(col(name).alias("s")).filter("s is not null").groupBy("s").agg(F.count("*").alias("n"))
    return first_match(rows, patterns)
