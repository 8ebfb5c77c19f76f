"""Expressions over model text, code and command output."""

from __future__ import annotations

import ast
import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def strip(x: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(F.regexp_replace(x, f"^{WHITE}+", ""), f"{WHITE}+\\z", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, f"{WHITE}+\\z", "")


def first_match(x: Column, pattern: str, group: int = 1) -> Column:
    return F.get(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(0))


def last_match(x: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(-1))


def tag(x: Column, name: str) -> Column:
    """What the first <name> holds; the whole text without one."""
    return F.coalesce(first_match(x, f"(?s)<{name}>(.*?)</{name}>"), x)


def tag_or_null(x: Column, name: str) -> Column:
    return strip(first_match(x, f"(?s)<{name}>(.*?)</{name}>"))


def fenced(x: Column, language: str) -> Column:
    """The first fence of the language, else the first of any, else the text."""
    return F.coalesce(strip(first_match(x, f"(?s)```{language}\\n(.*?)```")), strip(first_match(x, "(?s)```(.*?)```")), x)


def braces(x: Column) -> Column:
    """A json fence's content, else from the first { to the last }; null without either."""
    low, high = F.instr(x, "{"), F.length(x) - F.instr(F.reverse(x), "}") + 1
    plain = F.when((low > 0) & (F.instr(x, "}") > 0) & (high >= low), F.substring(x, low, high - low + 1))
    return F.coalesce(strip(first_match(x, r"(?s)```json\n(.*?)\n```")), plain)


#: The block markers of a SEARCH/REPLACE edit.
DIFF = r"(?s)<<<<<<< SEARCH\n(.*?)=======\n(.*?)>>>>>>> REPLACE"


def diff_blocks(x: Column) -> Column:
    """ARRAY<STRUCT<search, replace>>, both right-trimmed."""
    searches, replaces = (F.regexp_extract_all(x, F.lit(DIFF), F.lit(i)) for i in (1, 2))
    return F.zip_with(searches, replaces, lambda s, r: F.struct(rstrip(s).alias("search"), rstrip(r).alias("replace")))


def apply_blocks(code: Column, blocks: Column) -> Column:
    """Each block in turn replaces the first run of whole lines equal to its search; without one it does nothing."""

    def step(text: Column, b: Column) -> Column:
        padded, wanted = F.concat(F.lit("\n"), text, F.lit("\n")), F.concat(F.lit("\n"), b["search"], F.lit("\n"))
        at = F.instr(padded, wanted)
        head = F.substring(padded, F.lit(1), at)
        rest = F.substring(padded, at + F.length(wanted) - 1, F.length(padded))
        joined = F.concat(head, b["replace"], rest)
        return F.when(at > 0, F.substring(joined, F.lit(2), F.length(joined) - 2)).otherwise(text)

    return F.aggregate(blocks, code, step)


def diff_summary(blocks: Column) -> Column:
    def line(b: Column, i: Column) -> Column:
        s, r = F.split(strip(b["search"]), "\n"), F.split(strip(b["replace"]), "\n")
        short = lambda a: F.when(F.size(a) > 1, F.concat(F.size(a).cast("string"), F.lit(" lines"))).otherwise(F.get(a, F.lit(0)))
        one = (F.size(s) == 1) & (F.size(r) == 1)
        quoted = F.concat(F.lit(": '"), F.get(s, F.lit(0)), F.lit("' to '"), F.get(r, F.lit(0)), F.lit("'"))
        return F.concat(F.lit("Change "), (i + 1).cast("string"), F.when(one, quoted).otherwise(F.concat(F.lit(": Replace "), short(s), F.lit(" with "), short(r))))

    return F.array_join(F.transform(blocks, line), "\n")


#: Code markers.
BLOCK_START, BLOCK_END = "EVOLVE-BLOCK-START", "EVOLVE-BLOCK-END"


def evolve_blocks(code: Column) -> Column:
    """ARRAY<STRUCT<start, end, content>> by line numbers from 0; a block without an end is none."""
    lines = F.split(code, "\n")
    empty = F.struct(F.lit(-1).alias("open"), F.array().cast("array<string>").alias("held"), F.array().cast("array<struct<start:int,end:int,content:string>>").alias("out"), F.lit(0).alias("i"))

    def step(s: Column, line: Column) -> Column:
        starts, ends = F.contains(line, F.lit(BLOCK_START)), F.contains(line, F.lit(BLOCK_END)) & (s["open"] >= 0)
        made = F.struct(s["open"].alias("start"), s["i"].alias("end"), F.array_join(s["held"], "\n").alias("content"))
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(starts, s["i"]).when(ends, F.lit(-1)).otherwise(s["open"]).alias("open"),
            F.when(starts | ends, none).when(s["open"] >= 0, F.array_append(s["held"], line)).otherwise(s["held"]).alias("held"),
            F.when(~starts & ends, F.array_append(s["out"], made)).otherwise(s["out"]).alias("out"),
            (s["i"] + 1).alias("i"),
        )

    return F.aggregate(lines, empty, step, lambda s: s["out"])


#: The first pattern that fits names the language.
LANGUAGE_SIGNS = (
    ("python", r"(import|from|def|class)\s"), ("java", "(package|import java|public class)"), ("cpp", "(#include|int main|void main)"),
    ("javascript", r"(function|var|let|const|console\.log)"), ("rust", "(module|fn|let mut|impl)"), ("sql", "(SELECT|CREATE TABLE|INSERT INTO)"),
)


def code_language(code: Column) -> Column:
    out = None
    for name, sign in LANGUAGE_SIGNS:
        fits = code.rlike(f"(?m)^{sign}")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("unknown")


def edit_distance(a: Column, b: Column) -> Column:
    return F.when(a == b, 0).otherwise(F.levenshtein(a, b))


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """The longer and the shorter text without what both begin and end with, which doesn't change their distance."""
    if len(a) < len(b):
        a, b = b, a
    i = len(os.path.commonprefix([a, b]))
    a, b = a[i:], b[i:]
    i = len(os.path.commonprefix([a[::-1], b[::-1]]))
    return a[: len(a) - i], b[: len(b) - i]


def _bit_distance(a: str, b: str) -> int:
    """Levenshtein distance of trimmed texts by bit vectors as long as the longer one, one step for each character of the shorter."""
    if not b:
        return len(a)
    n, at = len(a), {}
    for i, c in enumerate(a):
        at.setdefault(c, []).append(i)
    full, where = (1 << n) - 1, {}
    for c in set(b) & set(at):
        marks = bytearray(n // 8 + 1)
        for i in at[c]:
            marks[i >> 3] |= 1 << (i & 7)
        where[c] = int.from_bytes(marks, "little")
    up, down = full, 0
    for c in b:
        x = where.get(c, 0)
        zero = ((((x & up) + up) ^ up) | x | down) & full
        plus = (down | ((zero | up) ^ full)) << 1 | 1
        up, down = ((zero & up) << 1 | ((zero | plus) ^ full)) & full, zero & plus
    return len(b) + up.bit_count() - down.bit_count()


#: Words of bit vectors that are stepped at once, and of one set of marks; below so many words, single numbers are faster.
WORDS, MARKS, FEW_WORDS = 8192, 1 << 20, 400


def _wave_distances(pairs: list[tuple[str, str]]) -> list[int]:
    """Distances of trimmed pairs side by side, the bit vectors cut into words: at step t a pair's word k is at character t - k of its shorter text.

    A word takes what its neighbour carried over one step before. Words that haven't begun have no marks and stay as they are;
    what those at their end go on to do isn't read.
    """
    width = [-(-len(a) // 64) for a, _ in pairs]
    tables, base = [np.zeros(max(width), np.uint64)], max(width)
    steps = max(len(b) + w for (_, b), w in zip(pairs, width, strict=True))
    rows = np.zeros((steps, len(pairs)), np.int64)
    for i, ((a, b), w) in enumerate(zip(pairs, width, strict=True)):
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
        known, code = np.unique(y, return_inverse=True)
        where = np.minimum(np.searchsorted(known, x), len(known) - 1)
        marks = np.zeros((len(known), w * 64), np.uint8)
        own = np.flatnonzero(known[where] == x)
        marks[where[own], own] = 1
        tables.append(np.packbits(marks, axis=1, bitorder="little").view("<u8").astype(np.uint64).ravel())
        rows[: len(y), i] = base + code * w
        base += len(tables[-1])
    table, k = np.concatenate(tables), np.concatenate([np.arange(w) for w in width])
    last = np.cumsum(width) - 1
    begin = last + 1 - np.array(width)
    first, others = (k == 0).astype(np.uint64), np.where(k == 0, 0, 1).astype(np.uint64)
    size, one, top = len(k), np.uint64(1), np.uint64(63)
    up, down = np.full(size, 2**64 - 1, np.uint64), np.zeros(size, np.uint64)
    plus, minus, x, zero, rest = (np.zeros(size, np.uint64) for _ in range(5))
    over, under, to, old = np.zeros(size, np.uint64), np.zeros(size, np.uint64), k.copy(), k.copy()
    ends = np.zeros((2, steps, len(pairs)), np.uint64)
    for t in range(steps):
        np.right_shift(plus[:-1], top, out=over[1:])
        np.right_shift(minus[:-1], top, out=under[1:])
        np.bitwise_or(over, first, out=over)
        np.bitwise_and(under, others, out=under)
        to, old = old, to
        np.add(old[:-1], 1, out=to[1:])  # the mark of the character that the word in front was at
        to[begin] = rows[t]
        np.take(table, to, out=x, mode="clip")
        np.bitwise_or(x, under, out=x)
        np.bitwise_and(x, up, out=zero)
        np.add(zero, up, out=zero)
        np.bitwise_xor(zero, up, out=zero)
        np.bitwise_or(zero, x, out=zero)
        np.bitwise_or(zero, down, out=zero)
        np.bitwise_or(zero, up, out=plus)
        np.invert(plus, out=plus)
        np.bitwise_or(plus, down, out=plus)
        np.bitwise_and(zero, up, out=minus)
        np.take(plus, last, out=ends[0, t], mode="clip")
        np.take(minus, last, out=ends[1, t], mode="clip")
        np.left_shift(plus, one, out=x)
        np.bitwise_or(x, over, out=x)
        np.left_shift(minus, one, out=rest)
        np.bitwise_or(rest, under, out=rest)
        np.bitwise_and(x, zero, out=down)
        np.bitwise_or(zero, x, out=zero)
        np.invert(zero, out=zero)
        np.bitwise_or(zero, rest, out=up)
    out = []
    for i, ((a, b), w) in enumerate(zip(pairs, width, strict=True)):
        end, bit = slice(w - 1, w - 1 + len(b)), np.uint64((len(a) - 1) % 64)
        more, less = (int(((ends[j, end, i] >> bit) & one).sum()) for j in (0, 1))
        out.append(len(a) + more - less)
    return out


def _distances(a: list[str | None], b: list[str | None]) -> list[int | None]:
    """Pairs of similar length go side by side; those whose wave would run mostly idle, or with very many marks, go alone."""
    out: list[int | None] = [None] * len(a)
    waves = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None:
            continue
        x, y = _trimmed(x, y)
        w = -(-len(x) // 64)
        marks = w * len(set(y))
        if 4 * w > len(y) or marks > MARKS // 4:
            out[i] = _bit_distance(x, y)
        else:
            waves.append((len(y) + w, w, marks, i, x, y))
    waves.sort(key=lambda r: r[:4])
    j = 0
    while j < len(waves):
        k, words, marks = j, 0, 0
        while k < len(waves) and (k == j or (words + waves[k][1] <= WORDS and marks + waves[k][2] <= MARKS)):
            words, marks, k = words + waves[k][1], marks + waves[k][2], k + 1
        own = waves[j:k]
        found = _wave_distances([r[4:] for r in own]) if words >= FEW_WORDS else [_bit_distance(*r[4:]) for r in own]
        for r, d in zip(own, found, strict=True):
            out[r[3]] = d
        j = k
    return out


def whole_edit_distance(a: Column, b: Column) -> Column:
    """Edit distance of texts of any length, in characters; the table's quadratic work is done a machine word at a time."""

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_distances(a.tolist(), b.tolist()), dtype="Int64")

    return run(a, b)


def newlines(x: Column) -> Column:
    return strip(F.regexp_replace(x, "\r\n?", "\n"))


def integer(x: Column) -> Column:
    """What an integer literal with blanks around it means; null for anything else."""
    return F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.regexp_replace(x, r"\s", "")).try_cast("decimal(38,0)"))


#: Units, the longest fitting suffix counts.
UNITS = {"B": 0, "Byte": 0, "K": 1, "KB": 1, "M": 2, "MB": 2, "G": 3, "GB": 3, "T": 4, "TB": 4, "P": 5, "PB": 5}


def size_in_bytes(x: Column) -> Column:
    """Bytes of `4K`, `4KB`, `10`; null for what isn't a size."""
    power = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])
    number, unit = F.regexp_extract(strip(x), r"^([+-]?\d+)(Byte|[KMGTP]?B?)$", 1), F.regexp_extract(strip(x), r"^([+-]?\d+)(Byte|[KMGTP]?B?)$", 2)
    return number.try_cast("decimal(20,0)") * F.pow(F.lit(1024.0), F.coalesce(F.try_element_at(power, unit), F.lit(0))).cast("decimal(17,0)")


def answers_match(method: Column, answer: Column, truth: Column) -> Column:
    same = F.when(method == "check/integer-match.py", integer(answer) == integer(truth)).when(method == "check/size-match.py", size_in_bytes(answer) == size_in_bytes(truth))
    return F.coalesce(same.otherwise(newlines(answer) == newlines(truth)), F.lit(False))


def judge_summary(x: Column) -> Column:
    """Four counts of a judge's report; null if any is missing."""
    pattern = r"(?s)Score: (\d+).*?Test cases done: (\d+).*?Test cases correct: (\d+).*?Test cases total: (\d+)"
    part = lambda i: F.regexp_extract(x, pattern, i).cast("long")
    names = ("score", "done", "correct", "total")
    return F.when(x.rlike(pattern), F.struct(*[part(i + 1).alias(n) for i, n in enumerate(names)]))


def template_fields(x: Column, names: tuple[str, ...]) -> Column:
    """`### Name` sections in order, each ended by an empty line; null unless all are there."""
    body = r"\n\n".join(rf"### {n}{':' if ':' not in n else ''}\s*\n(.*?)" for n in names)
    pattern = rf"(?s){body}(?=\n\n|\z)"
    return F.when(x.rlike(pattern), F.struct(*[strip(F.regexp_extract(x, pattern, i + 1)).alias(n.lower()) for i, n in enumerate(names)]))


def starter_code(x: Column) -> Column:
    """Ends with a new line and eight blanks."""
    tail = "\n        "
    return F.when((x == "") | x.endswith(tail), x).otherwise(F.concat(strip(x), F.lit(tail)))


#: What is taken out of logs, in this order, whatever the case; letters and white space are Unicode's.
SECRETS = (
    ("[A-Za-z0-9]{32,}", "<REDACTED_TOKEN>"), ("sk-[A-Za-z0-9]{48}", "<REDACTED_API_KEY>"),
    (f"password[=:]{WHITE}*{WHITE.replace('[', '[^', 1)}+", "password=<REDACTED>"), (f"token[=:]{WHITE}*{WHITE.replace('[', '[^', 1)}+", "token=<REDACTED>"),
)
#: Colour and cursor codes of a terminal.
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"


def redacted(x: Column) -> Column:
    out = F.regexp_replace(x, ANSI, "")
    for pattern, instead in SECRETS:
        out = F.regexp_replace(out, f"(?iu){pattern}", instead)
    return out


def artifact_section(name: Column, content: Column, most: int) -> Column:
    cut = F.when(F.length(content) > most, F.concat(F.left(content, F.lit(most)), F.lit("\n... (truncated)"))).otherwise(content)
    return F.concat(F.lit("### "), name, F.lit("\n```\n"), cut, F.lit("\n```"))


def artifact_report(sections: Column) -> Column:
    return F.when(F.size(sections) > 0, F.concat(F.lit("## Last Execution Output\n\n"), F.array_join(sections, "\n\n"))).otherwise("")


def decoded(x: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes replacement characters."""
    return F.make_valid_utf8(x.cast("string"))


def truncated_at(x: Column, stops: Column) -> Column:
    """Cut at the first stop of the list that occurs: the list's order counts, not the place. Empty stops don't."""
    found = F.get(F.filter(stops, lambda s: (s != "") & F.contains(x, s)), F.lit(0))
    return F.when(found.isNull(), x).otherwise(F.substring(x, F.lit(1), F.instr(x, found) - 1))


def safe_mkdir(x: Column) -> Column:
    return F.regexp_replace(x, r"\bmkdir\s+(?!-p\b)", "mkdir -p ")


def runtime_id(instance: Column, solution: Column, testing: Column | None = None, prefix: str = "agent") -> Column:
    parts = [F.lit(prefix), F.replace(instance, F.lit("."), F.lit("_")), solution] + ([] if testing is None else [testing])
    return F.concat_ws("-", *parts)


def path_safe(model: Column) -> Column:
    return F.replace(F.element_at(F.split(model, "/"), -1), F.lit(":"), F.lit("_"))


#: File extension to language.
EXTENSIONS = {
    ".4th": "Forth", ".c": "C", ".c++": "C++", ".cc": "C++", ".c#": "C#", ".cpp": "C++", ".cs": "C#", ".cxx": "C++", ".cbl": "COBOL", ".cob": "COBOL",
    ".cpy": "COBOL", ".forth": "Forth", ".frt": "Forth", ".fs": "F#", ".fth": "Forth", ".go": "Go", ".hs": "Haskell", ".java": "Java",
    ".js": "JavaScript (Node.js)", ".ts": "TypeScript", ".kt": "Kotlin", ".lisp": "Common Lisp", ".cl": "Common Lisp", ".m": "Objective-C", ".ml": "OCaml",
    ".pas": "Pascal", ".php": "PHP", ".pl": "Prolog", ".py": "Python 3", ".pyc": "Python 3", ".rb": "Ruby", ".rkt": "Racket", ".rs": "Rust",
    ".scala": "Scala", ".f90": "Fortran", ".f": "Fortran", ".for": "Fortran", ".sh": "Bash", ".apl": "APL", ".ss": "Gerbil", ".jl": "Julia",
    ".vb": "Visual Basic", ".dart": "Dart", ".zig": "Zig", ".swift": "Swift", ".nim": "Nim", ".lua": "Lua", ".pm": "Perl", ".sno": "SNOBOL",
    ".odin": "Odin", ".a68": "Algol 68", ".cr": "Crystal", ".sim": "Simula 67", ".d": "D", ".mod": "Modula-2", ".st": "Smalltalk", ".adb": "Ada",
    ".ads": "Ada", ".erl": "Erlang", ".ex": "Elixir",
}
#: Languages for which a main class, or a main file, is asked for; those whose main file shows in its text.
MAIN_CLASS = ("Elixir", "Erlang", "Java", "Kotlin", "Modula-2", "Scala")
MAIN_FILE = (
    "Ada", "Algol 68", "APL", "Bash", "Crystal", "Dart", "Forth", "Gerbil", "JavaScript (Node.js)", "JavaScript (SpiderMonkey)", "Julia", "Common Lisp", "Lua",
    "Nim", "Octave", "Pascal", "Perl", "PHP", "Python 2", "Python 3", "Racket", "Ruby", "Rust", "Simula", "Smalltalk", "SNOBOL", "TypeScript", "Zig",
)
MAIN_CALL = ("Java", "Rust", "Scala", "Kotlin")
#: What only the second version of Python has.
OLD_PYTHON = r"^\s*\bprint\b *[^ \(\),\]]|\braw_input\b"


def old_python(code: Column) -> Column:
    """True or false where a file tells by its first line or by a statement; null where it doesn't."""
    lines = F.split(code, "\n")
    first = F.get(lines, F.lit(0))
    bang = first.startswith("#!")
    used = F.exists(lines, lambda x: F.get(F.split(x, "#"), F.lit(0)).rlike(OLD_PYTHON))
    return F.when(bang & F.contains(first, F.lit("python2")), True).when(bang & F.contains(first, F.lit("python3")), False).when(used, True)


def language_of(extension: Column, has_c_files: Column, is_old_python: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in EXTENSIONS.items() for v in pair])
    low = F.lower(extension)
    return (
        F.when(extension == ".C", "C++").when((low == ".h") & has_c_files, "C").when(low == ".h", "C++").when((low == ".py") & is_old_python, "Python 2")
        .otherwise(F.try_element_at(names, low))
    )


#: Status codes of the judge.
STATUS = {
    0: "New", 1: "New", 2: "Waiting for compile", 3: "Compiling", 4: "Waiting for run", 5: "Running", 6: "Judge Error", 8: "Compile Error", 9: "Run Time Error",
    10: "Memory Limit Exceeded", 11: "Output Limit Exceeded", 12: "Time Limit Exceeded", 13: "Illegal Function", 14: "Wrong Answer", 16: "Accepted",
}


def status_text(code: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in STATUS.items() for v in pair])
    return F.coalesce(F.try_element_at(names, code.cast("int")), F.concat(F.lit("Unknown status "), code.cast("string")))


#: How the judge's answer names a submission.
SUBMISSION = r"Submission ID: (\d+)"


def submission_id(response: Column) -> Column:
    """The number in the judge's answer; null without one."""
    return first_match(response, SUBMISSION).try_cast("long")


def shown_score(status: Column) -> Column:
    """The number in brackets; empty without one."""
    return F.coalesce(first_match(status, r"\(([\d\.]+)\)"), F.lit(""))


def accepted_cases(html: Column) -> Column:
    """STRUCT<accepted, total>: leading non-empty results, and one less than the result marks."""
    results = F.regexp_extract_all(html, F.lit(r'<i class="([^"]*)"'), F.lit(1))
    empty = F.array_position(results, F.lit("")).cast("int")
    return F.struct(F.when(empty > 0, empty - 1).otherwise(F.size(results)).cast("long").alias("accepted"), (F.regexp_count(html, F.lit("<i")) - 1).cast("long").alias("total"))


def ports(output: Column) -> Column:
    """Ports in the second-last field of each line of at least nine, without the header."""
    lines = F.filter(F.split(F.trim(output), "\n"), lambda line, i: i > 0)
    fields = F.filter(F.transform(lines, lambda x: F.split(F.trim(x), r"\s+")), lambda f: F.size(f) >= 9)
    ends = F.flatten(F.transform(fields, lambda f: F.split(F.element_at(f, -2), "->")))
    found = F.transform(ends, lambda e: F.element_at(F.split(e, ":"), -1).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: p.isNotNull())))


#: What job messages say, and how it is counted.
JOB_SIGNS = {"successful": "Successfully processed", "skipped": "Skipped", "errors": "Error processing"}

#: Error class names.
FATAL = (
    "AgentRuntimeError", "AgentRuntimeBuildError", "AgentRuntimeTimeoutError", "AgentRuntimeUnavailableError", "AgentRuntimeNotReadyError",
    "AgentRuntimeDisconnectedError", "AgentRuntimeNotFoundError", "ConnectionError",
)
FATAL_RUNTIME = ("AgentRuntimeTimeoutError", "AgentRuntimeUnavailableError", "AgentRuntimeDisconnectedError", "AgentRuntimeNotFoundError")


def is_fatal(error: Column, names: tuple[str, ...] = FATAL) -> Column:
    return F.coalesce(error.rlike("|".join(names)), F.lit(False))


def safe_file_name(key: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(key, r"[^\p{L}\p{N}._-]", ""), F.lit("")), F.lit("artifact"))


#: Fences that mark JSON, in the order they are tried.
FENCES = (r"```json\s*\n(.*?)\n```", r"```json(.*?)```", r"`json\s*\n(.*?)\n`", r"```\s*json\s*\n(.*?)\n```")


def tolerant_json(text: str | None) -> tuple[str | None, str | None]:
    """(canonical JSON, error) of the last block of the first kind of fence that parses: as JSON, without comments, or as a Python literal."""
    found, last_error = False, None
    for pattern in FENCES:
        matches = re.findall(pattern, text or "", re.DOTALL | re.IGNORECASE)
        if not matches:
            continue
        found, body = True, matches[-1].strip()
        bare = re.sub(r"/\*.*?\*/", "", re.sub(r"//.*?\n", "", body), flags=re.DOTALL).strip()
        for load, source in ((json.loads, body), (json.loads, bare), (ast.literal_eval, body)):
            try:
                return json.dumps(load(source), sort_keys=True, ensure_ascii=False), None
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError) as e:
                last_error = f"{type(e).__name__}: {e}"
    return None, f"JSON parsing failed: {last_error}" if found else "No JSON code blocks found in the response."


def tolerant_json_column(x: Column) -> Column:
    """STRUCT<value, error>; a Python literal needs Python, in Arrow batches."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tolerant_json(t) for t in texts], columns=["value", "error"])

    return F.pandas_udf(run, "value string, error string")(x)
