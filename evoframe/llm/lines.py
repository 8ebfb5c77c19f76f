"""Line deduplication by a segment-partition edit join; DataFrame functions only.

Two lines within k edits share one of k + 1 segments of the shorter one, at a place that the edits before and after it can have
shifted it to. So each distinct line is indexed under its segments and its length, probes the substrings that a
line of its length or up to k bytes less could have as segments, and is compared with what it meets. All lengths, places and edits
are in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evoframe.llm.common import fresh

#: Edits between near-equal lines; shorter lines are only compared for equality.
EDITS, MIN_BYTES = 2, 24
#: A document without an id counts as the last.
NO_ID = (1 << 63) - 1
#: An edit changes at most two letters' counts, by one each, so far counts rule a pair out before its texts are fetched.
LETTERS = "entaiorh"


def _count(text: Column, letter: str) -> Column:
    """Replacing one letter is a search over bytes, much cheaper than a translation."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(letter), F.lit("")))


def letter_counts(line: Column) -> Column:
    """Eight counts modulo 16, side by side in 32 bits."""
    out = F.lit(0)
    for letter in LETTERS:
        out = F.shiftleft(out, 4).bitwiseOR(_count(line, letter).bitwiseAND(15))
    return out


def far_counts(a: str, b: str, edits: int) -> str:
    """SQL: the counts differ, around the circle of 16, by more than so many edits can change."""
    apart = (f"abs((shiftrightunsigned({a}, {s}) & 15) - (shiftrightunsigned({b}, {s}) & 15))" for s in range(0, 32, 4))
    return f"{' + '.join(f'least({d}, 16 - {d})' for d in apart)} > {2 * edits}"


def _row(by_row: bool) -> list[str]:
    """The columns that tell documents apart, in their order: the id, and by row a name of id and text besides."""
    return ["d", "row"] if by_row else ["d"]


def _named() -> dict[str, Column]:
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return {"d": d, "row": F.xxhash64(d, F.col("text").cast("binary"))}


def places(docs: DataFrame, by_row: bool = False) -> DataFrame:
    """(d, by row also row, pos, line, h) of every line of every document; a null text is one empty line. h names the line."""
    lines = docs.select(*[_named()[c].alias(c) for c in _row(by_row)], F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return lines.withColumn("h", F.xxhash64("line"))


def _segments(n: str, k: int) -> list[tuple[str, str]]:
    """SQL for start (from 0) and length of each of k + 1 even segments of n bytes; the last ones take the rest."""
    base, extra = f"({n} div {k + 1})", f"({n} % {k + 1})"
    out = []
    for i in range(k + 1):
        late = f"greatest(0, {i} - ({k + 1} - {extra}))"
        out.append((f"({i} * {base} + {late})", f"({base} + if({i} >= {k + 1} - {extra}, 1, 0))"))
    return out


def index_keys(k: int) -> Column:
    return F.expr("array(" + ", ".join(f"xxhash64({i}, n, substring(b, {s} + 1, {m}))" for i, (s, m) in enumerate(_segments("n", k))) + ")")


def probe_keys(k: int) -> Column:
    """Substrings that can be segment i of a line of n - shift bytes: i edits at most lie before it and k - i after it.

    Lines are long enough that none begins before the line does. The line's own segments, which a line of its length
    can have at the same places, are left out: they are index keys, and meet as such.
    """
    keys = []
    for shift in range(k + 1):
        for i, (s, m) in enumerate(_segments(f"(n - {shift})", k)):
            for move in range(max(-i, shift - (k - i)), min(i, shift + (k - i)) + 1):
                if shift or move:
                    keys.append(f"xxhash64({i}, n - {shift}, substring(b, {s} + {move} + 1, {m}))")
    return F.expr(f"array({', '.join(keys)})")


def few_blocks_differ(a: str, b: str, k: int, size: int = 8) -> Column:
    """What k edits imply: but for k at most, each short block of a stands in b, shifted by k at most. Much cheaper than the distance."""
    shifts = sorted(range(-k, k + 1), key=abs)
    same = " or ".join(f"substring({a}, {size} * j + 1, {size}) = substring({b}, {size} * j + {1 + s}, {size})" for s in shifts)
    return F.expr(f"size(filter(sequence(0, greatest(octet_length({a}) div {size}, 1) - 1), j -> not ({same}))) <= {k}")


def banded_distance(a: str, b: str, k: int) -> Column:
    """Edit distance of binary a and b if it is at most k, else more than k; octet lengths differ by at most k and are over k.

    Bit j of the words stands for row column - k + j of the table: a band of 2 k + 1 rows that moves down with each column. v holds
    the rows' steps up and w their steps down; d is the distance at the band's lowest row, then along the table's last row.
    """
    full, top = (1 << (2 * k + 1)) - 1, 2 * k
    equal = " | ".join(f"if(i + {1 - k + j} between 1 and m and substring({a}, i + {1 - k + j}, 1) = substring({b}, i + 1, 1), {1 << j}L, 0L)" for j in range(2 * k + 1))
    named = lambda v, w, d: f"named_struct('v', {v}, 'w', {w}, 'd', {d})"
    # let x -> ... end: a lambda over a one-element array names a value that is used several times.
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    zero = f"((((x & s.v) + s.v) ^ s.v) | x | s.w) & {full}L"
    plus, minus = f"(s.w | ({full}L & ~(z | s.v)))", "(z & s.v)"
    row = f"least({top}, cast(m - i - 1 + {k} as int))"
    step = f"if(m - i - 1 >= {k}, if((z & {1 << top}L) = 0, 1, 0), cast((shiftright(p, {row}) & 1) - (shiftright(q, {row}) & 1) as int))"
    after = named(f"(q | ({full}L & ~(shiftright(z, 1) | p)))", "(shiftright(z, 1) & p)", f"s.d + {step}")
    body = let(equal, "x", let(zero, "z", let(plus, "p", let(minus, "q", after))))
    start = named(f"{full & ~((1 << k) - 1)}L", "0L", f"{k}")
    return F.expr(f"transform(array(octet_length({a})), m -> aggregate(sequence(0, octet_length({b}) - 1), {start}, (s, i) -> {body}, s -> s.d))[0]")


def near_lines(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, by_row: bool = False) -> DataFrame:
    """(h, first, near) of the distinct lines that aren't blank and repeat, or come after another one within the edits: the first place, and the first one of those.

    Should two lines ever have one 64-bit name, a second name of 32 bits tells, and they are left out: both stay.
    """
    if min_bytes < (edits + 1) ** 2:
        raise ValueError("lines that are compared need at least (edits + 1) squared bytes")
    lines = places(docs, by_row).where("trim(line) <> ''")
    again = F.hash(F.lit(1), "line")
    distinct = lines.groupBy("h").agg(F.count("*").alias("n_places"), F.min(F.struct(*_row(by_row), "pos")).alias("first"), F.min(F.col("line").cast("binary")).alias("b"), F.min(again).alias("low"), F.max(again).alias("high"), F.min(letter_counts(F.col("line"))).alias("counts"))
    # All that use the lines' bytes ask for the same columns, so that one exchange of them serves all.
    distinct = distinct.where("low = high and first is not null and b is not null and counts is not null and n_places > 0").select("h", "first", "n_places", "b", "counts")
    long = distinct.select("h", "b", F.octet_length("b").alias("n"), "counts").where(F.col("n") >= min_bytes)
    held = long.select("h", "counts", F.explode(index_keys(edits)).alias("key"))
    asked = long.select(F.col("h").alias("g"), F.col("counts").alias("g_counts"), F.explode(probe_keys(edits)).alias("key"))
    near = f"not ({far_counts('counts', 'g_counts', edits)})"
    # Both sides of the index with itself are one exchange.
    x, y = held.alias("x"), held.alias("y")
    same = x.join(y, F.col("x.key") == F.col("y.key")).where("x.h < y.h").select("x.h", "x.counts", F.col("y.h").alias("g"), F.col("y.counts").alias("g_counts"))
    met = same.where(near).select("h", "g").unionByName(held.join(asked, "key").where(f"h <> g and {near}").select("h", "g"))
    pairs = met.select(F.least("h", "g").alias("h"), F.greatest("h", "g").alias("g")).distinct()
    other = distinct.select(F.col("h").alias("g"), F.col("first").alias("g_first"), F.col("n_places").alias("g_places"), F.col("b").alias("g_b"))
    both = pairs.join(distinct, "h").join(other, "g")
    # The longer line runs along the columns; equal lines have met in their group, so no pair is equal.
    own = F.octet_length("b") >= F.octet_length("g_b")
    longer, shorter = F.when(own, F.col("b")).otherwise(F.col("g_b")), F.when(own, F.col("g_b")).otherwise(F.col("b"))
    both = both.withColumns({"longer": longer, "shorter": shorter})
    linked = both.where(F.when(few_blocks_differ("shorter", "longer", edits), banded_distance("shorter", "longer", edits)) <= edits)
    later = F.col("first") > F.col("g_first")
    near = linked.select(F.when(later, F.col("h")).otherwise(F.col("g")).alias("h"), F.least("first", "g_first").alias("near")).groupBy("h").agg(F.min("near").alias("near"))
    return distinct.select("h", "first", "n_places").join(near, "h", "left").where("n_places > 1 or near is not null").select("h", "first", "near")


def judged_lines(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES, by_row: bool = False) -> DataFrame:
    """(d, by row also row, pos, blank, repeated, near) of every line: whether an equal one stands before it, and if not, whether one within the edits does."""
    lines = places(docs, by_row)
    key = [*_row(by_row), "pos"]
    place = F.struct(*key)
    own = lines.select(*key, "h", (F.trim("line") == "").alias("blank"))
    facts = near_lines(docs, edits, min_bytes, by_row)
    # The second key makes the join deal both sides anew, the few facts too; of two plain exchanges adaptive execution can split a frequent line's.
    again = F.xxhash64("h", F.lit(2)).alias("h2")
    out = own.select("*", again).join(facts.select("*", again), ["h", "h2"], "left")
    repeated = F.coalesce(~F.col("blank") & (F.col("first") < place), F.lit(False))
    return out.select(*key, "blank", repeated.alias("repeated"), (~repeated & F.coalesce(F.col("near") < place, F.lit(False))).alias("near"))


def line_report(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, n_lines, n_repeated, n_near, removed) of every document; removed: the numbers of the lines that go, from 0.

    A line goes if an equal one, or one of at least min_bytes bytes within the edits, stands before it: in a document of smaller
    id, or above it in its own. Lines are judged on the input, not on what is left. Blank lines stay. A null text is one empty
    line; a null doc_id counts as the largest; rows of equal id are one document, whose equal places don't precede each other; an
    empty table gives no rows; further columns are ignored.
    """
    gone = F.col("repeated") | F.col("near")
    return (
        judged_lines(docs, edits, min_bytes)
        .groupBy("d")
        .agg(
            F.count("*").alias("n_lines"), F.count_if("repeated").alias("n_repeated"), F.count_if("near").alias("n_near"),
            F.array_join(F.array_sort(F.collect_list(F.when(gone, F.col("pos")))).cast("array<string>"), ",").alias("removed"),
        )
        .select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_lines", "n_repeated", "n_near", "removed")
    )


def drop_lines(docs: DataFrame, edits: int = EDITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents, all their columns, with a text without the lines that go; a document goes if all its lines that aren't blank do.

    Null texts stay null, blank ones stay as they are. Of rows of equal id (or none) with different texts each loses only its own
    lines, and the one of the smaller hash of id and text comes first; rows of equal id and text are one document.
    """
    d, row, gone, some, left = fresh(docs, "d", "row", "gone", "some", "left")
    goes = F.col("repeated") | F.col("near")
    facts = (
        judged_lines(docs, edits, min_bytes, by_row=True)
        .groupBy(F.col("d").alias(d), F.col("row").alias(row))
        .agg(F.collect_set(F.when(goes, F.col("pos"))).alias(gone), F.bool_or(~F.col("blank")).alias(some), F.bool_or(~F.col("blank") & ~goes).alias(left))
        .where(F.size(gone) > 0)
    )
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    named = _named()
    own = docs.withColumns({d: named["d"], row: named["row"]})
    out = own.join(facts, [d, row], "left").where(F.col(gone).isNull() | F.col(left) | ~F.col(some))
    return out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = f"""
WITH places AS (
  SELECT coalesce(doc_id, {NO_ID}) AS d, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
),
firsts AS (SELECT line, min(struct_pack(d := d, pos := pos)) AS first, strlen(line) AS n FROM places WHERE trim(line) <> '' GROUP BY line),
linked AS (
  SELECT a.line, min(b.first) AS near FROM firsts a JOIN firsts b
  ON a.n >= {MIN_BYTES} AND b.n BETWEEN greatest({MIN_BYTES}, a.n - {EDITS}) AND a.n + {EDITS} AND b.first < a.first AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= {EDITS} GROUP BY a.line
),
judged AS (
  SELECT p.d, p.pos, trim(p.line) <> '' AND coalesce(f.first < struct_pack(d := p.d, pos := p.pos), false) AS repeated, coalesce(l.near < struct_pack(d := p.d, pos := p.pos), false) AS close
  FROM places p LEFT JOIN firsts f USING (line) LEFT JOIN linked l USING (line)
)
SELECT nullif(d, {NO_ID}) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN repeated THEN 1 ELSE 0 END) AS BIGINT) AS n_repeated,
  CAST(sum(CASE WHEN close AND NOT repeated THEN 1 ELSE 0 END) AS BIGINT) AS n_near,
  coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE repeated OR close), '') AS removed
FROM judged GROUP BY d"""
