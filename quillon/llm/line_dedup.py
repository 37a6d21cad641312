"""Line dedup by winnowing.

A document is the sequence of its lines that hold a word.  Every window of ``window`` such lines selects the line
with the smallest hash, the rightmost of equals, as its fingerprint; equal windows select alike, so a run of
``window`` lines or more that two places share always shares a fingerprint.  A line of ``long_line`` words or more is a
fingerprint by itself, so that it is found outside such runs too.  Only selected lines become rows.

1. Fingerprints found once in the corpus are put aside by a count.
2. Of the others, the first place by id and line is the origin, and later places are joined with it.
3. A match is extended from the fingerprint, line by line to the left and to the right, as far as the two documents agree and
   no farther than a window reaches: what lies beyond has fingerprints of its own.  A match of ``window`` lines, or of a long
   line alone, is a repeated run, and its later place goes.
4. Windows in which a later place differs from the first place of its fingerprint are compared among themselves, by their lines.

So a line goes if it stands in a window that stands earlier, or if it is a long line that stands earlier.  With a window of 1 every
later place of a line that holds a word goes.  Counts and first places are combined before the shuffle, and later places
find theirs by a join that can be split where a line is common; no two later places are ever paired.

Defined results: a null text stays null and an empty one empty; lines without a word are kept; a run may lie within one
document; rows with the same id and text are one document, so that each of them keeps what the others keep; rows with the
same id and other texts are told apart; a null id comes before all others.  Other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, LONG_LINE = 3, 5
_SPACES = "' \\t\\n\\u000b\\f\\r'"
_SPACE, _WORD = r"[\\x20\\x09-\\x0D]", r"[^\\x20\\x09-\\x0D]"


#: Words of a line counted by one pattern at most; Java's matcher takes stack for each.
_COUNTED = 100


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keys(id_column: str, text_column: str) -> list[Column]:
    return [F.col(id_column).alias("id"), F.xxhash64(F.col(text_column)).alias("th")]


def _has_words(stripped: str, n: int) -> str:
    """Whether the line l, which holds a word, holds n or more."""
    if n > _COUNTED:
        return f"size(split({stripped}, '{_SPACE}+', {n})) >= {n}"
    return f"l rlike '^{_SPACE}*+(?:{_WORD}++{_SPACE}++){{{max(n, 1) - 1}}}{_WORD}'"


def _places(docs: DataFrame, window: int, long_line: int, id_column: str, text_column: str) -> DataFrame:
    """A row for each selected line: id and th (the document), p (its number among the lines with a word), mark (its hash),
    around (other hashes of the lines from window - 1 before it to window - 1 after it, null beyond the ends; then 1 if the line
    is long, else 0: as a column of its own it would be left out where it isn't used, and uses of a row would be shuffled apart)."""
    out = docs.select(*_keys(id_column, text_column), F.split(F.col(text_column), "\n", -1).alias("lines"))
    stripped = f"trim(BOTH {_SPACES} FROM l)"
    is_long = _has_words(stripped, int(long_line)) if window > 1 else "true"
    out = out.withColumn("held", F.expr(f"transform(filter(lines, l -> {stripped} <> ''), l -> struct(xxhash64(l) as h, hash(l) as g, {is_long} as long))"))
    # A filter on held, or the one that Spark adds to explode, would be moved below it and cut every text a second and third time:
    # explode_outer and a filter on p give the same rows.
    out = out.select("id", "th", "held")
    if window > 1:
        hashes = ", ".join(f"get(held, p + {k}).h" for k in range(window - 1, -1, -1))
        minima = f"if(size(held) < {window}, cast(array() as array<int>), transform(sequence(0, size(held) - {window}), p -> p + {window} - cast(array_position(array({hashes}), least({hashes})) as int)))"
        longs = "filter(transform(held, (x, k) -> if(x.long, k, null)), k -> k is not null)"
        out = out.select("id", "th", "held", F.explode_outer(F.expr(f"array_distinct(concat({minima}, {longs}))")).alias("p")).where("p is not null")
        around = ", ".join(f"if(p + {k} < 0, null, get(held, p + {k}).g)" for k in range(1 - window, window))
        return out.select("id", "th", "p", F.expr("get(held, p).h").alias("mark"), F.expr(f"array({around}, int(get(held, p).long))").alias("around"))
    out = out.select("id", "th", F.posexplode_outer("held").alias("p", "x")).where("p is not null")
    return out.select("id", "th", "p", F.col("x.h").alias("mark"), F.array("x.g", F.lit(1)).alias("around"))


def _agreeing(window: int, step: int) -> str:
    """How many lines agree one after another on one side of the fingerprint."""
    out = "0"
    for k in range(window - 1, 0, -1):
        at = window - 1 + step * k
        out = f"if(coalesce(around[{at}] = first.around[{at}], false), 1 + {out}, 0)" if k < window - 1 else f"if(coalesce(around[{at}] = first.around[{at}], false), 1, 0)"
    return out


def repeated_runs(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, th (a hash of the text) and runs, array<struct<a,b>>: the first and last line, among those with a word, of runs to
    delete, of documents that have such runs."""
    places = _places(docs, window, long_line, id_column, text_column)
    shared = places.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    near = places.join(shared, "mark")
    place = F.struct("id", "th", "p")
    first = near.groupBy("mark").agg(F.min(F.struct("id", "th", "p", "around")).alias("first"))
    later = near.join(first, "mark").where(~(F.struct("id", "th", "p").eqNullSafe(F.struct("first.id", "first.th", "first.p"))))
    centre = window - 1
    later = later.withColumn("same", F.expr(f"around[{centre}] = first.around[{centre}]"))
    later = later.withColumn("l", F.expr(f"if(same, {_agreeing(window, -1)}, 0)")).withColumn("r", F.expr(f"if(same, {_agreeing(window, 1)}, 0)"))
    run = F.expr(f"if(same and 1 + l + r >= {window}, struct(p - l as a, p + r as b), if(same and around[{2 * window - 1}] = 1, struct(p as a, p as b), null))")
    runs = later.select("id", "th", run.alias("run")).where("run is not null")
    if window > 1:
        # Windows that differ from the first place's, by their lines.
        offsets = F.explode(F.expr(f"filter(sequence(0, {centre}), o -> not (same and o <= l and {centre} - o <= r))")).alias("o")
        others = later.select("id", "th", "p", "around", offsets)
        others = others.select("id", "th", (F.col("p") - F.col("o")).alias("p"), F.expr(f"slice(around, {centre} - o + 1, {window})").alias("w")).where("not exists(w, x -> x is null)")
        origin = others.groupBy("w").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
        again = others.join(origin, "w").where(~place.eqNullSafe(F.col("first")))
        runs = runs.unionByName(again.select("id", "th", F.struct(F.col("p").alias("a"), (F.col("p") + centre).alias("b")).alias("run")))
    return runs.groupBy("id", "th").agg(F.collect_set("run").alias("runs"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE, id_column: str = "doc_id", text_column: str = "text", added: str = "line_dedup") -> DataFrame:
    """docs with the texts cleaned, and a struct after its own columns (called added, with underscores if they have that name):
    removed_lines (ascending numbers, from 0, of the lines deleted from the original text) and n_lines (its lines)."""
    found = repeated_runs(docs, window, long_line, id_column, text_column)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys(id_column, text_column))
    out = whole.join(found.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "runs"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")
    text = F.col(f"row.`{text_column}`")
    # Only texts with runs are cut. Inside the lambda over runs an expression would be worked out for each line that goes:
    # numbers is bound by a lambda of its own, once a text.
    out = out.select("row", "runs", F.when(F.col("runs").isNotNull(), F.split(text, "\n", -1)).alias("lines"))
    worded = f"filter(transform(lines, (l, i) -> if(trim(BOTH {_SPACES} FROM l) <> '', i, null)), i -> i is not null)"
    gone = "array_sort(array_distinct(flatten(transform(runs, s -> transform(sequence(s.a, s.b), k -> get(numbers, k))))))"
    out = out.withColumn("removed", F.expr(f"if(runs is null, cast(array() as array<int>), transform(array({worded}), numbers -> {gone})[0])"))
    clean = F.when(F.col("runs").isNull(), text).otherwise(F.array_join(F.expr("transform(array_except(sequence(0, size(lines) - 1), removed), i -> get(lines, i))"), "\n"))
    n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    own = [clean.alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    about = F.struct(F.col("removed").alias("removed_lines"), F.coalesce(n_lines, F.lit(0)).alias("n_lines"))
    return out.select(*own, about.alias(free_name(docs, added)))
