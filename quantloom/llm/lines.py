"""Line dedup by content-defined windows of lines.

From every line with words the shortest window ahead that counts is taken, and to every
such line the shortest window behind: where a window ends is decided by the lines inside
it alone, so a passage gives the same windows wherever it stands. A window counts if it
has two lines with words and ``min_words`` words, or ``long_line`` words. Blank lines
inside a window belong to it; where blank lines stand before or behind it, it is taken
with them, too. So each line of a run that counts lies in a window of that run: ahead of
it if what follows it in the run counts, else in the window behind the run's last line.
Every repeated run that counts is found whole, whatever the lengths of its lines and
whatever stands around it. Of windows with equal hashes over the whole corpus, the first
(by document id, then line) stays; the lines of every other one are compared byte for
byte with the lines of the first and removed where they are equal.

The windows are the densest content-defined chunks: sparser ones, whose ends are chosen by
a rolling hash over line hashes, hold a short passage whole only by chance (the README has
figures), so every line with words begins and ends one here.

Built-in functions only. Windows leave the scan as keys of a few bytes, without text; they
are counted with a combine before the shuffle. Texts are shuffled by document id, and
only repeated lines are shuffled for the comparison, in a join that skew handling splits.

Defined cases: a null text stays null and has no lines; documents without an id are left
as they are and take no part; rows with the same id count as one document, and a line is
removed from each of them only where its own hash matches; ties cannot occur, as the
order is by id and line; an empty table gives an empty result. A document all of whose
lines are repeated is left with an empty text. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, let, words


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows_of(lines: Column, min_words: int, long_line: int) -> Column:
    """Array of structs hash, start, n: the windows that count."""
    most = max(2, min_words)  # lines with words in a window: each has a word at least
    enough = lambda n, w: ((n >= 2) & (w >= min_words)) | (w >= long_line)
    facts = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(words(x)).alias("w")))

    def reach(near: Column) -> Column:
        """How many of the lines, from the first on, make a window; null if all do not."""
        grow = lambda a, y: F.when(enough(a["n"], a["w"]), a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["w"] + y["w"]).alias("w")))
        return F.aggregate(near, F.struct(F.lit(0).alias("n"), F.lit(0).alias("w")), grow, lambda a: F.when(enough(a["n"], a["w"]), a["n"]))

    def windows(f: Column) -> Column:
        full = F.filter(F.transform(f, lambda x, i: F.struct(i.alias("i"), x["w"].alias("w"))), lambda x: x["w"] > 0)

        def of_full(g: Column) -> Column:
            key = lambda a, b: F.shiftleft(a.cast("long"), 32) + b
            ahead = F.transform(g, lambda x, k: key(k, k + reach(F.slice(g, k + 1, most)) - 1))

            def behind(x: Column, k: Column) -> Column:
                low = F.greatest(k - most + 1, F.lit(0))
                return key(k - reach(F.reverse(F.slice(g, low + 1, k - low + 1))) + 1, k)

            both = F.array_distinct(F.filter(F.concat(ahead, F.transform(g, behind)), lambda e: e.isNotNull()))

            def ranges(e: Column) -> Column:
                k, m = F.shiftright(e, 32).cast("int"), e.bitwiseAND(0xFFFFFFFF).cast("int")
                a, b = F.get(g, k)["i"], F.get(g, m)["i"]
                lead = F.coalesce(F.get(g, k - 1)["i"] + 1, F.lit(0))
                trail = F.coalesce(F.get(g, m + 1)["i"], F.size(f)) - 1
                of = lambda start, end: F.struct(start.alias("start"), (end - start + 1).alias("n"))
                return F.array(of(a, b), F.when(lead < a, of(lead, b)), F.when(trail > b, of(a, trail)))

            return F.filter(F.flatten(F.transform(both, ranges)), lambda r: r.isNotNull())

        def hashed(r: Column) -> Column:
            inside = F.slice(f, r["start"] + 1, r["n"])
            return F.struct(F.aggregate(inside, F.lit(0).cast("long"), lambda a, y: F.xxhash64(a, y["h"])).alias("hash"), r["start"].alias("start"), r["n"].alias("n"))

        return F.transform(let(full, of_full), hashed)

    return let(facts, windows)


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_words: int = 8,
    long_line: int = 50,
) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_removed_lines``."""
    body = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_id is not null and _text is not null")
    chunks = body.select(
        "_id", F.explode(let(_lines(F.col("_text")), lambda x: _windows_of(x, min_words, long_line))).alias("c")
    ).select("_id", "c.*")
    repeated = (
        chunks.groupBy("hash").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("_id", "start")).alias("first")).where("times > 1")
    )
    again = chunks.join(repeated, "hash").where((F.col("_id") != F.col("first._id")) | (F.col("start") != F.col("first.start")))
    # pairs of a repeated line and the line it repeats
    pairs = cut(
        again.select("_id", "start", F.col("first._id").alias("of"), F.col("first.start").alias("of_start"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        .select("_id", (F.col("start") + F.col("k")).alias("i"), "of", (F.col("of_start") + F.col("k")).alias("j"))
        .distinct()
    )
    wanted = (
        pairs.select("_id", F.struct("i", "of", "j").alias("p"))
        .unionByName(pairs.select(F.col("of").alias("_id"), F.struct(F.col("j").alias("i"), F.lit(None).cast(pairs.schema["of"].dataType).alias("of"), F.lit(None).cast("int").alias("j")).alias("p")).distinct())
        .groupBy("_id").agg(F.collect_list("p").alias("ps"))
    )
    found = cut(
        body.join(wanted, "_id")
        .select("_id", let(_lines(F.col("_text")), lambda x: F.transform("ps", lambda p: F.struct(p["i"].alias("i"), p["of"].alias("of"), p["j"].alias("j"), F.get(x, p["i"]).alias("line")))).alias("f"))
        .select("_id", F.explode("f").alias("f"))
        .select("_id", "f.*")
    )
    kept = found.where("of is null").select(F.col("_id").alias("of"), F.col("i").alias("j"), F.col("line").alias("first_line"))
    gone = (
        found.where("of is not null").join(kept, ["of", "j"]).where(F.col("line") == F.col("first_line"))
        .groupBy("_id").agg(F.collect_set(F.struct("i", F.xxhash64("line").alias("h"))).alias("_gone"))
    )
    of, lost_lines = fresh(docs, "of", "gone")
    rest = docs.join(gone.select(F.col("_id").alias(of), F.col("_gone").alias(lost_lines)), F.col(doc_id) == F.col(of), "left")

    def without(lines: Column) -> Column:
        keys = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h")))
        left = F.array_except(keys, lost_lines)
        return let(left, lambda k: F.transform(k, lambda y: F.get(lines, y["i"])))

    new = F.when(F.col(lost_lines).isNull(), F.col(text)).otherwise(F.array_join(let(_lines(F.col(text)), without), "\n"))
    lost = F.when(F.col(lost_lines).isNull(), F.lit(0)).otherwise(
        let(_lines(F.col(text)), lambda x: F.size(x) - F.size(without(x)))
    )
    names = [c for c in docs.columns if c != "n_removed_lines"]
    return rest.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in names], lost.cast("long").alias("n_removed_lines"))
