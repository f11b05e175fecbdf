"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. A HyperLogLog sketch of its sites per
line hash, merged by aggregation, settles most lines; those estimated near the
threshold are counted exactly. Boilerplate lines are then cut from all documents,
except from those that consist of such lines for the most part: these are copies of
each other, and what becomes of them is a matter of document dedup.

How widely a line must spread can depend on its length. Long lines do not repeat by
chance, so few sites tell (``long_sites``). Short ones do, on every site once there is
text enough; with ``by_chance`` they are boilerplate only if they stand more often than
sentences of their length would have these words by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import named, text_of
from millrace.scratch import Scratch

# Registers of a sketch as a power of two: a standard error of 1.6 percent.
SKETCH_BITS = 12

# Estimates this close to the threshold, as a part of it, are replaced by exact counts.
NEAR = 0.2

# Words from which a line is long, and up to which it may stand somewhere by chance.
LONG_WORDS = 50
CHANCE_WORDS = 12

# A word in a line may be so many times as likely as in all text, for languages differ.
SLACK = 4


def _hashes(value: Column, name: str) -> list[Column]:
    """128 bits as two independent hashes."""
    return [
        F.xxhash64(F.lit(seed), value).alias(f"{name}{i}") for i, seed in ((1, 7919), (2, 104729))
    ]


def _lines(rows: DataFrame, *more: str) -> DataFrame:
    """Every line that holds more than blanks, with its place and hash."""
    lines = rows.select(*more, F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line != ''")
    n_words = F.size(F.split("line", " +"))
    return lines.select(
        *more, "place", F.length("line").alias("size"), n_words.alias("n_words"), "line",
        *_hashes(F.col("line"), "h"),
    )


def _words(text: str) -> Column:
    """Lower-case words without punctuation."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _beyond_chance(rows: DataFrame, short: DataFrame, scratch: Scratch) -> DataFrame:
    """Hashes of the short lines that stand more often than chance has it.

    Chance is the number of other lines of this length times the shares that the words
    have in all text outside of this line, each taken ``SLACK`` times. Both sides grow
    with the text alike. Lines without letters or digits are all kept.
    """
    lengths = _lines(rows).groupBy("n_words").agg(F.count("*").alias("alike"))
    word = rows.select(F.explode(_words("text")).alias("word"))
    counts = scratch.stage(word.groupBy("word").agg(F.count("*").alias("all")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    parts = short.select("h1", "h2", "n", F.explode(_words("line")).alias("word"))
    parts = parts.groupBy("h1", "h2", "n", "word").agg(F.count("*").alias("times"))
    outside = F.col("all") - F.col("n") * F.col("times")
    share = F.log(outside.cast("double")) + F.log(F.lit(float(SLACK)))
    # The logarithm of 0 is null: a word found nowhere else is never there by chance.
    product = parts.join(counts, "word").groupBy("h1", "h2").agg(
        F.sum(F.col("times") * share).alias("logs"),
        F.sum("times").alias("k"),
        F.count_if(outside <= 0).alias("own_words"),
    )
    lines = short.join(F.broadcast(lengths), "n_words").join(product, ["h1", "h2"], "left")
    elsewhere = F.log(F.greatest(F.lit(total) - F.col("n") * F.col("k"), F.lit(1)).cast("double"))
    others = (F.col("alike") - F.col("n")).cast("double")
    chance = others * F.exp(F.col("logs") - F.col("k") * elsewhere)
    plain = F.col("k").isNull() | (F.col("own_words") > 0)
    return lines.filter(plain | (F.col("n") > chance)).select("h1", "h2")


def boilerplate(
    rows: DataFrame,
    min_sites: int,
    scratch: Scratch,
    *,
    sketch_bits: int = SKETCH_BITS,
    long_sites: int | None = None,
    by_chance: bool = False,
) -> DataFrame:
    """Hashes of the lines on ``min_sites`` or more distinct sites; null is no site.

    Lines of ``LONG_WORDS`` or more need ``long_sites``, if given. With ``by_chance``
    lines of up to ``CHANCE_WORDS`` must also stand more often than chance has it.
    """
    lines = _lines(rows, "site").select("h1", "h2", "site", "n_words", "line")
    need = F.lit(min_sites)
    about = []
    if long_sites is not None or by_chance:
        about.append(F.first("n_words").alias("n_words"))
        if long_sites is not None:
            need = F.when(F.col("n_words") >= LONG_WORDS, long_sites).otherwise(min_sites)
    if by_chance:
        line = F.when(F.col("n_words") <= CHANCE_WORDS, F.col("line"))
        about += [F.count("*").alias("n"), F.first(line).alias("line")]
    sketches = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", sketch_bits)).alias("sites"), *about
    )
    seen = scratch.stage(sketches.filter(F.col("sites") >= need * (1 - NEAR)), "spread")
    near = F.col("sites") <= need * (1 + NEAR)
    unsure = scratch.stage(seen.filter(near).select("h1", "h2", need.alias("need")), "near-threshold")
    # Each line meets each site once, however often it stands there.
    pairs = lines.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = pairs.join(unsure.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2")
    exact = exact.agg(F.count("site").alias("sites")).join(unsure, ["h1", "h2"])
    exact = exact.filter(F.col("sites") >= F.col("need"))
    spread = scratch.stage(
        seen.filter(~near).select("h1", "h2").unionByName(exact.select("h1", "h2")), "boilerplate"
    )
    if not by_chance:
        return spread
    short = seen.filter("line IS NOT NULL").join(spread, ["h1", "h2"], "left_semi")
    short = scratch.stage(short, "short-lines")
    longer = spread.join(short.select("h1", "h2"), ["h1", "h2"], "left_anti")
    return scratch.stage(longer.unionByName(_beyond_chance(rows, short, scratch)), "beyond-chance")


def without_boilerplate(
    docs: DataFrame,
    *,
    scratch: Scratch,
    min_sites: int = 8,
    max_share: float = 0.5,
    long_sites: int | None = None,
    by_chance: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
    site_column: str = "source",
) -> DataFrame:
    """Every row with its columns and ``cleaned_text``, ``n_lines``, ``n_removed``.

    Lines are compared without blanks at their ends; lines of blanks alone are neither
    counted nor removed. ``long_sites`` and ``by_chance`` let the spread depend on a
    line's length, as in ``boilerplate``. A line repeated within one site is no boilerplate. Where
    boilerplate makes up more than ``max_share`` of a text's characters (of its
    counted lines), the text stays as it is and ``n_removed`` is 0. A null text stays
    null; a null site adds nothing to a line's spread; rows that share id and text are
    treated alike; an empty table gives an empty result. Columns with the names of the
    three new ones are replaced.
    """
    rows = docs.select(
        named(id_column).alias("id"), text_of(text_column).alias("text"),
        named(site_column).cast("string").alias("site"),
    )
    spread = boilerplate(rows, min_sites, scratch, long_sites=long_sites, by_chance=by_chance)
    keyed = rows.select("id", "text", *_hashes(F.col("text"), "t"))
    found = _lines(keyed, "id", "t1", "t2").drop("line", "n_words").join(spread, ["h1", "h2"], "left_semi")
    # Repeated rows bring the same places again, hence a set of places and sizes.
    cuts = found.groupBy("id", "t1", "t2").agg(
        F.collect_set(F.struct("place", "size")).alias("cuts")
    )
    cuts = scratch.stage(
        cuts.select(
            F.col("id").alias("cut_id"), "t1", "t2",
            F.array_sort("cuts.place").alias("places"),
            F.aggregate("cuts.size", F.lit(0).cast("long"), lambda a, b: a + b).alias("cut_size"),
        ),
        "cuts",
    )
    body = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    text = text_of(text_column)
    whole = docs.select(body, named(id_column).alias("id"), text.alias("text"), *_hashes(text, "t"))
    same = [F.col(f"whole.{c}") == F.col(f"cuts.{c}") for c in ("t1", "t2")]
    joined = whole.alias("whole").join(
        cuts.alias("cuts"), [F.col("id").eqNullSafe(F.col("cut_id")), *same], "left"
    )
    joined = joined.withColumn("lines", F.split("text", "\n", -1))
    counted = F.filter("lines", lambda line: F.trim(line) != "")
    total = F.aggregate(
        counted, F.lit(0).cast("long"), lambda a, line: a + F.length(F.trim(line))
    )
    cut = F.col("cut_size").isNotNull() & (F.col("cut_size") <= total * F.lit(max_share))
    # What is left is the lines between neighbouring cuts.
    first = F.concat(F.array(F.lit(0)), F.transform("places", lambda place: place + 1))
    last = F.concat("places", F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(first, last, lambda a, b: F.slice("lines", a + 1, b - a)))
    original = F.col(f"row.c{docs.columns.index(text_column)}")
    new = {
        "cleaned_text": F.when(cut, F.array_join(kept, "\n")).otherwise(original),
        "n_lines": F.size(counted).cast("long"),
        "n_removed": F.when(cut, F.size("places")).otherwise(0).cast("long"),
    }
    taken = {name.lower() for name in new}
    columns = [
        F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in taken
    ]
    return joined.select(*columns, *[value.alias(name) for name, value in new.items()])
