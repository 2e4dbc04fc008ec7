"""Line dedup by an exact set-similarity join, with DataFrame operations only.

Copies go first. Hashes of lines that occur more than once, and the places of the first
of each, are kept as bitmaps of bounded size; a line in the first that is not in the
second is a copy. The rest holds every first line, and the few copies that the bitmaps
can't tell from one, which match it as any other set does.

Lines are sets of words in lower case. Words are counted over the rest and ordered by
rarity, then by hash; a word that only one line holds comes first of all. The counts are
kept in a table of fixed size at most, as the largest count of each slot: any order gives
the same result, a rare-first one gives short lists. For two sets with a Jaccard index of
at least ``THRESHOLD`` the first words of both must meet (prefix filter; the smaller
set needs the shorter prefix), at places that leave enough words after them
(positional filter), and neither may be much larger (length filter). Words that no other
line holds are not looked up, and a set whose first words are all of that kind has no match.

Sets that meet are not listed pair by pair: each set's first words are looked up in
lists of at most about ``LIST`` sets, split by a hash when a word is more common, and
of a list only the earliest set that fits is tried, after a bitmap of the words of
both has shown that few enough of them differ. These candidates are verified on the full sets.
Where none held, all fits of that set are listed and verified, so nothing is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamledger.llm.common import BITMAP, CHUNKS, fresh, lasting, numbered, pinned, scratch, sieved, stage, text_or_empty
from streamledger.llm.common import bitmap as _bitmap
from streamledger.llm.common import holds as _holds

THRESHOLD = 0.9
#: Lines with fewer distinct words are left as they are: none but blank ones.
LEAST_WORDS = 1
#: The table of counts has two to four slots for each word that more than one line holds, within these bounds.
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 25
LIST = 256
#: The share of all words in lines that counts as rare: about two and a half times what the prefixes need.
RARE = 0.25
#: Bytes of a dictionary page in the files that keep the lines' words.
DICTIONARY = 8 << 20
#: Most bits of each of the two bitmaps that tell copies. A full one tells none, and loses nothing.
COPIES = 1 << 26
#: Late sets of one early set that are verified together.
TOGETHER = 1024


def _lines(docs: DataFrame, row: str | None) -> DataFrame:
    """``row, doc_id, n_lines, line_no, line``, in lower case, words parted by blanks only; ``row`` is that column, or numbers the rows as read."""
    text = text_or_empty("text")
    # plain searches and a split at one character are much cheaper than regular expressions over every text
    other = [F.contains(text, F.lit(c)) for c in "\t\r\v\f"]
    text = F.when(other[0] | other[1] | other[2] | other[3], F.regexp_replace(text, r"[\t\r\x0B\f]", " ")).otherwise(text)
    number, parts = F.col(row) if row else F.monotonically_increasing_id(), F.split(text, "\n", -1)
    rows = docs.select(number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.size(parts).alias("n_lines"), parts.alias("parts"))
    # in lower case line by line: over whole texts it takes three times as long
    return rows.select("row", "doc_id", "n_lines", F.posexplode("parts").alias("line_no", "line")).withColumn("line", F.lower("line"))


def _words() -> Column:
    """Hashes of a line's distinct words; the empty word between two blanks is none."""
    return F.array_remove(F.array_distinct(F.transform(F.split("line", " ", -1), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _place(of: str) -> Column:
    return F.xxhash64(f"{of}row", f"{of}line_no")


def _without_copies(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``row, line_no`` of lines whose text an earlier line has, and ``sets`` without them; copies that the bitmaps can't tell are in the latter only."""
    often = stage(sets.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1"), "often")
    words, size = _bitmap(often, F.col("k1"), COPIES)
    repeats = _holds(words.scalar(), size, F.col("k1"))
    firsts = sets.where(repeats).groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("place"))
    words, size = _bitmap(stage(firsts.select(_at(F.col("place")).alias("at")), "firsts"), _place("at."), COPIES)
    first = _holds(words.scalar(), size, _place(""))
    return sets.where(repeats & ~first).select("row", "line_no"), sets.where(~repeats | first)


def _rarity(lines: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """How common the words of each slot are: one row ``levels`` and one row ``rare``, both with a value for each slot, and the number of slots.

    The level of a slot is 0 if no two lines share a word of it, else that of its most
    common word: thirds of a doubling, up to 127. ``rare`` tells the levels that hold
    the rarest ``RARE`` of all words that lines share, and all below.
    """
    counts = lines.select(F.explode("hashes").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    level = F.least(F.lit(127), F.floor(3 * F.log2("n"))).cast("int")
    common = stage(counts.select("w", "n", level.alias("level")), "common-words")
    # at most 128 rows
    by_level, seen, limit = sorted(common.groupBy("level").agg(F.sum("n").alias("n")).collect()), 0, 0
    for r in by_level:
        if seen < RARE * sum(x["n"] for x in by_level):
            seen, limit = seen + r["n"], r["level"]
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (2 * common.count()).bit_length()))
    wide = (slots // CHUNKS).bit_length() - 1
    slot = F.col("w").bitwiseAND(slots - 1).cast("int")
    # a slot's place in its chunk above 8 bits of its level: sorted, the last of a place has the largest
    known = common.select(F.shiftright(slot, wide).alias("chunk"), (F.shiftleft(slot.bitwiseAND((1 << wide) - 1), 8) + F.col("level")).alias("x"))
    every = lines.sparkSession.range(slots).select(F.shiftright("id", wide).cast("int").alias("chunk"), F.shiftleft(F.col("id").bitwiseAND((1 << wide) - 1), 8).cast("int").alias("x"))
    chunks = known.unionByName(every).groupBy("chunk").agg(F.sort_array(F.collect_list("x")).alias("a"))
    last = F.filter("a", lambda x, i: F.coalesce(F.shiftright(F.get("a", i + 1), 8) > F.shiftright(x, 8), F.lit(True)))
    chunks = chunks.select("chunk", F.transform(last, lambda x: x.bitwiseAND(255).cast("tinyint")).alias("levels"))
    # one row of bounded size
    row = chunks.agg(F.sort_array(F.collect_list(F.struct("chunk", "levels"))).alias("a")).select(F.flatten("a.levels").alias("levels"))
    levels = stage(row, "rarity")
    return levels, stage(levels.select(F.transform("levels", lambda x: x <= limit).alias("rare")), "rarity"), slots


def _ordered(sets: DataFrame, threshold: float) -> DataFrame:
    """``row, doc_id, line_no, n, bits, head``: the first words of each set, as longs that sort by rarity, the level above 56 bits of the hash.

    Its rare words come before all others, so where they are enough the others need no look.
    In ``bits`` each word turns one of 64 bits: two sets differ in at least as many words as bits.
    """
    levels, rare, slots = _rarity(sets)
    slot = lambda w: w.bitwiseAND(slots - 1)

    def key(w: Column) -> Column:
        # never null, which lets the sort work on plain longs
        level = F.coalesce(F.col("levels")[slot(w)], F.lit(0).cast("tinyint"))
        return F.shiftleft(level.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(w, 8))

    # the optimizer makes one projection of each pair, so the tables are no columns of any row
    kept = ("row", "doc_id", "line_no")
    rows = sets.select(*kept, "hashes", rare.scalar().alias("rare"))
    rows = rows.select(*kept, "hashes", F.filter("hashes", lambda w: F.col("rare")[slot(w)]).alias("few"))
    first = _prefix(F.col("n"), F.col("n") * threshold)
    # between the pairs stands a generator, which keeps them apart
    rows = pinned(rows, "n", F.size("hashes")).select(*kept, "n", "hashes", "few", levels.scalar().alias("levels"))
    enough = F.when(F.size("few") >= first, F.col("few")).otherwise(F.col("hashes"))
    # of all words: lines of common words alone share the bits of their rare ones
    bits = F.expr("aggregate(hashes, 0L, (a, w) -> a ^ shiftleft(1L, cast(w & 63 as int)))")
    return rows.select(*kept, "n", bits.alias("bits"), F.slice(F.sort_array(F.transform(enough, key)), F.lit(1), first).alias("head"))


def _prefix(n: Column, overlap: Column) -> Column:
    return F.greatest(F.lit(1), n - F.ceil(overlap - 1e-9).cast("int") + 1)


def _enough(n: Column, m: Column, threshold: float) -> Column:
    """The words that two sets of n and m words share at least, at the threshold."""
    return F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def _sets(docs: DataFrame, least_words: int, row: str | None = None) -> DataFrame:
    """``row, doc_id, n_lines, line_no, k1, k2, hashes``, staged: lines of enough distinct words, and the first line of every row."""
    # each text is split into words once; what follows reads the hashes
    sets = pinned(_lines(docs, row), "hashes", _words()).where((F.size("hashes") >= least_words) | (F.col("line_no") == 0))
    # a dictionary page that holds a large vocabulary keeps the files at two or three bytes a word
    return stage(sets.select("row", "doc_id", "n_lines", "line_no", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"), "hashes"), "line-sets", {"parquet.dictionary.page.size": DICTIONARY})


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS, row: str | None = None) -> DataFrame:
    """Lines that match an earlier one: ``row, line_no``; ``row`` is that column, or numbers the rows as read.

    Earlier is by doc_id (null first), then by row, then by line number. A line matches if
    its set of words has a Jaccard index of at least ``threshold`` with that of any earlier
    line. Lines of fewer than ``least_words`` distinct words match nothing, blank ones
    never do. Null texts are one blank line. Rows that repeat match each other as any do.
    """
    return _repeated(_sets(docs, least_words, row), threshold, least_words)


def _repeated(sets: DataFrame, threshold: float, least_words: int) -> DataFrame:
    sets = sets.where(F.size("hashes") >= max(1, least_words))
    copies, rest = _without_copies(sets)
    first = pinned(_ordered(rest, threshold), "prefix", F.filter("head", lambda w: w >= 1 << 56))
    # without a word to look up a set matches none
    lines = first.where(F.size("prefix") > 0).select(
        F.struct("doc_id", "row", "line_no").alias("place"), "n", (F.size("head") - F.size("prefix")).alias("skipped"), "prefix", "bits"
    )
    later = stage(_later(stage(lines, "lines"), sets, threshold), "later")
    return copies.unionByName(later.select("late.row", "late.line_no"))


def _found(entries: Column, of: dict[str, Column], threshold: float) -> Column:
    """Places of the ``entries`` that fit the set ``of(n, i, bits, most, place)``: earlier ones that can match it, as far as one word and the bitmaps tell."""
    n, i = of["n"], of["i"]
    short = lambda m: _prefix(m, m * (2 * threshold / (1 + threshold)))

    def fits(e: Column) -> Column:
        m, j = e["n"], e["i"]
        # the cheapest test that most fail comes first; the bounds of the bitmap are rounded up, the others are exact
        differ = F.bit_count(of["bits"].bitwiseXOR(e["bits"])) <= of["most"]
        alike = F.least(n, m) >= F.greatest(n, m) * threshold - 1e-9
        # the smaller set's word must be in its short prefix
        meets = F.when(m <= n, j < short(m)).otherwise(i < short(n))
        left = 1 + F.least(n - i - 1, m - j - 1)
        return differ & (e["place"] < of["place"]) & alike & meets & (left >= _enough(n, m, threshold))

    return F.transform(F.filter(entries, fits), lambda e: e["place"])


def _later(lines: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``late(row, line_no)`` of the ``lines`` that match an earlier one."""
    n = F.col("n")
    # as many words as may differ, for the largest set that can match
    most = F.floor((n + F.floor((n + 1e-9) / threshold)) * ((1 - threshold) / (1 + threshold)) + 1e-6).cast("int")
    entry = F.struct("n", (F.col("skipped") + F.col("k")).alias("i"), "bits", "most", "place")
    probe = lambda rows: rows.select("place", "n", "bits", most.alias("most"), "skipped", F.posexplode("prefix").alias("k", "word")).select("word", entry.alias("e"))
    # the level of a word's slot bounds how many lines hold it; the last word is the most common
    light = lambda word: F.shiftright(word, 56) < math.floor(3 * math.log2(LIST))
    lists = probe(lines).where(light(F.col("word"))).groupBy("word").agg(F.collect_list("e").alias("entries")).where(F.size("entries") > 1)
    own = lambda e: {k: e[k] for k in ("n", "i", "bits", "most", "place")}
    each = F.transform("entries", lambda e: F.struct(e["place"].alias("place"), _found(F.col("entries"), own(e), threshold).alias("found")))
    found = lists.select(F.explode(F.filter(each, lambda x: F.size(x["found"]) > 0)).alias("x")).select("x.*")

    # lists of the others are split by a hash; a set meets one part first, the rest only if nothing in it holds
    heavy = stage(probe(lines.where(~light(F.element_at("prefix", -1)))).where(~light(F.col("word"))), "heavy")
    sizes = heavy.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("parts"))
    parted = heavy.join(sizes, "word").groupBy("word", F.pmod(F.xxhash64("e.place"), F.col("parts")).alias("part")).agg(F.collect_list("e").alias("entries"))
    parted = stage(parted, "lists")

    def met(probes: DataFrame, lists: DataFrame) -> DataFrame:
        both = pinned(probes.join(lists, "word"), "found", _found(F.col("entries"), own(F.col("e")), threshold))
        return both.select(F.col("e.place").alias("place"), "found").where(F.size("found") > 0)

    found = stage(found.unionByName(met(heavy, parted.where("part = 0"))), "found")
    tried = stage(_earliest(found), "candidates")
    held = _verified(tried, sets, threshold)
    # where no candidate held, all fits are listed, and the other parts are met
    pairs = _listed(found, held).join(tried, ["late", "early"], "left_anti")
    others = parted.where("part > 0")
    more = None
    if not others.isEmpty():
        more = stage(met(heavy.join(held, _at(F.col("e.place")) == F.col("late"), "left_anti"), others), "found")
        pairs = pairs.unionByName(_earliest(more)).distinct()
    pairs = stage(pairs, "candidates")
    if pairs.isEmpty():
        return held
    held = stage(held.unionByName(_verified(pairs, sets, threshold)), "held")
    if more is None:
        return held
    pairs = stage(_listed(more, held).join(pairs, ["late", "early"], "left_anti"), "candidates")
    return held if pairs.isEmpty() else held.unionByName(_verified(pairs, sets, threshold))


def _at(place: Column) -> Column:
    return F.struct(place["row"].alias("row"), place["line_no"].alias("line_no"))


def _earliest(found: DataFrame) -> DataFrame:
    """``late, early``: of each list the earliest place."""
    return found.select(_at(F.col("place")).alias("late"), _at(F.array_min("found")).alias("early")).distinct()


def _listed(found: DataFrame, held: DataFrame) -> DataFrame:
    """``late, early``: all places found for sets that are not ``held`` yet."""
    rest = found.withColumn("late", _at(F.col("place"))).join(held, "late", "left_anti")
    return rest.select("late", F.explode("found").alias("p")).select("late", _at(F.col("p")).alias("early")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``late`` of those ``pairs(late, early)`` of places ``(row, line_no)`` that hold on the full sets."""
    # bitmaps of bounded size let most other lines fall out before the joins; full ones let all pass
    seen = {}
    for side in ("early", "late"):
        words, size = _bitmap(pairs, _place(f"{side}."), BITMAP)
        seen[side] = _holds(words.scalar(), size, _place(""))
    likely = sets.where(seen["early"] | seen["late"]).select(F.struct("row", "line_no").alias("node"), F.col("hashes").alias("words"), *[x.alias(f"as_{side}") for side, x in seen.items()])
    full = stage(likely, "sets")
    # an early set that many late ones are tried with is read once for every so many of them
    many = pairs.groupBy("early").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    early = full.where("as_early").select(F.col("node").alias("early"), F.col("words").alias("b")).join(many, "early").select("early", "b", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    late = pairs.join(many, "early").withColumn("part", F.pmod(F.xxhash64("late"), F.col("parts")).cast("int")).drop("parts").join(full.where("as_late").select(F.col("node").alias("late"), F.col("words").alias("a")), "late")
    common = F.size(F.array_intersect("a", "b"))
    both = late.join(early, ["early", "part"])
    return stage(both.where(common >= (F.size("a") + F.size("b") - common) * threshold - 1e-9).select("late").distinct(), "held")


def counted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` for each row; ``removed`` lists its line numbers, from 0, with commas."""
    # both sides read the numbers that were written with the lines
    with scratch(docs.sparkSession):
        sets = _sets(docs, LEAST_WORDS)
        with lasting():
            rows = stage(sets.where("line_no = 0").select("row", "doc_id", F.col("n_lines").cast("long").alias("n_lines")), "rows")
        gone = _repeated(sets, threshold, LEAST_WORDS).groupBy("row").agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
        with lasting():
            gone = stage(gone, "gone")
    out = rows.join(gone, "row", "left")
    n = F.coalesce(F.size("gone"), F.lit(0))
    return out.select("doc_id", "n_lines", F.greatest(n, F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))


def without_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, row: str | None = None) -> DataFrame:
    """``docs`` with their columns, without the lines that match an earlier one.

    A row all of whose non-blank lines are repeats goes; a row that had only blank lines,
    or none, stays as it is. ``n_chars``, where there is such a column, counts what is left.
    ``row`` is a column that numbers the rows, whenever they are read; without it a numbered copy is written.
    """
    own, of, lines = (fresh(docs, x) for x in ("own_row", "gone_row", "gone_lines"))
    rows, own = (docs, row) if row else (numbered(docs, own), own)
    with scratch(docs.sparkSession):
        gone = repeated_lines(rows, threshold, row=own).groupBy(F.col("row").alias(of)).agg(F.collect_set("line_no").alias(lines))
        with lasting():
            gone = stage(gone, "gone")
    whole, likely = sieved(rows, F.xxhash64(own), gone, F.xxhash64(of))
    # what goes grows with the corpus, so it is never broadcast, and the plan is the same at every size
    joined = likely.join(gone.hint("merge"), F.col(own) == F.col(of), "left")
    kept = F.filter(F.split(text_or_empty("text"), "\n", -1), lambda x, k: ~F.array_contains(F.col(lines), k))
    rest = joined.withColumn("text", F.when(F.col(of).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    rest = rest.where(F.col(of).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(F.col(of).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return whole.union(rest.select(*rows.columns)).select(*docs.columns)
