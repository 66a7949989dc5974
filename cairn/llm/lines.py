"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its lower-cased words; blank lines are left alone. A line is removed if an
earlier one, in the order of ids and lines, has a Jaccard similarity of ``SIMILARITY`` or more with it.

Lines with one set are one class, with its earliest line. The words of a class are ordered by rarity: by how often
their hash bucket, of 2^18, occurs over all lines (in steps of a square root of two), then by hash. Two classes
alike enough share a word among the first few in that order (prefix filter). Where the least word they share stands
in either bounds what they can have in common (length and positional filters); the bits in which the parities of
their hashed words differ bound it too. What is left is verified on the whole sets.

Of many lines alike most are found before that: each class is held against the earliest that has two of its rare words
side by side in that order too. Of two classes so found to go no pair is made any more; each still stands for lines after it.

Words that begin more than ``HOT_CLASSES`` classes are counted first. Among the classes of such a word only
those that share a second early word meet (any two alike do). Where more than ``HOT_CLASSES`` classes share two, each class
is first held against the earliest, as often as that settles many; only classes that are still open are held against all earlier ones.

Cases: null and empty texts have no lines to remove; null ids come last in the order; rows with one id
and one text are one document, reported for each row; repeated lines are one class, whatever their number; an empty
table gives an empty result. Texts are read whole. Other columns, whatever their names, are kept by
``dedup_lines`` and ignored otherwise. Words and classes are 64-bit hashes: two different sets of m pass for one with a
chance of about m^2 / 2^65.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted_in_place, discard, if_small, materialize, semi, unused

#: The similarity as a whole fraction, so that nothing is rounded.
SIMILARITY = NUM, DEN = 4, 5
#: Classes that may meet by one word; the share of open ones that a round must settle for another to follow.
HOT_CLASSES, ROUND_SHARE = 512, 0.1
#: Buckets in which words, and pairs of them, are counted to see where hot ones may be; at most as many rows are broadcast.
HOT_BUCKETS, HOT_PAIR_BUCKETS = 1 << 18, 1 << 20
#: Pairs of neighbours by rarity, of least hash, by which a class is first held against the earliest class that has such a pair.
LEAD_PAIRS = 3
#: Pairs up to which only the sets of their classes are shuffled to verify them.
FEW_PAIRS = 50_000
#: Leading bits of a hash that make its bucket; bits of a hash that stand below its level of rarity.
BUCKET_BITS, BELOW_LEVEL = 18, 57
#: Words from which on a line has a second word of parities.
SECOND_PARITY = 40
#: Parts in which prefixes are shuffled, one after the other, so that the disk holds one of them; pairs of words of a class, on
#: average, that a part may have.
PASSES, PASS_ROWS = 2, 3
#: Words repeat within a file of lines: with a large dictionary each takes a few bits, which no codec shortens.
LINE_FILES = {"parquet.dictionary.page.size": 8 << 20, "compression": "uncompressed"}


def line_tokens(line: Column) -> Column:
    """The distinct 64-bit word hashes of a lower-cased line without other white space than spaces, sorted."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_except(hashes, F.array(F.xxhash64(F.lit("")))))


def _spaced(text: Column) -> Column:
    """Lower-cased text whose other white space, line breaks apart, is spaces."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    return F.when(odd, F.translate(F.lower(text), "\t\r\x0b\x0c", "    ")).otherwise(F.lower(text))


def _enough(common: Column, na: Column, nb: Column) -> Column:
    """Whether sets of na and nb words with ``common`` in common are alike enough."""
    return common * (NUM + DEN) >= (na + nb) * NUM


def _may_match(a: str, b: str) -> Column:
    """What the parities and the places of a shared word leave open, for rows of (n, at, bits, more); at: twice the place, and 1 if the class is known to go.

    A word that only one of them has changes one parity, so parities that differ are no more than such words.
    The place bounds the overlap if the word is the least that both have; a pair alike enough is met there.
    """
    n, at, bits, more = ([F.col(f"{x}.{c}") for x in (a, b)] for c in ("n", "at", "bits", "more"))
    pos = [F.shiftright(x, 1) for x in at]
    every, odd = bits[0].bitwiseXOR(bits[1]), more[0].bitwiseXOR(more[1])
    long = F.least(*n) >= SECOND_PARITY
    apart = F.when(long, F.bit_count(every.bitwiseXOR(odd)) + F.bit_count(odd)).otherwise(F.bit_count(every))
    open_ = at[0].bitwiseAND(at[1]).bitwiseAND(F.lit(1)) == 0
    return (apart * (NUM + DEN) <= (n[0] + n[1]) * (DEN - NUM)) & _enough(F.least(n[0] - pos[0], n[1] - pos[1]), *n) & open_


def _levels(lines: DataFrame) -> DataFrame:
    """One row: an array of what turns a hash of each bucket into its rank, by exclusive or: the level comes to stand in the leading bits.

    Level 0 is a bucket that at most one line has a word of.
    """
    seen = lines.select(F.explode("toks").alias("t")).groupBy(F.shiftrightunsigned("t", 64 - BUCKET_BITS).alias("id")).agg(F.count("*").alias("n"))
    level = F.when(F.col("n") > 1, F.least(F.lit(63), F.floor(2 * F.log2("n")))).otherwise(0)
    # The leading bits of a hash are those of its bucket.
    lead = F.shiftright("id", BUCKET_BITS - (64 - BELOW_LEVEL))
    turn = F.shiftleft(F.coalesce(level, F.lit(0)).cast("bigint").bitwiseXOR(lead), BELOW_LEVEL)
    every = lines.sparkSession.range(1 << BUCKET_BITS).join(seen, "id", "left").select("id", turn.alias("turn"))
    # An entry for each bucket, whatever the corpus.
    listed = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "turn"))).alias("all"))
    with counted_in_place(lines.sparkSession, BUCKET_BITS + 1):
        return materialize(listed.select(F.col("all.turn").alias("levels")), "levels")


def _classes(lines: DataFrame) -> DataFrame:
    """A row for each class: cls, first (its earliest line), lines, n, bits, more, and head, the rarest words: the prefix and one more."""
    def ranked(t: Column) -> Column:
        return F.coalesce(t.bitwiseXOR(F.get("levels", F.shiftrightunsigned(t, 64 - BUCKET_BITS))), F.lit(0).cast("bigint"))

    bits = F.expr("aggregate(toks, 0L, (a, t) -> a ^ shiftleft(1L, cast(t & 63L as int)))")
    n = F.size("toks")
    more = F.when(n >= SECOND_PARITY, F.expr("aggregate(toks, 0L, (a, t) -> if(t & 64L = 0L, a, a ^ shiftleft(1L, cast(t & 63L as int))))")).otherwise(F.lit(0).cast("bigint"))
    head = F.slice(F.sort_array(F.transform("toks", ranked)), F.lit(1), n - F.expr(f"(size(toks) * {NUM} + {DEN} - 1) div {DEN}").cast("int") + 2)
    # A scalar subquery, used once: so the optimiser puts it where it is used, and no row carries it.
    rows = lines.withColumn("levels", _levels(lines).scalar()).select("cls", F.struct("nd", "k", "tie", "line").alias("key"), n.alias("n"), bits.alias("bits"), more.alias("more"), head.alias("head"))
    by = rows.groupBy("cls").agg(F.min("key").alias("first"), F.count("*").alias("lines"), *[F.first(c).alias(c) for c in ("n", "bits", "more", "head")])
    return materialize(by, "classes", compression="snappy")


def _begun(classes: DataFrame) -> DataFrame:
    """A row for each word of each prefix that other lines may have: pos, at (see ``_may_match``) and tok."""
    prefix = F.slice("head", F.lit(1), F.col("n") - F.expr(f"(n * {NUM} + {DEN} - 1) div {DEN}").cast("int") + 1)
    rows = classes.select("*", F.posexplode(prefix).alias("pos", "tok")).where(F.col("tok") >= 1 << BELOW_LEVEL)
    return rows.withColumn("at", 2 * F.col("pos") + F.col("late").cast("int"))


def _frequent(rows: DataFrame, key: str, buckets: int) -> tuple[DataFrame, int]:
    """The values of ``key`` that more than HOT_CLASSES rows have, and the number of all rows; buckets are counted first, then the values of the heavy ones."""
    keys = rows.select(key, F.col(key).bitwiseAND(F.lit(buckets - 1)).alias("b"))
    held = materialize(keys.groupBy("b").count(), "heavy")
    total = held.agg(F.sum("count")).first()[0] or 0
    heavy = held.where(F.col("count") > HOT_CLASSES).groupBy(F.shiftright("b", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits"))
    # A bit for each bucket, whatever the corpus.
    every = rows.sparkSession.range(buckets // 64).join(heavy, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    bits = materialize(every.groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("every")).select(F.col("every.bits").alias("bits")), "bits")
    in_heavy = keys.withColumn("bits", bits.scalar()).where(F.expr("shiftright(get(bits, shiftright(b, 6)), cast(b & 63 as int)) & 1 = 1"))
    frequent = materialize(in_heavy.groupBy(key).count().where(F.col("count") > HOT_CLASSES).select(key), "hot")
    discard(held)
    discard(bits)
    return frequent, total


def _hot_words(classes: DataFrame) -> DataFrame | None:
    """The words that begin more than HOT_CLASSES classes, or None.

    Such words are in more lines than that, so only those of their levels are counted (a level less, for rounding).
    """
    least = max(0, int(2 * math.log2(HOT_CLASSES + 1)) - 1)
    hot, _ = _frequent(_begun(classes).where(F.col("tok") >= min(least, 62) << BELOW_LEVEL), "tok", HOT_BUCKETS)
    return hot if hot.limit(1).count() else None


def _pairs(found: DataFrame, a: str, b: str) -> DataFrame:
    return found.select(F.col(f"{a}.cls").alias("a"), F.col(f"{b}.cls").alias("b")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later classes, as cls, of those ``pairs`` (a, b: earlier and later) whose whole sets are alike enough."""
    pairs = materialize(pairs.select("a", "b"), "held")
    # Few pairs must not have all sets shuffled.
    if pairs.limit(FEW_PAIRS + 1).count() <= FEW_PAIRS:
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        sets = sets.join(F.broadcast(ends), "cls", "left_semi")
    with_a = pairs.join(sets.select(F.col("cls").alias("a"), F.col("toks").alias("ta")), "a")
    both = with_a.join(sets.select(F.col("cls").alias("b"), F.col("toks").alias("tb")), "b")
    late = both.where(_enough(F.size(F.array_intersect("ta", "tb")), F.size("ta"), F.size("tb"))).select(F.col("b").alias("cls")).distinct()
    late = materialize(late, "alike")
    discard(pairs)
    return late


def _whole(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The words of the classes ``ids`` (cls)."""
    return materialize(semi(lines.select("cls", "toks"), ids, "cls").groupBy("cls").agg(F.first("toks").alias("toks")), "sets", **LINE_FILES)


def _led(classes: DataFrame, lines: DataFrame) -> DataFrame:
    """Classes, as cls, that match the earliest of those with one of the LEAD_PAIRS least pairs of neighbours by rarity in common.

    Of what is alike some pairs differ, wherever they stand in the order; of the rest the least are mostly the same.
    """
    rare = F.filter("head", lambda x: x >= 1 << BELOW_LEVEL)
    beside = F.transform(F.sequence(F.lit(0), F.size("rare") - 2), lambda i: F.xxhash64(F.get("rare", i), F.get("rare", i + 1)))
    least = F.explode(F.slice(F.sort_array(beside), 1, LEAD_PAIRS))
    keyed = materialize(classes.select("cls", rare.alias("rare")).where(F.size("rare") > 1).select("cls", least.alias("key")), "keyed")
    shared = materialize(keyed.groupBy("key").count().where("count > 1").select("key"), "shared")
    rows = semi(keyed, shared, "key").join(classes.select("cls", "first", "n", "bits", "more"), "cls")
    rows = materialize(rows.select("key", F.struct("first", "cls", "n", F.lit(0).alias("at"), "bits", "more").alias("r")), "led")
    leads = rows.groupBy("key").agg(F.min("r").alias("lead"))
    met = rows.join(leads, "key").where((F.col("lead.cls") != F.col("r.cls")) & _may_match("lead", "r"))
    pairs = materialize(_pairs(met, "lead", "r"), "pairs")
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "ends")
    sets = _whole(lines, ends)
    late = _alike(pairs, sets)
    for part in (keyed, shared, rows, pairs, ends, sets):
        discard(part)
    return late


def _marked(classes: DataFrame, late: DataFrame) -> DataFrame:
    """``classes`` with late: whether they are among ``late`` (cls)."""
    told = if_small(late.withColumn("late", F.lit(True)), 2)
    return materialize(classes.join(told, "cls", "left").withColumn("late", F.coalesce("late", F.lit(False))), "marked", compression="snappy")


def _met(rows: DataFrame, key: str, passes: int) -> list[DataFrame]:
    """Pairs (a, b) of classes of ``rows`` that have a ``key`` in common and may match, by parts; a and b as their numbers stand."""
    parts = []
    for i in range(passes):
        part = rows.where(F.pmod(key, F.lit(passes)) == i).select(key, "cls", "n", "at", "bits", "more")
        met = part.alias("x").join(part.alias("y"), F.col(f"x.{key}") == F.col(f"y.{key}")).where((F.col("x.cls") < F.col("y.cls")) & _may_match("x", "y"))
        parts.append(materialize(_pairs(met, "x", "y"), "pairs"))
    return parts


def _second(classes: DataFrame, hot: DataFrame) -> DataFrame:
    """The classes of hot words, a row with ``key`` for each such word and each word after it in the head."""
    second = F.explode(F.expr("slice(head, pos + 2, size(head))"))
    rows = _begun(classes).join(if_small(hot), "tok").select("cls", "first", "n", "at", "bits", "more", "tok", second.alias("next"))
    return rows.withColumn("key", F.xxhash64("tok", "next")).drop("tok", "next")


def _candidates(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs (a, b) of classes that may match, met by words that few classes share; rows (key, r) of two words that many share: all, then by parts."""
    hot = _hot_words(classes)
    rows, crowded = _begun(classes), []
    parts = _met(rows if hot is None else rows.join(if_small(hot), "tok", "left_anti"), "tok", PASSES)
    if hot is not None:
        rows, most = _second(classes, hot), PASS_ROWS * classes.count()
        keys, total = _frequent(rows, "key", HOT_PAIR_BUCKETS)
        few = rows
        if keys.limit(1).count():
            few = rows.join(if_small(keys), "key", "left_anti")
            held = rows.join(if_small(keys), "key").select("key", F.struct("first", "cls", "n", "at", "bits", "more").alias("r"))
            held = materialize(held, "second")
            n = math.ceil(held.count() / most)
            crowded = [held] + [held.where(F.pmod("key", F.lit(n)) == i) for i in range(n)]
        parts += _met(few, "key", math.ceil(total / most))
        discard(keys)
        discard(hot)
    pairs = materialize(reduce(DataFrame.unionByName, parts).distinct(), "pairs")
    for part in parts:
        discard(part)
    return pairs, crowded


def _late_cold(pairs: DataFrame, classes: DataFrame, sets: DataFrame, led: DataFrame) -> DataFrame:
    """Classes of ``pairs`` that match an earlier one, but those ``led`` (cls). Each is first held against the earliest that it met."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "ends")
    firsts = semi(classes.select("cls", "first"), ends, "cls")
    told = pairs.join(firsts.select(F.col("cls").alias("a"), F.col("first").alias("fa")), "a").join(firsts.select(F.col("cls").alias("b"), F.col("first").alias("fb")), "b")
    after = F.col("fa") < F.col("fb")
    told = told.select(F.when(after, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(after, F.col("b")).otherwise(F.col("a")).alias("b"), F.least("fa", "fb").alias("since"))
    told = materialize(told.join(if_small(led.select(F.col("cls").alias("b"))), "b", "left_anti"), "told")
    settled = _alike(told.groupBy("b").agg(F.min(F.struct("since", "a")).alias("m")).select("m.a", "b"), sets)
    rest = told.join(if_small(settled.select(F.col("cls").alias("b"))), "b", "left_anti")
    others = _alike(rest, sets)
    late = materialize(settled.unionByName(others), "late")
    for part in (ends, told, settled, others):
        discard(part)
    return late


def _late_hot(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Classes of ``rows`` that match an earlier one with the same key, but those marked already."""
    remaining, opened, done = rows, None, []
    while True:
        leads = remaining.groupBy("key").agg(F.min("r").alias("lead"))
        if remaining is rows:
            remaining = rows.where(F.col("r.at").bitwiseAND(F.lit(1)) == 0)
        beside = remaining.join(leads, "key").where(F.col("lead.cls") != F.col("r.cls"))
        settled = _alike(_pairs(beside.where(_may_match("lead", "r")), "lead", "r"), sets)
        done.append(settled)
        left = materialize(beside.select("key", "r", F.col("r.cls").alias("cls")).join(if_small(settled), "cls", "left_anti").drop("cls"), "open")
        before, after = remaining.count(), left.count()
        if opened and remaining is not opened:
            discard(remaining)
        remaining, opened = left, opened or left
        if before - after < ROUND_SHARE * before or not after:
            break
    # Later rounds' leads were held against those before them, but not against those that earlier rounds settled.
    settled = materialize(reduce(DataFrame.unionByName, done).distinct(), "settled")
    late = opened.select("key", F.col("r").alias("late"), F.col("r.cls").alias("cls")).join(if_small(settled), "cls", "left_anti").drop("cls")
    met = late.join(rows.select("key", F.col("r").alias("early")), "key")
    met = met.where((F.col("early.first") < F.col("late.first")) & _may_match("early", "late"))
    done.append(_alike(_pairs(met, "early", "late"), sets))
    late = materialize(reduce(DataFrame.unionByName, done).distinct(), "late")
    for part in (*done, remaining, opened, settled):
        discard(part)
    return late


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """nd, k and tie, which tell a document, and the numbers of its lines that go; only documents with such."""
    keyed = _keyed(docs, doc_id, text)
    exploded = keyed.select("nd", "k", "tie", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line", "words"))
    tokens = exploded.where(F.trim("words") != "").select("nd", "k", "tie", "line", line_tokens(F.col("words")).alias("toks"))
    lines = materialize(tokens.select("nd", "k", "tie", "line", F.xxhash64("toks").alias("cls"), "toks"), "lines", **LINE_FILES)
    classes = _classes(lines)
    led = _led(classes, lines)
    marked = _marked(classes, led)
    discard(classes)
    pairs, crowded = _candidates(marked)
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cls"))
    if crowded:
        involved = involved.unionByName(crowded[0].select("r.cls"))
    involved = materialize(involved.distinct(), "involved")
    sets = _whole(lines, involved)
    late = _late_cold(pairs, marked, sets, led).unionByName(led)
    for part in crowded[1:]:
        late = late.unionByName(_late_hot(part, sets)).distinct()
    if crowded:
        discard(crowded[0])
    late = materialize(late.withColumn("late", F.lit(True)), "late")
    flagged = marked.select("cls", "first", "lines").join(if_small(late, 2), "cls", "left").where("lines > 1 or late")
    flagged = materialize(flagged.select("cls", "first", F.coalesce("late", F.lit(False)).alias("late")), "flagged")
    told = semi(lines.select("nd", "k", "tie", "line", "cls"), flagged.select("cls"), "cls").join(flagged, "cls")
    gone = told.where(F.col("late") | (F.struct("nd", "k", "tie", "line") != F.col("first"))).groupBy("nd", "k", "tie").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    gone = materialize(gone, "gone")
    for part in (lines, marked, led, pairs, involved, sets, late, flagged):
        discard(part)
    return gone


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).isNull().alias("nd"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k"), F.xxhash64(t).alias("tie"), t.alias("text"))


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers, from 0) of every document."""
    gone = removed_lines(docs, doc_id, text)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = _keyed(docs, doc_id, text).select("nd", "k", "tie", (breaks + 1).alias("n_lines"))
    found = rows.join(gone, ["nd", "k", "tie"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select(F.when(~F.col("nd"), F.col("k")).alias("doc_id"), "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; null texts stay null."""
    names = unused(docs, "nd", "k", "tie", "removed")
    gone = removed_lines(docs, doc_id, text).toDF(*names)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keys = (F.col(doc_id).isNull(), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)), F.xxhash64(t))
    joined = docs.withColumns(dict(zip(names, keys, strict=False))).join(gone, names[:3], "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.coalesce(names[3], F.array().cast("array<int>")), i)), "\n")
    return joined.select(*[F.when(F.col(text).isNotNull(), kept).alias(c) if c == text else F.col(c) for c in docs.columns])
