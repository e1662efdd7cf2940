"""Exact similarity join of profile names with list names, without comparing every pair that shares a letter.

Three facts make it lossless for matches (score at or over the threshold):

* Different birth dates cap the score under the threshold, so a pair needs equal dates or a missing one.
* The common subsequence is at most the number of letters two names share, counted with repeats. A pair of lengths
  (m, n) therefore needs ``o = ceil(t (m + n) / 2)`` common letters.
* If two sets share ``o`` elements, then under any fixed order the first ``m - o + L`` of one and ``n - o + L`` of the
  other share at least ``L`` (prefix filter). Joining on hashed ``L``-element combinations of those prefixes finds
  every such pair. Letters are ordered rare first, so common letters seldom take part.

The number of keys is bounded whatever the length. A pair belongs to the class of its longer name: ``L`` falls from
three letters to one as names grow, and in very long ones every ``g``-th repeat of a letter stands for ``g`` of them
(``o`` common letters leave at least ``(o - (g - 1) * alphabet) / g`` of those). A name has keys for its own class and
for those of longer partners, fewer than 200 in all. Pairs with equal birth dates meet on the date as well as a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vettra.constants import MATCH_THRESHOLD, SAME_DOB_BOOST
from vettra.functions import similarity
from vettra.functions.binding import bind
from vettra.functions.names import canonical_letters, canonical_name
from vettra.session import stored

# By class: the longest name, how many letters a key combines, and how many repeats of a letter stand for one (g).
# From 350 letters on each class is 1.6 times as long as the one before; a partner is at most 1.53 times as long.
CLASSES = [(3, 1, 1), (22, 3, 1), (48, 2, 1), (350, 1, 1)]
CLASSES += [(longest, 1, -(-longest // 150)) for longest in (int(350 * 1.6**i) for i in range(1, 21))]
# Similarity to reach before the birth date is looked at, times 10,000; scores are rounded to four digits.
UNKNOWN_BASE = round(MATCH_THRESHOLD * 10_000) - 1
SAME_BASE = round((MATCH_THRESHOLD - SAME_DOB_BOOST) * 10_000) - 1
OPEN, BLANK = 0, 1


def _needed(per_10000: Column, total: Column) -> Column:
    """Common letters a pair of summed length ``total`` needs, in whole numbers."""
    return F.floor((per_10000 * total + 19999) / 20000).cast("int")


def _combinations(bag: Column, size: int, head: list[Column]) -> Column:
    if size == 1:
        return F.transform(bag, lambda x: F.xxhash64(*head, x))
    return F.flatten(
        F.transform(
            bag,
            lambda x, i: bind(
                F.slice(bag, i + 2, F.size(bag)), lambda rest: _combinations(rest, size - 1, [*head, x])
            ),
        )
    )


def _class_of(length: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(c[0]) for c in CLASSES]), lambda longest: longest < length))


def _of_class(values: list[int], k: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), k)


def signature_keys(bag: Column, per_10000: Column, *scope: Column) -> Column:
    """The keys of a name given by its letter bag, for partners of every length.

    ``per_10000`` is the similarity to reach, times 10,000; keys of different ``scope`` values never meet.
    """
    none = F.array().cast("array<bigint>")
    facts = F.struct(
        F.size(bag).alias("own"),
        bag.alias("bag"),
        per_10000.alias("t"),
        F.xxhash64(*scope).alias("scope"),
    )

    def for_classes(f: Column) -> Column:
        longest = F.floor(f.own * (20000 - f.t) / f.t).cast("int")
        nearest = F.ceil(f.own * f.t / (20000 - f.t)).cast("int")
        mine = _class_of(f.own)

        def for_class(k: Column) -> Column:
            shortest = _of_class([1, *(c[0] + 1 for c in CLASSES)], k)
            needed = _needed(f.t, f.own + F.when(k == mine, nearest).otherwise(shortest))
            every = _of_class([c[2] for c in CLASSES], k)
            shared = F.floor((needed - (every - 1) * len(similarity.RARE_FIRST)) / every).cast("int")
            letters = F.when(every == 1, f.bag).otherwise(
                F.filter(f.bag, lambda x: (similarity.repeat_of(x) + 1) % every == 0)
            )

            def keys(c: Column) -> Column:
                def of(size: int) -> Column:
                    prefix = F.slice(c.letters, 1, F.greatest(F.size(c.letters) - c.shared + size, F.lit(0)))
                    return _combinations(prefix, size, [f.scope, k])

                found = F.when(c.size == 3, of(3)).when(c.size == 2, of(2)).otherwise(of(1))
                return F.when(c.needed > f.own, none).otherwise(found)

            size = _of_class([c[1] for c in CLASSES], k)
            facts = F.struct(letters.alias("letters"), shared.alias("shared"), needed.alias("needed"), size.alias("size"))
            return bind(facts, keys)

        return F.flatten(F.transform(F.sequence(mine, _class_of(longest)), for_class))

    return F.when(F.size(bag) > 0, bind(facts, for_classes)).otherwise(none)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Spread rows over all shuffle partitions.

    Distinct names are few bytes and much work: left to size-based coalescing they would end up in a handful of tasks.
    They are dealt by a hash of the keys, as Spark leaves out a shuffle by the very keys that rows were grouped by.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def reachable(same: Column, bag: Column, other_bag: Column) -> Column:
    """Whether (canonical_name, entry_cname) can reach the threshold; ``same`` tells equal birth dates.

    The letter bound needs no subsequence work and holds for the plain and the token-sorted form alike, which have the
    same letters.
    """
    name, other = F.col("canonical_name"), F.col("entry_cname")
    total = F.length(name) + F.length(other)
    needed = _needed(F.when(same, SAME_BASE).otherwise(UNKNOWN_BASE), total)
    long_enough = (total > 0) & (F.least(F.length(name), F.length(other)) >= needed)
    return F.when(long_enough, F.size(F.array_intersect(bag, other_bag)) >= needed).otherwise(False)


def with_similarity(rows: DataFrame, name: str, other: str) -> DataFrame:
    """Add ``base``, the similarity of two names as written: every distinct pair once, spread over all tasks."""
    pairs = spread(rows.select(F.col(name).alias("_name"), F.col(other).alias("_other")).distinct(), "_name", "_other")
    told = pairs.withColumn(
        "base", similarity.name_similarity(canonical_name(F.col("_name")), canonical_name(F.col("_other")))
    )
    met = (F.col(name) == F.col("_name")) & (F.col(other) == F.col("_other"))
    return rows.join(told.hint("merge"), met, "left").drop("_name", "_other")


def based(pairs: DataFrame, is_long: Column) -> DataFrame:
    """Rows with canonical_name and entry_cname, and what else ``pairs`` has, with ``base``: null where out of reach.

    Names over one word of bits are scored in Python, as an expression would take a thousand times as long.
    """
    name, other = F.col("canonical_name"), F.col("entry_cname")
    # The looser bound of equal dates; letters are counted before any subsequence is looked for.
    near = reachable(F.lit(True), similarity.letter_bag(name), similarity.letter_bag(other))
    short = pairs.where(~is_long).withColumn("base", F.when(near, similarity.name_similarity(other, name)))
    return short.unionByName(similarity.long_similarity(pairs.where(is_long), SAME_BASE))


def with_score(pairs: DataFrame, told: DataFrame, keys: list[str], same: Column) -> DataFrame:
    """``pairs`` at or over the threshold, by the ``base`` that ``told`` has for ``keys``."""
    # A null base is a pair out of reach; least() would pass over it and give 1.
    told = told.where("base IS NOT NULL").where(similarity.with_dob(F.col("base"), F.lit("same")) >= MATCH_THRESHOLD)
    relation = F.when(same, "same").otherwise("unknown")
    return (
        pairs.join(told.hint("merge"), keys)
        .withColumn("score", similarity.with_dob(F.col("base"), relation))
        .withColumn("dob_match", same)
        .where(F.col("score") >= MATCH_THRESHOLD)
        .drop("base")
    )


def scored(pairs: DataFrame, same: Column) -> DataFrame:
    """Score (canonical_name, entry_cname) pairs and keep those at or over the threshold.

    A distinct pair of names is scored once, whatever birth dates and entries it stands for. Scores are stored before
    they are filtered: Spark moves a filter below ``distinct`` and to the other side of the join, and would score every row.
    """
    keys = ["canonical_name", "entry_cname"]
    is_long = F.greatest(F.length("canonical_name"), F.length("entry_cname")) > similarity.WORD_BITS
    told = stored(based(spread(pairs.select(keys).distinct(), *keys), is_long), "scored-names")
    return with_score(pairs, told, keys, same)


def best_names(pairs: DataFrame, *keys: str) -> DataFrame:
    """Best-scoring name per profile key and entry; the earliest name wins a tie."""
    best = F.min_by(
        F.struct("entry_name", "score", "dob_match", "entry_letters"), F.struct(-F.col("score"), F.col("pos"))
    )
    return (
        pairs.groupBy(*keys, "entry_id")
        .agg(best.alias("best"))
        .select(
            *keys,
            "entry_id",
            F.col("best.entry_name").alias("matched_name"),
            F.col("best.score").alias("score"),
            F.col("best.dob_match").alias("dob_match"),
            F.col("best.entry_letters").alias("entry_letters"),
        )
    )


def keyed_names(rows: DataFrame, name: str, number: str, per_10000: int) -> DataFrame:
    """(name, number, keys) of the distinct names: keys are worked out once a name.

    They are stored: exploding them implies that they are not empty, and Spark would work that out for every row.
    """
    keys = signature_keys(similarity.letter_bag(F.col(name)), F.lit(per_10000), F.lit(0))
    distinct = spread(rows.select(name).distinct(), name)
    place = F.monotonically_increasing_id()
    # A name of more than a word of bits has a negative number.
    place = F.when(F.length(name) > similarity.WORD_BITS, -1 - place).otherwise(place)
    told = distinct.withColumns({"keys": F.array_distinct(keys), number: place})
    # Grows with the names and is much larger in memory than its files are: never a broadcast.
    return stored(told, "keyed-names").hint("merge")


def _met_numbers(people: DataFrame, listed: DataFrame, same: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct (person, scope, listed) of the numbered names that share a scope and a key, and the two tables of names."""

    def keyed(rows: DataFrame, name: str, number: str) -> tuple[DataFrame, DataFrame]:
        told = keyed_names(rows, name, number, SAME_BASE if same else UNKNOWN_BASE)
        # Only what finds a pair travels with the keys; a name may be long, so its number stands for it.
        keys = spread(rows.join(told, name).select(number, "scope", "keys"), number, "scope")  # a row becomes dozens
        keys = keys.select(number, "scope", F.explode("keys").alias("key")).withColumn("key", F.xxhash64("key", "scope"))
        return told.select(name, number).hint("merge"), keys

    names, left = keyed(people, "canonical_name", "person")
    others, right = keyed(listed, "entry_cname", "listed")
    # Spark's estimate leaves out that a row becomes one a key, so it would broadcast lists far too large for the driver.
    # Scopes may share a hash, so they are compared again.
    pairs = left.join(right.withColumnRenamed("scope", "entry_scope").hint("merge"), "key").where("scope = entry_scope")
    return pairs.select("person", "scope", "listed").distinct(), names, others


def _met(people: DataFrame, listed: DataFrame, same: bool) -> DataFrame:
    """Distinct pairs of (canonical_name, scope) and (entry_cname, scope) rows of one scope that share a key."""
    pairs, names, others = _met_numbers(people, listed, same)
    return pairs.join(names, "person").join(others, "listed").select("canonical_name", "scope", "entry_cname")


def all_found(people: DataFrame, names: DataFrame, same: bool) -> DataFrame:
    """Best-scoring name per (canonical_name, scope) and entry, for people and list names of equal ``scope``.

    Stored, as the rows of a name and birth date are few; those of all profiles that have them may be far more than disks hold.
    """
    pairs, numbers, others = _met_numbers(people, names.select("entry_cname", "scope").distinct(), same)
    pairs = stored(pairs, "near-names")
    distinct = pairs.select("person", "listed").distinct().join(numbers, "person").join(others, "listed")
    is_long = F.least("person", "listed") < 0
    told = stored(based(spread(distinct, "person", "listed"), is_long).select("person", "listed", "base"), "scored-names")
    listed = names.select("entry_cname", "scope", "entry_id", "pos", "entry_name", "entry_letters").join(others, "entry_cname")
    rows = with_score(pairs, told, ["person", "listed"], F.lit(same)).join(listed.drop("entry_cname").hint("merge"), ["listed", "scope"])
    shares_letter = F.arrays_overlap(canonical_letters(F.col("canonical_name")), F.col("entry_letters"))
    best = best_names(rows, "person", "scope").join(numbers, "person")
    return stored(best.where(shares_letter).drop("entry_letters", "person"), "best-names")


def all_matches(profiles: DataFrame, names: DataFrame) -> DataFrame:
    """Every (profile, entry) at or over the threshold that shares a first letter, joined back to the profile rows.

    ``profiles`` needs canonical_name and dob_iso; all its columns are kept. Equal dates meet with the date as scope. On
    the name alone OPEN pairs every name with undated entries, BLANK the names of undated profiles with dated entries.
    """
    columns = [*profiles.columns, "entry_id", "matched_name", "score", "dob_match"]

    def rows(profiles: DataFrame, names: DataFrame, same: bool) -> DataFrame:
        found = all_found(profiles.select("canonical_name", "scope").distinct(), names, same)
        return profiles.join(found.hint("merge"), ["canonical_name", "scope"]).select(columns)

    dated = profiles.where("dob_iso is not null").withColumn("scope", F.col("dob_iso").cast("date"))
    # Undated rows are few or none: without them, no name need be keyed without its date.
    no_dob, no_entry_dob = (not x.isEmpty() for x in (profiles.where("dob_iso is null"), names.where("entry_dob is null")))
    on_date = rows(dated, names.where("entry_dob is not null").withColumn("scope", F.col("entry_dob")), True)
    scopes = F.when(F.col("dob_iso").isNull(), F.array(F.lit(OPEN), F.lit(BLANK))).otherwise(F.array(F.lit(OPEN)))
    scope = F.when(F.col("entry_dob").isNull(), OPEN).otherwise(BLANK)
    if not no_dob and not no_entry_dob:
        return on_date
    people, listed = profiles.withColumn("scope", F.explode(scopes)), names.withColumn("scope", scope)
    people = people if no_entry_dob else people.where(F.col("scope") == BLANK)
    listed = listed if no_dob else listed.where(F.col("scope") == OPEN)
    return on_date.unionByName(rows(people, listed, False))


def page_matches(profiles: DataFrame, names: DataFrame, pages: DataFrame) -> DataFrame:
    """Matches among the looked-up pages only: the page is cut first, then birth dates are compared.

    ``pages`` holds (letters, entry_id, entry_dob). Equal dates join on letters and date together, so a profile meets
    the few dated entries of its page that can match, plus the undated ones.
    """
    people = spread(profiles.select("canonical_name", "dob_iso", "letters").distinct(), "canonical_name")
    listed = pages.select("letters", "entry_id", F.col("entry_dob").cast("date").alias("page_dob"))
    dated, undated = listed.where("page_dob is not null"), listed.where("page_dob is null").drop("page_dob")
    columns = ["canonical_name", "dob_iso", "entry_id"]
    same = (
        people.where("dob_iso is not null")
        .join(dated.withColumnRenamed("page_dob", "dob_iso"), ["letters", "dob_iso"])
        .select(columns)
    )
    no_entry_dob = people.join(undated, "letters").select(columns)
    no_own_dob = people.where("dob_iso is null").join(dated.drop("page_dob"), "letters").select(columns)
    pairs = same.unionByName(no_entry_dob).unionByName(no_own_dob).join(names.hint("merge"), "entry_id")
    equal = F.coalesce(F.col("dob_iso") == F.col("entry_dob"), F.lit(False))
    kept = stored(pairs, "near-names")
    found = stored(best_names(scored(kept, equal), "canonical_name", "dob_iso").drop("entry_letters"), "best-names")
    rows = profiles.alias("p").join(
        found.alias("f").hint("merge"),
        (F.col("p.canonical_name") == F.col("f.canonical_name")) & F.col("p.dob_iso").eqNullSafe(F.col("f.dob_iso")),
    )
    return rows.select("p.*", "f.entry_id", "f.matched_name", "f.score", "f.dob_match")
