"""Fuzzy line deduplication by MinHash, with DataFrame operations only.

  1. Every line that is not blank, trimmed and lower-cased, is one node, named by its 64-bit hash; equal lines are
     one node from here on, merged before anything else is done with them.
  2. Its shingles are the WIDTH characters at every place, as 64-bit hashes. Two lines are similar if the Jaccard of their
     sets of shingles and the ratio of their numbers of places both reach SIMILARITY. One changed character of a line of
     50 characters, or one changed word of a line of 110, leaves them similar.
  3. MinHash: of one random order, the shingles are dealt into BANDS bins by their hash, and the least and the greatest
     hash of a bin, in two orders, are its values. Lines of 4 ** j * LEAST places and more first keep one shingle of 4 ** j, those of
     the least hashes, which is the same choice in every line. Lines of fewer than FEW places have BANDS orders of their own
     instead of bins. Lines near a bound between classes take part in both, so that no similar pair falls between.
  4. High-recall banding: a bin's four values are a key. A pair at Jaccard 0.8 shares one of its keys with
     probability 0.99 at least (the README has measured figures by length).
  5. Each member of a list is held against its least member, if 60 bits of their MinHash values, and 120 together, are as close as
     those of similar pairs, by exact Jaccard. Of lists whose members are then not all in one component, the members that are close to
     one of another component get a sketch of their whole set, by which no similar pair is lost and nearly all others are told apart.
     They are held against PIVOTS members of their list, TURNS times, which joins most of a large family; then all members that are still
     of different components are held against each other by bits and sketches, in long lists block by block, and those that may be similar by
     exact Jaccard, the closest first, ROUND pairs at a time; pairs that earlier rounds have put into one component are left out. So the
     components are those of all pairs that share a key, and a list of near copies, which its least member settles, is not expanded
     into pairs. Of all bands only members of lists of two and more are stored, once, and pairs; keys are dealt band by band, as
     many at once as have ENTRIES members.
  6. Distributed union-find over verified links; of each component the earliest line, by doc_id, then text
     hash, then line number, is kept, and every other occurrence of any of its lines is removed.

Cases: blank lines are never removed; null doc_ids come last; null and empty texts have no lines;
rows that repeat doc_id and text are one document and keep the same lines; a document may lose all of its
lines and then has an empty text; very long texts and lines are read whole; other columns, whatever their names, pass unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmend.llm.common import any_of, components, drop_stash, id_key, lookup, named, stash, text_hash, unnamed
from gridmend.operators.store import small

WIDTH = 5
BANDS = 10
KEYS = [f"k{i}" for i in range(BANDS)]
#: Entries of lists that a pass makes, if they are not those of one band: it takes as many bands at once as that allows.
ENTRIES = 10_000_000
SIMILARITY = 0.8
#: Places from which a line's shingles are dealt into bins, those that it must keep, and the share of one class in the next.
FEW, LEAST, STEP = 48, 128, 4
#: Of 6 * BANDS bits, those in which similar lines may differ.
APART = 15
#: Members of a list that one side of a block of comparisons holds, and of a list that is compared without blocks.
BLOCK, SET_BLOCK = 1024, 64
#: Line hashes that may be broadcast, of some 20 bytes each; more of them are joined by a shuffle.
BROADCAST = 2_000_000
#: Words of 64 bits of a sketch; members of a list that all others are held against in a turn, and turns.
WORDS, PIVOTS, TURNS = 16, 8, 2
#: Pairs of lines that are compared at a time.
ROUND = 2_000_000


def normal(line: Column) -> Column:
    """The form in which a lower-cased line is compared."""
    odd = any_of([F.contains(line, F.lit(c)) for c in "\t\r\v\f"])
    return F.when(odd, F.btrim(line, F.lit(" \t\r\v\f"))).otherwise(F.trim(line))


def line_rows(docs: DataFrame, *cols: Column) -> DataFrame:
    """(cols, line_no, lk, line) of the lines that take part, once for each occurrence."""
    rows = docs.select(*cols, F.posexplode(F.split(F.lower(F.col("text").cast("string")), "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", normal(F.col("line"))).where(F.length("line") > 0)
    return rows.withColumn("lk", F.xxhash64("line"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(lk, line), dealt by lk."""
    return line_rows(docs).select("lk", "line").dropDuplicates(["lk"])


def occurrences(docs: DataFrame) -> DataFrame:
    """(no_id, id0, hash, line_no, lk) of the lines that take part."""
    return line_rows(docs, F.col("doc_id").isNull().alias("no_id"), id_key().alias("id0"), text_hash().alias("hash")).drop("line")


def _class(places: Column) -> Column:
    """The class of a line: it keeps one shingle of STEP ** class."""
    return F.greatest(F.lit(0), F.floor(F.log(F.greatest(places, F.lit(1)) / LEAST) / F.log(F.lit(float(STEP))) + 1e-9)).cast("int")


def measured(lines: DataFrame, *cols: str) -> DataFrame:
    """lines (lk, line) with n, the places, and b, four bytes a character, instead of the line."""
    return lines.select("lk", *cols, F.greatest(F.length("line") - (WIDTH - 1), F.lit(1)).alias("n"), F.encode("line", "UTF-32").alias("b"))


def shingles(lines: DataFrame, *cols: str) -> DataFrame:
    """(lk, cols, x): a row for the shingle at each place of measured lines; a line shorter than a shingle is one itself."""
    rows = lines.select("lk", *cols, "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return rows.select("lk", *cols, F.xxhash64(F.substring("b", F.col("i") * 4 + 1, F.lit(4 * WIDTH))).alias("x"))


def signatures(lines: DataFrame) -> DataFrame:
    """(lk, kind, k0, k1, ..., sig, more) of distinct lines (lk, line), dealt by lk: for each kind, which are -1 for orders of
    their own and the classes from 0, the keys of the bands and twice 6 * BANDS bits that stand for the values."""
    n = F.col("n")
    low, high = _class(n * SIMILARITY), _class(n / SIMILARITY)
    # an order is a class, or of orders of their own a band less 16; dealt out by line, not by shingle
    own = F.array(*[F.lit(band - 16) for band in range(BANDS)])
    orders = F.when(n < int(FEW * SIMILARITY), own).when(n < FEW, F.concat(own, F.array(low))).when(high > low, F.array(low, high)).otherwise(F.array(low))
    sized = measured(lines).select("lk", "n", "b", F.explode(orders).alias("of"))
    step = STEP.bit_length() - 1
    rows = shingles(sized, "of").where(f"of <= 0 or shiftrightunsigned(x, 64 - {step} * of) = 0")
    # a slot is a kind and a band
    rows = rows.select("lk", F.when(F.col("of") < 0, F.col("of")).otherwise(F.col("of") * 16 + F.pmod("x", F.lit(BANDS))).cast("int").alias("slot"), "x")
    rows = rows.select("lk", "slot", F.when(F.col("slot") < 0, F.xxhash64("x", "slot")).otherwise(F.col("x")).alias("x"))
    turned = F.expr("shiftleft(x, 32) | shiftrightunsigned(x, 32)")
    bands = rows.groupBy("lk", "slot").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min(turned).alias("c"), F.max(turned).alias("d"))

    # of each value a bit or two that neither the bin nor the order depends on, and as many again
    bits = F.expr("(shiftright(a, 8) & 3) | (shiftright(b, 6) & 12) | (shiftright(c, 36) & 16) | (shiftright(d, 35) & 32)")
    more = F.expr("(shiftright(a, 12) & 1) | (shiftright(b, 11) & 2) | (shiftright(c, 40) & 12) | (shiftright(d, 38) & 48)")
    bands = bands.select("lk", F.expr("shiftright(slot, 4)").alias("kind"), F.expr("slot & 15").alias("band"), F.xxhash64("slot", "a", "b", "c", "d").alias("key"), bits.alias("bits"), more.alias("more"))
    keys = [F.min(F.when(F.col("band") == i, F.col("key"))).alias(c) for i, c in enumerate(KEYS)]
    return bands.groupBy("lk", "kind").agg(*keys, *[F.expr(f"bit_or(shiftleft({c}, 6 * band))").alias(out) for c, out in (("bits", "sig"), ("more", "more"))])


def entries_of(signed: DataFrame) -> DataFrame:
    """(key, lk, sig) of each band whose column signed has."""
    keys = [c for c in signed.columns if c in KEYS]
    return signed.select("lk", "sig", F.explode(F.array(*keys)).alias("key")).where("key is not null")


def _apart(x: str, y: str) -> Column:
    """Of the bits sig and more of x and y, the number that differ."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in ("sig", "more")])


def _close(x: str, y: str) -> Column:
    """Whether the bits of x and y are as close as those of similar lines."""
    return (F.bit_count(F.col(f"{x}.sig").bitwiseXOR(F.col(f"{y}.sig"))) <= APART) & (_apart(x, y) <= 2 * APART - 2)


def shingle_set(line: Column) -> Column:
    """The distinct shingles of a line, as an array of 64-bit hashes."""
    places = F.sequence(F.lit(0), F.greatest(F.length(line) - WIDTH, F.lit(0)))
    # as an array's only element the encoded line is made once, not once for each place
    hashed = F.transform(F.array(F.encode(line, "UTF-32")), lambda b: F.transform(places, lambda i: F.xxhash64(F.substring(b, i * 4 + 1, F.lit(4 * WIDTH)))))
    return F.array_distinct(hashed[0])


def _similar(x: Column, y: Column) -> Column:
    """Whether the Jaccard of two sets reaches SIMILARITY."""
    common = F.size(F.array_intersect(x, y))
    return common >= SIMILARITY * (F.size(x) + F.size(y) - common)


def _texts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(lk, line) of the lines asked for (lk) of docs, or of lines (lk, line), stored."""
    asked = stash(asked.distinct())
    small = asked.count() <= BROADCAST
    rows = docs if docs.columns == ["lk", "line"] else line_rows(docs).select("lk", "line")
    out = stash(rows.join(F.broadcast(asked) if small else asked, "lk", "left_semi").dropDuplicates(["lk"]))
    drop_stash(asked)
    return out


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The distinct pairs (lk, rep) that are similar, stored. Lines travel as text; no row holds more than two lines and their sets."""
    texts = _texts(docs, pairs.select(F.explode(F.array("lk", "rep")).alias("lk")))
    # pairs of unlike lengths need no text
    places = F.greatest(F.length("line") - (WIDTH - 1), F.lit(1))
    n, m = (small(texts.select(F.col("lk").alias(c), places.alias(out)), BROADCAST // 4) for c, out in (("lk", "n"), ("rep", "m")))
    sized = pairs.join(n, "lk").join(m, "rep").where(F.least("n", "m") >= SIMILARITY * F.greatest("n", "m")).select("lk", "rep")
    x = sized.join(texts.select("lk", F.col("line").alias("x")), "lk")
    # dealt before the sets are made, so that the sets of rep are made once a line and aren't shuffled
    y = texts.select(F.col("lk").alias("rep"), "line").repartition("rep").select("rep", shingle_set(F.col("line")).alias("t"))
    # a generator's output is made once, however often it is named
    sets = x.join(y.hint("merge"), "rep").select("lk", "rep", "t", F.explode(F.array(shingle_set(F.col("x")))).alias("s"))
    out = stash(sets.where(_similar(F.col("s"), F.col("t"))).select("lk", "rep"))
    drop_stash(texts)
    return out


def _lists(entries: DataFrame, *aggs: Column, where: str) -> DataFrame:
    """entries (key, lk, ...) of the lists that ``where`` asks for, with aggs of each list."""
    # keys that hold a thousandth of all entries are few; a share of the lines is enough to name them all but surely, and it
    # decides only where a list is counted
    share = entries.where("pmod(xxhash64(lk), 64) = 0").groupBy("key").agg(F.count("*").alias("n"))
    total = share.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r.key for r in share.where(F.col("n") > F.lit(max(8, total // 1000))).collect()]  # 1,000 at most
    counted = lambda rows: rows.groupBy("key").agg(*aggs).where(where)
    cold = entries.where(~F.col("key").isin(hot)).repartition("key") if hot else entries.repartition("key")
    lists = cold.join(counted(cold).hint("shuffle_hash"), "key")
    if hot:
        warm = entries.where(F.col("key").isin(hot))
        lists = lists.unionByName(warm.join(F.broadcast(counted(warm)), "key"))
    return lists


def _passes(signed: DataFrame) -> list[DataFrame]:
    """signed with a few of its keys each, so that no more of its lists exist at a time."""
    rest = [c for c in signed.columns if c not in KEYS]
    passes = min(BANDS, max(1, -(-signed.count() * BANDS // ENTRIES)))
    bands = -(-BANDS // passes)
    return [signed.select(*rest, *KEYS[i : i + bands]) for i in range(0, BANDS, bands)]


def _all_of(parts: list[DataFrame]) -> DataFrame:
    """The distinct rows of stored tables, stored in their stead."""
    out = stash(reduce(DataFrame.unionByName, parts).distinct())
    for t in parts:
        drop_stash(t)
    return out


def members_of(signed: DataFrame) -> list[DataFrame]:
    """(key, lk, sig, more) of the members of lists of two and more, stored by pass."""
    # more goes along in lk
    passes = _passes(signed.withColumn("lk", F.struct("lk", "more")).drop("more"))
    lists = [_lists(entries_of(part), F.count("*").alias("n"), where="n > 1") for part in passes]
    return [stash(rows.select("key", "lk.lk", "sig", "lk.more")) for rows in lists]


def first_pairs(members: list[DataFrame]) -> DataFrame:
    """(lk, rep): each member of a list with its least, if their bits are close, stored."""
    parts = []
    for part in members:
        lists = _lists(part, F.count("*").alias("n"), F.min(F.struct("lk", "sig", "more")).alias("least"), where="n > 1").select("lk", F.struct("sig", "more").alias("x"), "least")
        parts.append(stash(lists.where((F.col("lk") != F.col("least.lk")) & _close("x", "least")).select("lk", F.col("least.lk").alias("rep")).distinct()))
    return _all_of(parts)


def _tagged(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows (lk, ...) with comp, the component of the line, by comps (lk, comp)."""
    return rows.join(comps, "lk", "left").withColumn("comp", F.coalesce("comp", "lk"))


def unsettled(members: list[DataFrame], comps: DataFrame) -> DataFrame:
    """(key, n, lk, sig, more, comp) of the lists whose members are of different components, stored."""
    parts, comps = [], small(comps, BROADCAST // 4)
    for part in members:
        # of two members the one has been held against the other
        counts = [F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")]
        parts.append(stash(_lists(_tagged(part, comps), *counts, where="n > 2 and lo <> hi").select("key", "n", "lk", "sig", "more", "comp")))
    out = stash(reduce(DataFrame.unionByName, parts))
    for t in parts:
        drop_stash(t)
    return out


def _met(lists: DataFrame, where: Column, how: str = "inner") -> list[DataFrame]:
    """The pairs x, y of members of one list and of different components for which where holds; with left_semi those members x."""
    few, many = lists.where(F.col("n") <= SET_BLOCK), lists.where(F.col("n") > SET_BLOCK)
    # each block of a long list meets each in a place of its own
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = many.withColumn("block", F.pmod(F.xxhash64("lk"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    turned = dealt.select(*lists.columns, F.col("block").alias("other"), F.col("other").alias("block"))
    out = []
    for x, y, on in ((few, few, ["key"]), (dealt, turned, ["key", "block", "other"])):
        same = reduce(lambda a, b: a & b, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in on])
        out.append(x.alias("x").join(y.alias("y").hint("merge"), same & (F.col("x.comp") != F.col("y.comp")) & where, how))
    return out


def close_members(lists: DataFrame) -> DataFrame:
    """(lk) of the members of lists that another of a different component is close to by its bits."""
    return reduce(DataFrame.unionByName, [x.select("lk") for x in _met(lists, _close("x", "y"), "left_semi")])


def sketches(texts: DataFrame) -> DataFrame:
    """(lk, places, size, w0, w1, ...) of lines (lk, line): of their sets of shingles the size, and for each of 64 * WORDS residues of the
    hash the parity of their number. Each shingle that only one of two lines has turns one bit, so sketches never differ in more bits."""
    bit = f"shiftleft(1L, cast(shiftrightunsigned(x, {WORDS.bit_length() - 1}) & 63 as int))"
    words = [F.expr(f"bit_xor(if(x & {WORDS - 1} = {i}, {bit}, 0L))").alias(f"w{i}") for i in range(WORDS)]
    places = F.greatest(F.length("line") - (WIDTH - 1), F.lit(1))
    rows = texts.select("lk", places.alias("places"), F.explode(shingle_set(F.col("line"))).alias("x"))
    return rows.groupBy("lk", "places").agg(F.count("*").alias("size"), *words)


def _may_be_similar(x: str, y: str) -> Column:
    """False only of lines that aren't similar: sets of Jaccard SIMILARITY differ in (1 - SIMILARITY) / (1 + SIMILARITY) of their sizes at most."""
    n, m = F.col(f"{x}.places"), F.col(f"{y}.places")
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"{x}.w{i}").bitwiseXOR(F.col(f"{y}.w{i}"))) for i in range(WORDS)])
    most = (1 - SIMILARITY) / (1 + SIMILARITY) * (F.col(f"{x}.size") + F.col(f"{y}.size"))
    return (F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & (differ <= most + 1e-6)


def sketched(lists: DataFrame, lines: DataFrame) -> DataFrame:
    """The members of lists that are in lines (lk, line), with their sketches, stored."""
    made = stash(sketches(lines))
    out = stash(lists.join(made, "lk"))
    drop_stash(made)
    return out


def pivot_pairs(lists: DataFrame, turn: int) -> DataFrame:
    """(lk, rep): the members of sketched lists with PIVOTS of each list, others each turn, if they are of different components and may
    be similar; stored. It makes PIVOTS rows a member and joins most of a large family, whose pairs need not be made then."""
    sketch = ["lk", "comp", "sig", "more", "places", "size", *[f"w{i}" for i in range(WORDS)]]
    pivots = [F.min(F.struct(F.xxhash64("lk", F.lit(turn * PIVOTS + i)).alias("by"), *sketch)) for i in range(PIVOTS)]
    rows = _lists(lists.select("key", *sketch), F.array_distinct(F.transform(F.array(*pivots), lambda p: p.dropFields("by"))).alias("pivots"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), where="lo <> hi")
    met = rows.select(F.struct(*sketch).alias("x"), F.explode("pivots").alias("y")).where((F.col("x.comp") != F.col("y.comp")) & _close("x", "y") & _may_be_similar("x", "y"))
    return stash(met.select(F.least("x.lk", "y.lk").alias("lk"), F.greatest("x.lk", "y.lk").alias("rep")).distinct())


def pairs_across(lists: DataFrame) -> DataFrame:
    """(lk, rep, apart): all pairs of members of one of the sketched lists that are of different components, close by their bits, of which
    apart differ, and may be similar; stored."""
    where = (F.col("x.lk") < F.col("y.lk")) & _close("x", "y") & _may_be_similar("x", "y")
    pairs = [met.select(F.col("x.lk").alias("lk"), F.col("y.lk").alias("rep"), _apart("x", "y").alias("apart")) for met in _met(lists, where)]
    return stash(pairs[0].unionByName(pairs[1]).distinct())


def _comps(links: DataFrame) -> DataFrame:
    """(lk, comp) of linked lines, stored."""
    return stash(components(links.select(F.col("lk").alias("a"), F.col("rep").alias("b"))).withColumnRenamed("node", "lk"))


def links_across(pairs: DataFrame, links: list[DataFrame], docs: DataFrame) -> list[DataFrame]:
    """links with those among pairs (lk, rep, apart) that are similar and whose lines are of different components when their round comes;
    each stored. pairs is deleted."""
    links, done = list(links), False
    while not done:
        # the closest, whole steps of apart as long as a round holds them; of a step that no round holds an even share
        sizes, total, upto, share = sorted((r[0], r[1]) for r in pairs.groupBy("apart").count().collect()), 0, -1, 1
        for apart, n in sizes:
            if total and total + n > ROUND:
                break
            upto, total = apart, total + n
            share = -(-n // ROUND)
        if not total:
            break
        mine = F.expr(f"apart <= {upto} and pmod(xxhash64(lk, rep), {share}) = 0")
        links.append(verified(pairs.where(mine).select("lk", "rep").distinct(), docs))
        done = upto == sizes[-1][0] and share == 1
        if not done:
            comps = _comps(reduce(DataFrame.unionByName, links))
            left = _tagged(pairs.where(~mine), comps)
            left = left.join(comps.select(F.col("lk").alias("rep"), F.col("comp").alias("other")), "rep", "left")
            rest = stash(left.where(F.col("comp") != F.coalesce("other", "rep")).select("lk", "rep", "apart"))
            drop_stash(comps)
            drop_stash(pairs)
            pairs = rest
    drop_stash(pairs)
    return links


def similar_links(docs: DataFrame) -> DataFrame:
    """(a, b) of links between distinct lines; their components are those of all similar pairs that share a key."""
    signed = stash(signatures(distinct_lines(docs)))
    members = members_of(signed)
    drop_stash(signed)
    first = first_pairs(members)
    found = [verified(first, docs)]
    drop_stash(first)
    comps = _comps(found[0])
    lists = unsettled(members, comps)
    for t in (comps, *members):
        drop_stash(t)
    lines = _texts(docs, close_members(lists))
    rows = sketched(lists, lines)
    drop_stash(lists)
    for turn in range(TURNS):
        pairs = pivot_pairs(rows, turn)
        found.append(verified(pairs, lines))
        comps = _comps(reduce(DataFrame.unionByName, found))
        tagged = stash(_tagged(rows.drop("comp"), small(comps, BROADCAST // 4)))
        for t in (pairs, comps, rows):
            drop_stash(t)
        rows = tagged
    pairs = pairs_across(rows)
    drop_stash(rows)
    found = links_across(pairs, found, lines)
    drop_stash(lines)
    return reduce(DataFrame.unionByName, found).select(F.col("lk").alias("a"), F.col("rep").alias("b"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(id0, hash, removed): the sorted numbers of the lines to remove, of each document that loses any."""
    whole = stash(occurrences(docs))
    rows = whole.select("lk", F.struct("no_id", "id0", "hash", "line_no").alias("rank"))
    firsts = stash(rows.groupBy("lk").agg(F.min("rank").alias("first"), F.count("*").alias("n")))
    comps = stash(components(similar_links(docs)))
    member = comps.join(firsts, comps.node == firsts.lk).select("lk", "comp", "first", "n")
    kept = member.groupBy("comp").agg(F.min("first").alias("keep"))
    fuzzy = member.join(kept, "comp").select("lk", "keep", "n")
    exact = firsts.where("n > 1").join(comps, firsts.lk == comps.node, "left_anti").select("lk", F.col("first").alias("keep"), "n")
    keep = stash(fuzzy.unionByName(exact))
    gone = lookup(rows, keep, "lk", "n").where("rank <> keep")
    out = stash(gone.groupBy("rank.id0", "rank.hash").agg(F.sort_array(F.collect_set("rank.line_no")).alias("removed")))
    for t in (whole, firsts, comps, keep):
        drop_stash(t)
    return out


def mark_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, removed) of every row of docs."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("id0"), text_hash().alias("hash"),
        F.coalesce(F.size(F.split(F.col("text").cast("string"), "\n")), F.lit(0)).cast("long").alias("n_lines"),
    )
    none = F.array().cast("array<int>")
    return rows.join(removed_lines(docs), ["id0", "hash"], "left").select("doc_id", "n_lines", F.coalesce("removed", none).alias("removed"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs, with the texts rid of their removed lines."""
    rows, names = named(docs)
    out = rows.join(removed_lines(docs), ["id0", "hash"], "left")
    text = F.col(names["text"]).cast("string")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    out = out.withColumn(names["text"], F.when(F.col("removed").isNull(), text).otherwise(left))
    return unnamed(out, docs)
