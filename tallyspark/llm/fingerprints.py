"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests; DataFrame functions only.

A text is cut into paragraphs at line breaks and after sentence ends; the set of their 60-bit digests goes into cells that
hold a count, the XOR of digests and the XOR of check values. The cells lie in groups of ``ROWS`` rows of ``WIDTH`` cells; some
bits of a digest name its group, others its cell in each row. A fingerprint has a power of two of groups, one for up to eight
paragraphs, so it grows with the text, and folds to fewer groups as cells are added up.

Two fingerprints are folded to the fewer groups of the two and subtracted cell by cell: equal paragraphs cancel, and peeling of
cells with one digest recovers the paragraphs that differ. Where that gets stuck, both sets are sketched again with two
groups for each digest and other bits, then with sixteen times as many, and so on. Cells are sums and XORs by row id and group, so nothing
but digests is shuffled and a long text is no more work than as many short ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import pick, shuffle_parts, stage

ROWS = 3
WIDTH = 4
GROUP_BIT = 27
LOAD = 8
CHECK = 2_147_483_629
PRIME = 2_147_483_647
SLOTS = 1 << 16
MAX_ROUNDS = 8
FOUND = "array<struct<d: bigint, s: bigint>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: a lambda variable, as SQL has no other local names."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scramble(digest: Column, turn: int) -> Column:
    """The digest itself in the first round, other uniform bits of it in later ones."""
    if not turn:
        return digest
    low, high = digest % PRIME * (48_271 + 2 * turn) % PRIME, digest % CHECK * (69_621 + 2 * turn) % CHECK
    return F.shiftleft(low, 29).bitwiseXOR(high)


def _place(bits: Column, row: int) -> Column:
    return F.shiftright(bits, 2 * row).bitwiseAND(WIDTH - 1)


def check_value(digest: Column) -> Column:
    return F.shiftleft(digest % CHECK, 29).bitwiseXOR(digest % PRIME)


def _power_of_two(at_least: Column) -> Column:
    """The smallest power of two that is not below ``at_least``, 1 at least."""
    return F.when(at_least <= 1, F.lit(1).cast("long")).otherwise(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(at_least.cast("long") - 1))))


def groups_of(n: Column) -> Column:
    """Groups of the fingerprint of ``n`` digests."""
    return _power_of_two(F.ceil(n / LOAD))


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text: the first 60 bits of their MD5."""
    parts = F.split(F.regexp_replace(text, r"([.!?]) +", "$1\n"), "\n")
    own = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.conv(F.substring(F.md5(p.cast("binary")), 1, 15), 16, 10).cast("long"))
    return F.array_distinct(own)


def sketch_text(digests: Column) -> Column:
    """The fingerprint of a set of digests as text: its cells, group after group and row after row, joined by ``|``; a cell is
    its count, XOR and check XOR, an empty one nothing."""
    zero = F.lit(0).cast("long")

    def cell(own: Column) -> Column:
        start = F.struct(zero.alias("n"), zero.alias("x"), zero.alias("y"))
        full = F.aggregate(own, start, lambda a, d: F.struct((a.n + 1).alias("n"), a.x.bitwiseXOR(d).alias("x"),
                                                             a.y.bitwiseXOR(check_value(d)).alias("y")))
        return _let(full, lambda c: F.when(c.n == 0, "").otherwise(F.concat_ws(".", c.n, F.lower(F.hex(c.x)), F.lower(F.hex(c.y)))))

    def group(own: Column) -> Column:
        def row(j: int) -> Column:
            return F.transform(F.sequence(zero, F.lit(WIDTH - 1).cast("long")), lambda c: cell(F.filter(own, lambda d: _place(d, j) == c)))

        return F.array_join(F.concat(*map(row, range(ROWS))), "|")

    groups = groups_of(F.size(digests))
    return _let(digests, lambda every: _let(groups, lambda g: F.array_join(F.transform(_split(every, g), group), "|")))


def _split(every: Column, groups: Column) -> Column:
    """Digests by group, as an array of arrays; in two steps, so that a long text takes its length to the power 1.5."""
    zero = F.lit(0).cast("long")

    def group(d: Column) -> Column:
        return F.shiftright(d, GROUP_BIT) % groups

    def two_steps(fine: Column) -> Column:
        # ``fine`` neighbouring groups at a time; both are powers of two
        return F.flatten(F.transform(F.sequence(zero, F.try_divide(groups, fine).cast("long") - 1), lambda c: _let(
            F.filter(every, lambda d: F.floor(group(d) / fine) == c), lambda part: F.transform(
                F.sequence(zero, fine - 1), lambda k: F.filter(part, lambda d: group(d) == c * fine + k)))))

    half = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.length(F.bin(groups)) / 2).cast("int"))
    return _let(F.least(half, groups), two_steps)


def _names() -> list[tuple[str, int, int]]:
    return [(f"{j}{c}", j, c) for j in range(ROWS) for c in range(WIDTH)]


def _cells(items: DataFrame, keys: Sequence[str], groups: Column, sign: Column, turn: int) -> DataFrame:
    """The cells of every group of the digests ``d``, one row a group: columns n, x and y of each cell."""
    bits = items.withColumn("bits", _scramble(F.col("d"), turn)).withColumn("check", check_value(F.col("d")))
    bits = bits.withColumn("grp", F.shiftright("bits", GROUP_BIT) % groups).withColumn("sign", sign.cast("long"))
    zero, sums = F.lit(0).cast("long"), []
    for name, j, c in _names():
        here = _place(F.col("bits"), j) == c
        sums += [F.sum(F.when(here, F.col("sign")).otherwise(zero)).alias(f"n{name}"),
                 F.bit_xor(F.when(here, F.col("d")).otherwise(zero)).alias(f"x{name}"),
                 F.bit_xor(F.when(here, F.col("check")).otherwise(zero)).alias(f"y{name}")]
    return bits.groupBy(*keys, "grp").agg(*sums)


def _peel(cells: Column, turn: int) -> Column:
    """Peels the cells of one group: the digests recovered with their signs, or null where cells stay."""

    def step(state: Column, _: Column) -> Column:
        pure = F.filter(state.cells, lambda c: (F.abs(c.n) == 1) & (check_value(c.x) == c.y))

        def less(one: Column) -> Column:
            bits = _scramble(one.x, turn)
            places = F.array(*((_place(bits, j) + j * WIDTH).cast("int") for j in range(ROWS)))
            return _let(places, lambda at: F.transform(state.cells, lambda c, i: F.when(F.array_contains(at, i), F.struct(
                (c.n - one.n).alias("n"), c.x.bitwiseXOR(one.x).alias("x"), c.y.bitwiseXOR(one.y).alias("y"))).otherwise(c)))

        # One pure cell at a time.
        after = F.transform(F.slice(pure, 1, 1), lambda one: F.struct(
            less(one).alias("cells"), F.concat(state.found, F.array(F.struct(one.x.alias("d"), one.n.alias("s")))).alias("found"),
            F.lit(True).alias("going")))
        stuck = F.struct(state.cells.alias("cells"), state.found.alias("found"), F.lit(False).alias("going"))
        return F.when(state.going, F.coalesce(F.get(after, F.lit(0)), stuck)).otherwise(state)

    start = F.struct(cells.alias("cells"), F.array().cast(FOUND).alias("found"), F.lit(True).alias("going"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROWS * WIDTH)), start, step, lambda s: F.when(
        ~F.exists(s.cells, lambda c: (c.n != 0) | (c.x != 0) | (c.y != 0)), s.found))


def _recovered(turn: int) -> Column:
    """The digests of the difference in one group. A row of cells with one digest at most in each names them all, so only
    groups without such a row are peeled step by step."""
    def pure(name: str) -> Column:
        n, x, y = (F.col(f"{k}{name}") for k in "nxy")
        return ((n == 0) & (x == 0) & (y == 0)) | ((F.abs(n) == 1) & (check_value(x) == y))

    def cell(name: str) -> Column:
        return F.struct(F.col(f"x{name}").alias("d"), F.col(f"n{name}").alias("s"))

    whole = F.array(*(F.struct(*(F.col(f"{k}{name}").alias(k) for k in "nxy")) for name, _, _ in _names()))
    out = _peel(whole, turn)
    for j in reversed(range(ROWS)):
        row = [name for name, r, _ in _names() if r == j]
        clear = pure(row[0])
        for name in row[1:]:
            clear = clear & pure(name)
        out = F.when(clear, F.filter(F.array(*map(cell, row)), lambda c: c.s != 0)).otherwise(out)
    return out


def _stored_difference(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The cells of the difference of the fingerprints of each pair, folded to the fewer groups of the two."""
    sets = sorted({c for pair in pairs for c in pair})
    sizes = [groups_of(F.size(c)).alias(f"g_{c}") for c in sets]
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("ds")) for i, c in enumerate(sets)))
    items = rows.select("rid", *sets).repartition("rid").select("rid", *sizes, F.inline(sides))
    keys = ["rid", "side", *(f"g_{c}" for c in sets)]
    items = items.select(*keys, F.explode("ds").alias("d"))
    own = F.col(f"g_{sets[-1]}")
    for i, c in enumerate(sets[:-1]):
        own = F.when(F.col("side") == i, F.col(f"g_{c}")).otherwise(own)
    stored = _cells(items, keys, own, F.lit(1), 0)
    uses = F.array(*(F.struct(F.lit(p).alias("pair"), F.lit(sets.index(c)).alias("of"), F.lit(s).cast("long").alias("sign"),
                              F.least(*(F.col(f"g_{o}") for o in pair)).alias("folded"))
                     for p, pair in enumerate(pairs) for c, s in zip(pair, (1, -1))))
    used = stored.select("*", F.inline(uses)).where("side = of").withColumn("grp", F.expr("grp % folded"))
    sums = [out for name, _, _ in _names() for out in (
        F.sum(F.col(f"n{name}") * F.col("sign")).alias(f"n{name}"), F.bit_xor(f"x{name}").alias(f"x{name}"), F.bit_xor(f"y{name}").alias(f"y{name}"))]
    return used.groupBy("rid", "pair", "grp").agg(*sums)


def _larger_difference(rows: DataFrame, stuck: DataFrame, pairs: Sequence[tuple[str, str]], turn: int) -> DataFrame:
    """The cells of the difference of larger sketches of the stuck pairs, two groups for each digest or 32, 512, ... of them."""
    open_ = rows.join(stuck.select("rid", "pair"), "rid")

    def chosen(side: int) -> Column:
        out = F.col(pairs[-1][side])
        for p, pair in enumerate(pairs[:-1]):
            out = F.when(F.col("pair") == p, F.col(pair[side])).otherwise(out)
        return out

    sides = F.array(F.struct(F.lit(1).alias("s"), chosen(0).alias("ds")), F.struct(F.lit(-1).alias("s"), chosen(1).alias("ds")))
    groups = (_power_of_two(F.size(chosen(0)) + F.size(chosen(1))) * (2 * 16 ** (turn - 1))).alias("groups")
    items = open_.select("rid", "pair", groups, F.inline(sides)).select("rid", "pair", "groups", "s", F.explode("ds").alias("d"))
    return _cells(items, ["rid", "pair"], F.col("groups"), F.col("s"), turn)


def differences(rows: DataFrame, pairs: Sequence[tuple[str, str]], digests: bool = False) -> DataFrame:
    """What differs between the digest sets of each row: (rid, pair, found), ``pair`` the number in ``pairs``, two columns each.

    ``found`` counts the digests in one of the two sets only; with ``digests`` two more columns hold them, ``ours`` those of the
    first set and ``theirs`` those of the second. ``rid`` names a row and must not repeat; two empty sets give no row. The pairs
    that get stuck are sketched again, larger each time.
    """
    done, cells = None, _stored_difference(rows, pairs)
    for turn in range(MAX_ROUNDS):
        groups = cells.select("rid", "pair", _recovered(turn).alias("got"))
        sums = [F.sum(F.size("got")).alias("found"), F.bool_and(F.col("got").isNotNull()).alias("whole")]
        more = [F.flatten(F.collect_list("got")).alias("got")] if digests else []
        result = stage(groups.groupBy("rid", "pair").agg(*sums, *more), "differences")
        part = result.where("whole")
        done = part if done is None else done.unionByName(part)
        stuck = result.where("not whole")
        if stuck.isEmpty():
            break
        cells = _larger_difference(rows, stuck, pairs, turn + 1)
    else:
        raise RuntimeError(f"sketches did not peel in {MAX_ROUNDS} rounds")
    if not digests:
        return done.select("rid", "pair", "found")

    def side(sign: int) -> Column:
        return F.transform(F.filter("got", lambda c: c.s == sign), lambda c: c.d)

    return done.select("rid", "pair", "found", side(1).alias("ours"), side(-1).alias("theirs"))


def likeness(ours: Column, theirs: Column, difference: Column) -> Column:
    """Jaccard similarity of two sets from their sizes and the size of their difference; of two empty sets 1."""
    both = (ours + theirs).cast("double")
    return F.when(both == 0, F.lit(1.0)).otherwise((both - difference) / (both + difference))


def with_next_text(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, next_text): the text that follows by ascending doc_id, after the last one the first.

    Rows are dealt to ranges of ids of about equal bytes, eight for each shuffle partition; the first row of the following range joins each as a
    guest. Null ids come first; rows of one id are ordered by text. Texts are shuffled once.
    """
    spark = docs.sparkSession
    src = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low, high = src.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low if low is not None else 0, high if high is not None else 0
    width = F.lit(max(1.0, (float(high) - float(low) + 1) / (SLOTS - 1)))
    slot = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(float(low))) / width).cast("int") + 1, F.lit(0))
    src = src.withColumn("slot", slot).withColumn("rank", F.coalesce("doc_id", F.lit(-2**63)))
    # At most SLOTS + 1 rows: bytes and first id of each slot of the id range.
    sizes = src.groupBy("slot").agg(F.sum(F.octet_length("text") + 16).alias("bytes"), F.min("rank").alias("first"))
    sizes = stage(sizes.coalesce(1), "sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    target = max(1 << 16, total // (8 * shuffle_parts(spark)))
    every = Window.partitionBy(F.lit(0))
    before = F.sum("bytes").over(every.orderBy("slot")) - F.col("bytes")
    ranges = sizes.select("slot", "first", F.floor(before / F.lit(target)).alias("raw"))
    ranges = ranges.select("slot", "first", (F.dense_rank().over(every.orderBy("raw")) - 1).cast("long").alias("bucket"))
    ranges = stage(ranges.select("slot", "bucket", F.min("first").over(Window.partitionBy("bucket")).alias("first")), "ranges")
    count = (ranges.agg(F.max("bucket")).first()[0] or 0) + 1
    rows = src.join(F.broadcast(ranges), "slot")
    heads = rows.where(F.col("rank") == F.col("first")).groupBy("bucket").agg(F.min("text").alias("text"))
    guests = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.pmod(F.col("bucket") - 1, F.lit(count)).alias("bucket"),
                          F.lit(1).alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    both = rows.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).unionByName(guests)
    both = both.withColumn("next_text", F.lead("text").over(order))
    return both.where("guest = 0").select("doc_id", "text", "next_text")


def paragraph_sets(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, n_chars, edited_sha256, own, changed, following): the digest sets of every text, of its edited text and of
    the text that follows, written to the shared folder."""
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = with_next_text(docs).withColumn("edited", edited).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), paragraph_digests(F.col("text")).alias("own"),
        paragraph_digests(F.col("edited")).alias("changed"), paragraph_digests(F.col("next_text")).alias("following"))
    return stage(rows, "paragraphs", "none")  # digests do not shrink


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Returns (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). In the edited text the
    last quarter is replaced by as many characters from the start of the following document. A null text counts as empty;
    two empty texts are alike by 1. Rows of one id are ordered by text; repeated rows come out repeated, an empty table gives
    no row. Texts are read whole, whatever their length; further columns do not matter.
    """
    rows = paragraph_sets(docs)
    found = differences(rows, (("own", "changed"), ("own", "following")))
    wide = found.groupBy("rid").agg(*(F.max(F.when(F.col("pair") == p, F.col("found"))).alias(f"to_{p}") for p in range(2)))
    rows = rows.join(wide, "rid", "left")

    def near(other: str, pair: int) -> Column:
        return likeness(F.size("own"), F.size(other), F.coalesce(F.col(f"to_{pair}"), F.lit(0)))

    return rows.select("doc_id", "n_chars", "edited_sha256", sketch_text(F.col("own")).alias("fingerprint"),
                       sketch_text(F.col("changed")).alias("edited_fingerprint"), near("changed", 0).alias("near_edited"),
                       near("following", 1).alias("near_next"))
